"""Best-fit packing of token sequences by minimum bin slack.

Documents become pieces of at most the capacity. Per bin, a subset-sum over the lengths still
there, kept as the bits of one integer, finds the fullest combination that holds the longest
piece left; it is taken out, as many times at once as the stock allows. Only the number of pieces
of each length matters for that, so the driver sees a histogram with one row per length, and
the plan that comes back gives every piece its sequence by its rank among those of its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formsift.llm.common import even_place, running_totals, settled

#: Memos hold this many entries at most, so a worker's memory stays bounded.
MOST_WORDS, LONGEST_WORD = 300_000, 48
#: Characters of text whose new words are encoded together.
GATHER = 2_000_000
#: Words of these characters alone are cut at the borders of letters, digits and marks as the
#: tokenizer cuts them; no apostrophe, for the contractions, and no special token among them.
PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9 \n]+")
#: Texts of such words alone are cut into runs at once.
PLAIN_TEXT = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ \n]*")


class WordEncoder:
    """Token ids of texts, word by word.

    For vocabularies whose tokens never go across white space and whose normal form works
    character by character, so that the ids of a text are those of its words in a row.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        batch = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in batch]

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs that are one word each to the tokenizer: a line of many, cut at word ends."""
        lines = [" ".join(runs[k:k + 500]) for k in range(0, len(runs), 500)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(ends) != len(runs):
            raise ValueError("a run is not one word")
        data = ids.tobytes()
        return [data[4 * a:4 * b] for a, b in zip([0, *ends], ends)]

    def learn(self, words: list[str]) -> None:
        """Take in the ids of words, from those of their runs of letters, digits or marks where that
        is exact."""
        whole, cut = [], {}
        for w in words:
            if w.isascii() and w.isalpha():
                cut[w] = (w.lower(),)
            elif PLAIN.fullmatch(w):
                cut[w] = RUNS.findall(w.lower())
            else:
                whole.append(w)
        runs = set().union(*cut.values())
        new = self.learn_runs(runs)
        known = self.runs
        if whole:
            self.words.update(zip(whole, self.encode(whole)))
        self.words.update((w, known[r[0]] if len(r) == 1 else b"".join([known[x] for x in r])) for w, r in cut.items())
        self.forget(new)

    def learn_runs(self, runs: set[str]) -> list[str]:
        """Take in the ids of runs; of those known before, a full memo keeps the ones asked for."""
        known = self.runs
        new = list(runs - known.keys())
        if len(known) + len(new) > MOST_WORDS:
            known = self.runs = {r: known[r] for r in runs & known.keys()}
        if new:
            known.update(zip(new, self.encode_runs(new)))
        return new

    def forget(self, runs: list[str]) -> None:
        """Long runs are not remembered."""
        for r in runs:
            if len(r) > LONGEST_WORD:
                del self.runs[r]

    def many_plain(self, texts: list[str]) -> list[bytes]:
        cut = [RUNS.findall(t.lower()) for t in texts]
        new = self.learn_runs(set().union(*cut))
        known = self.runs
        out = [b"".join(map(known.__getitem__, runs)) for runs in cut]
        self.forget(new)
        return out

    def many_by_words(self, texts: list[str]) -> list[bytes]:
        known = self.words
        if len(known) > MOST_WORDS:
            known.clear()
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*cut) - known.keys())
        if new:
            self.learn(new)
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for w in new:
            if len(w) > LONGEST_WORD:
                del known[w]
        return out

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, 4 bytes each, little-endian."""
        plain = [bool(PLAIN_TEXT.fullmatch(t)) for t in texts]
        done = {True: iter(self.many_plain([t for t, p in zip(texts, plain) if p])),
                False: iter(self.many_by_words([t for t, p in zip(texts, plain) if not p]))}
        return [next(done[p]) for p in plain]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def gathered(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows of (identifier, text) in lists of about ``GATHER`` characters, null text as empty."""
    some, chars = [], 0
    for key, text in rows:
        some.append((key, text or ""))
        chars += len(some[-1][1])
        if chars >= GATHER:
            yield some
            some, chars = [], 0
    yield some


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if wanted, ``ids`` of every piece.

    A document's ids end with ``end_id``; null text counts as empty. Only documents of more than
    ``capacity`` ids are cut.
    """
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
            for some in gathered(rows):
                out = []
                for (doc_id, _), ids in zip(some, encode.many([t for _, t in some])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), step)):
                        part = ids[at:at + step]
                        out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[:len(names)])
                columns = zip(*out) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(cut, schema)


def fullest(stock: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many pieces of each length fill ``room`` best, out of a stock.

    Bit ``s`` of ``reach`` says that a sum ``s`` can be made. ``lengths`` is in falling order.
    """
    reach, steps, goal = 1, [], 1 << room
    mask = (goal << 1) - 1
    for length in lengths:
        if length > room:
            continue
        most = min(stock[length], room // length)
        if not most:
            continue
        steps.append((length, most, reach))
        step = 1
        while most:  # copies in powers of two make every number of them
            take = min(step, most)
            reach |= (reach << (take * length)) & mask
            most -= take
            step *= 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        copies = next(c for c in range(most + 1) if total >= c * length and before >> (total - c * length) & 1)
        if copies:
            chosen[length] = copies
            total -= copies * length
    return chosen


def bin_plan(stock: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, each with the number of bins that it fills; uses up the stock."""
    stock, plan = {n: c for n, c in stock.items() if c}, []
    while stock:
        lengths = sorted(stock, reverse=True)
        longest = lengths[0]
        stock[longest] -= 1
        chosen = fullest(stock, lengths, capacity - longest)
        stock[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(stock[n] // c for n, c in chosen.items())
        for n, c in chosen.items():
            stock[n] -= c * times
            if not stock[n]:
                del stock[n]
        plan.append((chosen, times))
    return plan


#: Ranks of one length per key of the join with the plan.
STRETCH = 1024


def plan_rows(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, copies in a sequence, offset)."""
    rows, used, sequence = [], {}, 0
    for chosen, times in plan:
        offset = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            first = used.get(length, 0)
            used[length] = first + copies * times
            rows.append((length, first, used[length], sequence, copies, offset))
            offset += length * copies
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """Every piece of every document with its place: ``sequence_id`` and ``offset`` in it.

    Adds both to the columns of ``token_pieces``. A document within the capacity is one piece; null
    and empty texts are one piece with the end alone; very long texts are cut, never shortened.
    Repeated rows are packed each; null identifiers are kept. Pieces of one length that tie in
    the hash that ranks them go by document and piece. Columns other than ``doc_id`` and
    ``text`` are not looked at. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    pieces = settled(token_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces")
    # At most one row for each length up to the capacity.
    stock = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan_rows(bin_plan(stock, capacity))
    names = ("length", "first", "end", "first_sequence", "copies", "first_offset")
    plan = spark.createDataFrame(rows, T.StructType([T.StructField(n, T.LongType()) for n in names]))
    stretches = F.sequence(F.floor(F.col("first") / STRETCH), F.floor((F.col("end") - 1) / STRETCH))
    plan = plan.select("*", F.explode(stretches).alias("stretch"))
    keyed = pieces.drop("ids").withColumns({
        "place": even_place(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_id", "piece", "ids_crc32")]), "one": F.lit(1)})
    ranked = running_totals(keyed, ["length"], "place", ["doc_id", "piece", "ids_crc32"], "one", "rank")
    ranked = ranked.withColumn("stretch", F.floor(F.col("rank") / STRETCH)).drop("place", "one")
    placed = ranked.join(plan, ["length", "stretch"]).filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    turn = F.col("rank") - F.col("first")
    placed = placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(turn / F.col("copies"))).alias("sequence_id"),
        (F.col("first_offset") + turn % F.col("copies") * F.col("length")).alias("offset"))
    if not keep_ids:
        return placed
    same = [F.struct("doc_id", "piece", "ids_crc32").alias("_key")]
    ids = pieces.select(*same, "ids").groupBy("_key").agg(F.first("ids").alias("ids"))
    return placed.select("*", *same).join(ids, "_key").drop("_key")
