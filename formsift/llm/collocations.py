"""Phrase collocations, counted with an FM-index over word identifiers per shard.

Words of one language are gathered into shards. A shard's bidirectional index is a pair of
Burrows-Wheeler transforms, of its words and of its words reversed, sorted as deep as the longest
phrase needs. Extending all intervals of one level by one word, to the left or to the right, gives
all longer phrases with their counts at once. Counts are summed across shards; a phrase is only
extended in a shard if it is frequent in the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formsift.llm.common import LOWER, UPPER, settled

#: A shard is closed at the first end of a piece after this many words.
SHARD_WORDS = 1_000_000
#: Bytes of text that are split into words at once, and rows of a result batch.
SPLIT_BYTES, BATCH_ROWS = 1 << 20, 1 << 16
#: Fixed values of the operator's contract: separators of pieces and of words.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
FOLD = bytes.maketrans(
    PIECE_ENDS + WORD_ENDS + UPPER.encode(), b"\n" * len(PIECE_ENDS) + b" " * len(WORD_ENDS) + LOWER.encode())
NO_WORD, SEPARATOR = -1, 0


class WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) - 1
        return number


class Gathered:
    """Word identifiers of one language until a shard is full; pieces end with ``SEPARATOR``."""

    def __init__(self) -> None:
        self.ids = WordIds({b"": NO_WORD, b"\n": SEPARATOR})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, folded: bytes) -> None:
        words = folded.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        self.parts.append(ids[ids != NO_WORD])
        self.size += len(self.parts[-1])

    def text(self) -> np.ndarray:
        """All identifiers, without repeated separators, and with one at the end."""
        ids = np.concatenate([*self.parts, np.zeros(1, np.int32)])
        return ids[np.append(True, (ids[1:] != SEPARATOR) | (ids[:-1] != SEPARATOR))]

    def vocabulary(self) -> bytes:
        return b"\n".join(list(self.ids)[2:])


def cuts(folded: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text in parts of about ``SPLIT_BYTES`` that end at a space or with a piece (then true)."""
    start = 0
    while len(folded) - start > SPLIT_BYTES:
        ends = [e for e in (folded.find(b" ", start + SPLIT_BYTES), folded.find(b"\n", start + SPLIT_BYTES)) if e >= 0]
        if not ends:
            break
        end = min(ends) + 1
        yield folded[start:end], folded[end - 1:end] == b"\n"
        start = end
    yield folded[start:], True


class FmIndex:
    """The transform of a text, its symbol counts, and the step from a row to the row of the symbol before."""

    def __init__(self, bwt: np.ndarray, symbols: int):
        self.bwt, self.symbols = bwt, symbols
        self.first = np.append(0, np.cumsum(np.bincount(bwt, minlength=symbols)))

    @classmethod
    def of(cls, text: np.ndarray, symbols: int, depth: int) -> FmIndex:
        """Rows sorted by their first ``depth - 1`` symbols: enough for counts of ``depth`` words."""
        order = np.arange(len(text))
        for k in reversed(range(0, depth - 1, 2)):
            key = np.roll(text, -k).astype(np.int64)
            if k + 1 < depth - 1:
                key = key * symbols + np.roll(text, -k - 1)
            order = order[np.argsort(key[order], kind="stable")]
        return cls(text[order - 1], symbols)

    @cached_property
    def before(self) -> np.ndarray:
        rows = np.empty(len(self.bwt), np.int64)
        rows[np.argsort(self.bwt, kind="stable")] = np.arange(len(self.bwt))
        return rows

    def extend(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """The words before the rows of disjoint intervals.

        Returns per (interval, word): interval, word, rows, rows of the interval with a smaller
        word, and the first row with this word.
        """
        starts = np.cumsum(size) - size
        parent = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(parent)) + np.repeat(low - starts, size)
        keys = parent * np.int64(self.symbols) + self.bwt[rows]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(keys)))
        parent, word = np.divmod(keys[begin], self.symbols)
        smaller = begin - starts[parent]
        real = word != SEPARATOR
        return parent[real], word[real], count[real], smaller[real], rows[order[begin]][real]


class Phrases:
    """Phrases of one length: their words, counts, and intervals in both transforms.

    An interval's start is worked out only if the phrase is extended on that side.
    """

    def __init__(self, words: np.ndarray, count: np.ndarray, forward, backward):
        self.words, self.count, self._forward, self._backward = words, count, forward, backward

    @cached_property
    def forward(self) -> np.ndarray:
        return self._forward()

    @cached_property
    def backward(self) -> np.ndarray:
        return self._backward()

    def only(self, mask: np.ndarray) -> Phrases:
        return Phrases(self.words[mask], self.count[mask], lambda: self.forward[mask], lambda: self.backward[mask])


class PhraseIndex:
    """Bidirectional index: what comes before in one transform, what follows in the other."""

    def __init__(self, forward: FmIndex, backward: FmIndex):
        self.left, self.right = forward, backward

    @classmethod
    def of(cls, text: np.ndarray, symbols: int, depth: int = 3) -> PhraseIndex:
        return cls(FmIndex.of(text, symbols, depth), FmIndex.of(text[::-1], symbols, depth))

    def words(self) -> Phrases:
        low = self.left.first[1:-1]
        return Phrases(np.arange(1, self.left.symbols)[:, None], np.diff(self.left.first)[1:], lambda: low, lambda: low)

    def extend_left(self, of: Phrases) -> Phrases:
        parent, word, count, smaller, row = self.left.extend(of.forward, of.count)
        return Phrases(np.column_stack([word, of.words[parent]]), count,
                       lambda: self.left.before[row], lambda: of.backward[parent] + smaller)

    def extend_right(self, of: Phrases) -> Phrases:
        parent, word, count, smaller, row = self.right.extend(of.backward, of.count)
        return Phrases(np.column_stack([of.words[parent], word]), count,
                       lambda: of.forward[parent] + smaller, lambda: self.right.before[row])


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i4").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


INDEX = "shard long, lang string, words long, vocabulary binary, forward binary, backward binary"


def build_indexes(docs: DataFrame, shard_words: int) -> DataFrame:
    """One row per shard: language, number of words, vocabulary, both transforms.

    A shard holds words of one language that one task has read; a document may go over several
    shards, cut between pieces. Counts summed over shards do not depend on how texts are dealt.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 24, 0
        open_shards: dict[str, Gathered] = {}
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal made
            shard = open_shards.pop(lang)
            text, symbols = shard.text(), len(shard.ids) - 1
            index = PhraseIndex.of(text, symbols)
            made += 1
            row = [base + made, lang, int((text != SEPARATOR).sum()), shard.vocabulary(), packed(index.left.bwt), packed(index.right.bwt)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        def take(lang: str) -> Iterator[pa.RecordBatch]:
            folded = b"\n".join(waiting.pop(lang)).translate(FOLD) + b"\n"
            del sizes[lang]
            for part, whole in cuts(folded):
                open_shards.setdefault(lang, Gathered()).add(part)
                if whole and open_shards[lang].size >= shard_words:
                    yield close(lang)
            while sum(s.size for s in open_shards.values()) >= 2 * shard_words:
                yield close(max(open_shards, key=lambda x: open_shards[x].size))

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                data = text.as_py()
                waiting.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data) + 1
                if sizes[lang] >= SPLIT_BYTES:
                    yield from take(lang)
        for lang in list(waiting):
            yield from take(lang)
        for lang in list(open_shards):
            yield close(lang)

    names = [c.split()[0] for c in INDEX.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(
        F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return texts.mapInArrow(build, INDEX)


def single_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: each holds a whole shard, and a batch all of a task's."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def index_of(row: dict) -> tuple[PhraseIndex, pa.Array]:
    """A shard's index, and its words by identifier (the separator has none)."""
    words = pa.array([None, *row["vocabulary"].split(b"\n")] if row["words"] else [None], pa.binary())
    forward, backward = (FmIndex(unpacked(row[side]), len(words)) for side in ("forward", "backward"))
    return PhraseIndex(forward, backward), words


def keyed_batches(lang: str, phrases: Phrases, words: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """``language LF words`` and count; no word has a line feed, so the last one ends the language."""
    for at in range(0, len(phrases.count), BATCH_ROWS):
        part = phrases.words[at:at + BATCH_ROWS]
        spoken = [words.take(pa.array(part[:, k])) for k in range(part.shape[1])]
        phrase = spoken[0] if len(spoken) == 1 else pc.binary_join_element_wise(*spoken, b" ")
        key = pc.binary_join_element_wise(pa.scalar(lang.encode()), phrase, b"\n").cast(pa.string())
        yield key, pa.array(phrases.count[at:at + BATCH_ROWS], pa.int64())


def short_phrases(indexes: DataFrame) -> DataFrame:
    """``key, shard, n``: counts of words and of pairs per shard; the key without a word has all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in single_rows(batch):
                index, words = index_of(row)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["lang"] + "\n"]), pa.array([row["shard"]], pa.int64()), pa.array([row["words"]], pa.int64())], names)
                single = index.words()
                for level in (single, index.extend_left(single)):
                    for key, n in keyed_batches(row["lang"], level, words):
                        yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(key), row["shard"])), n], names)

    names = ["key", "shard", "n"]
    return indexes.mapInArrow(count, "key string, shard long, n long")


def phrase_of(key: Column) -> Column:
    return F.substring_index(key, "\n", -1)


def long_phrases(indexes: DataFrame, frequent: DataFrame) -> DataFrame:
    """``key, n``: per shard, counts of triples both of whose pairs are frequent in the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in single_rows(batch):
                index, words = index_of(row)
                number = {w: i for i, w in enumerate(words.to_pylist())}
                symbols = np.int64(len(words))
                wanted = (p.encode().split(b" ") for p in row["pairs"])
                wanted = np.sort(np.array([number[a] * symbols + number[b] for a, b in wanted], np.int64))
                pairs = index.extend_left(index.words())
                pairs = pairs.only(np.isin(pairs.words[:, 0] * symbols + pairs.words[:, 1], wanted))
                triples = index.extend_right(pairs)
                triples = triples.only(np.isin(triples.words[:, 1] * symbols + triples.words[:, 2], wanted))
                for key, n in keyed_batches(row["lang"], triples, words):
                    yield pa.RecordBatch.from_arrays([key, n], ["key", "n"])

    pairs = frequent.select("shard", phrase_of(F.col("key")).alias("pair")).filter("pair like '% %'")
    pairs = pairs.groupBy("shard").agg(F.collect_list("pair").alias("pairs"))
    return indexes.join(pairs, "shard").mapInArrow(count, "key string, n long")


def phrase_counts(docs: DataFrame, least: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, phrase, size, f``: all phrases of up to 3 words with ``f >= least`` in their language.

    The row with the empty phrase and size 0 has the number of all words of the language.
    """
    indexes = settled(build_indexes(docs, shard_words), "phrase-indexes")
    total = F.sum("n").over(Window.partitionBy("key"))
    short = short_phrases(indexes).withColumn("f", total).filter((F.col("f") >= least) | F.col("key").endswith("\n"))
    short = settled(short.drop("n"), "short-phrases")
    triples = long_phrases(indexes, short).groupBy("key").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    counts = short.groupBy("key").agg(F.max("f").alias("f")).unionByName(triples)
    phrase = phrase_of(F.col("key"))
    size = F.when(phrase == "", 0).otherwise(F.regexp_count(phrase, F.lit(" ")) + 1)
    lang = F.expr("left(key, length(key) - length(phrase) - 1)")
    return settled(counts.withColumn("phrase", phrase).select(lang.alias("lang"), "phrase", size.alias("size"), "f"), "phrase-counts")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best collocations of every language.

    Candidates are phrases of 2 or 3 words that occur ``least`` times or more. A cut in two parts
    of ``l`` and ``r`` occurrences scores ``floor(1000000 a a / (l r))``; the lowest-scoring cut
    counts, ties to the shorter first part. Products are decimals of up to 37 digits, exact for
    counts below ``10 ** 15``. A pair goes if a longer candidate around it has half of its
    occurrences or more. Null language counts as ``und``, null text as empty. Repeated rows count
    as often as they are there; rows without words and empty tables give nothing. Columns other than
    ``lang`` and ``text`` are not looked at.
    """
    return ranked(phrase_counts(docs, least, shard_words), top)


def ranked(counts: DataFrame, top: int) -> DataFrame:
    """The collocations from the table of ``phrase_counts``."""
    words = lambda k: F.substring_index("phrase", " ", k)
    cut = lambda k, first, rest: F.struct(F.lit(k).alias("k"), first.alias("first"), rest.alias("rest"))
    found = counts.filter("size >= 2").withColumnRenamed("f", "a")
    parts = F.when(F.col("size") == 2, F.array(cut(1, words(1), words(-1)))).otherwise(
        F.array(cut(1, words(1), words(-2)), cut(2, words(2), words(-1))))
    cuts_ = found.select("lang", "phrase", "size", "a", F.inline(parts))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    scored = cuts_.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    scored = scored.withColumns({
        "over": exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), "under": exact("l") * exact("r")})
    lowest = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(
        F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut"))
    longer = found.filter("size = 3").select("lang", "a", F.explode(F.array(words(2), words(-2))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter("around is null or 100 * around < 50 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= top)  # each task hands on so many of a language
    sizes = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
