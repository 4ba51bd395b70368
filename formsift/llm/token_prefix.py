"""Token counts by prefix dynamic programming.

For a byte-pair vocabulary the last token of a prefix is unique: it is the one token that ends
there and may follow the last token of the prefix before it. So one pass over a text gives the
exact token count of every prefix. Stored as differences, one byte per character, these counts
answer truncation and budget questions without encoding again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Memos hold this many entries at most, so a worker's memory stays bounded; longer words are not remembered.
MOST_WORDS, MOST_PAIRS, LONGEST_WORD = 300_000, 600_000, 48
#: Characters of text whose new words are worked out together.
GATHER = 2_000_000
SPACE_MARK = "▁"


class PrefixCounter:
    """Token counts of all prefixes under a sentencepiece byte-pair model.

    The model must leave text as it is, but for white space marks and the mark put before a text.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (
            sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.tokens = {sp.id_to_piece(i) for i in plain}
        if any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece in self.tokens):
            raise ValueError("pieces must not go across words")
        self.byte_fallback = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        # Behind a character of no piece a string is encoded as if the mark before a text weren't there.
        self.barrier = next(c for c in "\n\t\r\x00\x01\x7f" if not any(c in piece for piece in self.tokens))
        self.skip = len(sp.encode_as_pieces(self.barrier))
        self.encode = sp.encode_as_pieces
        self.units = re.compile(self.unit_pattern())
        # Every end of a token, and whether it is one itself.
        self.ends = {piece[n:]: False for piece in self.tokens for n in range(1, len(piece))}
        self.ends |= dict.fromkeys(self.tokens, True)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.follows: dict[str, dict[str, bool]] = {}
        self.pairs = 0

    def unit_pattern(self) -> str:
        """Cuts a text where no token can go across: before white space, around line breaks that
        no piece has, and between a letter or digit and a mark, where no piece has the two."""
        before: dict[str, set[str]] = {}
        for piece in self.tokens:
            for x, y in zip(piece, piece[1:]):
                before.setdefault(y, set()).add(x)
        chars = {c for piece in self.tokens for c in piece}
        marks = {c for c in chars if not c.isalnum() and c != SPACE_MARK and not c.isspace()}
        while bound := {m for m in marks if before.get(m, set()) - marks - {SPACE_MARK}}:
            marks -= bound
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in chars)
        m = "".join(map(re.escape, sorted(marks)))
        word = f"{SPACE_MARK}*[^{SPACE_MARK}{alone}{m}]+"
        marked = f"|{SPACE_MARK}*[{m}]+[^{SPACE_MARK}{alone}{m}]*" if m else ""
        return (f"[{alone}]|" if alone else "") + word + marked + f"|{SPACE_MARK}+"

    def may_follow(self, last: str, token: str) -> bool:
        """Whether ``token`` can come after ``last`` (empty: at the start) in an encoding."""
        pieces = self.encode(self.barrier + last + token)[self.skip:]
        return pieces == ([last, token] if last else [token])

    def resolve(self, units: list[str]) -> dict[str, bytes]:
        """Differences of the token counts along each of some sorted units that no token crosses.

        Each unit goes on where it parts from the one before, so common beginnings are worked
        out once.
        """
        out, before, last, counts = {}, "", [""], [0]
        for unit in units:
            done, most = 0, min(len(unit), len(before))
            while done < most and unit[done] == before[done]:
                done += 1
            del last[done + 1:], counts[done + 1:]
            for end in range(done + 1, len(unit) + 1):
                for start in range(end - 1, -1, -1):
                    token = unit[start:end]
                    whole = self.ends.get(token)
                    if whole is None:
                        start = -1
                        break
                    if whole:
                        known = self.follows.get(last[start])
                        if known is None:
                            known = self.follows[last[start]] = {}
                        fits = known.get(token)
                        if fits is None:
                            fits = known[token] = self.may_follow(last[start], token)
                            self.pairs += 1
                        if fits:
                            break
                else:
                    start = -1
                if start < 0:  # a character of no piece stands alone, and what follows begins anew
                    counts.append(counts[-1] + (len(unit[end - 1].encode("utf-8", "surrogatepass")) if self.byte_fallback else 1))
                    token = ""
                else:
                    counts.append(counts[start] + 1)
                last.append(token)
            out[unit] = bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])
            before = unit
        if self.pairs > MOST_PAIRS:
            self.follows, self.pairs = {}, 0
        return out

    def learn(self, words: list[str]) -> None:
        """Take in the differences along each word with the mark before it."""
        known, cut = self.parts, {w: self.units.findall(SPACE_MARK + w.replace(" ", SPACE_MARK)) for w in words}
        if len(known) > MOST_WORDS:
            known.clear()
        new = sorted(set().union(*cut.values()) - known.keys())
        known.update(self.resolve(new))
        self.words.update((w, known[u[0]] if len(u) == 1 else b"".join([known[x] for x in u])) for w, u in cut.items())
        for u in new:
            if len(u) > LONGEST_WORD:
                del known[u]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Per character of each text, by how much it changes the token count of the prefix."""
        known = self.words
        if len(known) > MOST_WORDS:
            known.clear()
        # With runs of spaces or marks of its own a text is cut as a whole; else each word has one mark before it.
        whole = lambda t: t[:1] == " " or t[-1:] == " " or "  " in t or SPACE_MARK in t
        cut = [[t] if whole(t) else t.split(" ") for t in texts]
        new = list(set().union(*cut) - known.keys() - {""})
        if new:
            self.learn(new)
        out = []
        for text, words in zip(texts, cut):
            if not text:
                out.append(np.zeros(0, np.int8))
                continue
            steps = np.frombuffer(b"".join(map(known.__getitem__, words)), np.int8).copy()
            steps[1] += steps[0]  # the mark before the text comes with its first character
            out.append(steps[1:])
        for w in new:
            if len(w) > LONGEST_WORD:
                del known[w]
        return out

    def differences(self, text: str) -> np.ndarray:
        return self.many([text])[0]


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def gathered(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in lists of about ``GATHER`` characters, null as empty."""
    some, chars = [], 0
    for text in texts:
        some.append(text or "")
        chars += len(some[-1])
        if chars >= GATHER:
            yield some
            some, chars = [], 0
    yield some


def longest_within(steps: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_table(docs: DataFrame, model_path: str, limit: int, keep_steps: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, limit_chars`` and ``steps`` of every document.

    ``steps`` is the stored prefix array: one signed byte per character, whose running sum is the
    exact token count of every prefix; leave it out where only its answers are wanted.
    ``limit_chars`` is the length of the longest prefix of at most ``limit`` tokens. Null text
    counts as empty: no bytes, no tokens. Texts are read whole, however long. Repeated rows and
    null identifiers are kept as they are; columns other than ``doc_id`` and ``text`` are not
    looked at. An empty table gives an empty one. The path must exist on every executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(model_path)
        for batch in batches:
            steps = [d for texts in gathered(batch.column("text").to_pylist()) for d in prefixes.many(texts)]
            totals = [int(s.sum(dtype=np.int64)) for s in steps]
            columns = [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64()),
                pa.array([n > limit for n in totals], pa.bool_()),
                pa.array([longest_within(s, limit) for s in steps], pa.int64()),
            ]
            if keep_steps:
                columns.append(pa.array([s.tobytes() for s in steps], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(
        F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long" + ", steps binary" * keep_steps
    names = [c.split()[0] for c in schema.split(", ")]
    return text.mapInArrow(count, schema)
