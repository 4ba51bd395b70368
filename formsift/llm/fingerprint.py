"""Document fingerprints from prefix polynomial hashes.

Prefix arrays of a text's polynomial hash give the hash of any span in constant time, so spans
can be compared without their characters, and the longest common extension of two positions is
found by binary search. A fingerprint is the hash of the whole text with the smallest span
hashes of one length; the overlap of two fingerprints estimates that of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formsift.llm.common import settled

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_000_003_177, 1_862_771_693)
SPAN, SMALLEST = 24, 64


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the Mersenne prime 2^31 - 1, for values below 2^62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


class Powers:
    """Powers of a base and of its inverse, grown by doubling as longer texts come."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, int(PRIME)))
        self.rows = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        for k, base in enumerate(self.bases):
            row = self.rows[k]
            while len(row) < n:
                row = np.concatenate([row, reduced(row * np.uint64(pow(base, len(row), int(PRIME))))])
            self.rows[k] = row
        return self.rows


POWERS = tuple(Powers(b) for b in BASES)


class PrefixHash:
    """Prefix arrays of a text, for two bases; a span's hash has 62 bits.

    ``like`` and ``keep`` name a text with the same first characters, whose arrays are taken over.
    """

    def __init__(self, text: str, like: PrefixHash | None = None, keep: int = 0):
        self.n, self.prefix = len(text), []
        codes = np.frombuffer(text[keep:].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        for k, powers in enumerate(POWERS):
            terms = reduced(codes * powers.upto(self.n + 1)[0][keep:self.n])
            sums = np.empty(self.n + 1, np.uint64)
            sums[:keep + 1] = like.prefix[k][:keep + 1] if like else 0
            sums[keep + 1:] = reduced(np.cumsum(terms, dtype=np.uint64) + sums[keep])
            self.prefix.append(sums)

    def span(self, start: int, length: int) -> int:
        """Hash of a span, whatever the text that it stands in."""
        out = 0
        for prefix, powers in zip(self.prefix, POWERS):
            part = int(prefix[start + length]) - int(prefix[start])
            out = out << 31 | part * int(powers.rows[1][start]) % int(PRIME)
        return out

    def windows(self, length: int, first: int = 0) -> np.ndarray:
        """Hashes of all spans of one length from ``first`` on, in order, by the first base alone."""
        prefix, powers = self.prefix[0], POWERS[0]
        part = reduced(prefix[first + length:] + PRIME - prefix[first:self.n + 1 - length])
        return reduced(part * powers.upto(self.n + 1)[1][first:first + len(part)])

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        """Whether two spans have the same hash, so but for chance the same characters."""
        return self.span(start, length) == other.span(other_start, length)

    def common_extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Length of the longest common run from two positions, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread hashes evenly over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def smallest(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` smallest distinct values, in order."""
    if len(hashes) > 8 * k:
        few = np.unique(hashes[hashes < np.uint64(int(2.0**64 * 4 * k / len(hashes)))])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def fingerprint(prefix: PrefixHash, spans: np.ndarray | None = None) -> tuple[int, np.ndarray]:
    """Hash of the whole text, and its sketch: the smallest span hashes, cut to 32 bits."""
    whole = prefix.span(0, prefix.n)
    if spans is None:
        spans = span_hashes(prefix)
    return whole, np.unique((smallest(spans, SMALLEST) >> np.uint64(32)).astype(np.uint32))


def span_hashes(prefix: PrefixHash, like: np.ndarray | None = None, keep: int = 0) -> np.ndarray:
    """Spread hashes of a text's spans; ``like`` has them of a text with ``keep`` equal characters."""
    if prefix.n == 0:
        return np.zeros(0, np.uint64)
    same = max(0, keep - SPAN + 1)
    if like is None or prefix.n < SPAN or not same:
        return mixed(prefix.windows(min(SPAN, prefix.n)))
    return np.concatenate([like[:same], mixed(prefix.windows(SPAN, same))])


def packed(print_: tuple[int, np.ndarray]) -> bytes:
    return print_[0].to_bytes(8, "big") + print_[1].astype(">u4").tobytes()


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of common spans among all, from two sketches; 1 for equal fingerprints."""
    if a[0] == b[0] and np.array_equal(a[1], b[1]):
        return 1.0
    both = np.union1d(a[1], b[1])[:SMALLEST]
    if not len(both):
        return 0.0
    return float(np.isin(both, np.intersect1d(a[1], b[1], assume_unique=True)).mean())


def edited(text: str, following: str) -> str:
    """``text`` whose last half is replaced by as many first characters of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


SCHEMA = ("doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
          "near_edited double, near_next double, common_chars long")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]


def row(doc_id: int | None, text: str, own: tuple, following: str, next_print: tuple) -> tuple:
    """The result for one document, from its hashes and print, and the next's print."""
    prefix, spans, print_ = own
    changed, keep = edited(text, following), len(text) - len(text) // 2
    changed_prefix = PrefixHash(changed, prefix, keep)
    changed_print = fingerprint(changed_prefix, span_hashes(changed_prefix, spans, keep))
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), packed(print_),
        packed(changed_print), likeness(print_, changed_print), likeness(print_, next_print),
        prefix.common_extension(0, changed_prefix, 0),
    )


def hashed(text: str) -> tuple[PrefixHash, np.ndarray, tuple]:
    prefix = PrefixHash(text)
    spans = span_hashes(prefix)
    return prefix, spans, fingerprint(prefix, spans)


def batch_of(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
    """Result rows, and rows (kind, partition, document, text) of the ends of a partition."""
    nothing = [None] * len(rows)
    heads = [["row"] * len(rows), nothing, [r[0] for r in rows], nothing]
    columns = [pa.array([*head, *(e[k] for e in edges)], t) for k, (head, t) in enumerate(
        zip(heads, [pa.string(), pa.int32(), pa.int64(), pa.string()]))]
    columns += [pa.array([*(r[k] for r in rows), *[None] * len(edges)], TYPES[k]) for k in range(1, len(NAMES))]
    return pa.RecordBatch.from_arrays(columns, ["kind", "part", "doc_id", "text", *NAMES[1:]])


def compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each document of a sorted partition with the next; hand out the two at its ends."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        rows, edges = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            text = text or ""
            now = hashed(text)
            if held is None:
                edges.append(("first", part, doc_id, text))
            else:
                rows.append(row(held[0], held[1], held[2], text, now[2]))
            held = doc_id, text, now
            if len(rows) >= 1000:
                yield batch_of(rows, [])
                rows = []
        yield batch_of(rows, edges)
    if held is not None:
        yield batch_of([], [("last", part, held[0], held[1])])


def compare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare documents with a given next one."""
    for batch in batches:
        rows = [row(d, t, hashed(t), n, hashed(n)[2]) for d, t, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")))]
        columns = zip(*rows) if rows else [[]] * len(NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)


def as_text(print_: Column) -> Column:
    """A fingerprint as hexadecimal text: hash of the whole, colon, sketch."""
    return F.concat(F.lower(F.hex(F.substring(print_, 1, 8))), F.lit(":"), F.lower(F.hex(F.substring(print_, 9, 1 << 20))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how like they are.

    The edited text takes its last half from the next document by ``doc_id``, the last from the
    first. Documents are range-sorted once; inside a partition each meets the next, and the
    documents at the ends of partitions, two for each, meet in a second small step. Null text
    counts as empty; null identifiers come first; rows with one identifier follow each other by
    text (null first). A single document is its own next. Columns other than ``doc_id`` and
    ``text`` are not looked at. An empty table gives an empty one. ``common_chars`` is the
    longest common extension of a text and its edited text from their starts.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows of one identifier are cut by how their texts begin, which keeps them in order.
    ranged = texts.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    kinds = "kind string, part int, doc_id long, text string, " + SCHEMA.split(", ", 1)[1]
    compared = settled(ranged.mapInArrow(compare_neighbours, kinds), "fingerprints")
    ends = compared.filter("kind <> 'row'").select("kind", "part", "doc_id", "text")
    firsts = ends.filter("kind = 'first'").select("part", F.col("text").alias("following"))
    order = Window.orderBy("part")  # one row per partition
    firsts = firsts.withColumn("before", F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())))
    pairs = ends.filter("kind = 'last'").join(firsts.select("before", "following"), F.col("part") == F.col("before"))
    across = pairs.select("doc_id", "text", "following").mapInArrow(compare_pairs, SCHEMA)
    rows = compared.filter("kind = 'row'").select(*NAMES).unionByName(across)
    return rows.withColumns({
        "edited_sha256": F.lower(F.hex("edited_sha256")), "fingerprint": as_text(F.col("fingerprint")),
        "edited_fingerprint": as_text(F.col("edited_fingerprint"))})
