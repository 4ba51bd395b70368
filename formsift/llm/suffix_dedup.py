"""Suffix-array deduplication of repeated byte strings across all documents.

A string of the judged length contains an anchor: the span of ``ANCHOR`` bytes with the smallest
hash in it, which copies of the string share at the same place. So the strings of a document
fall into runs with one anchor, and only runs whose anchor occurs again can hold a repeat. Their
contexts meet by anchor. Equal contexts are settled by aggregation; contexts that agree only in
part go, many anchors together, into suffix arrays by linear grouping, in which equal strings
stand next to each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formsift.llm.common import settled
from formsift.llm.shingles import Tables, mix
from formsift.llm.suffix_array import suffix_array

#: Bytes of an anchor; bits of the filters that spare what cannot repeat; bounds what is broadcast.
ANCHOR, FILTER_BITS = 32, 1 << 26
#: Bytes of text that are worked on together, and of one suffix array.
SEGMENT, BLOCK_BYTES = 2_000_000, 200_000
#: Distinct contexts of one anchor that one task takes; those of an anchor with more are cut into
#: single strings, which aggregation settles.
MOST_CONTEXTS = 50_000


def polynomial(codes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all spans of one length."""
    up, down = Tables.upto(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:len(codes)], dtype=np.uint64)])
    return mix((sums[length:] - sums[:len(sums) - length]) * down[:len(codes) - length + 1])


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of every window, from prefix and suffix minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[:n - width + 1], from_left[width - 1:n])


def segments(rows: list[tuple], length: int) -> Iterator[list[tuple]]:
    """(identifier, offset, bytes) in lists of about ``SEGMENT`` bytes; long texts go in parts that
    overlap so far that each string of ``length`` lies in exactly one of them."""
    some, size = [], 0
    for doc_id, text in rows:
        raw = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(0, len(raw) - length + 1), SEGMENT):
            part = raw[at:at + SEGMENT + length - 1]
            some.append((doc_id, at, part))
            size += len(part)
            if size >= SEGMENT:
                yield some
                some, size = [], 0
    if some:
        yield some


def anchored_runs(parts: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one anchor: its hash, the part, first start, end, anchor's place."""
    width = length - ANCHOR + 1
    codes = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    ends = np.cumsum([len(p[2]) for p in parts])
    hashes = polynomial(codes, ANCHOR)
    places = np.arange(len(hashes), dtype=np.uint64)
    keys = (hashes & ~np.uint64(0xFFFFFF)) | places
    anchor = (sliding_argmin(keys, width) & np.uint64(0xFFFFFF)).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), np.diff(np.concatenate([[0], ends])))[:len(anchor)]
    valid = np.arange(len(anchor)) + length <= ends[part]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    stop = np.concatenate([first[1:], [len(anchor)]])
    keep = valid[first]
    first, stop = first[keep], stop[keep]
    return hashes[anchor[first]], part[first], first, stop, anchor[first]


def bit_filter(values: DataFrame) -> np.ndarray:
    """Bits at the places ``p`` of the values, in a table of a fixed size."""
    words = values.select("p").groupBy(F.floor(F.col("p") / 32).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[words["w"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return table


def has_bit(table: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (table[p // 32] >> (p % 32).astype(np.uint32) & np.uint32(1)).astype(bool)


def repeated_anchors(texts: DataFrame, length: int) -> DataFrame:
    """``anchor`` hashes that have more than one run in the corpus."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in segments(list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())), length):
                yield pa.RecordBatch.from_arrays([pa.array(anchored_runs(parts, length)[0].view(np.int64))], ["anchor"])

    runs = texts.mapInArrow(emit, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    return settled(runs.filter("n > 1").select("anchor"), "anchors")


OCCURRENCE = "anchor long, mark binary, size int, doc_id long, start long"


def mark_of(context: bytes) -> bytes:
    """What equal contexts of an anchor are found by, so that their bytes need not move."""
    return hashlib.blake2b(context, digest_size=12).digest()


def occurrences(texts: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """The contexts of runs whose anchor occurs again: hash, size and place of all bytes of the
    run's strings. The bytes themselves stay in the texts."""
    bits = anchors.select(F.col("anchor").bitwiseAND(FILTER_BITS - 1).alias("p"))
    table = texts.sparkSession.sparkContext.broadcast(bit_filter(bits))
    names = [c.split()[0] for c in OCCURRENCE.split(", ")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in segments(list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())), length):
                found = anchored_runs(parts, length)
                hit = has_bit(table.value, (found[0] & np.uint64(FILTER_BITS - 1)).astype(np.int64))
                anchor, part, first, stop, _ = (x[hit] for x in found)
                data = b"".join(x[2] for x in parts)
                base = np.cumsum([0] + [len(x[2]) for x in parts])
                start = first - base[part] + np.array([x[1] for x in parts], np.int64)[part]
                marks = [mark_of(data[a:b + length - 1]) for a, b in zip(first.tolist(), stop.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor.view(np.int64)), pa.array(marks, pa.binary()), pa.array((stop - first + length - 1).astype(np.int32)),
                    pa.array(np.array([x[0] for x in parts], np.int64)[part]), pa.array(start),
                ], names)

    found = settled(texts.mapInArrow(emit, OCCURRENCE), "occurrences")
    table.destroy()
    return found


def first_of_equals(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct contexts with their first place, and ``doc_id, start, end`` of all the others."""
    keys = ["anchor", "mark"]
    distinct = settled(found.groupBy(*keys).agg(
        F.min(F.struct("doc_id", "start")).alias("first"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n")), "contexts")
    again = distinct.filter("n > 1").select(*keys, "first")
    others = found.join(again, keys).filter(F.struct("doc_id", "start") != F.col("first"))
    return distinct, others.select("doc_id", "start", (F.col("start") + F.col("size")).alias("end"))


def with_bytes(chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """``chosen`` (anchor, mark, size, doc_id, start) with ``context``, cut from the texts.

    Where several rows share an identifier, those whose bytes have the mark give the context.
    """
    places = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "mark", "size", "start")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, here in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "places"))):
                raw = text.encode("utf-8", "surrogatepass")
                rows = [(x, raw[x["start"]:x["start"] + x["size"]]) for x in here]
                rows = [(x, context) for x, context in rows if mark_of(context) == x["mark"]]
                yield pa.RecordBatch.from_arrays([
                    *(pa.array([x[c] for x, _ in rows], t) for c, t in (("anchor", pa.int64()), ("mark", pa.binary()), ("size", pa.int32()))),
                    pa.array([doc_id] * len(rows), pa.int64()), pa.array([x["start"] for x, _ in rows], pa.int64()),
                    pa.array([context for _, context in rows], pa.binary()),
                ], ["anchor", "mark", "size", "doc_id", "start", "context"])

    return texts.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(cut, OCCURRENCE + ", context binary")


def single_strings(found: DataFrame, length: int) -> DataFrame:
    """Contexts cut into one occurrence for each of their strings."""
    cut = found.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - length)).alias("at"))
    string = F.substring("context", F.col("at") + 1, F.lit(length))
    return cut.select("anchor", F.unhex(F.md5(string)).alias("mark"), F.lit(length).alias("size"), "doc_id",
                      (F.col("start") + F.col("at")).alias("start"))


class Block:
    """Contexts of some anchors, to be judged by one suffix array."""

    def __init__(self, length: int):
        self.length, self.contexts, self.size = length, [], 0

    def add(self, group: list[tuple]) -> None:
        """Take what the contexts of one anchor share with another of them: of each, the bytes of every run
        of strings whose hashes others have. What no other has cannot repeat."""
        raw = np.frombuffer(b"".join(c for c, _, _ in group), np.uint8)
        sizes = np.array([len(c) for c, _, _ in group])
        owner = np.repeat(np.arange(len(group)), sizes - self.length + 1)
        base = np.cumsum(sizes) - sizes
        runs = np.cumsum(sizes - self.length + 1) - (sizes - self.length + 1)
        hashes = polynomial(raw, self.length)[np.arange(len(owner)) - runs[owner] + base[owner]]
        order = np.lexsort((owner, hashes))
        same = hashes[order][1:] == hashes[order][:-1]
        shared = np.zeros(len(owner), bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        edge = np.ones(len(owner) + 1, bool)
        edge[1:-1] = (owner[1:] != owner[:-1]) | (shared[1:] != shared[:-1])
        at = np.flatnonzero(edge)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if shared[a]:
                context, doc_id, start = group[owner[a]]
                first, stop = a - int(runs[owner[a]]), b - int(runs[owner[a]])
                self.contexts.append((context[first:stop + self.length - 1], doc_id, start + first))
                self.size += stop - first + self.length

    def repeats(self) -> list[tuple[int, int, int]]:
        """Spans (document, start, end) of the strings that also start earlier."""
        length, text = self.length, b"\0".join(c for c, _, _ in self.contexts)
        counts = np.array([len(c) - length + 1 for c, _, _ in self.contexts])
        ends = np.cumsum(counts + length)
        # Of each place in the text: the context whose string starts there, if one does.
        owner = np.full(len(text), -1)
        for k, (end, count) in enumerate(zip((ends - length - counts).tolist(), counts.tolist())):
            owner[end:end + count] = k
        order = np.array(suffix_array(text), np.int64)
        order = order[owner[order] >= 0]
        strings = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), length)
        new = np.ones(len(order), bool)
        for k in range(1, len(order), 4_096):  # compared in parts, which bounds the copies
            part = order[k - 1:k + 4_096]
            new[k:k + 4_096] = (strings[part[1:]] != strings[part[:-1]]).any(axis=1)
        docs, starts = (np.array([c[n] for c in self.contexts], np.int64) for n in (1, 2))
        of = owner[order]
        docs, starts = docs[of], starts[of] + order - (ends - length - counts)[of]
        equal = np.cumsum(new)
        rank = np.lexsort((starts, docs, equal))
        docs, starts, equal = docs[rank], starts[rank], equal[rank]
        later = np.zeros(len(rank), bool)
        later[1:] = equal[1:] == equal[:-1]
        # One place may stand in several contexts; it is no repeat of itself.
        head = np.flatnonzero(~later)
        of = np.cumsum(~later) - 1
        later &= (docs != docs[head][of]) | (starts != starts[head][of])
        out = zip(docs[later].tolist(), starts[later].tolist())
        spans: list[list[int]] = []
        for doc_id, start in sorted(set(out)):
            if spans and spans[-1][0] == doc_id and start <= spans[-1][2] - length + 1:
                spans[-1][2] = start + length
            else:
                spans.append([doc_id, start, start + length])
        self.contexts, self.size = [], 0
        return [tuple(s) for s in spans]


def by_suffix_array(contexts: DataFrame, length: int) -> DataFrame:
    """``doc_id, start, end`` of strings that start earlier in another of some contexts of their anchor."""
    names = ["doc_id", "start", "end"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, group, current, last = Block(length), [], None, None

        def handed(spans: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([s[k] for s in spans], pa.int64()) for k in range(3)], names)

        for batch in batches:
            for anchor, mark, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "mark", "context", "doc_id", "start"))):
                if anchor != current:
                    if len(group) > 1:
                        block.add(group)
                    if block.size >= BLOCK_BYTES:
                        yield handed(block.repeats())
                    group, current, last = [], anchor, None
                # Rows that repeat identifier and text stand next to each other.
                if (mark, *row[1:]) != last:
                    group.append(tuple(row))
                last = (mark, *row[1:])
        if len(group) > 1:
            block.add(group)
        if block.contexts:
            yield handed(block.repeats())

    rows = contexts.select("anchor", "mark", "context", "doc_id", "start")
    return rows.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start", "mark").mapInArrow(judge, "doc_id long, start long, end long")


def without(raw: bytes, spans: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """``raw`` without the union of some spans, and that union as runs."""
    runs: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    kept, at = [], 0
    for s, e in runs:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]]), [tuple(r) for r in runs]


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """``doc_id`` and ``spans`` (array of start and end bytes) of all documents with repeats."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(
        F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    anchors = repeated_anchors(texts, length)
    found = occurrences(texts, anchors, length)
    distinct, spans = first_of_equals(found)
    # Only the first of equal contexts is looked at, and only of anchors with several.
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    chosen = settled(distinct.join(several, "anchor").select("anchor", "mark", "size", "first.*", "many"), "chosen")
    crowded = F.col("many") > MOST_CONTEXTS
    spans = spans.unionByName(by_suffix_array(with_bytes(chosen.filter(~crowded), texts), length))
    if not chosen.filter(crowded).isEmpty():
        _, alone = first_of_equals(single_strings(with_bytes(chosen.filter(crowded), texts), length))
        spans = spans.unionByName(alone)
    return settled(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")


def drop_repeats(docs: DataFrame, length: int = 100, keep_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, and ``kept`` if wanted.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a document
    with a smaller identifier or before it in its own; overlaps count, and strings are judged
    on the input. ``kept`` has the remaining bytes. Null text counts as empty; texts shorter than
    ``length`` stay as they are, very long ones are judged whole. Rows that share an identifier
    are each judged by it: what both have at one place is no repeat. Rows with a null identifier
    take no part and stay whole. Columns other than ``doc_id`` and ``text`` are not looked at. An
    empty table gives an empty one.
    """
    spans = repeated_spans(docs, length)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    table = docs.sparkSession.sparkContext.broadcast(bit_filter(spans.select(place.alias("p"))))
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def judged(doc_id, raw: bytes, spans: list[dict]) -> tuple:
        kept, runs = without(raw, spans)
        return doc_id, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if keep_text else None

    def batch_of(rows: list[tuple], extra: dict) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())]
        return pa.RecordBatch.from_arrays([*columns, *extra.values()], [*types, *extra])

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole documents are done; the texts of the others, and of a few by chance, go on."""
        for batch in batches:
            p = batch.column("p").to_numpy()
            rows, texts = [], []
            for doc_id, text, hit in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), has_bit(table.value, p)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                hit = bool(hit) and doc_id is not None
                rows.append((doc_id, *[None] * 5) if hit else judged(doc_id, raw, []))
                texts.append(raw if hit else None)
            yield batch_of(rows, {"raw": pa.array(texts, pa.binary())})

    def second_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([
                judged(r["doc_id"], r["raw"], r["spans"] or []) if r["raw"] is not None else tuple(r[c] for c in types)
                for r in batch.to_pylist()], {})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    looked = texts.withColumn("p", place).mapInArrow(first_look, schema + ", raw binary")
    out = looked.join(spans, "doc_id", "left").mapInArrow(second_look, schema)
    return out if keep_text else out.drop("kept")
