"""Stretches of repeated words: scale-tiled search for periodic runs.

A document is cut into overlapping tiles per octave of periods: short periods in tiles of a fixed
size, longer ones in tiles that grow with the period. In a tile of periods ``P .. 2P - 1``, every
run passes one of the boundaries that lie ``3P`` words apart; how far a period holds around a
boundary is read off two Z-functions. Tiles are solved on their own, wherever they are; the
fragments they find meet by document and period and are stitched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formsift.llm.common import settled

#: A run is at least this many periods and words long.
TIMES, LEAST = 4, 6
#: Words of the smallest tile; a tile spans at least 32 times the lowest period of its octave.
TILE_WORDS, SPAN = 1 << 14, 32
#: Words of tiles that are solved together.
GATHER_WORDS = 1 << 20
#: Equal words next to a boundary that are looked at before its Z-functions are computed.
GLANCE = 8


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of the documents get a periodic tail; fixed rule of the operator's contract.

    A null identifier gets none.
    """
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def tile_plan(n: int, tile_words: int) -> Iterator[tuple[int, int, int, int]]:
    """``lowest octave, highest octave, start, stop`` of the tiles of ``n`` words.

    Neighbours overlap so far that every word lies three boundaries' distances inside one of them.
    """
    if n < LEAST:
        return
    low, last = 0, (n // TIMES).bit_length() - 1
    while low <= last:
        high = low
        while high < last and SPAN << (high + 1) <= tile_words:
            high += 1
        length = max(tile_words, SPAN << high)
        if length >= n:
            yield low, last, 0, n
            return
        start = 0
        while start + length < n:
            yield low, high, start, start + length
            start += length - (8 << high)
        yield low, high, start, n
        low = high + 1


def z_function(text: list[int]) -> list[int]:
    """Per place, how many symbols from there on repeat the text's beginning."""
    n = len(text)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and text[k] == text[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def around(words: np.ndarray, at: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and from ``at`` equal the word ``q`` further on, for ``q < 2 period``."""
    step = 3 * period
    begin, end = max(0, at - step), min(len(words), at + 2 * period)
    most = min(2 * period, len(words) - at)
    after = np.array(z_function(words[at:at + step + 2 * period].tolist())[:most])
    before = words[begin:at][::-1].tolist()
    z = z_function(before + [-1] + words[begin:end][::-1].tolist() + [-2])
    shifted = len(before) + 1 + end - at
    return np.array([z[shifted - q] for q in range(most)]), after


def primitive(before: np.ndarray, after: np.ndarray, periods: np.ndarray, period: int) -> np.ndarray:
    """Those of some periods whose stretch has no shorter period that divides them."""
    all_periods = np.arange(len(after))
    long = all_periods[(before + after + all_periods >= 2 * period) & (all_periods > 0)]
    while len(long) and len(periods):
        p = long[0]
        covered = lambda q: (q % p == 0) & (q > p) & (before[q] <= before[p]) & (after[q] + q <= after[p] + p)  # noqa: B023, E731
        periods, long = periods[~covered(periods)], long[1:]
        long = long[~covered(long)]
    return periods


def octave_fragments(words: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periods, starts and ends of stretches of places whose word comes again a period later.

    Only stretches of ``3 period`` places or more, and none of a multiple of a shorter period.
    """
    step, n = 3 * period, len(words)
    glance = min(GLANCE, -(-step // 2))
    padded = np.concatenate([np.full(glance, -2, words.dtype), words, np.full(2 * period + glance, -1, words.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(padded[glance + period:], period)
    bounds = np.arange(0, n, step)
    j, q = np.nonzero(windows[bounds] == words[bounds][:, None])
    at, q = bounds[j] + glance, q + period
    right, left = np.ones(len(at), bool), np.ones(len(at), bool)
    for t in range(1, glance):
        right &= padded[at + t] == padded[at + q + t]
    for t in range(1, glance + 1):
        left &= padded[at - t] == padded[at + q - t]
    out = []
    for b in np.unique(at[right | left] - glance).tolist():
        before, after = around(words, b, period)
        found = np.arange(period, len(after))
        found = primitive(before, after, found[before[found] + after[found] >= step], period)
        if len(found):
            out.append((found, b - before[found], b + after[found]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return merged(*(np.concatenate(c) for c in zip(*out)), n)


def merged(periods: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that touch as one."""
    shift = periods.astype(np.int64) * (n + 2)
    order = np.argsort(low + shift, kind="stable")
    low, high, shift, periods = (low + shift)[order], np.maximum.accumulate((high + shift)[order]), shift[order], periods[order]
    first = np.append(True, low[1:] > high[:-1])
    last = np.append(first[1:], True)
    return periods[first], (low - shift)[first], (high - shift)[last]


def needed(period: np.ndarray) -> np.ndarray:
    """Places of a run whose word comes again a period later."""
    return np.maximum((TIMES - 1) * period, LEAST - period)


def solve(tiles: list[dict]) -> dict[str, list]:
    """Fragments of runs in some tiles, all of one octave at once.

    A fragment too short for a run is kept only where a neighbouring tile goes on with it.
    """
    out: dict[str, list] = {"tile": [], "period": [], "low": [], "high": []}
    for octave in range(max(t["high"] for t in tiles) + 1):
        some = [i for i, t in enumerate(tiles) if t["low"] <= octave <= t["high"]]
        if not some:
            continue
        parts, ends, shift = [], [0], 0
        for i in some:  # no two tiles share a symbol, so no period goes across
            parts.append(tiles[i]["ids"] + np.int32(shift))
            shift += int(tiles[i]["ids"].max()) + 1
            ends.append(ends[-1] + len(parts[-1]))
        period, low, high = octave_fragments(np.concatenate(parts), 1 << octave)
        if not len(period):
            continue
        begin = np.array(ends)
        where = np.searchsorted(begin, low, "right") - 1
        low, high = low - begin[where], high - begin[where]
        start, size, whole = (np.array([tiles[i][c] for i in some]) for c in ("start", "size", "n"))
        open_left = (low == 0) & (start[where] > 0)
        open_right = (high + period == size[where]) & ((start + size < whole)[where])
        keep = (high - low >= needed(period)) | open_left | open_right
        out["tile"] += [some[w] for w in where[keep]]
        out["period"] += period[keep].tolist()
        out["low"] += (low + start[where])[keep].tolist()
        out["high"] += (high + start[where])[keep].tolist()
    return out


def words_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, list[bytes], bytes]]:
    """Identifier, words and their digest of every document. White space of bytes is the contract's."""
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        words = planted(text.as_py().split(), doc_id)
        yield doc_id, words, hashlib.sha256(b" ".join(words)).digest()


TILE = "doc_id long, digest binary, n long, low int, high int, start long, size long, width int, ids binary"
FRAGMENT = "doc_id long, digest binary, period long, low long, high long"


def batch_of(schema: str, columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[t]) for n, t in fields], [n for n, _ in fields])


def tiles(texts: DataFrame, tile_words: int) -> DataFrame:
    """All tiles of all documents, dealt evenly; words as numbers within their document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in TILE.split(", ")]
        for batch in batches:
            rows, held = [], 0
            for doc_id, words, digest in words_of(batch):
                if len(words) < LEAST:
                    continue
                numbers: dict[bytes, int] = {}
                ids = np.array([numbers.setdefault(w, len(numbers)) for w in words])
                ids = ids.astype(np.min_scalar_type(len(numbers)))
                for low, high, start, stop in tile_plan(len(words), tile_words):
                    part = ids[start:stop]
                    rows.append((doc_id, digest, len(words), low, high, start, len(part), ids.itemsize, part.tobytes()))
                    held += len(part)
                    if held >= GATHER_WORDS:
                        yield batch_of(TILE, dict(zip(names, map(list, zip(*rows)))))
                        rows, held = [], 0
            if rows:
                yield batch_of(TILE, dict(zip(names, map(list, zip(*rows)))))

    return texts.mapInArrow(cut, TILE).repartition("digest", "doc_id", "low", "start")


def fragments(of: DataFrame) -> DataFrame:
    """What each tile finds on its own."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0

        def solved() -> pa.RecordBatch:
            found = solve(some)
            rows = {c: [some[t][c] for t in found["tile"]] for c in ("doc_id", "digest")}
            return batch_of(FRAGMENT, {**rows, **{c: found[c] for c in ("period", "low", "high")}})

        for batch in batches:
            for row in batch.to_pylist():
                row["ids"] = np.frombuffer(row["ids"], f"u{row['width']}").astype(np.int32)
                some.append(row)
                held += row["size"]
                if held >= GATHER_WORDS:
                    yield solved()
                    some, held = [], 0
        if some:
            yield solved()

    return of.mapInArrow(find, FRAGMENT)


def stitched(found: DataFrame) -> DataFrame:
    """``doc_id, digest, runs``: all runs of a document by start and period."""
    key = ["doc_id", "digest", "period"]
    order = Window.partitionBy(*key).orderBy("low", "high")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("low") <= reached, 0).otherwise(1)
    islands = found.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order))
    whole = islands.groupBy(*key, "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    q = F.col("period")
    whole = whole.filter(F.col("high") - F.col("low") >= F.greatest((TIMES - 1) * q, LEAST - q))
    # A run of a period is one of its multiples, too; the smallest counts.
    whole = whole.select("doc_id", "digest", F.col("low").alias("start"), (F.col("high") - F.col("low") + q).alias("length"), "period")
    runs = whole.groupBy("doc_id", "digest", "start", "length").agg(F.min("period").alias("period"))
    return runs.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


REPORT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def collapsed(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    gone = np.zeros(len(words) + 1, np.int32)
    for r in runs:
        gone[r["start"] + r["period"]] += 1
        gone[r["start"] + r["length"]] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist()) if not g]


def periodic_runs(docs: DataFrame, tile_words: int = TILE_WORDS, keep_text: bool = False) -> DataFrame:
    """Number of runs, the longest run, and digests of all runs and of the text without repeats.

    A run is a stretch of words of smallest period ``q``, at least ``max(6, 4 q)`` words long,
    that no neighbouring word extends. ``keep_text`` adds the collapsed ``text``. Null text
    counts as empty: no runs, null for the longest. Rows that agree in ``doc_id`` (null, too) and
    words give the same row each; rows that share a ``doc_id`` only are told apart by their words.
    Texts of any length are searched whole. Columns other than ``doc_id`` and ``text`` are not
    looked at; an empty table gives an empty one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(
        F.col("text").cast("binary"), F.lit(b"")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = [(d, digest, squeeze.compress(b" ".join(words))) for d, words, digest in words_of(batch)]
            if rows:
                yield batch_of("doc_id long, digest binary, words binary", dict(zip(("doc_id", "digest", "words"), map(list, zip(*rows)))))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc_id, digest, data, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "words", "runs"))):
                longest = [None] * 4
                text = None
                if runs:
                    r = min(runs, key=lambda r: (-r["length"], r["start"], r["period"]))
                    longest = [r["start"], r["length"], r["period"], 1000 * r["length"] // r["period"]]
                    text = b" ".join(collapsed(open_up.decompress(data).split(b" "), runs))
                    digest = hashlib.sha256(text).digest()
                listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs or ())
                row = [doc_id, len(runs or ()), *longest, hashlib.sha256(listed.encode()).hexdigest(), digest.hex()]
                out.append(row + [(open_up.decompress(data) if text is None else text).decode()] * keep_text)
            if out:
                yield batch_of(schema, dict(zip(names, map(list, zip(*out)))))

    schema = REPORT + ", text string" * keep_text
    runs = settled(stitched(fragments(tiles(texts, tile_words))), "runs")
    words = texts.mapInArrow(pack, "doc_id long, digest binary, words binary")
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "runs")
    same = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return words.join(runs, same, "left").select("doc_id", "digest", "words", "runs").mapInArrow(report, schema)
