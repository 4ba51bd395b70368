"""N-gram Jaccard join: documents whose word shingles overlap enough, as linked components.

Two sets that are similar enough share an element among the first ones of each, in any common
order; taking rare shingles first keeps the groups that share one small. A group is cut into
tiles of neighbouring size bands. A tile's members are compared first with its smallest member,
so that a group of near copies is linked in one pass; what that leaves open is compared in
blocks of a bounded size. Hashed bitmaps bound an overlap from above by counting bits, and
sorted arrays decide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formsift.llm.common import settled
from formsift.llm.components import components
from formsift.llm.shingles import gathered, shingle_sets
from formsift.session import set_for, shuffles_freed

#: Shingles whose frequency is known, at most; bounds what is broadcast.
MOST_FREQUENT = 100_000
#: Bits of the filter that picks the documents whose sets are needed; bounds what is broadcast.
FILTER_BITS = 1 << 25
#: Members of a tile that are compared at once; with more than a quarter of that outside a tile's
#: main component, pivots come first.
BLOCK = 512
#: Rows of one Arrow batch: texts and sets are long, and a batch stands in the worker and in the JVM.
BATCH_ROWS = 1_000
#: Shingles that a task counts at once.
COUNTED = 2_000_000
#: Bits of a shingle's hash that group documents; chance meetings are found out later.
GROUP_BITS = np.uint64(24)


class Threshold:
    """Similarity as a fraction ``num / den``, decided in whole numbers."""

    def __init__(self, num: int = 3, den: int = 4):
        self.num, self.den = num, den

    def shared(self, n: int) -> int:
        """How many of its first elements a set of ``n`` is asked to share with a similar one, if
        that isn't smaller."""
        return n // 20 + 1

    def first(self, n: int) -> int:
        """How many first elements hold that many shared ones, whatever the similar set."""
        return n - -(-n * self.num // self.den) + self.shared(n)

    def least_shared(self, n):
        """How many first elements a set of ``n`` shares with any similar one, at least."""
        return F.floor(F.ceil(n * self.num / self.den) / 20) + 1

    def needed(self, n, m):
        """The least overlap of two sets of these sizes."""
        return -(-(n + m) * self.num // (self.num + self.den))

    def band(self, n: int) -> int:
        return int(math.log(n) / math.log(self.den / self.num) + 1e-9)


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of a set: one hashed bit for each element, as bytes."""
    row = np.zeros(bits, np.uint8)
    row[(values >> np.uint64(40)).astype(np.int64) % bits] = 1
    return np.packbits(row)


def bitmap_bits(n: int) -> int:
    """About two bits for an element; sizes that are compared get the same or twice as many."""
    return 1 << max(6, (2 * n - 1).bit_length())


def folded(row: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of fewer bits: halves on top of each other."""
    while len(row) > size:
        row = row[:len(row) // 2] | row[len(row) // 2:]
    return row


def overlap_bound(a: np.ndarray, n: int, b: np.ndarray, m) -> np.ndarray:
    """Upper bounds of the overlap of a set of ``n`` with sets of ``m``: a bit that one has and the
    other hasn't stands for an element at least."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(~a & b).sum(axis=-1, dtype=np.int64)
    return np.minimum(n - only_a, m - only_b)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Exact overlap of two sorted arrays of distinct values."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hash and count of the corpus' most frequent shingles, at most ``MOST_FREQUENT`` of them.

    Each task counts its shingles and hands on those that it saw three times or more. The
    counts only order shingles; no result depends on them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= 3
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n[keep])], ["shingle", "n"])

        for batch in batches:
            for some in gathered([(None, t) for t in batch.column("text").to_pylist()]):
                for s in shingle_sets([t for _, t in some]):
                    held.append(s)
                    size += len(s)
                if size > COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counts = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = settled(counts, "frequent")
    # At most one row for each power of two.
    sizes = {r["p"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, total = 64, 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > MOST_FREQUENT:
            break
        least = p
    top = counts.filter(F.col("n") >= F.pow(F.lit(2.0), F.lit(least))).toArrow()
    values, n = top["shingle"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(values)
    return values[order], n[order]


def first_elements(values: np.ndarray, known: np.ndarray, counts: np.ndarray, many: int) -> np.ndarray:
    """The first elements in the common order: rare ones by hash, then frequent ones by count."""
    if not len(known):
        return values[:many]
    at = np.searchsorted(known, values)
    at[at == len(known)] = len(known) - 1
    frequent = known[at] == values
    rare = values[~frequent][:many]
    if len(rare) == many:
        return rare
    rest, n = values[frequent], counts[at[frequent]]
    return np.concatenate([rare, rest[np.lexsort((rest, n))][:many - len(rare)]])


def set_table(docs: DataFrame, threshold: Threshold) -> DataFrame:
    """``doc_id, n_shingles, key`` (hash of the set) and ``firsts`` of every row.

    Of equal sets that one task meets, only the first hands on its elements.
    """
    known, counts = frequent_shingles(docs)
    shared = docs.sparkSession.sparkContext.broadcast((known, counts))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for some in gathered(list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))):
                sets = shingle_sets([t for _, t in some])
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                firsts = []
                for (doc_id, _), s, key in zip(some, sets, keys):
                    if doc_id is None or key in seen or not len(s):
                        firsts.append(np.zeros(0, np.int64))
                        continue
                    if len(seen) < 200_000:
                        seen.add(key)
                    part = first_elements(s, *shared.value, threshold.first(len(s)))
                    firsts.append((part >> GROUP_BITS).view(np.int64))
                offsets = np.cumsum([0] + [len(f) for f in firsts]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([d for d, _ in some], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts))),
                ], ["doc_id", "n_shingles", "key", "firsts"])

    schema = "doc_id long, n_shingles long, key binary, firsts array<long>"
    built = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, schema), "sets")
    shared.destroy()
    return built


def bit_filter(wanted: DataFrame) -> np.ndarray:
    """Bits at the places of the wanted ``id``s, in a table of a fixed size."""
    words = wanted.select(place_of("id").alias("p")).groupBy(F.floor(F.col("p") / 32).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[words["w"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return table


def has_bit(table: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (table[p // 32] >> (p % 32).astype(np.uint32) & np.uint32(1)).astype(bool)


def place_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def needed_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, p, n, bits, elements`` of the documents whose ``id`` is wanted.

    A bitmap of wanted identifiers of a fixed size spares most other texts; sets that it lets by
    for nothing stay unused.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(shared.value, batch.column("p").to_numpy())))
            keys = zip(batch.column("id").to_pylist(), batch.column("p").to_pylist())
            for some in gathered(list(zip(keys, batch.column("text").to_pylist()))):
                sets = shingle_sets([t for _, t in some])
                yield pa.RecordBatch.from_arrays([
                    pa.array([k[0] for k, _ in some], pa.int64()), pa.array([k[1] for k, _ in some], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([bitmap(s, bitmap_bits(len(s))).tobytes() for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ], ["id", "p", "n", "bits", "elements"])

    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    built = texts.select("id", "text", place_of("id").alias("p")).mapInArrow(build, "id long, p long, n long, bits binary, elements binary")
    built = settled(built.filter("n > 0"), "needed-sets")
    shared.destroy()
    return built


def verified(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """Those of the pairs ``a, b`` that are similar: first by bitmaps, then by the sets."""

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))):
                size = min(len(x), len(y))
                a, b = (folded(np.frombuffer(r, np.uint8), size) for r in (x, y))
                keep.append(bool(overlap_bound(a, n, b, m) >= threshold.needed(n, m)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def by_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(*(batch.column(c).to_pylist() for c in ("elements_a", "elements_b"))):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(overlap(a, b) >= threshold.needed(len(a), len(b)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def joined(left: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
        for end in ("a", "b"):
            side = sets.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
            left = left.join(side, end)
        return left

    close = joined(pairs, sets, "n", "bits").filter(
        F.least("n_a", "n_b") * threshold.den >= F.greatest("n_a", "n_b") * threshold.num)
    likely = settled(close.mapInArrow(by_bits, "a long, b long").distinct(), "likely")
    # Sets are long: only those of likely pairs are moved.
    table = sets.sparkSession.sparkContext.broadcast(bit_filter(
        likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["id", "elements"]).filter(pa.array(has_bit(table.value, batch.column("p").to_numpy())))

    picked = sets.select("id", "elements", "p").mapInArrow(pick, "id long, elements binary")
    links = settled(joined(likely, picked, "elements").mapInArrow(by_elements, "a long, b long").distinct(), "links")
    table.destroy()
    return links


def tiles(table: DataFrame, classes: DataFrame, threshold: Threshold) -> DataFrame:
    """``element, band, id, n, first`` of every class in every tile of two members or more; ``first`` is
    the tile's smallest member. Of tiles with the same members there is one.

    A member stands in the tile of its size band and in the one below, so that sizes that can be
    similar meet in one of them.

    Two similar documents meet in ``least_shared`` elements at least. In one order of all elements, that many
    less one of the most common ones can be left out of each document: the rarest one that both have
    comes before all others that both have, and so stays with both.
    """
    rows = table.select(F.explode("firsts").alias("element"), "doc_id", F.col("n_shingles").alias("n"))
    group = Window.partitionBy("element")
    rows = rows.select("*", F.min("doc_id").over(group).alias("low"), F.max("doc_id").over(group).alias("high"),
                       F.count(F.lit(1)).over(group).alias("among"))
    rows = settled(rows.filter("low < high").drop("low", "high"), "meetings")
    # A document that meets others in fewer elements than that has no similar one, and no place here.
    own = Window.partitionBy("doc_id").orderBy(F.desc("among"), "element")
    rows = rows.withColumn("place", F.row_number().over(own)).filter(F.col("place") >= threshold.least_shared(F.col("n")))
    # Dealt by element once: neither the distinct rows nor the tiles of an element move again.
    rows = rows.join(classes, "doc_id").select("element", "id", "n").repartition("element").distinct()
    band = F.floor(F.log(F.col("n")) / F.lit(math.log(threshold.den / threshold.num)) + F.lit(1e-9))
    rows = rows.select("element", "id", "n", F.explode(F.array(band, band - 1)).alias("band"))
    tile = Window.partitionBy("element", "band")
    rows = rows.withColumns({
        "first": F.min("id").over(tile), "high": F.max("id").over(tile), "size": F.count(F.lit(1)).over(tile),
        "sum": F.sum("n").over(tile), "mark": F.bit_xor(F.xxhash64("id")).over(tile)}).filter("first < high")
    kinds = rows.filter("id = first").groupBy("first", "high", "size", "sum", "mark").agg(F.min(F.struct("element", "band")).alias("t"))
    unique = kinds.groupBy(F.col("t.element").alias("element")).agg(F.collect_set("t.band").alias("bands"))
    kept = rows.join(unique, "element").filter(F.array_contains("bands", F.col("band")))
    return settled(kept.select("element", "band", "id", "n", "first"), "tiles")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` of the tiles that hold several components, with ``label`` and the tile's ``main``.

    ``main`` is the component of the smallest member.
    """
    plain = members.select("element", "band", "id", "n")
    named = plain.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
        "label", F.coalesce("component", "id")).drop("component")
    kinds = named.groupBy("element", "band").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "id").alias("main"), F.count(F.lit(1)).alias("size"))
    several = kinds.filter("low < high").select("element", "band", "main", "size")
    return settled(named.join(several, ["element", "band"]), "open-tiles")


def pivot_pairs(members: DataFrame) -> DataFrame:
    """Pairs of each member outside its tile's main component with the smallest such member."""
    rest = members.filter("label <> main")
    pivots = rest.groupBy("element", "band").agg(F.min(F.struct("id", "label")).alias("p"))
    pairs = members.join(pivots, ["element", "band"]).filter("label <> p.label")
    return pairs.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()


def block_rows(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members outside the main component of a tile, in blocks (side 0), beside all members (side
    1): a task sees two blocks of a tile at once, and what is sent grows with the members outside
    times the blocks."""
    # A hash splits a tile into parts of about one block.
    salted = members.drop("n").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / F.lit(BLOCK))))
    outside = salted.filter("label <> main").withColumnRenamed("salt", "left")
    inside = salted.withColumnRenamed("salt", "right")
    parts = lambda d, side: d.select("element", "band", side).distinct()
    both = parts(outside, "left").join(parts(inside, "right"), ["element", "band"])
    pick = lambda d, side: d.select("element", "band", "left", "right", "id", "label", F.lit(side).alias("side"))
    rows = pick(outside.join(both, ["element", "band", "left"]), 0).unionByName(
        pick(inside.join(both, ["element", "band", "right"]), 1))
    tile = ["element", "band", "left", "right"]
    rows = rows.join(sets.select("id", "n", "bits"), "id").withColumn("tile", F.struct(*tile)).drop(*tile)
    return rows.repartition("tile").sortWithinPartitions("tile", "side", "id")


def likely_partners(lefts: list[tuple], rights: list[tuple], threshold: Threshold, best: bool) -> list[tuple]:
    """(bound, left, right) of pairs of different components whose bitmaps allow a link; with
    ``best``, of each left and component only the pair with the highest bound."""
    ids, labels, sizes = (np.array([r[k] for r in rights]) for k in range(3))
    maps = [np.frombuffer(r[3], np.uint8) for r in rights]
    folds: dict[int, list] = {}
    out = []
    for a, label, n, bits in lefts:
        near = np.flatnonzero((labels != label) & (np.minimum(n, sizes) * threshold.den >= np.maximum(n, sizes) * threshold.num))
        if not len(near):
            continue
        own = np.frombuffer(bits, np.uint8)
        size = min(len(own), min(len(maps[i]) for i in near))
        if size not in folds:
            folds[size] = [folded(m, size) if len(m) >= size else m for m in maps]
        row = folds[size]
        bound = overlap_bound(folded(own, size)[None, :], n, np.stack([row[i] for i in near]), sizes[near])
        fits = bound >= threshold.needed(n, sizes[near])
        hits = near[fits]
        if best and len(hits):
            order = np.lexsort((ids[hits], -bound[fits], labels[hits]))
            first = np.ones(len(order), bool)
            first[1:] = labels[hits][order][1:] != labels[hits][order][:-1]
            hits = hits[order[first]]
        out += [(min(a, b), max(a, b)) for b in ids[hits].tolist()]
    return out


def block_pairs(rows: DataFrame, threshold: Threshold, best: bool) -> DataFrame:
    """Pairs ``a, b`` of different components in a tile that may be similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sides, out = None, ([], []), set()
        for batch in batches:
            tiles_ = batch.column("tile")
            keys = zip(*(tiles_.field(k).to_pylist() for k in range(4)))
            values = zip(*(batch.column(c).to_pylist() for c in ("id", "label", "n", "bits")))
            for key, side, row in zip(keys, batch.column("side").to_pylist(), values):
                if key != tile:
                    if tile is not None:
                        out.update(likely_partners(*sides, threshold, best))
                    tile, sides = key, ([], [])
                    if len(out) > 100_000:
                        yield pairs_batch(out)
                        out = set()
                sides[side].append(row)
        if tile is not None:
            out.update(likely_partners(*sides, threshold, best))
        yield pairs_batch(out)

    return rows.mapInArrow(compare, "a long, b long").distinct()


def pairs_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    rows = sorted(pairs)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], ["a", "b"])


def similar_components(docs: DataFrame, threshold: Threshold | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Sets are the distinct five-word shingles of the text with A-Z lower-cased; a shorter text is
    one shingle, and a null or blank one has none and links with nothing. A component is the
    smallest ``doc_id`` that links lead to, the document's own if none does. Rows that share
    an identifier are one document; a null identifier has no component. Equal texts are compared
    once. Columns other than ``doc_id`` and ``text`` are not looked at. An empty table gives an
    empty one. No link is lost: groups, tiles and bitmaps only spare comparisons that cannot
    succeed or would join what is joined already.
    """
    rows = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    with shuffles_freed(docs.sparkSession), set_for(docs.sparkSession, rows):
        return linked(docs, threshold or Threshold())


def linked(docs: DataFrame, threshold: Threshold) -> DataFrame:
    """The rows of ``similar_components``, whose rounds run while this is built."""
    table = set_table(docs, threshold)
    sized = table.filter("doc_id is not null and n_shingles > 0")
    by_key = sized.groupBy("key").agg(F.min("doc_id").alias("id"))
    classes = settled(sized.select("doc_id", "key").join(by_key, "key").select("doc_id", "id"), "classes")
    members = tiles(sized, classes, threshold)
    sets = needed_sets(docs, members.select("id").distinct())
    first = members.filter("first < id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = verified(first, sets, threshold)
    # A document's rows, should it have several, are one node.
    same = classes.filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    step = 0
    while True:
        labels = components(links.unionByName(same), "labels")
        members = open_members(members, labels)
        outside = members.filter("label <> main").groupBy("element", "band").count().agg(F.max("count")).first()[0]
        if not outside:
            break
        # While a tile has many members outside its main component, one of them meets all; then, once,
        # each meets its likeliest partner in other components; at last, all likely ones.
        if outside > BLOCK // 4 and step == 0:
            pairs = pivot_pairs(members)
        else:
            step = max(step, 1)
            pairs = block_pairs(block_rows(members, sets), threshold, best=step < 2)
        more = verified(pairs, sets, threshold)
        found = not more.isEmpty()
        if step == 2:
            if found:
                labels = components(links.unionByName(more).unionByName(same), "labels")
            break
        step += step == 1 or not found
        links = settled(links.unionByName(more), "links")
    named = labels.select(F.col("node").alias("doc_id"), "component")
    out = table.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
