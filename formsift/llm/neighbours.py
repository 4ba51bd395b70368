"""Approximate nearest neighbours: NN-descent builds a graph, greedy search answers queries.

Equal vectors are one node. A few random trees, grown on a bounded sample, give every node its
first neighbours, out of blocks of a bounded size. Each round of NN-descent then joins the
neighbours of a node with each other: edges and reversed edges meet at their node, the members'
vectors are joined to them, and every pair that beats the worst neighbour of either is handed
on. A query starts at its own neighbours and goes on from the best nodes not yet expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formsift.llm.common import settled


@dataclass(frozen=True)
class Plan:
    """Parameters: neighbours a node keeps, edges of a kind that a round samples, trees, nodes of
    a block, vectors that trees are grown on, share of changed neighbours that ends the rounds,
    nodes of a search's beam, and results."""

    neighbours: int = 50
    sample: int = 25
    trees: int = 6
    block: int = 1000
    tree_sample: int = 20_000
    settled_share: float = 0.01
    beam: int = 45
    results: int = 20


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the vectors that take part: not null, without null or non-finite
    components, not zero, and of the most common length (of equally common ones the longest)."""
    v = vectors.filter("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(finite & F.exists("embedding", lambda x: x != 0))
    size = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return v.filter(F.size("embedding") == (size["d"] if size else 0))


def nodes_of(vectors: DataFrame, results: int) -> DataFrame:
    """One row for each distinct vector: ``id`` (its smallest), ``embedding``, ``members``: its
    smallest ``results + 1`` identifiers, which is all that any result can show of them."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= results + 1)
    nodes = few.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    return settled(nodes, "nodes")


def grown_tree(points: np.ndarray, leaf: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (direction, bound, left, right) of a random tree; a leaf has no direction."""
    tree: list[tuple] = []

    def grow(rows: np.ndarray) -> int:
        at = len(tree)
        tree.append((None, 0.0, -1, -1))
        if len(rows) > leaf:
            a, b = points[rng.choice(rows, 2, replace=False)]
            side = points[rows] @ (a - b)
            bound = float(np.median(side))
            low, high = rows[side <= bound], rows[side > bound]
            if len(low) and len(high):
                tree[at] = (a - b, bound, grow(low), grow(high))
        return at

    grow(np.arange(len(points)))
    return tree


def leaves(tree: list[tuple], points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    out = np.zeros(len(points), np.int64)
    stack = [(0, np.arange(len(points)))]
    while stack:
        at, rows = stack.pop()
        direction, bound, left, right = tree[at]
        if direction is None:
            out[rows] = at
            continue
        low = points[rows] @ direction <= bound
        stack += [(left, rows[low]), (right, rows[~low])]
    return out


def unpacked(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float32)


def on_sphere(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors; of vectors of unequal norm (``longest`` > 0) with one component more, which
    makes the angle between two of them follow their inner product."""
    if not longest:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x = x / longest
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))
    return np.concatenate([x, rest], axis=1).astype(np.float32)


def split_by_planes(rows: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """``rows`` (id, unit, tree, block) with blocks of twice ``plan.block`` nodes at most.

    A larger block is halved at the median along the line between two of its nodes, and again
    until it is small enough; nodes at the median itself are dealt by a hash.
    """
    keys = ["tree", "block"]

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, u, v = (unpacked(batch.column(c).to_pylist(), kind) for c in ("unit", "u", "v"))
                side = np.einsum("ij,ij->i", x.astype(np.float64), (v - u).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "unit", *keys)), pa.array(side)], ["id", "unit", *keys, "side"])

    done, level = None, 0
    while True:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        large = settled(counts.filter(F.col("n") > 2 * plan.block).select(*keys), f"large-{level}")
        small = rows.join(large, keys, "left_anti").select("id", "unit", *keys)
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        rows = settled(rows.join(large, keys, "left_semi"), f"crowded-{level}")
        some = F.struct(F.xxhash64("id", F.lit(level)), "unit")
        ends = rows.groupBy(*keys).agg(F.min(some).alias("low"), F.max(some).alias("high")).select(
            *keys, F.col("low.unit").alias("u"), F.col("high.unit").alias("v"))
        lined = settled(rows.join(ends, keys).select("id", "unit", *keys, "u", "v").mapInArrow(
            along, "id long, unit binary, tree int, block long, side double"), f"lined-{level}")
        middle = lined.groupBy(*keys).agg(F.percentile_approx("side", 0.5, F.lit(1000)).alias("middle"))
        even = F.pmod(F.xxhash64("id", F.lit(level), F.lit("even")), F.lit(2)) == 0
        high = (F.col("side") > F.col("middle")) | ((F.col("side") == F.col("middle")) & even)
        rows = settled(lined.join(middle, keys).select(
            "id", "unit", "tree", F.xxhash64("tree", "block", F.lit(level), high).alias("block")), f"halved-{level}")
        level += 1


def norm() -> Column:
    return F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x))


def longest_norm(nodes: DataFrame) -> float:
    """The largest norm; 0 if all norms are one."""
    least, most = nodes.agg(F.min(norm()), F.max(norm())).first()
    return float(most) if most and most > 1.001 * least else 0.0


def placed_nodes(nodes: DataFrame, plan: Plan) -> tuple[DataFrame, str]:
    """``id, unit`` (the place on the sphere) and its ``block`` in every tree; and the kind of
    number in ``unit``: half precision for vectors of one norm, else single."""
    longest = longest_norm(nodes)
    kind = "float32" if longest else "float16"
    # A bounded sample, by a hash of the identifier.
    sample = nodes.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(plan.tree_sample).toPandas()
    if sample.empty:
        points = np.zeros((0, 1), np.float32)
    else:
        points = on_sphere(np.stack(sample["embedding"].to_list()), longest)
    n, rng = nodes.count(), np.random.default_rng(11)
    leaf = max(16, int(len(points) * plan.block / max(n, 1)))
    forest = nodes.sparkSession.sparkContext.broadcast([grown_tree(points, leaf, rng) for _ in range(plan.trees)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = on_sphere(np.array(batch.column("embedding").to_pylist(), np.float64), longest)
            found = np.stack([leaves(t, x) for t in forest.value], 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()),
                pa.array(found.tolist(), pa.list_(pa.int64()))], ["id", "unit", "leaves"])

    placed = settled(nodes.select("id", "embedding").mapInArrow(place, "id long, unit binary, leaves array<long>"), "placed")
    rows = placed.select("id", "unit", F.posexplode("leaves").alias("tree", "leaf"))
    rows = rows.select("id", "unit", "tree", F.xxhash64("tree", "leaf").alias("block"))
    return settled(split_by_planes(rows, plan, kind), "blocks"), kind


def top_of(scores: np.ndarray, k: int) -> np.ndarray:
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if k else np.zeros((len(scores), 0), int)


EDGES = "a long, b long, score float"


def first_graph(placed: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """Best neighbours of every node within its blocks."""

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["id"].to_numpy()
        x = unpacked(frame["unit"], kind)
        out = []
        for at in range(0, len(ids), 1000):
            scores = x[at:at + 1000] @ x.T
            scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
            best = top_of(scores, min(plan.neighbours, len(ids) - 1))
            out.append(pd.DataFrame({
                "a": np.repeat(ids[at:at + 1000], best.shape[1]), "b": ids[best].ravel(),
                "score": np.take_along_axis(scores, best, 1).ravel()}))
        return pd.concat(out)

    return merged(None, placed.select("block", "id", "unit").groupBy("block").applyInPandas(within, EDGES), plan, 0)


def merged(graph: DataFrame | None, found: DataFrame, plan: Plan, round_: int) -> DataFrame:
    """The graph with found edges: ``a, near`` (array of score, b, new), best first."""
    found = found.select("a", "b", "score", F.lit(True).alias("new"))
    if graph is not None:
        found = found.unionByName(graph.select("a", F.inline("near")).select("a", "b", "score", "new"))
    pairs = found.groupBy("a", "b").agg(F.max("score").alias("score"), F.min("new").alias("new"))
    near = F.slice(F.sort_array(F.collect_list(F.struct("score", "b", "new")), False), 1, plan.neighbours)
    return settled(pairs.groupBy("a").agg(near.alias("near")), f"graph-{round_}")


def joined_neighbours(graph: DataFrame, placed: DataFrame, plan: Plan, kind: str, round_: int) -> DataFrame:
    """Pairs of neighbours of a common node that beat the worst neighbour of the first."""
    home = placed.filter("tree = 0").select("id", "block")
    ranked = graph.select("a", F.posexplode("near").alias("at", "e")).select("a", "e.b", "e.new", "at")
    by_kind = Window.partitionBy("a", "new").orderBy("at")
    chosen = ranked.withColumn("k", F.row_number().over(by_kind)).filter(F.col("k") <= plan.sample).select("a", "b", "new")
    chosen = settled(chosen, f"chosen-{round_}")
    turned = chosen.select(F.col("b").alias("a"), F.col("a").alias("b"), "new")
    some = Window.partitionBy("a", "new").orderBy(F.xxhash64("a", "b", F.lit(round_)), "b")
    turned = turned.withColumn("k", F.row_number().over(some)).filter(F.col("k") <= plan.sample).drop("k")
    edges = chosen.unionByName(turned).groupBy("a", "b").agg(F.max("new").alias("new"))
    edges = settled(edges.join(home, F.col("a") == F.col("id")).select("block", "a", "b", "new"), f"edges-{round_}")
    worst = graph.select(F.col("a").alias("id"), F.when(
        F.size("near") >= plan.neighbours, F.element_at("near", -1)["score"]).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    vectors = placed.filter("tree = 0").select("id", "unit").join(worst, "id")
    members = edges.select(F.col("block").alias("home"), F.col("b").alias("id")).distinct().join(vectors, "id")

    def join(edge: pd.DataFrame, member: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "score": np.zeros(0, np.float32)})
        if edge.empty or member.empty:
            return nothing
        member = member.sort_values("id")
        ids, bound = member["id"].to_numpy(), member["worst"].to_numpy()
        x = unpacked(member["unit"], kind)
        edge = edge.sort_values("a", kind="stable")
        at, new = np.searchsorted(ids, edge["b"].to_numpy()), edge["new"].to_numpy()
        cuts = np.flatnonzero(np.diff(edge["a"].to_numpy())) + 1
        parts: list[tuple] = []
        for rows, fresh in zip(np.split(at, cuts), np.split(new, cuts)):
            if len(rows) < 2 or not fresh.any():
                continue
            scores = x[rows] @ x[rows].T
            better = (scores > bound[rows][:, None]) & (fresh[:, None] | fresh[None, :])
            np.fill_diagonal(better, False)
            i, j = np.nonzero(better)
            parts.append((rows[i], rows[j], scores[i, j]))
        if not parts:
            return nothing
        a, b, score = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((b, -score, a))
        a, b, score = a[order], b[order], score[order]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, score = a[keep], b[keep], score[keep]
        first = np.searchsorted(a, a)
        keep = np.arange(len(a)) - first < plan.neighbours
        return pd.DataFrame({"a": ids[a[keep]], "b": ids[b[keep]], "score": score[keep]})

    return edges.groupBy("block").cogroup(members.groupBy("home")).applyInPandas(join, EDGES)


def seen(graph: DataFrame, plan: Plan) -> DataFrame:
    """The graph after a round: the new edges that it sampled are old."""
    fresh = F.filter("near", lambda e: e["new"])
    used = F.transform(F.slice(fresh, 1, plan.sample), lambda e: e["b"])
    near = F.transform("near", lambda e: F.struct(
        e["score"].alias("score"), e["b"].alias("b"), (e["new"] & ~F.array_contains(F.col("used"), e["b"])).alias("new")))
    return graph.withColumn("used", used).select("a", near.alias("near"))


def neighbour_graph(nodes: DataFrame, plan: Plan) -> DataFrame:
    """``a, near``: every node's best neighbours found, best first; nodes alone have no row."""
    placed, kind = placed_nodes(nodes, plan)
    graph, round_ = first_graph(placed, plan, kind), 0
    while True:
        round_ += 1
        found = joined_neighbours(graph, placed, plan, kind, round_)
        graph = merged(seen(graph, plan), found, plan, round_)
        fresh, all_ = graph.agg(F.sum(F.size(F.filter("near", lambda e: e["new"]))), F.sum(F.size("near"))).first()
        if not all_ or fresh / all_ < plan.settled_share:
            return graph


def scored(pairs: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """``q, id, score``: inner products of the original vectors, sent as ``kind`` components and
    added up in double precision."""

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("u", "v"))
            score = np.einsum("ij,ij->i", u.astype(np.float64), v.astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("id"), pa.array(score)], ["q", "id", "score"])

    vector = F.col("embedding").cast(f"array<{kind}>")
    ends = pairs.join(nodes.select("id", vector.alias("v")), "id").join(
        nodes.select(F.col("id").alias("q"), vector.alias("u")), "q")
    return ends.select("q", "id", "u", "v").mapInArrow(dot, "q long, id long, score double")


def searched(starts: DataFrame, graph: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """``q, best``: nodes of the query nodes ``q``'s beam, found greedily along the graph.

    Each step expands all nodes of a beam that are not expanded yet, for all queries at once; a
    search ends when its whole beam is. Where norms differ, the largest inner products are mostly
    those of long vectors, far from the query's own place: a search then starts at the longest, too.
    """
    links = graph.select("a", F.transform("near", lambda e: e["b"]).alias("near"))
    first = starts.select("q", F.col("q").alias("id"))
    if longest_norm(nodes):
        long_ = nodes.select("id", norm().alias("norm")).orderBy(F.desc("norm"), "id").limit(plan.beam).select("id")
        first = first.unionByName(starts.select("q").crossJoin(long_)).distinct()
    state, fresh, step = None, first, 0
    while True:
        new = scored(fresh, nodes, "float").groupBy("q").agg(F.collect_list(F.struct("score", "id")).alias("found"))
        order = lambda c: F.slice(F.array_sort(c, lambda x, y: F.when(x["score"] > y["score"], -1).when(
            x["score"] < y["score"], 1).when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)), 1, plan.beam)
        none = F.array().cast("array<bigint>")
        if state is None:
            state = new.select("q", order("found").alias("beam"), F.transform("found", lambda e: e["id"]).alias("known"), none.alias("done"))
        else:
            met = F.transform(F.coalesce("found", F.array()), lambda e: e["id"])
            state = state.join(new, "q", "left").select(
                "q", order(F.concat("beam", F.coalesce("found", F.array().cast("array<struct<score:double,id:bigint>>")))).alias("beam"),
                F.array_union("known", met).alias("known"), "done")
        todo = F.array_except(F.transform("beam", lambda e: e["id"]), F.col("done"))
        state = settled(state.select("q", "beam", "known", todo.alias("todo"), F.array_union("done", todo).alias("done")), f"beam-{step}")
        step += 1
        front = state.select("q", F.explode("todo").alias("a")).join(links, "a")
        met = front.select("q", F.explode("near").alias("id")).distinct().groupBy("q").agg(F.collect_list("id").alias("met"))
        fresh = settled(state.select("q", "known").join(met, "q").select(
            "q", F.explode(F.array_except("met", "known")).alias("id")), f"fresh-{step}")
        if fresh.isEmpty():
            return state.select("q", "beam")


def nearest(vectors: DataFrame, queries: DataFrame, plan: Plan | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: nearest vectors found for each query, nearest first.

    ``vectors`` has ``vec_id`` and ``embedding``; ``queries`` has ``vec_id`` of rows among them,
    which are not their own candidates. Ties go to the smaller ``vec_id``. Vectors that are null,
    zero, or hold null or non-finite components, or are not of the most common length, take no
    part; nor do null identifiers. Rows that repeat identifier and vector count once. Equal
    vectors are one node of the graph, however many there are. Fewer candidates than results
    give all of them; an empty table gives an empty result; other columns are not looked at.
    """
    plan = plan or Plan()
    valid = usable(vectors)
    nodes = nodes_of(valid, plan.results)
    graph = neighbour_graph(nodes, plan)
    asked = settled(valid.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").distinct().join(
        nodes.select("embedding", F.col("id").alias("q")), "embedding").select(F.col("vec_id").alias("query_id"), "q"), "queries")
    found = searched(asked.select("q").distinct(), graph, nodes, plan)
    # A query's own vector may stand first, so one node more than results can matter.
    exact = scored(found.select("q", F.explode("beam.id").alias("id")), nodes, "double")
    rows = exact.join(nodes.select("id", "members"), "id")
    rows = rows.select("q", "score", F.explode("members").alias("vec_id"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= plan.results + 1).drop("k")
    answers = asked.join(rows, "q").filter("vec_id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= plan.results)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
