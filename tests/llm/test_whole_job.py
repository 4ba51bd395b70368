"""Bounds and results that hold for tables of any size and kind."""

import numpy as np

from formsift.llm import neighbours, suffix_dedup
from tests.llm.test_operators import brute_nearest, brute_repeats, table_of


def test_chance_hits_of_the_filter_do_not_enlarge_a_group(spark, monkeypatch):
    """40 copies of a passage are three contexts of an anchor, whatever the filter lets by."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = word(400)
    rows = [(i, passage, "a") for i in range(40)] + [(100, passage[:300] + word(200), "a"), (101, word(200) + passage[100:], "a")] + [(0, passage, "a")] * 5

    class Bounded(suffix_dedup.Block):
        def add(self, group):
            assert len(group) <= 3, len(group)
            super().add(group)

    monkeypatch.setattr(suffix_dedup, "FILTER_BITS", 32)
    monkeypatch.setattr(suffix_dedup, "Block", Bounded)
    got = suffix_dedup.drop_repeats(table_of(spark, rows)).collect()
    once = [r for k, r in enumerate(rows) if k < 42]
    assert {tuple(r)[:5] for r in got} == set(brute_repeats(once, 100)) and len(got) == len(rows)


def recall(spark, rows, plan=None):
    table = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, table.filter("vec_id % 20 = 0"), plan).collect()
    want = brute_nearest(rows, [i for i, _ in rows if i % 20 == 0], 20)
    return sum(len({r.vec_id for r in got if r.query_id == q} & set(want[q])) for q in want) / (20 * len(want))


def test_recall_for_unequal_norms(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(2000, 8)) * rng.lognormal(0, 1, (2000, 1))
    assert recall(spark, [(i, v.tolist()) for i, v in enumerate(vectors)], neighbours.Plan(neighbours=20, block=100, beam=25)) >= 0.9


def test_large_leaves_are_split_by_place(spark):
    """One leaf holds all nodes; blocks are bounded, and hold near nodes."""
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(16, 8))
    vectors = middles[np.arange(1600) % 16] + 0.05 * rng.normal(size=(1600, 8))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))], "id long, embedding array<double>")
    placed = neighbours.placed_nodes(nodes, neighbours.Plan(trees=2, block=60, tree_sample=16))
    blocks = {}
    for r in (placed[0] if isinstance(placed, tuple) else placed).collect():
        blocks.setdefault((r.tree, r.block), []).append(r.id % 16)
    assert max(map(len, blocks.values())) <= 120
    assert sum(len(set(b)) for b in blocks.values()) / len(blocks) < 6
