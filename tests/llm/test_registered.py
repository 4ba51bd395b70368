"""The registered queries without SQL, over the whole smallest tables, against brute force."""

import hashlib
import math
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from formsift.llm import catalog, fingerprint, mixing, quality, token_prefix
from tests.conftest import SF_DIR
from tests.llm.test_operators import PIECES, WORDS, brute_components, brute_repeats


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def run(spark, name):
    return catalog.QUERIES[name](spark, SF_DIR).collect()


def test_op3_components(spark, documents):
    got = {r.doc_id: r.component_id for r in run(spark, "op3_ngram_join")}
    assert got == {d: root for d, _, root in brute_components(documents)}


def test_op6_repeats(spark, documents):
    got = sorted(tuple(r)[:5] for r in run(spark, "op6_suffix_dedup"))
    assert got == sorted(brute_repeats(documents, 100))


def test_op8_pieces(spark, documents):
    library = Tokenizer.from_file(WORDS)
    want = {}
    for d, text, _ in documents:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[d, piece] = at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())
    rows = run(spark, "op8_best_fit_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    total = sum(r.length for r in rows)
    assert max(sequences.values()) <= 4096 and len(sequences) <= math.ceil(total / 4096) + 1


def test_op9_counts(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {d: t or "" for d, t, _ in documents}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op9_token_counts")}
    counts = dict(zip(texts, map(len, library.encode(list(texts.values()), num_threads=1))))
    assert got == {d: (len(t.encode()), counts[d], counts[d] > 4096) for d, t in texts.items()}


def test_op9_after_characters_of_no_piece():
    """Characters that become bytes inside words, and marks of the text's own, at every prefix."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = token_prefix.PrefixCounter(PIECES)
    rng = np.random.default_rng(4)
    pool = [*"abc the in  \n\t.,", "▁", " ▁", "鷄", "鬱", "Ǆ", "ǅenana", "日本語の漢字", " the", "\xa0", "😀", "\x00"]
    texts = ["日本語の漢字", "中国鷄肉", "鬱陶しい", "Ǆenana", " the", "▁ \xa0"]
    texts += ["".join(rng.choice(pool, rng.integers(1, 14))) for _ in range(1500)]
    for text, steps in zip(texts, counter.many(texts)):
        for end in {len(text), len(text) // 2, 1}:
            assert int(steps[:end].sum()) == len(library.encode(text[:end])), text[:end]


def test_op10_edited_texts(spark, documents):
    texts = sorted((d, t or "") for d, t, _ in documents)
    rows = {r.doc_id: r for r in run(spark, "op10_fingerprints")}
    assert len(rows) == len(texts)
    for (d, text), (e, other) in zip(texts, texts[1:] + texts[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half] if half else text
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (text != other or r.fingerprint == rows[e].fingerprint and r.near_next == 1)


def test_op5_scores_are_the_rules_replayed(spark):
    """The compiled column against the rules, one document and one rule at a time."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit_rules(quality.sample_labels(docs, labels, 8000))
    stats = {r.doc_id: r.stats for r in quality.with_statistics(docs).collect()}
    held = [(r.doc_id, r.held_out, r.score, r.predicted) for r in run(spark, "op5_quality")]
    assert len(held) == len(stats) and model.rules
    for d, out, score, predicted in held:
        holds = lambda rule: all(stats[d][n] <= v if upper else stats[d][n] > v for n, upper, v in rule)  # noqa: B023, E731
        total = model.intercept + sum(w for rule, w in model.rules if holds(rule))
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9) and predicted == (score >= 0.7)
        assert out == (zlib.crc32(str(d).encode()) % 4 == 2)


@pytest.mark.parametrize("partitions", ["3", "16"])
def test_op10_rows_of_one_identifier_follow_each_other_by_text(spark, partitions):
    rng = np.random.default_rng(6)
    rows = [(i % 5, "".join(rng.choice(list("abcé😀"), rng.integers(0, 90)))) for i in range(120)]
    rows += [(2, "x" * 80 + str(k)) for k in range(9)] + [(2, None), (None, "n1"), (None, "n0")]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = []
    for (d, text), (_, other) in zip(order, order[1:] + order[:1]):
        text, other = text or "", other or ""
        half = len(text) // 2
        want.append((d, hashlib.sha256((text[:len(text) - half] + other[:half] if half else text).encode()).hexdigest()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)


def test_pipeline_keeps_columns_of_any_name_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    clashes = ["size", "score", "predicted", "held_out", "stats", "n_lines", "n_removed", "taken", "component_id", "_key", "_times"]
    docs = docs.withColumns({c: F.col("doc_id") + 1000 for c in clashes})
    docs = docs.unionByName(docs.filter("doc_id % 9 = 0")).unionByName(
        docs.filter("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(
        docs.filter("doc_id = 1").withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settled(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns, name
        assert docs.filter("doc_id >= 0").filter(" or ".join(f"{c} is null or {c} <> doc_id + 1000" for c in clashes)).count() == 0, name
    mixed = docs.groupBy("doc_id", "source").count()
    assert mixed.count() > 50 and corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).filter("piece = 0").count() == docs.count()


def test_pipeline_takes_alike_rows_as_often_as_the_mix(spark):
    """Three alike rows of a source that is served one and a half times."""
    rows = [(7, "a b c d", "small")] * 3 + [(i, "w " * 40, f"s{i}") for i in range(3)]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    mix = mixing.in_order(mixing.mixture(docs)).filter("taken * 2 >= size")
    want = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    got = {r.doc_id: r["count"] for r in corpus_pipeline.mix_sources(spark, docs, SF_DIR).groupBy("doc_id").count().collect()}
    assert got == want
