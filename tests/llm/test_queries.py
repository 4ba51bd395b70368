"""The registered queries against DuckDB, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from formsift.llm import catalog
from tests.conftest import SF_DIR
from tests.llm.test_operators import brute_components, brute_lines
from tools.check import compare, duck

DOCUMENTS = ["doc_id", "lang", "n_chars", "source", "text"]


def test_every_operator_is_registered():
    names = driver.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(catalog.CHECKS))
def test_query_equals_its_check(spark, name):
    message, _, same = compare(spark, duck(SF_DIR), SF_DIR, name, catalog)
    assert same, message


def test_pipeline_keeps_the_shape_and_takes_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        docs = corpus_pipeline.settled(stage(spark, docs, SF_DIR), name)
        assert sorted(docs.columns) == DOCUMENTS
        left = sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "line_dedup":
            assert left == sorted(brute_lines(rows, 5))
        if name == "ngram_jaccard_join":
            heads = {d for d, _, root in brute_components(rows) if d == root}
            assert left == sorted((d, t) for d, t, _ in rows if d in heads)
        if name == "source_mixing":
            texts = {d: t for d, t, _ in rows}
            assert all(t == texts[d] for d, t in left) and max(left.count(x) for x in left) <= 3
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
            clean = labels.filter("quality = 1").join(docs, "doc_id", "left_anti").count()
            junk = labels.filter("quality = 0").join(docs, "doc_id", "left_semi").count()
            assert docs.count() < before and clean + junk <= 4
    mixed = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    pieces = packed.agg(F.count_if(F.col("piece") == 0)).first()[0]
    assert pieces == mixed
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.filter("n > 4096 or n <> end").count() == 0


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settled(stage(spark, docs, SF_DIR), name)
    assert docs.count() == 0
