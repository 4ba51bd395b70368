"""Training-data pipeline: classify, clean lines, drop near copies, mix, pack."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formsift.llm import line_dedup, mixing, ngram_join, packing, quality
from formsift.llm.common import settled, table, word_count

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_row(docs: DataFrame, *columns: str) -> DataFrame:
    """Some columns, and the rest of the row aside (all of it but the text, if that is among them), so
    that no column of a stage can take another's place."""
    return docs.select(*columns, F.struct(*[c for c in docs.columns if c != "text" or c not in columns]).alias("_row"))


def _row_again(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` out of ``_row``, but for the ``new`` ones."""
    return [new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept; learned from ``labels`` and the stage's texts."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.score_quality(_with_row(docs, "doc_id", "text"), labels).filter("predicted = 1").select(
        *_row_again(docs, text=F.col("text")))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that spread over many sources."""
    cleaned = line_dedup.drop_boilerplate(_with_row(docs, "doc_id", "text", "source"))
    return cleaned.select(*_row_again(docs, text=F.col("text"), n_chars=F.length("text").cast("long")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest identifier."""
    groups = ngram_join.similar_components(docs)
    others = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time; one that is in service when the
    budget ends is taken if at least half of its words are. Rows that the mix cannot tell apart, with
    one identifier, source and size, share in turn what it takes of them."""
    mix = mixing.in_order(mixing.mixture(docs))
    key = lambda size: F.struct("doc_id", "source", size.alias("size")).alias("_key")
    taken = mix.groupBy(key(F.col("size"))).agg(F.count_if(F.col("taken") * 2 >= F.col("size")).alias("_times")).filter("_times > 0")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key(word_count(F.col("text"))))
    alike = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    met = rows.join(taken, "_key").join(alike, "_key", "left")
    among = F.coalesce("_rows", F.lit(1))
    turn = F.row_number().over(Window.partitionBy("_key").orderBy("_row.text"))
    times = met.withColumn("_turns", (F.floor(F.col("_times") / among) + F.when(turn <= F.col("_times") % among, 1).otherwise(0)).cast("int"))
    repeated = times.filter("_turns > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_turns"))).alias("_turn"))
    return repeated.select("_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good), ("line_dedup", clean_lines), ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources), ("best_fit_packing", pack_sequences),
]

#: The classifier and the packing cannot be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
