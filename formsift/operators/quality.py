"""Extraction quality against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formsift.functions import fields, metrics, text
from formsift.functions.align import aligned_pairs
from formsift.operators.stages import computed
from formsift.schema import GAP, MATRIX_SYMBOLS


def label_predictions(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every labelled field with its prediction; a missing one is blank and unverified."""
    return _filled(labels.join(predictions, ["case_id", "field"], "left"))


def label_records(labels: DataFrame, records: DataFrame) -> DataFrame:
    """``label_predictions`` for records, which have one row per (case_id, field).

    Labels and records are put one below the other and meet within a field. Where both are dealt by
    case alike, nothing is shuffled or broadcast.
    """
    names = [name for name in records.columns if name not in ("case_id", "field")]
    answers = records.select("case_id", "field", F.struct(*names).alias("_answer"))
    both = labels.withColumn("_label", F.lit(True)).unionByName(answers, allowMissingColumns=True)
    met = both.withColumn("_answer", F.max("_answer").over(Window.partitionBy("case_id", "field"))).filter("_label")
    return _filled(met.select(*labels.columns, "_answer.*"))


def _filled(joined: DataFrame) -> DataFrame:
    return joined.withColumns({
        "predicted": text.blank_to_empty(F.col("predicted")),
        "status": text.blank_to_empty(F.col("status")),
        "verified": F.coalesce("verified", F.lit(False)),
    })


def score_fields(eval_fields: DataFrame) -> DataFrame:
    """Error rates and flags per (case_id, field)."""
    normed = eval_fields.withColumns({
        "expected": fields.metric_value(F.col("field"), F.col("reference")),
        "answer": fields.metric_value(F.col("field"), F.col("predicted")),
    })
    exact = F.col("expected") == F.col("answer")
    confirmed = F.col("verified") & (F.col("status") == "read")
    return normed.withColumns({
        "cer": metrics.cer(F.col("expected"), F.col("answer")),
        "wer": metrics.wer(F.col("expected"), F.col("answer")),
        "exact": exact,
        "confirmed": confirmed,
        "false_confirmed": confirmed & ~exact,
    })


def case_quality(scored: DataFrame) -> DataFrame:
    return scored.groupBy("case_id").agg(
        F.avg("cer").alias("mean_cer"), F.avg("wer").alias("mean_wer"),
        F.count_if("exact").alias("exact_fields"), F.count("*").alias("field_count"),
    )


def corpus_quality(scored: DataFrame) -> DataFrame:
    """Totals and the mean of the per-case means."""
    return corpus_totals(case_quality(scored))


def corpus_totals(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.sum("exact_fields").alias("exact_fields"), F.sum("field_count").alias("field_count"),
        F.avg("mean_cer").alias("mean_cer"), F.avg("mean_wer").alias("mean_wer"),
        F.count("*").alias("cases"),
    )


def field_quality(scored: DataFrame) -> DataFrame:
    counts = scored.groupBy("field").agg(
        F.count_if("exact").alias("exact"), F.count("*").alias("total"),
        F.count_if("confirmed").alias("verified"),
        F.count_if("false_confirmed").alias("false_verified"),
        F.count_if(~F.col("confirmed")).alias("needs_review"),
    )
    return field_rates(counts)


def field_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "false_rate": F.try_divide("false_verified", "verified"),
        "review_rate": F.col("needs_review") / F.col("total"),
    })


def numeric_pairs(eval_fields: DataFrame) -> DataFrame:
    """Distinct (field, ref, pred) digit strings of numeric fields with their counts."""
    ref = text.digits_only(fields.metric_value(F.col("field"), F.col("reference")))
    pred = text.digits_only(fields.metric_value(F.col("field"), F.col("predicted")))
    return (
        eval_fields.filter(fields.is_numeric_field(F.col("field")))
        .select("field", ref.alias("ref"), pred.alias("pred"))
        .groupBy("field", "ref", "pred").agg(F.count("*").alias("n"))
    )


def aligned_digits(eval_fields: DataFrame) -> DataFrame:
    """Aligned digits ``field, reference, predicted, position, n``.

    When two strings of one length have as many differing positions as their edit distance,
    the alignment is position by position. The rest, distinct pairs with an inserted or lost
    digit, get the whole table. Both stay in the JVM.
    """
    pairs = numeric_pairs(eval_fields)
    straight = F.when(
        F.length("ref") == F.length("pred"),
        metrics.hamming(F.col("ref"), F.col("pred")) == F.levenshtein("ref", "pred"),
    ).otherwise(False)
    # Staged, so that the test runs on the distinct pairs and not below the aggregation.
    marked = computed(pairs, {"straight": straight})
    by_position = F.transform(
        F.split("ref", ""),
        lambda r, i: F.struct(
            r.alias("reference"), F.substr("pred", i + 1, F.lit(1)).alias("predicted"),
            (i + 1).alias("position"),
        ),
    )
    # Both branches filter above the stage only, so that they share the exchange of the pairs.
    shown = F.when(F.col("ref") != "", by_position)
    plain = marked.filter("straight").select("field", "n", F.inline(shown))
    return plain.unionByName(alignments(marked.filter("NOT straight")))


def alignments(pairs: DataFrame) -> DataFrame:
    """Aligned digits of ``field, ref, pred, n``, all by the whole table."""
    return aligned_pairs(pairs, "ref", "pred", "_way").select("field", "n", F.inline("_way"))


def confusion_counts(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("reference", "predicted").agg(F.sum("n").alias("n"))


def confusion_matrix(aligned: DataFrame) -> DataFrame:
    """Dense matrix: one row per reference symbol, one column per predicted symbol."""
    def column(symbol: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("predicted") == symbol, F.col("n"))), F.lit(0)).alias(
            f"pred_{'gap' if symbol == GAP else symbol}"
        )

    # Zero rows keep the matrix dense without a join.
    spark = aligned.sparkSession
    zeros = spark.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in MATRIX_SYMBOLS])).alias("reference"),
        F.lit(None).cast("string").alias("predicted"), F.lit(0).cast("long").alias("n"),
    )
    counted = confusion_counts(aligned).unionByName(zeros)
    return counted.groupBy("reference").agg(*[column(s) for s in MATRIX_SYMBOLS])


def position_errors(aligned: DataFrame) -> DataFrame:
    return (
        aligned.filter("reference <> predicted")
        .groupBy("field", "position", "reference", "predicted").agg(F.sum("n").alias("n"))
    )


def skip_reasons(eval_fields: DataFrame) -> DataFrame:
    return (
        eval_fields.filter(text.blank_to_empty(F.col("audit_reason")) != "")
        .groupBy("audit_status", "audit_reason").agg(F.count("*").alias("n"))
    )


def verification_totals(eval_fields: DataFrame) -> DataFrame:
    return eval_fields.agg(
        F.sum("attempted").alias("attempted"), F.sum("completed").alias("completed")
    )


def run_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.sum("elapsed").alias("elapsed"), F.sum("requests").alias("requests"))


def first_cases(cases: DataFrame, n: int) -> DataFrame:
    """First ``n`` distinct cases by name (a top-n, so only ``n`` rows leave each task)."""
    return cases.select("case_id").distinct().orderBy("case_id").limit(n)
