"""Queries that measure the final record: all readings and all pages of a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions import fields, text
from formsift.operators import pages, quality
from formsift.plans import duck as D
from formsift.plans.field_queries import DUCK_RATES  # noqa: F401  registers the bodies used below
from formsift.plans.flows import final_records
from formsift.plans import quality_queries, reading_queries  # noqa: F401
from formsift.plans.registry import BODIES, query
from formsift.sources.fixtures import derived

c = F.col

_AUDIT = ", ".join(pages.AUDIT_COLUMNS)
_RECORD = f"""
reconciled AS MATERIALIZED ({BODIES["h7_adjudication"]}),
audited AS ({BODIES["h8_verification_audit"]}),
record_pages AS MATERIALIZED (SELECT doc_id, page_no, field, {D.auto_format('field', 'value')} AS value, status, verified, {_AUDIT} FROM (
  SELECT doc_id, page_no, field, value, status, verified, {_AUDIT} FROM fx_page_values
  WHERE page_no > 1 OR (doc_id, field) NOT IN (SELECT (doc_id, field) FROM reconciled)
  UNION ALL SELECT doc_id, 1, field, r.value, r.status, r.verified, a.status, a.reason, a.attempted, a.completed
  FROM reconciled r LEFT JOIN audited a USING (doc_id, field)) u),
record AS MATERIALIZED (SELECT * REPLACE ({D.auto_format('field', 'value')} AS value) FROM ({BODIES["d1_page_merge"].replace("fx_page_values", "record_pages")}) m)"""
_RECORD_EVAL = f"""{_RECORD},
truths AS (SELECT DISTINCT doc_id, field, truth AS reference FROM fx_readings
  UNION ALL SELECT doc_id, '{S.CHILD_FIO}', surname || ' ' || first_name || ' ' || patronymic FROM fx_person),
record_eval AS MATERIALIZED (SELECT t.doc_id AS case_id, field, reference, coalesce(value, '') AS predicted, coalesce(status, '') AS status,
  coalesce(verified, false) AS verified, {_AUDIT} FROM truths t LEFT JOIN record USING (doc_id, field))"""


def _with(tables: str, body: str) -> str:
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opening):
            return f"{opening}{tables},\n{body[len(opening):]}"
    return f"WITH {tables}\n{body}"


def _over_records(name: str) -> str:
    """The check of a query over one reading, put to the final record."""
    return _with(_RECORD_EVAL, BODIES[name].replace("fx_eval", "record_eval"))


def _records(spark, sf):
    return final_records(derived(spark, sf, "fx_readings"), derived(spark, sf, "fx_page_values")).withColumnRenamed("doc_id", "case_id")


def record_eval(spark, sf):
    """Labels against the final record."""
    known = derived(spark, sf, "fx_readings").select(c("doc_id").alias("case_id"), "field", c("truth").alias("reference")).distinct()
    names = derived(spark, sf, "fx_person").select(
        c("doc_id").alias("case_id"), F.lit(S.CHILD_FIO).alias("field"),
        F.concat_ws(" ", "surname", "first_name", "patronymic").alias("reference"))
    return quality.label_records(known.unionByName(names), _records(spark, sf).withColumnRenamed("value", "predicted"))


def _scored(spark, sf):
    return quality.score_fields(record_eval(spark, sf))


def _aligned(spark, sf):
    return quality.aligned_digits(record_eval(spark, sf))


@query("c8_record_predictions", _with(_RECORD, """
SELECT l.doc_id AS case_id, l.field, l.value AS reference, coalesce(r.value, '') AS predicted, coalesce(r.status, '') AS status, coalesce(r.verified, false) AS verified
FROM fx_fields l LEFT JOIN record r USING (doc_id, field)"""))
def c8_record_predictions(spark, sf):
    labels = derived(spark, sf, "fx_fields").select(c("doc_id").alias("case_id"), "field", c("value").alias("reference"))
    return quality.label_records(labels, _records(spark, sf).select(
        "case_id", "field", c("value").alias("predicted"), "status", "verified"))


@query("d5_record_case_quality", _over_records("d5_case_quality"))
def d5_record_case_quality(spark, sf):
    return quality_queries._rounded(quality.case_quality(_scored(spark, sf)), "mean_cer", "mean_wer")


@query("d6_record_corpus_quality", _over_records("d6_corpus_quality"))
def d6_record_corpus_quality(spark, sf):
    return quality_queries._rounded(quality.corpus_quality(_scored(spark, sf)), "mean_cer", "mean_wer")


@query("d7_record_field_quality", _over_records("d7_field_quality"))
def d7_record_field_quality(spark, sf):
    return quality_queries._rounded(quality.field_quality(_scored(spark, sf)), "false_rate", "review_rate")


@query("d8_record_confusion_matrix", _over_records("d8_confusion_matrix"))
def d8_record_confusion_matrix(spark, sf):
    return quality.confusion_matrix(_aligned(spark, sf))


@query("d9_record_position_errors", _over_records("d9_position_errors"))
def d9_record_position_errors(spark, sf):
    return quality.position_errors(_aligned(spark, sf))


@query("d10_record_skip_reasons", _over_records("d10_skip_reasons"))
def d10_record_skip_reasons(spark, sf):
    return quality.skip_reasons(record_eval(spark, sf))


@query("d11_record_verification_totals", _over_records("d11_verification_totals"))
def d11_record_verification_totals(spark, sf):
    return quality.verification_totals(record_eval(spark, sf))


@query("g8_record_levenshtein", _over_records("g8_levenshtein"))
def g8_record_levenshtein(spark, sf):
    return record_eval(spark, sf).select("case_id", "field", F.levenshtein(
        text.metric_norm(c("reference")), text.metric_norm(c("predicted"))).alias("distance"))


@query("g25_record_metric_value", _over_records("g25_metric_value"))
def g25_record_metric_value(spark, sf):
    return record_eval(spark, sf).select(
        "case_id", "field", fields.metric_value(c("field"), c("reference")).alias("expected"),
        fields.metric_value(c("field"), c("predicted")).alias("predicted"))


@query("g26_record_cer_wer", _over_records("g26_cer_wer"))
def g26_record_cer_wer(spark, sf):
    return quality_queries._rounded(_scored(spark, sf).select("case_id", "field", "cer", "wer"), "cer", "wer")


@query("h4_record_digit_alignment", _over_records("h4_digit_alignment"))
def h4_record_digit_alignment(spark, sf):
    return _aligned(spark, sf).groupBy("field", "reference", "predicted", "position").agg(F.sum("n").alias("n"))


@query("j3_record_align_udtf", _over_records("j3_align_udtf"))
def j3_record_align_udtf(spark, sf):
    aligned = quality.alignments(quality.numeric_pairs(record_eval(spark, sf)))
    return aligned.groupBy("field", "reference", "predicted", "position").agg(F.sum("n").alias("n"))
