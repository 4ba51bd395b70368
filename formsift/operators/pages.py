"""From the pages of a document to one record.

Page values: ``doc_id, page_no, field_ord, field, value, status, source, verified,
audit_status, audit_reason, attempted, completed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions import text

AUDIT_COLUMNS = ["audit_status", "audit_reason", "attempted", "completed"]


def _page(value: Column) -> Column:
    return F.struct("page_no", value.alias("value"), "status", "source", "verified", *AUDIT_COLUMNS)


def _chosen(df: DataFrame) -> DataFrame:
    """The page whose value stands for each (doc_id, field), by conditional aggregates only."""
    value = text.strip(F.col("value"))
    page = _page(value)
    filled = value != ""
    solid = filled & ~text.is_unclear(value)
    grouped = df.groupBy("doc_id", "field").agg(
        F.min(F.when(F.col("page_no") == 1, page)).alias("first_page"),
        F.min(F.when(filled, page)).alias("first_filled"),
        F.min(F.when(solid, page)).alias("first_solid"),
        F.min(F.when(solid & (F.col("status") == "read"), page)).alias("first_read"),
        F.min(F.when(solid, value)).alias("lowest"),
        F.max(F.when(solid, value)).alias("highest"),
    )
    conflict = F.coalesce(F.col("lowest") != F.col("highest"), F.lit(False))
    chosen = (
        F.when(conflict, F.coalesce("first_read", "first_solid"))
        .otherwise(F.coalesce("first_solid", "first_filled"))
    )
    return grouped.withColumns({"conflict": conflict, "chosen": chosen})


def merge_pages(df: DataFrame) -> DataFrame:
    """One row per (doc_id, field): value, status, page, audit; conflicts are only flagged."""
    out = _chosen(df)
    chosen, solid = F.col("chosen"), F.col("first_solid").isNotNull()
    status = F.when(solid & ~F.col("conflict"), chosen["status"]).otherwise("needs_review")
    # A field without any value takes the audit of page 1.
    audit_page = F.coalesce(chosen, F.col("first_page"))

    def audit(name: str, default: str | int) -> Column:
        return F.coalesce(audit_page[name], F.lit(default)).alias(name)

    return out.select(
        "doc_id", "field", F.coalesce(chosen["value"], F.lit("")).alias("value"),
        status.alias("status"), F.coalesce(chosen["source"], F.lit("page")).alias("source"),
        F.coalesce(chosen["page_no"], F.lit(1)).alias("page_no"),
        (F.coalesce(audit_page["verified"], F.lit(False)) & (status == "read")).alias("verified"),
        F.when(F.col("conflict"), S.NOTE_PAGES_DIFFER).otherwise("").alias("note"),
        F.col("conflict"),
        audit("audit_status", "skipped"), audit("audit_reason", "multipage_disabled"),
        audit("attempted", 0), audit("completed", 0),
    )


def page_conflicts(df: DataFrame) -> DataFrame:
    """Page values that lost against a different chosen value, one row each."""
    chosen = _chosen(df).filter("conflict").select(
        "doc_id", "field", F.col("chosen.value").alias("chosen_value")
    )
    value = text.strip(F.col("value"))
    return (
        df.withColumn("value", value).filter((value != "") & ~text.is_unclear(value))
        .join(chosen, ["doc_id", "field"]).filter("value <> chosen_value")
        .select("doc_id", "field", "page_no", "value", "status")
    )


def field_union(df: DataFrame) -> DataFrame:
    """Fields of a document in the order of first appearance over its pages."""
    place = F.min(F.struct("page_no", "field_ord")).alias("place")
    return df.groupBy("doc_id", "field").agg(place).select(
        "doc_id", "field", F.col("place.page_no").alias("first_page"),
        F.col("place.field_ord").alias("first_ord"),
    )


def merge_stats(df: DataFrame) -> DataFrame:
    """Sums of the additive statistics, last non-empty value of the others."""

    def last(name: str, present: Column) -> Column:
        return F.max_by(F.when(present, F.col(name)), F.when(present, F.col("page_no")))

    return df.groupBy("doc_id").agg(
        F.sum("requests").alias("requests"),
        F.sum("tokens_total").alias("tokens_total"),
        F.round(F.sum("elapsed"), 2).alias("elapsed"),
        F.coalesce(last("backend", text.blank_to_empty(F.col("backend")) != ""), F.lit("")).alias("backend"),
        F.coalesce(last("model", text.blank_to_empty(F.col("model")) != ""), F.lit("")).alias("model"),
        F.coalesce(last("speed", F.col("speed") > 0), F.lit(0.0)).alias("speed"),
    )


def page_ok(error: Column, n_fields: Column) -> Column:
    return (text.blank_to_empty(error) == "") & (n_fields > 0)


def document_gate(df: DataFrame) -> DataFrame:
    """Per document: are all pages readable, and which page failed first."""
    ok = page_ok(F.col("error"), F.col("n_fields"))
    return df.groupBy("doc_id").agg(
        F.bool_and(ok).alias("accepted"), F.min(F.when(~ok, F.col("page_no"))).alias("bad_page")
    )


def accepted_pages(df: DataFrame) -> DataFrame:
    """Pages of documents without a failed page."""
    return df.join(document_gate(df).filter("accepted").select("doc_id"), "doc_id", "left_semi")
