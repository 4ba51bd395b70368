"""Whole data flows composed of the operators: one document set, one batch, one evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions import fields, names, text
from formsift.operators import canon, dictionary, duplicates, journal, pages, reconcile, responses
from formsift.session import settled
from formsift.sources.fixtures import derived


def surname_hints(records: DataFrame) -> DataFrame:
    """Parent names that differ from the child's surname in one letter: ``doc_id, field, hint``."""
    pair = records.filter(F.col("field").isin(S.CHILD_FIO, S.PARENT_FIO)).groupBy("doc_id").agg(
        F.max(F.when(F.col("field") == S.CHILD_FIO, F.col("value"))).alias("child"),
        F.max(F.when(F.col("field") == S.PARENT_FIO, F.col("value"))).alias("parent"),
    )
    hint = names.surname_suggestion(F.col("child"), F.col("parent"))
    return pair.select("doc_id", F.lit(S.PARENT_FIO).alias("field"), hint.alias("hint")).filter("hint IS NOT NULL")


def _with_hints(records: DataFrame) -> DataFrame:
    """Records with ``hint`` of ``surname_hints``, null where there is none."""
    def name_in(field: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col("value"))).over(Window.partitionBy("doc_id"))

    named = records.withColumns({"_child": name_in(S.CHILD_FIO), "_parent": name_in(S.PARENT_FIO)})
    hint = F.when(
        (F.col("field") == S.PARENT_FIO) & F.col("doc_id").isNotNull(), names.surname_suggestion(F.col("_child"), F.col("_parent")))
    return named.withColumn("hint", hint).drop("_child", "_parent")


def finish_records(records: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """After reconciliation: compare surnames, then format every value.

    ``records``: ``doc_id, field, value, status, verified, alternative``. Without ``hints`` the names
    are compared within each document, so that the records are computed once; pass ``hints`` of an earlier table to
    use those. A ``note`` column is passed on; a hint puts its own there. So are columns of an audit.
    """
    out = _with_hints(records) if hints is None else records.join(hints, ["doc_id", "field"], "left")
    hinted = F.col("hint").isNotNull()
    blank = text.blank_to_empty(F.col("alternative")) == ""
    return out.select(
        "doc_id", "field", fields.auto_format(F.col("field"), F.col("value")).alias("value"),
        F.when(hinted, "needs_review").otherwise(F.col("status")).alias("status"),
        (F.col("verified") & ~hinted).alias("verified"),
        F.when(hinted & blank, F.col("hint")).otherwise(F.col("alternative")).alias("alternative"),
        *[F.when(hinted, S.NOTE_SURNAMES_DIFFER).otherwise(F.col("note")).alias("note")] * ("note" in records.columns),
        *[name for name in pages.AUDIT_COLUMNS if name in records.columns],
    )


def final_records(readings: DataFrame, page_values: DataFrame) -> DataFrame:
    """The record a user gets: ``doc_id, field, value, status, verified`` and the audit columns.

    All readings of a field are reconciled and adjudicated; the result stands for the field on
    page 1. The values of all pages are formatted, merged and finished.
    """
    decided = reconcile.adjudicate(reconcile.multi_view(readings))
    status, reason = reconcile.audit_outcome(F.col("checks"), F.col("checks_done"))
    audit = dict(zip(pages.AUDIT_COLUMNS, (status, reason, F.col("checks"), F.col("checks_done"))))
    columns = ["doc_id", "field", "page_no", "value", "status", "source", "verified", *pages.AUDIT_COLUMNS]
    first_page = decided.withColumns({**audit, "page_no": F.lit(1), "source": F.lit("readings")}).select(
        *columns, F.lit(True).alias("_read"))
    both = page_values.select(*columns, F.lit(False).alias("_read")).unionByName(first_page)
    # What was read for a field stands in its place on page 1.
    was_read = F.max("_read").over(Window.partitionBy("doc_id", "field"))
    current = both.withColumn("_replaced", was_read).filter("_read OR NOT page_no <=> 1 OR NOT _replaced")
    formatted = current.withColumn("value", fields.auto_format(F.col("field"), F.col("value"))).select(columns)
    merged = pages.merge_pages(formatted).withColumn("alternative", F.lit(""))
    return finish_records(merged.select("doc_id", "field", "value", "status", "verified", "alternative", *pages.AUDIT_COLUMNS)).drop("alternative")


def answer_records(answers: DataFrame) -> DataFrame:
    """Raw model answers ``doc_id, raw, thinking`` to formatted standard fields.

    Documents whose answer cannot be read have no rows here; ``responses.answers_to_fields``
    reports them.
    """
    rows = responses.answers_to_fields(answers).filter("error IS NULL")
    named = canon.canonical_fields(canon.strip_internal(rows)).filter("value IS NOT NULL")
    return named.select(
        "doc_id", "field", fields.auto_format(F.col("field"), F.col("value")).alias("value")
    )


def checked_records(records: DataFrame, entries: DataFrame, corrections: DataFrame) -> DataFrame:
    """Records with dictionary corrections, formatting and suggestions.

    Address and passport words are replaced, names only get a suggestion that asks for review.
    ``records``: ``doc_id, field, value, status, verified, alternative``.
    """
    entries = settled(entries, "dictionary")
    texts = dictionary.rebuilt(
        records, dictionary.propose(dictionary.text_tokens(records), entries, corrections)
    )
    corrected = records.join(texts, ["doc_id", "field"], "left").withColumn(
        "value", F.coalesce("corrected", "value")
    ).drop("corrected")
    names_ = dictionary.rebuilt(
        records, dictionary.propose(dictionary.fio_tokens(records), entries, corrections)
    ).withColumnRenamed("corrected", "suggestion")
    # The dictionary leaves names alone here, so their hints come from the records as they were.
    return reconcile.attach_suggestions(finish_records(corrected, surname_hints(records)), names_)


def batch_journal(records: DataFrame, statuses: DataFrame) -> DataFrame:
    """Export journal of a batch: ``records`` doc_id, field, value; ``statuses`` doc_id, filename, review_status."""
    service = statuses.select("doc_id", F.inline(F.array(
        F.struct(F.lit(S.SOURCE_FILE).alias("field"), F.col("filename").alias("value")),
        F.struct(F.lit(S.REVIEW_STATUS).alias("field"), F.col("review_status").alias("value")),
    )))
    return journal.export_records(records.select("doc_id", "field", "value").unionByName(service))


def reviewed_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with duplicate counts and review status."""
    records = derived(spark, sf_dir, "fx_applications")
    found = duplicates.batch_duplicates(duplicates.application_keys(records))
    marked = duplicates.annotate(records.select("doc_id", "filename", "reviewer_confirmed"), found)
    return marked.withColumn(
        "review_status", canon.review_status(F.col("reviewer_confirmed"), F.col("n_duplicates") > 0)
    )


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many applications stand in each review status."""
    return reviewed_applications(spark, sf_dir).groupBy("review_status").agg(
        F.count("*").alias("applications"), F.sum(F.col("n_duplicates")).alias("duplicate_links")
    )
