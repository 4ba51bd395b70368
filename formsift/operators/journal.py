"""The export journal: reading, writing, appending, editing, summarising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions import text
from formsift.operators.ranking import BUCKETS, number_by_id
from formsift.session import settled

NO_DATA = "Нет данных"


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """CSV journal with a header; cells are text, fully blank rows are dropped."""
    rows = spark.read.option("header", True).option("multiLine", False).option("escape", '"').csv(path)
    cells = [text.blank_to_empty(F.col(f"`{c}`")).alias(c) for c in rows.columns]
    filled = F.exists(F.array(*[F.col(f"`{c}`") for c in rows.columns]), lambda x: ~text.is_blank(x))
    return rows.filter(filled).select(*cells)


def export_records(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Long records ``doc_id, field, value`` as the journal's columns in order, any number of rows."""
    names = S.JOURNAL_COLUMNS[1:]
    wide = records.groupBy("doc_id").agg(*[
        text.safe_cell(F.max(F.when(F.col("field") == n, F.col("value")))).alias(n) for n in names
    ])
    # Numbering reads the rows three times: for the quantiles, the totals and the rows themselves.
    numbered = number_by_id(settled(wide, "journal-rows"), "doc_id", S.ROW_NUMBER, buckets)
    return numbered.select("doc_id", *[F.col(f"`{n}`") for n in S.JOURNAL_COLUMNS])


def write_journal(journal: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = journal.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def find_column(existing: list[str], field: str) -> str | None:
    """Header of ``existing`` that takes ``field``; table metadata only, no rows involved."""
    def norm(name: str) -> str:
        return "".join(ch for ch in name.lower() if ch in "0123456789ё" or "a" <= ch <= "z" or "а" <= ch <= "я")

    def group(name: str) -> str | None:
        bare = norm(name)
        return next((g for g, parts in S.HEADER_GROUPS.items() if any(p in bare for p in parts)), None)

    if field in existing:
        return field
    for key in (norm, group):
        wanted = key(field)
        if wanted is None:
            continue
        hit = next((name for name in existing if key(name) == wanted), None)
        if hit is not None:
            return hit
    return None


def is_number_column(name: str) -> bool:
    return name.lower().startswith("№") or "п/п" in name.lower()


def append_records(journal: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Append wide rows to a journal whose columns grow by the fields it does not know.

    New columns stand before the file and status columns. When two incoming fields fall on one
    column, the later one is written. A number column of the journal goes on after its rows, in
    the order of ``order``, a unique column of ``incoming`` that is not written itself.
    """
    columns = list(journal.columns)
    source: dict[str, str] = {}
    for name in incoming.columns:
        if is_number_column(name) or name == order:
            continue
        target = find_column(columns, name)
        if target is None:
            target = name
            service = [i for i, c in enumerate(columns) if "файл" in c.lower() or "статус" in c.lower()]
            columns.insert(min(service, default=len(columns)), name)
        source[target] = name
    number = next((c for c in journal.columns if is_number_column(c)), None)
    rows = number_by_id(incoming, order, "_place")
    numbered = []
    if number is not None:
        # The sheet's row is what counts, not the numbers that stand in it.
        existing = journal.agg(F.count(F.lit(1))).scalar()
        numbered = [(existing + F.col("_place")).cast("string").alias(number)]
    renamed = rows.select(*numbered, *[
        text.safe_cell(F.col(f"`{name}`").cast("string")).alias(target) for target, name in source.items()
    ])
    combined = journal.unionByName(renamed, allowMissingColumns=True)
    return combined.select(*[F.col(f"`{c}`") for c in columns])


def delete_rows(journal: DataFrame, row_ids: DataFrame, order: str, buckets: int = BUCKETS) -> DataFrame:
    """Drop the listed rows and number the rest again; unknown ids have no effect."""
    kept = journal.join(row_ids.select(order).distinct(), order, "left_anti")
    return number_by_id(kept, order, "row_no", buckets)


def update_rows(journal: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Overwrite cells for which ``updates`` (key, map<column, value>) names a new value."""
    joined = journal.join(updates, key, "left")

    def cell(name: str) -> Column:
        changed = F.coalesce(F.map_contains_key("changes", name), F.lit(False))
        new = text.safe_cell(F.try_element_at("changes", F.lit(name)))
        return F.when(changed, new).otherwise(F.col(f"`{name}`")).alias(name)

    return joined.select(key, *[cell(n) for n in journal.columns if n != key])


def summary(journal: DataFrame, class_column: str | None, status_column: str | None) -> DataFrame:
    """Totals, verified and pending rows, and the most frequent class with its share."""
    if status_column is None:
        verified = F.lit(True)
    else:
        verified = F.contains(F.lower(text.blank_to_empty(F.col(f"`{status_column}`"))), F.lit("проверен"))
    name = F.upper(text.strip(F.col(f"`{class_column}`"))) if class_column else F.lit("")
    # One aggregation by class, then its few rows: no second pass over the journal.
    by_class = journal.groupBy(name.alias("class_name")).agg(
        F.count("*").alias("n"), F.count_if(verified).alias("verified")
    )
    named = F.col("class_name") != ""
    top = F.max(F.when(named, F.struct("n", F.col("class_name"))))
    total = F.sum("n")
    return by_class.agg(
        total.alias("total_count"), F.sum("verified").alias("verified_count"),
        (total - F.sum("verified")).alias("pending_count"),
        F.count_if(named).alias("class_count"),
        F.coalesce(top["class_name"], F.lit(NO_DATA)).alias("top_profile"),
        F.floor(F.coalesce(100 * top["n"] / total, F.lit(0))).alias("top_profile_pct"),
    )


def class_distribution(journal: DataFrame, class_column: str) -> DataFrame:
    name = F.upper(text.strip(F.col(f"`{class_column}`")))
    return (
        journal.select(name.alias("class_name")).filter("class_name <> ''")
        .groupBy("class_name").agg(F.count("*").alias("n"))
    )
