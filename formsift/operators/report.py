"""The evaluation report: all its tables from one pass, written as one run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from formsift.functions import text
from formsift.operators import quality
from formsift.session import settled, shared_folder

#: Grouping columns of the one pass, and the sets of them that the tables need.
GROUPED = ["case_id", "field", "audit_status", "audit_reason"]
SETS = {"cases": ["case_id"], "fields": ["field"], "skips": ["audit_status", "audit_reason"], "audits": []}


def report_tables(scored: DataFrame, aligned: DataFrame) -> dict[str, DataFrame]:
    """Tables by name: cases, corpus, fields, audits, skips, matrix, positions.

    Everything that counts scored fields comes from one pass with one grouping set per table;
    the corpus is summed up from the rows of its cases. Digits come from their alignment.
    """
    flag = lambda name: F.count_if(name)
    blank = text.blank_to_empty(F.col("audit_reason"))
    once = scored.withColumn("audit_reason", blank).groupingSets(list(SETS.values()), *GROUPED).agg(
        F.avg("cer").alias("mean_cer"), F.avg("wer").alias("mean_wer"), flag("exact").alias("exact_fields"),
        F.count("*").alias("field_count"), flag("confirmed").alias("verified"), flag("false_confirmed").alias("false_verified"),
        F.sum("attempted").alias("attempted"), F.sum("completed").alias("completed"), F.grouping_id(*GROUPED).alias("set"))
    passed = settled(once, "report-pass")
    # A column that a set leaves out has its bit set, the first column the highest.
    bits = {name: sum(1 << (len(GROUPED) - 1 - i) for i, c in enumerate(GROUPED) if c not in columns) for name, columns in SETS.items()}
    rows = {name: passed.filter(F.col("set") == number) for name, number in bits.items()}
    cases = rows["cases"].select("case_id", "mean_cer", "mean_wer", "exact_fields", "field_count")
    per_field = rows["fields"].select(
        "field", F.col("exact_fields").alias("exact"), F.col("field_count").alias("total"), "verified", "false_verified",
        (F.col("field_count") - F.col("verified")).alias("needs_review"))
    return {
        "cases": cases,
        "corpus": quality.corpus_totals(cases),
        "fields": quality.field_rates(per_field),
        "audits": rows["audits"].select("attempted", "completed"),
        "skips": rows["skips"].filter("audit_reason <> ''").select("audit_status", "audit_reason", F.col("field_count").alias("n")),
        "matrix": quality.confusion_matrix(aligned),
        "positions": quality.position_errors(aligned),
    }


def write_report(spark: SparkSession, tables: dict[str, DataFrame], run: dict | None = None) -> str:
    """Write the tables as JSON lines and then, last, a manifest; returns the run's folder.

    A run counts only with its manifest, so one that broke off is never read. ``run`` holds
    the run's parameters.
    """
    folder = shared_folder(spark, "report")
    entries = []
    for name, table in tables.items():
        path = f"{folder}/{name}"
        table.write.option("ignoreNullFields", False).json(path)
        rows = spark.read.schema(table.schema).json(path).count()
        entries.append((name, rows, table.schema.json()))
    manifest = [(json.dumps(run or {}, ensure_ascii=False, sort_keys=True), entries)]
    schema = "run string, tables array<struct<name:string,n_rows:long,columns:string>>"
    spark.createDataFrame(manifest, schema).coalesce(1).write.json(f"{folder}/manifest")
    return folder


def read_report(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a finished run. A run without a manifest is an error, as is one with rows missing."""
    manifest = spark.read.schema("run string, tables array<struct<name:string,n_rows:long,columns:string>>").json(f"{folder}/manifest").first()
    tables = {}
    for entry in manifest["tables"]:
        schema = StructType.fromJson(json.loads(entry["columns"]))
        tables[entry["name"]] = spark.read.schema(schema).json(f"{folder}/{entry['name']}")
        if tables[entry["name"]].count() != entry["n_rows"]:
            raise ValueError(f"{entry['name']} of {folder} is not whole")
    return tables
