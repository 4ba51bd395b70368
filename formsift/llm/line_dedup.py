"""Line deduplication: removes lines that appear on many sites.

Each distinct line gets a HyperLogLog sketch of its sites, merged by aggregation. Lines whose
estimate lies near the threshold are counted exactly. What spreads over enough sites is
boilerplate and goes, except in the first document that has it, so that no text is lost.
Everything is a DataFrame expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift.llm.common import settled


def lines_of(text: Column) -> Column:
    """Lines of a text, split at line feeds; a null text has none."""
    return F.split(text, "\n", -1)


def line_hashes(text: Column) -> Column:
    """Hash of each line without the spaces around it; null for blank lines."""
    return F.transform(lines_of(text), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int, z: float) -> DataFrame:
    """Lines on at least ``min_sites`` distinct sites: ``line, first_doc``.

    ``lines`` has ``doc_id, site, line`` (hash). A sketch's relative error has the deviation
    1.04 / sqrt(2^lg_k); estimates within ``z`` deviations of the threshold are replaced by
    exact counts.
    """
    error = z * 1.04 / math.sqrt(2**lg_k)
    sketches = lines.groupBy("line").agg(
        F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("doc_id").alias("first_doc"))
    estimate = F.hll_sketch_estimate("sketch").cast("double")
    wide = sketches.select("line", "first_doc", estimate.alias("sites")).filter(
        F.col("sites") >= F.lit(math.floor(min_sites * (1 - error))))
    wide = settled(wide, "wide-lines")
    sure = F.col("sites") > F.lit(math.ceil(min_sites * (1 + error)))
    near = wide.filter(~sure).select("line")
    exact = lines.join(near, "line", "left_semi").groupBy("line", "site").agg(F.count(F.lit(1)).alias("n"))
    exact = exact.groupBy("line").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites)
    counted = wide.filter(~sure).join(exact.select("line"), "line", "left_semi")
    return wide.filter(sure).unionByName(counted).select("line", "first_doc")


def drop_boilerplate(docs: DataFrame, min_sites: int = 5, lg_k: int = 12, z: float = 6.0) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus ``n_lines`` and ``n_removed``.

    A line is boilerplate if, spaces around it apart, it appears in documents of at least
    ``min_sites`` distinct ``source`` values; a null source is one more site. The first line of
    its kind in the document with the smallest ``doc_id`` stays (null is the smallest; rows
    that share that identifier each keep it). Blank lines always stay. Null text stays null and
    has 0 lines; an empty text has one. Repeated rows are each cleaned alike. Other columns are
    passed through; columns of the added names are replaced. An empty table gives an empty one.
    """
    site = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))
    lines = docs.select("doc_id", site.alias("site"), F.explode(F.array_distinct(line_hashes(F.col("text")))).alias("line"))
    lines = settled(lines.filter("line is not null"), "lines")
    wide = settled(spread_lines(lines, min_sites, lg_k, z), "boilerplate")
    hit = lines.join(wide, "line").groupBy(F.struct("doc_id").alias("_key")).agg(
        F.collect_set("line").alias("_gone"),
        F.collect_set(F.when(F.col("first_doc").eqNullSafe(F.col("doc_id")), F.col("line"))).alias("_first"))
    joined = docs.drop(*ADDED).withColumn("_key", F.struct("doc_id")).join(hit, "_key", "left")
    counted = joined.withColumn("_kept", kept_lines()).withColumns(counts())
    return counted.withColumn("text", kept_text()).select(*[c for c in docs.columns if c not in ADDED], *ADDED)


ADDED = ("n_lines", "n_removed")


def kept_lines() -> Column:
    """Lines that stay of a text joined with its ``_gone`` and ``_first`` line hashes; null: all."""
    hashes, text_lines = line_hashes(F.col("text")), lines_of(F.col("text"))
    here = F.transform(hashes, lambda h, i: F.coalesce(
        ~F.array_contains("_gone", h) | (F.array_contains("_first", h) & (F.array_position(hashes, h) == i + 1)), F.lit(True)))
    zipped = F.arrays_zip(text_lines.alias("line"), here.alias("stays"))
    return F.when(F.col("_gone").isNotNull(), F.transform(F.filter(zipped, lambda x: x["stays"]), lambda x: x["line"]))


def kept_text() -> Column:
    return F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))


def counts() -> dict[str, Column]:
    """Lines of a text, and those that go."""
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    gone = F.when(F.col("_kept").isNull(), 0).otherwise(n - F.size("_kept"))
    return {"n_lines": n, "n_removed": gone}
