"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formsift.session import settled

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(col, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_totals(
    df: DataFrame, groups: list[str], place: str, order: list[str], value: str, out: str, rows: int = 256,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows that come earlier in their group.

    Rows are ordered by ``place`` and then ``order``. ``place`` is a double in [0, 1) over which
    a group's rows spread evenly, such as a hash. It is cut, for all groups alike, into so many
    buckets that ``rows`` rows of the whole table come to one, and those into blocks of ``rows`` buckets;
    a group of any share of the table has that share of ``rows`` in a bucket. The windows run
    inside a group's bucket, over a block's buckets and over a group's blocks, and rows are
    only ever dealt by group and bucket, so that no task gets a group.
    ``df`` is read twice: settle it first if it is dear.
    """
    null_safe = [F.struct(F.col(g)).alias(f"_g{i}") for i, g in enumerate(groups)]
    g = [f"_g{i}" for i in range(len(groups))]
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    keyed = df.select("*", *null_safe).withColumn(
        "_blocks", total.select(F.ceil(F.col("_n") / F.lit(rows * rows)).cast("long")).scalar())
    keyed = keyed.withColumns({
        "_block": F.floor(F.col(place) * F.col("_blocks")).cast("long"),
        "_bucket": F.floor(F.col(place) * F.col("_blocks") * F.lit(rows)).cast("long"),
    })
    own, block, bucket = g + ["_block", "_bucket"], g + ["_block"], ["_bucket"]
    # Else the windows would stay with the groups' partitioning, and a large group in one task.
    keyed = keyed.repartition(*own)
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*own).agg(F.sum(value).alias("_sum"))
    block_sums = sums.groupBy(*block).agg(F.sum("_sum").alias("_block_sum"))
    block_sums = block_sums.withColumn("_before_block", F.coalesce(F.sum("_block_sum").over(before(g, ["_block"])), F.lit(0)))
    sums = sums.withColumn("_before_bucket", F.coalesce(F.sum("_sum").over(before(block, bucket)), F.lit(0)))
    offsets = sums.join(block_sums, block).select(*own, (F.col("_before_block") + F.col("_before_bucket")).alias("_offset"))
    inside = F.coalesce(F.sum(value).over(before(own, [place, *order])), F.lit(0))
    added = keyed.withColumn("_inside", inside).join(offsets, own)
    return added.withColumn(out, F.col("_inside") + F.col("_offset")).select(*df.columns, out)


def even_place(*cols: Column) -> Column:
    """A double in [0, 1) from the MD5 of the columns' text: the same on every run and engine."""
    text = F.concat_ws("|", *cols)
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


__all__ = [
    "LOWER", "SPACE", "UPPER", "WORD", "ascii_lower", "even_place", "running_totals", "settled", "table", "word_count",
]
