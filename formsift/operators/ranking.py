"""Numbering and prefix counts that never sort a whole group in one task.

Rows are cut into buckets between quantiles of the order column, so that they are even however
sparse, dense or clustered its values are. The windows below stay inside a bucket; the buckets'
totals, a table of a fixed number of rows for each key, carry the running offsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of an order column, a power of two.
BUCKETS = 1024


def with_bucket(df: DataFrame, order: str, buckets: int = BUCKETS) -> DataFrame:
    """Add ``_bucket``, which rises with ``order``; nulls and empty tables have bucket 0."""
    shares = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(order, shares, 100 * buckets).alias("b")).scalar()
    # The bounds below a value are counted by halving.
    steps = F.array(*[F.lit(buckets >> k) for k in range(1, buckets.bit_length())])
    below = F.aggregate(steps, F.lit(0), lambda i, step: F.when(
        F.try_element_at("_bounds", i + step) < F.col(order), i + step).otherwise(i))
    return df.withColumn("_bounds", bounds).withColumn("_bucket", F.coalesce(below, F.lit(0))).drop("_bounds")


def _before_bucket(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Running total of the buckets before each bucket, per key."""
    window = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_before", F.sum("_n").over(window)).filter("_before > 0").drop("_n")


def count_earlier(
    entries: DataFrame, keys: list[str], order: str, flag: str, buckets: int = BUCKETS
) -> DataFrame:
    """Add ``earlier`` and ``earlier_flagged``: rows with the same keys and a smaller ``order``.

    ``order`` is unique within a key. One shuffle of the rows by (keys, bucket) serves the
    window and the join with the running totals.
    """
    rows = with_bucket(entries, order, buckets)
    hit = F.when(F.col(flag), 1).otherwise(0)
    before_row = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    before_bucket = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"), F.sum(hit).alias("_h"))
    running = totals.withColumns({
        "_all": F.sum("_n").over(before_bucket), "_flagged": F.sum("_h").over(before_bucket),
    }).filter("_all > 0").drop("_n", "_h")
    # Keys are null where a grouping does not use them, so they are compared null-safe.
    b = running.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "_bucket")]
    local = {
        "_local": F.coalesce(F.count("*").over(before_row), F.lit(0)),
        "_local_flagged": F.coalesce(F.sum(hit).over(before_row), F.lit(0)),
    }
    joined = rows.withColumns(local).alias("a").join(b, reduce(lambda x, y: x & y, same), "left")
    zero = F.lit(0)
    return joined.select(
        *[F.col(f"a.{n}") for n in entries.columns],
        (F.col("_local") + F.coalesce("_all", zero)).alias("earlier"),
        (F.col("_local_flagged") + F.coalesce("_flagged", zero)).alias("earlier_flagged"),
    )


def number_rows(
    df: DataFrame, order: list[Column], bucket: Column, name: str = "row_no",
    keys: list[str] | None = None,
) -> DataFrame:
    """Dense numbers from 1 in the order of ``order``, per ``keys`` when given.

    ``bucket`` must rise with the first order column; it decides how the work is split.
    """
    keys = keys or []
    columns = list(df.columns)
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    if keys:
        before = _before_bucket(totals, keys)
    else:
        # One row per bucket; the window sees the bucket totals, not the data.
        window = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(
            "_bucket", F.coalesce(F.sum("_n").over(window), F.lit(0)).alias("_before")
        )
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        rows.withColumn("_local", local)
        .join(before, [*keys, "_bucket"], "left")
        .select(*columns, (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).alias(name))
    )


def number_by_id(df: DataFrame, order: str, name: str = "row_no", buckets: int = BUCKETS) -> DataFrame:
    """Dense numbers from 1 in the order of a column, which may be sparse, such as a hash."""
    rows = with_bucket(df, order, buckets)
    return number_rows(rows, [F.col(order)], F.col("_bucket"), name).drop("_bucket")
