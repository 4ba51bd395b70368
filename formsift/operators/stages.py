"""Staged columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that later steps name many times.

    The values pass through a one-row generator, so a filter or projection above refers to the
    finished value. With plain projections the optimizer copies the whole expression into every
    place that names it, which grows exponentially over several decision steps. The values are made
    by a projection below the generator, because a generator with a higher-order function in it is not compiled.
    """
    kept = [F.col(f"`{name}`") for name in df.columns if name not in columns]
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, values.alias("_computed")).select(*kept, F.inline(F.array("_computed")))
