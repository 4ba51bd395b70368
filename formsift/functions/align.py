"""Edit alignment in the JVM, and the similarity ratio, which is a Python helper inside tasks."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formsift.operators.stages import computed
from formsift.schema import GAP


def _numbers(count: Column) -> Column:
    """1, 2, ... count; none for zero."""
    return F.slice(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), F.lit(1), count)


def _costs(reference: Column, predicted: Column) -> Column:
    """Edit distances of all prefixes of two character arrays, one row per prefix of the first."""
    columns = _numbers(F.size(predicted))

    def next_row(rows: Column, i: Column) -> Column:
        above, letter = F.element_at(rows, -1), F.element_at(reference, i)

        def next_cell(row: Column, j: Column) -> Column:
            changed = F.element_at(above, j) + F.when(letter == F.element_at(predicted, j), 0).otherwise(1)
            missing, extra = F.element_at(above, j + 1) + 1, F.element_at(row, -1) + 1
            return F.concat(row, F.array(F.least(changed, missing, extra)))

        return F.concat(rows, F.array(F.aggregate(columns, F.array(i), next_cell)))

    first = F.concat(F.array(F.lit(0)), columns)
    return F.aggregate(_numbers(F.size(reference)), F.array(first), next_row)


def _way(reference: Column, predicted: Column, costs: Column) -> Column:
    """Aligned characters from the end back to the start; ties prefer a match, then a missing one."""
    pair = "array<struct<reference:string,predicted:string,position:int>>"

    def step(at: Column, _: Column) -> Column:
        i, j = at["i"], at["j"]
        cost = lambda a, b: F.get(F.get(costs, a), b)
        r, p = F.get(reference, i - 1), F.get(predicted, j - 1)
        diagonal = (i > 0) & (j > 0) & (cost(i, j) == cost(i - 1, j - 1) + F.when(r == p, 0).otherwise(1))
        missing = (i > 0) & (cost(i, j) == cost(i - 1, j) + 1)
        both, lost = F.coalesce(diagonal, F.lit(False)), F.coalesce(missing, F.lit(False))

        def moved(di: int, dj: int, left: Column, right: Column, position: Column) -> Column:
            aligned = F.struct(left.alias("reference"), right.alias("predicted"), position.alias("position"))
            return F.struct((i - di).alias("i"), (j - dj).alias("j"), F.concat(at["pairs"], F.array(aligned)).alias("pairs"))

        gap = F.lit(GAP)
        return (
            F.when((i == 0) & (j == 0), at).when(both, moved(1, 1, r, p, i))
            .when(lost, moved(1, 0, r, gap, i)).otherwise(moved(0, 1, gap, p, i + 1)))

    n, m = F.size(reference), F.size(predicted)
    start = F.struct(n.alias("i"), m.alias("j"), F.array().cast(pair).alias("pairs"))
    return F.aggregate(_numbers(n + m), start, step, lambda at: F.reverse(at["pairs"]))


def aligned_pairs(df: DataFrame, reference: str, predicted: str, out: str) -> DataFrame:
    """Add ``out``: the edit alignment of two short texts as ``reference, predicted, position``.

    Ties prefer a match, then a missing character; an extra character takes the position after
    the one it follows. Characters, table and way back are staged columns, each worked out once
    per row without leaving the JVM. Null is empty.
    """
    letters = lambda name: F.filter(F.split(F.coalesce(F.col(name), F.lit("")), ""), lambda x: x != "")
    staged = computed(df, {"_r": letters(reference), "_p": letters(predicted)})
    staged = computed(staged, {"_costs": _costs(F.col("_r"), F.col("_p"))})
    return computed(staged, {out: _way(F.col("_r"), F.col("_p"), F.col("_costs"))}).drop("_r", "_p", "_costs")


@F.pandas_udf(T.DoubleType())
def similarity(value: pd.Series, candidate: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two normalised words; meant for distinct pairs."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(value, candidate)])
