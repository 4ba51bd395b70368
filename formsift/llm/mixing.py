"""Mixing sources to target weights by weighted fair queueing.

Every source offers its documents in shuffled order, epoch after epoch. An entry's virtual
finish time is the source's words up to its end divided by the source's target; merging all
sources by finish time gives each its share in every stretch of the mix. The mix ends at virtual
time 1, when the total budget is spent; the entry that a source has in service then gives the
words that it has been served.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formsift.llm.common import even_place, running_totals, settled, word_count


def source_targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int, budget: float) -> DataFrame:
    """Target words of each source: ``source, source_size, target``.

    ``sizes`` has ``source`` and ``source_size``, one row per source. Sources take the weights in
    turn, by code point, null last. A target stops at ``epochs`` times its source's size; what
    that leaves over goes to the others by weight, until none is above. The windows run over one
    row per source.
    """
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (position - 1) % len(weights) + 1)
    s = sizes.withColumns({"w": weight.cast("long"), "cap": F.col("source_size") * epochs})
    by_need = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    spent = F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total * F.lit(budget) - spent) / left)
    # Sources are capped in order of need until one has room at the level that is left; further
    # ones would only lower the level.
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")))
    s = s.withColumn("final", level.over(Window.partitionBy()))
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("w") * F.col("final")), F.col("cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def mixture(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, budget: float = 1.0, seed: str = "mix",
) -> DataFrame:
    """The mix, one row per document and epoch, with its source's figures.

    Columns: ``doc_id, source, size, source_size, target, epoch, taken`` (words) and ``finish``
    (virtual finish time, at most 1). Documents that get nothing stay, with null epoch and 0
    taken, so that no row is lost. Null text has size 0; a null source is a source of its own, the last;
    repeated rows are served each. Ties in the shuffle go by document and size. Columns other
    than ``doc_id, source, text`` are not looked at. An empty table gives an empty mix.
    """
    base = settled(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = settled(source_targets(
        base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs, budget), "mix-targets")
    joined = base.join(targets, base["source"].eqNullSafe(targets["source"])).select(base["*"], "source_size", "target")
    # Each step's rows are few and small; written, they spare the next step's plan the work before.
    turns = F.when(F.col("source_size") > 0, F.ceil(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    entries = joined.select("*", F.explode(F.sequence(F.lit(0), F.greatest(turns - 1, F.lit(0)))).alias("epoch"))
    entries = entries.withColumn("place", even_place(F.lit(seed), F.col("epoch"), F.col("doc_id")))
    entries = settled(entries, "mix-entries")
    timed = running_totals(entries, ["source", "epoch"], "place", ["doc_id", "size"], "size", "before")
    start = F.col("epoch") * F.col("source_size") + F.col("before")
    served = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start)).cast("long")
    finish = F.when(F.col("target") > 0, F.least(F.lit(1.0), (start + F.col("size")) / F.col("target")))
    timed = timed.withColumns({"taken": F.coalesce(served, F.lit(0)), "finish": F.coalesce(finish, F.lit(1.0))})
    return settled(timed.select(
        "doc_id", "source", "size", "source_size", "target", F.when(F.col("taken") > 0, F.col("epoch")).alias("epoch"),
        "taken", "finish"), "mix")


def in_order(mix: DataFrame) -> DataFrame:
    """The served entries in the order of the mix, range-sorted over the whole cluster by virtual
    finish time and cut where the total budget is spent.

    Adds ``mix_start``, the words of the mix before an entry. Fair queueing spreads the words
    evenly over virtual time, so equal stretches of it make even buckets for the running total.
    """
    served = mix.filter("taken > 0")
    budget = served.select("source", "target").distinct().agg(F.sum("target")).scalar()
    placed = served.withColumn("stretch", F.least(F.col("finish"), F.lit(1 - 2.0**-40)))
    order = ["source", "epoch", "doc_id", "size"]
    timed = running_totals(placed, [], "stretch", order, "taken", "mix_start").drop("stretch")
    cut = F.least(F.col("taken"), F.floor(budget + F.lit(0.5)).cast("long") - F.col("mix_start"))
    return timed.withColumn("taken", cut).filter("taken > 0").orderBy("mix_start", "doc_id")


def taken_words(mix: DataFrame, ordered: DataFrame) -> DataFrame:
    """Words that the mix takes of each document, all epochs together, and its first place there.

    Rows that agree in identifier, source and size are one document here.
    """
    keys = ["doc_id", "source", "size", "source_size", "target"]
    none = mix.select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("mix_start"))
    return none.unionByName(ordered.select(*none.columns)).groupBy(*keys).agg(
        F.sum("taken").alias("taken"), F.min("mix_start").alias("first_place"))
