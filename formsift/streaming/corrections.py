"""Confirmed corrections that act on the documents that come after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formsift.functions import text
from formsift.operators import dictionary
from formsift.session import settled
from formsift.streaming.keyed import KeyedState
from formsift.streaming.streams import run_batches

#: Columns of a stream of events: a document's field, or a change that a reviewer accepted.
EVENTS = (
    "kind string, doc_id long, field string, value string, seq long, field_part string, `from` string, `to` string")
CORRECTED = "doc_id long, field string, value string, corrected string, n_changed long"
LOG = "category string, wrong string, right string, seq long"


class Confirmed:
    """What reviewers have confirmed so far: the mapping in force, and the right-hand sides as entries."""

    def __init__(self, spark, folder: str, every: int = 8):
        keys = ["category", "norm"]
        self.mapping = KeyedState(spark, f"{folder}/mapping", "category string, norm string, right string, seq long", keys, every)
        self.entries = KeyedState(spark, f"{folder}/entries", "category string, norm string, value string", keys, every)

    @staticmethod
    def as_log(mapping: DataFrame) -> DataFrame:
        return mapping.select("category", F.col("norm").alias("wrong"), "right", "seq")

    def before(self, number: int, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Mapping (as a log) and learned entries in force before a batch, for some (category, norm)."""
        return self.as_log(self.mapping.in_force(number, keys)), self.entries.in_force(number, keys).select("category", "value")

    def confirm(self, number: int, pairs: DataFrame) -> DataFrame:
        """Take in a batch of pairs ``category, wrong, right, seq``; returns those that say something new."""
        keyed = _keyed(pairs, "wrong")
        known = settled(self.mapping.in_force(number, keyed), "known-mapping")
        fresh = settled(dictionary.new_corrections(self.as_log(known), pairs).select("category", "wrong", "right", "seq"), "new-pairs")
        valid = dictionary.valid_corrections(fresh)
        newest = _keyed(valid, "wrong").select(*self.mapping.columns).unionByName(known)
        newest = newest.groupBy("category", "norm").agg(F.max_by("right", "seq").alias("right"), F.max("seq").alias("seq"))
        self.mapping.put(number, newest)
        rights = _keyed(valid, "right").select("category", "norm", F.col("right").alias("value"))
        earlier = self.entries.in_force(number, rights)
        self.entries.put(number, rights.unionByName(earlier).groupBy("category", "norm").agg(F.min("value").alias("value")))
        return fresh


def _keyed(pairs: DataFrame, column: str) -> DataFrame:
    return pairs.withColumn("norm", text.dict_norm(text.strip(F.col(column)))).withColumn("category", text.strip(F.col("category")))


def collect_corrections(pairs: DataFrame) -> DataFrame:
    """Append a stream of confirmed pairs ``category, wrong, right, seq``; return the log kept.

    A pair that says what is in force already is not kept. Only the mapping of a batch's own
    words is looked up, never the log.
    """
    spark, schema = pairs.sparkSession, pairs.schema

    def step(batch: DataFrame, number: int, base: str) -> None:
        fresh = Confirmed(spark, f"{base}/confirmed").confirm(number, settled(batch, "pairs"))
        fresh.select(*schema.fieldNames()).write.mode("overwrite").parquet(f"{base}/log/batch={number}")

    base = run_batches(pairs, "stream-corrections", step)
    return spark.read.schema(schema).parquet(f"{base}/log")


def tokens_of(documents: DataFrame) -> DataFrame:
    """Words that corrections apply to: names, addresses, passport texts."""
    return dictionary.fio_tokens(documents).unionByName(dictionary.text_tokens(documents))


def document_events(documents: DataFrame, *more: str) -> DataFrame:
    """Events for ``doc_id, field, value``, with ``more`` columns."""
    none = F.lit(None)
    return documents.select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), "field", "value",
        none.cast("long").alias("seq"), *[none.cast("string").alias(c) for c in ("field_part", "from", "to")], *more)


def accepted_events(accepted: DataFrame, *more: str) -> DataFrame:
    """Events for ``seq, field_part, field, from, to``, with ``more`` columns."""
    none: Column = F.lit(None)
    return accepted.select(
        F.lit("accepted").alias("kind"), none.cast("long").alias("doc_id"), "field", none.cast("string").alias("value"),
        F.col("seq").cast("long").alias("seq"), "field_part", "from", "to", *more)


def correct_as_confirmed(events: DataFrame, entries: DataFrame, fuzzy: bool = True, every: int = 8) -> tuple[DataFrame, DataFrame]:
    """Correct documents as they come by what was confirmed in earlier micro-batches.

    ``events`` has the columns of ``EVENTS``. A document of batch ``n`` sees the mapping and the
    entries as they stood before it; what is accepted in batch ``n`` is appended at its end and
    acts from ``n + 1`` on. A category comes from the accepted field or its part. The latest
    ``seq`` of a word is in force. Returns the documents ``doc_id, field, value, corrected,
    n_changed`` and the log of appended pairs, both with their ``batch``.
    """
    spark = events.sparkSession
    known = settled(entries.select("category", "value"), "static-entries")

    def step(batch: DataFrame, number: int, base: str) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={number}")
        now = spark.read.schema(events.schema).parquet(f"{base}/batch={number}")
        confirmed = Confirmed(spark, f"{base}/confirmed", every)
        documents = now.filter("kind = 'document'").select("doc_id", "field", "value")
        tokens = tokens_of(documents)
        mapping, learned = confirmed.before(number, tokens.select("category", "norm").distinct())
        proposed = settled(dictionary.propose(tokens, known.unionByName(learned).distinct(), mapping, fuzzy), "proposed")
        patched = dictionary.rebuilt(documents, proposed)
        changed = proposed.filter("to IS NOT NULL").groupBy("doc_id", "field").agg(F.count("*").alias("n_changed"))
        corrected = documents.join(patched.join(changed, ["doc_id", "field"]), ["doc_id", "field"], "left").select(
            "doc_id", "field", "value", F.coalesce("corrected", "value").alias("corrected"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"))
        corrected.write.mode("overwrite").parquet(f"{base}/corrected/batch={number}")
        pairs = dictionary.learned_pairs(now.filter("kind = 'accepted'"), "seq")
        confirmed.confirm(number, settled(pairs, "pairs")).write.mode("overwrite").parquet(f"{base}/log/batch={number}")

    base = run_batches(events, "stream-confirmed", step)
    read = lambda name, schema: spark.read.schema(f"{schema}, batch int").parquet(f"{base}/{name}")
    return read("corrected", CORRECTED), read("log", LOG)
