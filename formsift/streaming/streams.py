"""Structured Streaming jobs.

Every job keeps its checkpoint, state and output in the cluster's shared folder and starts from
there again after a failure. Batches are written under their number, so a repeated batch
replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from formsift import schema as S
from formsift.functions import fields, text
from formsift.operators import duplicates
from formsift.session import settled, shared_folder
from formsift.streaming.keyed import KeyedState

# A session of 24 hours that a use exactly at its end no longer extends, in whole seconds.
SESSION_GAP = f"{S.SESSION_TTL_HOURS * 3600 - 1} seconds"


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream, be it one file or a folder of files; ``files_per_batch`` bounds a
    micro-batch. A table that is missing is an error, as is one without a file."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    # A stream's source is a folder; of this one only the table's own file is taken.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_table(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Process what is available into a Parquet table and read that table."""
    spark = stream.sparkSession
    base = shared_folder(spark, purpose)
    query = (
        stream.writeStream.outputMode(mode).format("parquet")
        .option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def run_batches(
    stream: DataFrame, purpose: str, step: Callable[[DataFrame, int, str], None], mode: str = "append"
) -> str:
    """Process what is available batch by batch with ``step(batch, number, folder)``."""
    base = shared_folder(stream.sparkSession, purpose)

    def run(batch: DataFrame, number: int) -> None:
        step(batch, number, base)

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(run)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return base


def normalise(stream: DataFrame) -> DataFrame:
    """Format every value of a stream of long records."""
    return stream.select(
        "doc_id", "field", fields.auto_format(F.col("field"), F.col("value")).alias("formatted")
    )


def mark_duplicates(keys: DataFrame) -> DataFrame:
    """Duplicate counts of a stream of record keys, against earlier batches and within the batch.

    Kept is one row per key and reason with its count, not the records. A batch is counted per
    key before it meets them, and no earlier batch is read again.
    """
    spark = keys.sparkSession
    columns = ["doc_id", "n_snils", "n_name_birth", "n_name"]
    grouping = ["level", "ks", "kn", "kb"]

    def step(batch: DataFrame, number: int, base: str) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={number}")
        now = spark.read.schema(keys.schema).parquet(f"{base}/batch={number}")
        state = KeyedState(spark, f"{base}/counts", "level string, ks string, kn string, kb string, n long, undated long", grouping)
        entries = duplicates.level_entries(now)
        counted = settled(entries.groupBy(*grouping).agg(
            F.count("*").alias("n"), F.count_if("blank").alias("undated")), "batch-counts")
        before = settled(state.in_force(number, counted), "earlier-counts")
        inside = duplicates.batch_duplicates(now).select(*columns)
        outside = duplicates.level_totals(entries, before, grouping)
        found = inside.unionByName(outside).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in columns[1:]])
        found.write.mode("overwrite").parquet(f"{base}/found/batch={number}")
        summed = counted.unionByName(before).groupBy(*grouping).agg(F.sum("n").alias("n"), F.sum("undated").alias("undated"))
        state.put(number, summed)

    base = run_batches(keys, "stream-duplicates", step)
    return spark.read.parquet(f"{base}/found").select(*columns)


def first_seen(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """One row per key within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def daily_activity(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Actions per day; a day is final once the watermark has passed its end."""
    counted = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day")).agg(
        F.count("*").alias("actions"), F.count_if("ok").alias("ok_count")
    )
    return counted.select(F.col("window.start").cast("date").alias("day"), "actions", "ok_count")


def sliding_failures(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Failures per user over sliding 15-minute windows that move by the minute."""
    failed = stream.filter(~F.col("success")).withWatermark("ts", delay)
    counted = failed.groupBy(F.window("ts", "15 minutes", "1 minute"), "user_key").agg(F.count("*").alias("failures"))
    return counted.select("user_key", F.col("window.start").alias("from_ts"), "failures")


def sessions(df: DataFrame, delay: str | None = None) -> DataFrame:
    """Sessions that every access extends; batch, or streaming when ``delay`` is given."""
    rows = df.withColumn("at", F.date_trunc("second", "ts"))
    if delay:
        rows = rows.withWatermark("at", delay)
    grouped = rows.groupBy("username", F.session_window("at", SESSION_GAP)).agg(F.count("*").alias("accesses"))
    return grouped.select(
        "username", F.col("session_window.start").alias("started"),
        F.col("session_window.end").alias("ended"), "accesses",
    )


LOCK_OUTPUT = "id long, user_key string, at_s long, blocked boolean"
LOCK_STATE = "failures array<long>"


def _lock_step(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Attempts of one user in a micro-batch, in time order; the state is at most five times."""
    if state.hasTimedOut:
        state.remove()
        return
    failures = list(state.get[0]) if state.exists else []
    rows = pd.concat(batches).sort_values(["at_s", "id"])
    blocked = []
    for at_s, success in zip(rows.at_s, rows.success):
        failures = [t for t in failures if at_s - t < S.LOCK_WINDOW_SECONDS]
        locked = len(failures) >= S.MAX_FAILED_USER
        blocked.append(locked)
        if not locked:
            failures = [] if success else [*failures, int(at_s)]
    if failures:
        state.update((failures,))
        ends_ms = (max(failures) + S.LOCK_WINDOW_SECONDS) * 1000
        state.setTimeoutTimestamp(max(ends_ms, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    yield rows[["id", "user_key", "at_s"]].assign(blocked=blocked)


def lockout(attempts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The exact sign-in rule on a stream of ``id, username, success, at_s``.

    Size micro-batches with ``maxFilesPerTrigger``: a trigger holds one user's attempts of that
    batch in memory. The batch job for history is ``activity.exact_user_lockout``.
    """
    keyed = attempts.select(
        "id", F.lower(text.strip(F.col("username"))).alias("user_key"), "at_s", "success",
        F.timestamp_seconds("at_s").alias("ts"),
    ).withWatermark("ts", delay)
    return keyed.groupBy("user_key").applyInPandasWithState(
        _lock_step, LOCK_OUTPUT, LOCK_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def job_progress(items: DataFrame) -> DataFrame:
    """Latest progress per job; each batch writes the jobs it changed."""
    done, failed = F.col("status") == "done", F.col("status") == "error"
    counts = items.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(done | failed).alias("completed")
    )
    spark, batches = items.sparkSession, []
    progress = lambda base: KeyedState(spark, f"{base}/progress", counts.schema, ["job_id"])

    def step(batch: DataFrame, number: int, base: str) -> None:
        progress(base).put(number, batch)
        batches.append(number)

    base = run_batches(counts, "stream-progress", step, mode="update")
    return progress(base).in_force(max(batches, default=-1) + 1)
