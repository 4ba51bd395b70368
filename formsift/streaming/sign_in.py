"""The sign-in rule on a stream, with the counters of users and of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formsift import schema as S
from formsift.operators import activity
from formsift.session import settled
from formsift.streaming.keyed import KeyedState
from formsift.streaming.streams import run_batches

ATTEMPT = activity.ATTEMPT
HORIZON = "seen long, ready long"


def judged(due: DataFrame, counters: DataFrame) -> DataFrame:
    """Replay attempts from given open counters ``kind, key, times``."""
    units = settled(activity.sign_in_groups(due).withColumnRenamed("spell", "unit"), "spells-due")
    seeds = activity.counter_keys(units, "unit").join(counters.filter("size(times) > 0"), ["kind", "key"])
    return activity.replayed(units, seeds)


def lockout(attempts: DataFrame, delay_s: int = 3600, finish: bool = True) -> tuple[DataFrame, DataFrame]:
    """Which attempts of a stream ``id, username, ip, success, at_s`` are locked out.

    An attempt touches two counters, so neither key alone can hold the state. Each micro-batch
    takes what the watermark has passed (``delay_s`` behind the newest attempt), splits it into
    spells that cannot influence each other, seeds them with the open counters, and keeps the
    counters they leave: at most five times of a user and fifteen of an address. Attempts that
    wait for the watermark are carried to the next batch; ``finish`` judges what still waits when
    the source has ended. Attempts behind the watermark's last place cannot be judged in order; they
    are the second table, ``id, user_key, ip_key, at_s, success``, not merged silently.
    """
    spark, numbers = attempts.sparkSession, []

    def step(batch: DataFrame, number: int, base: str, last: bool = False) -> None:
        numbers.append(number)
        carried, horizon = spark.createDataFrame([], ATTEMPT), None
        if number:
            carried = spark.read.schema(ATTEMPT).parquet(f"{base}/waiting/batch={number - 1}")
            horizon = spark.read.schema(HORIZON).parquet(f"{base}/horizon/batch={number - 1}").first()
        passed = horizon.ready if horizon else None
        arrived = settled(activity.sign_in_keys(batch).select(*[c.split()[0] for c in ATTEMPT.split(", ")]), "arrived")
        newest = arrived.agg(F.max("at_s")).first()[0]
        seen = max((s for s in (newest, horizon.seen if horizon else None) if s is not None), default=None)
        ready = None if seen is None else seen + 1 if last else seen - delay_s
        spark.createDataFrame([(seen, max((r for r in (ready, passed) if r is not None), default=None))], HORIZON).write.mode("overwrite").parquet(f"{base}/horizon/batch={number}")
        behind = F.lit(False) if passed is None else F.col("at_s") < passed
        arrived.filter(behind).write.mode("overwrite").parquet(f"{base}/late/batch={number}")
        open_rows = arrived.filter(~behind).unionByName(carried)
        due = F.lit(False) if ready is None else F.col("at_s") < ready
        open_rows.filter(~due).write.mode("overwrite").parquet(f"{base}/waiting/batch={number}")
        due_rows = settled(open_rows.filter(due), "due")
        alive = F.lit(True) if ready is None else F.element_at("times", -1) > ready - S.LOCK_WINDOW_SECONDS
        state = KeyedState(spark, f"{base}/counters", "kind string, key string, times array<long>", ["kind", "key"],
                           keep=(F.size("times") > 0) & alive)
        replayed = settled(judged(due_rows, state.in_force(number, activity.counter_keys(due_rows))), "replayed")
        verdicts = replayed.filter("kind is null").select("id", "user_key", "ip_key", "at_s", "success", "blocked")
        verdicts.write.mode("overwrite").parquet(f"{base}/judged/batch={number}")
        # A key of two spells of a batch: the later one leaves its counter.
        state.put(number, replayed.filter("kind is not null").groupBy("kind", "key").agg(F.max_by("times", "at_s").alias("times")))

    base = run_batches(attempts, "stream-sign-in", step)
    if finish:
        step(spark.createDataFrame([], attempts.schema), max(numbers, default=-1) + 1, base, last=True)
    read = lambda name, schema: spark.read.schema(schema).parquet(*[f"{base}/{name}/batch={n}" for n in sorted(set(numbers))]) if numbers else spark.createDataFrame([], schema)
    return read("judged", ATTEMPT + ", blocked boolean"), read("late", ATTEMPT)
