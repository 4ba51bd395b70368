"""Activity log, batch jobs, sign-in rules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formsift import schema as S
from formsift.functions import text
from formsift.operators.ranking import number_rows
from formsift.session import settled

# Sign-in attempts of one key are windowed per chunk of this many seconds.
CHUNK_SECONDS = 3600


def log_rows(df: DataFrame) -> DataFrame:
    """Rows to append to the log: blank users become "-", empty details null, day for pruning."""
    user = F.when(text.blank_to_empty(F.col("username")) == "", "-").otherwise(F.col("username"))
    return df.withColumns({"username": user, "day": F.to_date("ts")})


def append_log(rows: DataFrame, path: str) -> None:
    log_rows(rows).write.mode("append").partitionBy("day").parquet(path)


def per_user(activity: DataFrame, since: Column) -> DataFrame:
    recent = activity.filter(F.col("ts") >= since)
    return recent.groupBy("username").agg(
        F.count("*").alias("actions"), F.count_if("ok").alias("ok_count"),
        F.count_if(~F.col("ok")).alias("error_count"),
        F.avg("elapsed_ms").cast("long").alias("avg_elapsed_ms"), F.max("ts").alias("last_ts"),
    )


def per_day(activity: DataFrame, since: Column) -> DataFrame:
    recent = activity.filter(F.col("ts") >= since)
    return recent.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("actions"), F.count_if("ok").alias("ok_count")
    )


def recent_actions(activity: DataFrame, n: int = 50) -> DataFrame:
    columns = ["id", "ts", "username", "action", "ok", "elapsed_ms", "model", "backend"]
    return activity.select(*columns).orderBy(F.col("id").desc()).limit(n)


# --- batch jobs ---------------------------------------------------------------------------


def job_outcomes(items: DataFrame) -> DataFrame:
    """Status of each job from its items; a running job keeps running, cancelling wins."""
    jobs = items.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("ok_files"),
        F.count_if(F.col("status") == "error").alias("error_files"),
        F.bool_or("job_cancelled").alias("cancelled"), F.bool_or("job_running").alias("running"),
        F.max("idx").alias("created"), F.max("owner_id").alias("owner_id"),
    )
    status = (
        F.when(F.col("cancelled"), "cancelled").when(F.col("running"), "running")
        .when(F.col("error_files") == F.col("total"), "error").otherwise("done")
    )
    out = jobs.withColumn("job_status", status)
    return out.withColumn(
        "activity_ok", (F.col("job_status") == "done") & (F.col("error_files") == 0)
    )


def job_progress(items: DataFrame) -> DataFrame:
    done, failed = F.col("status") == "done", F.col("status") == "error"
    counts = items.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(done | failed).alias("completed"),
        F.count_if(failed | (F.col("status") == "pending")).alias("unfinished"),
        F.count_if(done & F.col("verified")).alias("verified"),
    )
    # Half a percent rounds up, as browsers do.
    percent = F.floor(100 * F.col("completed") / F.col("total") + 0.5)
    return counts.withColumn("percent", percent)


def owned_items(items: DataFrame, owner_id: int) -> DataFrame:
    """Items of one owner; their data stays hidden until the job has finished."""
    mine = items.filter(F.col("owner_id") == owner_id)
    jobs = job_outcomes(mine).select("job_id", "job_status")
    finished = F.col("job_status").isin("done", "error", "cancelled")
    return mine.join(jobs, "job_id").select(
        "job_id", "idx", "filename", "status", "job_status",
        F.when(finished, F.col("data")).alias("data"),
    )


PREVIEW_OK, PREVIEW_RUNNING, PREVIEW_NO_FILE, PREVIEW_NONE = "ok", "still running", "no such file", "no preview"


def previews(items: DataFrame, owner_id: int, requests: DataFrame) -> DataFrame:
    """Answers to ``request_id, job_id, index``: ``answer`` and, if ok, ``preview``.

    Only jobs of the owner are seen; others give no row. The index counts the job's items from 0 in
    their order; items carry a ``preview``, null where there is none.
    """
    mine = items.filter(F.col("owner_id") == owner_id)
    jobs = job_outcomes(mine).select("job_id", "job_status", "total")
    numbered = number_rows(mine.select("job_id", "idx", "preview"), [F.col("idx")], F.floor(F.col("idx") / 4096), "no", ["job_id"])
    asked = requests.join(jobs, "job_id")
    found = asked.join(numbered.select("job_id", (F.col("no") - 1).alias("index"), "preview"), ["job_id", "index"], "left")
    answer = (
        F.when(~F.col("job_status").isin("done", "error", "cancelled"), PREVIEW_RUNNING)
        .when((F.col("index") < 0) | (F.col("index") >= F.col("total")), PREVIEW_NO_FILE)
        .when(F.col("preview").isNull(), PREVIEW_NONE).otherwise(PREVIEW_OK))
    return found.select("request_id", "job_id", "index", answer.alias("answer"), F.when(answer == PREVIEW_OK, F.col("preview")).alias("preview"))


def job_duplicates(items: DataFrame, found: DataFrame) -> DataFrame:
    """``job_id, duplicates``: items of each job whose record (``idx`` is its ``doc_id``) repeats an earlier one."""
    repeated = found.filter("n_snils + n_name_birth + n_name > 0").select(F.col("doc_id").alias("idx"), F.lit(1).alias("hit"))
    return items.select("job_id", "idx").join(repeated, "idx", "left").groupBy("job_id").agg(F.count("hit").alias("duplicates"))


def retry_items(items: DataFrame) -> DataFrame:
    return items.filter(F.col("status").isin("error", "pending")).orderBy("job_id", "idx")


def retained_jobs(jobs: DataFrame, keep: int = S.KEEP_FINISHED_JOBS) -> DataFrame:
    """All running jobs and the newest finished ones (a top-n, not a window over all jobs)."""
    running = jobs.filter("job_status = 'running'")
    finished = jobs.filter("job_status <> 'running'").orderBy(F.col("created").desc(), "job_id").limit(keep)
    return running.unionByName(finished)


# --- sessions and sign-in -----------------------------------------------------------------


def valid_accesses(accesses: DataFrame, sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Accesses whose token's session has not expired and whose user is enabled."""
    enabled = users.filter(~F.col("disabled")).select("user_id")
    live = sessions.join(enabled, "user_id", "left_semi")
    return accesses.join(live, "token").filter(
        (F.col("at_s") >= F.col("created_s")) & (F.col("expires_s") > F.col("at_s"))
    )


def _recent_failures(attempts: DataFrame, key: str, name: str) -> DataFrame:
    """Failures of the key within the lock window before each attempt, since its last success.

    Only the last 15 minutes matter, so an hour of attempts plus a copy of the 15 minutes
    before it is enough: windows are per (key, hour) and a busy key is spread over its hours.
    Each failure adds one when it happens and takes it back when it leaves the window, so
    every frame only grows and costs one step per row however dense the attempts are.
    """
    span = S.LOCK_WINDOW_SECONDS
    chunk = F.floor(F.col("at_s") / CHUNK_SECONDS)
    carries = F.col("at_s") > (chunk + 1) * CHUNK_SECONDS - span
    copies = attempts.withColumn("chunk", F.explode(
        F.when(carries, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    ))
    happens = F.struct(F.col("at_s").alias("t"), F.when(F.col("success"), 0).otherwise(1).alias("step"), F.lit(True).alias("real"))
    leaves = F.struct((F.col("at_s") + span - 1).alias("t"), F.lit(-1).alias("step"), F.lit(False).alias("real"))
    marks = copies.select(
        "*", F.inline(F.when(F.col("success"), F.array(happens)).otherwise(F.array(happens, leaves)))
    )
    order = Window.partitionBy(key, "chunk").orderBy("t")
    before, upto = order.rangeBetween(Window.unboundedPreceding, -1), order.rangeBetween(Window.unboundedPreceding, 0)
    failed = F.when(F.col("real"), F.col("step")).otherwise(0)
    works = F.col("real") & F.col("success")
    zero = F.lit(0)
    totals = marks.withColumns({
        "_recent": F.coalesce(F.sum("step").over(before), zero),
        "_before": F.coalesce(F.sum(failed).over(before), zero),
        "_upto": F.sum(failed).over(upto),
        "_last_ok": F.max(F.when(works, F.col("t"))).over(before),
    })
    # Failures up to the last success within the window are forgiven.
    forgiven = F.max(F.when(works, F.col("_upto"))).over(before)
    counted = totals.withColumn("_forgiven", forgiven).filter("real").filter(F.col("chunk") == chunk)
    since_success = F.when(
        F.col("_last_ok") >= F.col("at_s") - (span - 1), F.col("_before") - F.col("_forgiven")
    ).otherwise(F.col("_recent"))
    return counted.select(*attempts.columns, since_success.alias(name))


def lockout(attempts: DataFrame) -> DataFrame:
    """A report in which every failure counts, unlike in the rule (``exact_lockout``).

    ``attempts``: ``id, username, ip, success, at_s``. User names are compared case-folded.
    Attempts in one second see only earlier seconds.
    """
    folded = attempts.withColumn("user_key", F.lower(text.strip(F.col("username"))))
    counted = _recent_failures(_recent_failures(folded, "user_key", "user_failures"), "ip", "ip_failures")
    blocked = (F.col("user_failures") >= S.MAX_FAILED_USER) | (F.col("ip_failures") >= S.MAX_FAILED_IP)
    return counted.select("id", "user_key", "ip", "user_failures", "ip_failures", blocked.alias("blocked"))


def sign_in_keys(attempts: DataFrame) -> DataFrame:
    """``id, user_key, ip_key, at_s, success``: user names trimmed and folded, a blank IP null."""
    user = F.lower(text.strip(F.col("username")))
    ip = text.strip(F.col("ip"))
    return attempts.select(
        "id", F.when(user != "", user).alias("user_key"), F.when(ip != "", ip).alias("ip_key"), "at_s", "success")


class SignInRule:
    """Attempts in order, one at a time: which are locked out.

    A user is locked after so many failures in the window, an address after so many more. A
    locked attempt counts as nothing; a success clears both counters. An attempt without a user
    is neither locked nor counted; one without an address has only the user's counter.
    """

    def __init__(self, users: dict | None = None, addresses: dict | None = None):
        self.users, self.addresses = users or {}, addresses or {}

    @staticmethod
    def recent(counters: dict, key: str, at_s: int) -> list[int]:
        times = [t for t in counters.get(key, ()) if at_s - t < S.LOCK_WINDOW_SECONDS]
        if times:
            counters[key] = times
        else:
            counters.pop(key, None)
        return times

    def attempt(self, user: str | None, ip: str | None, at_s: int, success: bool) -> bool:
        if user is None:
            return False
        if len(self.recent(self.users, user, at_s)) >= S.MAX_FAILED_USER:
            return True
        if ip is not None and len(self.recent(self.addresses, ip, at_s)) >= S.MAX_FAILED_IP:
            return True
        for counters, key in ((self.users, user), (self.addresses, ip)):
            if key is None:
                continue
            if success:
                counters.pop(key, None)
            else:
                counters[key] = [*counters.get(key, ()), at_s]
        return False


def sign_in_groups(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``spell``: attempts that cannot influence each other have different ones.

    Only failures leave something behind, and for less than a window. So a key's failures with
    an empty window before them begin a new run, and other attempts belong to the run that covers
    their window or the one before; without one they are a spell of their own. Runs of users and of
    addresses that share an attempt are connected; a spell is a connected group of runs. The runs
    come from (key, slot) counts, and spells from the links between runs, both smaller than the attempts.
    """
    slot = F.floor(F.col("at_s") / S.LOCK_WINDOW_SECONDS)
    rows = keyed.withColumn("slot", slot)
    for key, run in (("user_key", "user_run"), ("ip_key", "ip_run")):
        slots = rows.filter(F.col(key).isNotNull() & ~F.coalesce("success", F.lit(False))).select(key, "slot").distinct()
        by_slot = Window.partitionBy(key).orderBy("slot")
        starts = F.when(F.coalesce(F.col("slot") - F.lag("slot").over(by_slot) > 1, F.lit(True)), F.col("slot"))
        runs = slots.withColumn("start", F.last(starts, ignorenulls=True).over(by_slot))
        name = F.concat_ws("|", F.lit(key[0]), "start", key)
        covered = runs.select(key, name.alias(run), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot")).distinct()
        rows = rows.join(covered, [key, "slot"], "left")
    links = settled(rows.filter("user_run is not null and ip_run is not null").select("user_run", "ip_run").distinct(), "run-links")
    spells = connected(links.select(F.col("user_run").alias("a"), F.col("ip_run").alias("b")))
    named = rows.join(spells.withColumnRenamed("node", "user_run"), "user_run", "left")
    alone = F.concat(F.lit("#"), F.coalesce(F.col("id").cast("string"), F.lit("-")))
    return named.withColumn("spell", F.coalesce("component", "user_run", "ip_run", alone)).drop("slot", "user_run", "ip_run", "component")


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of the nodes of ``links`` (a, b).

    Each round gives a node the smallest component among its neighbours' and then that one's
    own, so components merge in rounds that grow with the logarithm of the longest path.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = settled(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "spells")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(seen, labels["node"] == seen["a"], "left").select("node", F.least("component", "near").alias("component"))
        jumped = stepped.alias("x").join(stepped.alias("y"), F.col("x.component") == F.col("y.node"), "left").select(
            F.col("x.node").alias("node"), F.coalesce("y.component", "x.component").alias("component"))
        following = settled(jumped, "spells")
        changed = following.join(labels, ["node", "component"], "left_anti")
        if changed.isEmpty():
            return labels
        labels = following


ATTEMPT = "id long, user_key string, ip_key string, at_s long, success boolean"
REPLAYED = "unit string, " + ATTEMPT + ", blocked boolean, kind string, key string, times array<long>"


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Apply the rule to rows sorted by unit; a unit's open counters come before its attempts.

    Gives the attempts with their verdict, and after each unit the counters it leaves.
    """
    columns = [c.split()[0] for c in REPLAYED.split(", ")]
    unit, rule, touched = None, SignInRule(), {}

    def left() -> list[tuple]:
        stores = {"user": rule.users, "address": rule.addresses}
        return [(unit, None, None, None, at_s, None, None, kind, key, list(stores[kind].get(key, ()))) for (kind, key), at_s in touched.items()]

    for rows in batches:
        rows = rows.astype(object).where(rows.notna(), None)
        out = []
        for r in rows.itertuples(index=False):
            if r.unit != unit:
                out += left()
                unit, rule, touched = r.unit, SignInRule(), {}
            if r.kind is not None:
                (rule.users if r.kind == "user" else rule.addresses)[r.key] = [int(t) for t in r.times]
                continue
            blocked = rule.attempt(r.user_key, r.ip_key, r.at_s, bool(r.success))
            out.append((unit, r.id, r.user_key, r.ip_key, r.at_s, r.success, blocked, None, None, None))
            for kind, key in (("user", r.user_key), ("address", r.ip_key)):
                if key is not None:
                    touched[kind, key] = r.at_s
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(left(), columns=columns)


def replayed(units: DataFrame, counters: DataFrame) -> DataFrame:
    """Replay each ``unit`` of attempts on its own, from its open counters ``unit, kind, key, times``."""
    none = F.lit(None)
    rows = units.select("unit", "id", "user_key", "ip_key", "at_s", "success", none.cast("string").alias("kind"),
                        none.cast("string").alias("key"), none.cast("array<long>").alias("times"))
    seeds = counters.select(
        "unit", none.cast("long").alias("id"), none.cast("string").alias("user_key"), none.cast("string").alias("ip_key"),
        none.cast("long").alias("at_s"), none.cast("boolean").alias("success"), "kind", "key", "times")
    ordered = rows.unionByName(seeds).repartition("unit").sortWithinPartitions("unit", F.asc_nulls_first("at_s"), "id")
    return ordered.mapInPandas(_replay, REPLAYED)


def counter_keys(attempts: DataFrame, *more: str) -> DataFrame:
    """The counters that attempts look at."""
    pair = lambda kind, column: F.struct(F.lit(kind).alias("kind"), F.col(column).alias("key"))
    keys = attempts.select(*more, F.inline(F.array(pair("user", "user_key"), pair("address", "ip_key"))))
    return keys.filter("key is not null").distinct()


#: A spell of more attempts is cut into stretches of this many seconds, longer than the window.
SPELL_ROWS, STRETCH_SECONDS = 50_000, 4 * S.LOCK_WINDOW_SECONDS


def in_stretches(spells: DataFrame, seconds: int = STRETCH_SECONDS) -> DataFrame:
    """Replay long spells stretch by stretch, all stretches at once.

    Each stretch first assumes that no counter is open when it begins. Then those whose predecessor
    left something else than they assumed are replayed from that, until all agree; what agrees
    along the whole spell is the replay of the whole spell, since counters live for less than a
    stretch. A wrong assumption is forgotten with the first success or quiet window, so few
    stretches need a second round; in the worst case there is a round for each stretch.
    """
    units = settled(spells.withColumn("stretch", F.floor(F.col("at_s") / seconds)).withColumn(
        "unit", F.concat_ws("|", F.col("stretch").cast("string"), "spell")), "stretches")
    asked = settled(counter_keys(units, "unit", "spell", "stretch"), "stretch-keys")
    nothing = units.sparkSession.createDataFrame([], "unit string, kind string, key string, times array<long>")
    sign = lambda counters: counters.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("kind", "key", "times").cast("decimal(38,0)")).alias("h"))
    rows, used, assumed, ends, rounds = units, nothing, nothing, None, []
    while True:
        out = settled(replayed(rows, used), "stretches-replayed")
        left = out.filter("kind is not null").select("unit", "kind", "key", "times")
        redone = rows.select("unit").distinct()
        ends = settled(left if ends is None else ends.join(redone, "unit", "left_anti").unionByName(left), "stretch-ends")
        assumed = settled(assumed.join(redone, "unit", "left_anti").unionByName(used), "stretch-assumed")
        rounds.append((out, redone))
        # What a stretch leaves is what the next one finds, as far as it is in the window there.
        names = asked.select("unit", "spell", "stretch").distinct()
        handed = ends.join(names, "unit").withColumn("stretch", F.col("stretch") + 1).drop("unit")
        begins = F.col("stretch") * seconds - S.LOCK_WINDOW_SECONDS
        handed = handed.withColumn("times", F.filter("times", lambda t: t > begins)).filter("size(times) > 0")
        found = settled(handed.join(asked, ["spell", "stretch", "kind", "key"]).select("unit", "kind", "key", "times"), "stretch-found")
        both = sign(found).withColumnRenamed("n", "m").withColumnRenamed("h", "g").join(sign(assumed), "unit", "full")
        wrong = settled(both.filter(~(F.col("n").eqNullSafe(F.col("m")) & F.col("h").eqNullSafe(F.col("g")))).select("unit"), "stretches-wrong")
        if wrong.isEmpty():
            break
        rows, used = units.join(wrong, "unit", "left_semi"), settled(found.join(wrong, "unit", "left_semi"), "stretch-used")
    verdicts, later = [], None
    for out, redone in reversed(rounds):
        kept = out.filter("kind is null")
        verdicts.append(kept if later is None else kept.join(later, "unit", "left_anti"))
        later = redone if later is None else later.unionByName(redone).distinct()
    return reduce(DataFrame.unionByName, verdicts)


def exact_lockout(attempts: DataFrame, spell_rows: int = SPELL_ROWS, seconds: int = STRETCH_SECONDS) -> DataFrame:
    """Which attempts are locked out, with the counters of users and of addresses.

    ``attempts`` has ``id, username, ip, success, at_s``; attempts of one second go by ``id``. The
    work is split by spells that cannot influence each other; a task reads a spell in order
    and keeps only the times of open counters. Spells of more than ``spell_rows`` attempts, such
    as those of an address that is never idle, are replayed in stretches.
    """
    spells = settled(sign_in_groups(sign_in_keys(attempts)), "sign-in-spells")
    long = settled(spells.groupBy("spell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > spell_rows).select("spell"), "long-spells")
    nothing = spells.sparkSession.createDataFrame([], "unit string, kind string, key string, times array<long>")
    columns = [*[c.split()[0] for c in ATTEMPT.split(", ")], "blocked"]
    short = replayed(spells.join(long, "spell", "left_anti").withColumnRenamed("spell", "unit"), nothing)
    verdicts = short.filter("kind is null").select(*columns)
    if long.isEmpty():
        return verdicts
    return verdicts.unionByName(in_stretches(spells.join(long, "spell", "left_semi"), seconds).select(*columns))


def exact_user_lockout(attempts: DataFrame) -> DataFrame:
    """The rule with the counters of users alone."""
    alone = attempts.withColumn("ip", F.lit(None).cast("string"))
    return exact_lockout(alone).drop("ip_key")
