"""Streaming queries: the driver's files as a stream, processed until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from formsift import schema as S
from formsift.operators import dictionary, duplicates
from formsift.plans import duck as D
from formsift.plans.activity_queries import BOTH_COUNTERS, EXACT_LOCKOUT
from formsift.plans.dictionary_queries import _DEFAULTS, _ENTRIES, _TOKENS, _VALID
from formsift.plans.record_queries import _PAIRS
from formsift.plans.registry import query
from formsift.session import shared_folder, use_utc
from formsift.sources.fixtures import derived
from formsift.streaming import corrections, sign_in, streams

c = F.col


def _stream(spark, sf, fixture: str, base: str):
    """A derived table over a streaming base table."""
    use_utc(spark)
    view = f"fs_stream_{base}"
    streams.read_stream(spark, sf, base).createOrReplaceTempView(view)
    return derived(spark, sf, fixture, views={base: view})


def _timed(df):
    return df.withColumn("ts", c("ts").cast("timestamp"))


#: Micro-batches of the queries below that deal their events to several.
ROUNDS = 4


def _in_rounds(spark, events, purpose: str):
    """A stream of ``events`` whose ``turn`` 0, 1, ... are micro-batches, written in that order."""
    folder, columns = shared_folder(spark, purpose), [col for col in events.columns if col != "turn"]
    for turn in range(ROUNDS):
        events.filter(c("turn") == turn).select(*columns).coalesce(1).write.parquet(f"{folder}/turn={turn}")
    schema = events.select(*columns).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/turn=*")


@query("i1_stream_normalise", f"SELECT doc_id, field, {D.auto_format('field', 'value')} AS formatted FROM fx_fields")
def i1_stream_normalise(spark, sf):
    return streams.run_to_table(streams.normalise(_stream(spark, sf, "fx_fields", "customer")), "stream-normalise")


@query("i2_stream_duplicates", f"WITH {_PAIRS} SELECT doc_id, n_snils, n_name_birth, n_name FROM found")
def i2_stream_duplicates(spark, sf):
    keys = duplicates.application_keys(_stream(spark, sf, "fx_applications", "customer"))
    return streams.mark_duplicates(keys)


@query("i2_first_seen", "SELECT DISTINCT username, action FROM fx_activity")
def i2_first_seen(spark, sf):
    stream = _timed(_stream(spark, sf, "fx_activity", "events"))
    seen = streams.first_seen(stream, ["username", "action"], "ts", "60 days")
    return streams.run_to_table(seen.select("username", "action"), "stream-first-seen")


@query("i3_daily_activity", """
SELECT day, count(*) AS actions, count(*) FILTER (WHERE ok) AS ok_count FROM (SELECT CAST(ts AS date) AS day, ok FROM fx_activity) t
GROUP BY day HAVING CAST(day AS timestamp) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM fx_activity)""")
def i3_daily_activity(spark, sf):
    stream = _timed(_stream(spark, sf, "fx_activity", "events"))
    return streams.run_to_table(streams.daily_activity(stream), "stream-daily")


@query("i4_stream_lockout", EXACT_LOCKOUT)
def i4_stream_lockout(spark, sf):
    return streams.run_to_table(streams.lockout(_stream(spark, sf, "fx_logins", "events")), "stream-lockout")


@query("i4_sign_in_stream", BOTH_COUNTERS)
def i4_sign_in_stream(spark, sf):
    """Users' and addresses' counters over four micro-batches; attempts come up to 20 minutes late."""
    logins = derived(spark, sf, "fx_logins")
    first, last = logins.agg(F.min("at_s"), F.max("at_s")).first()
    arrival = (c("at_s") + c("id") % 3 * 600 - first) / (last + 1201 - first)
    events = logins.withColumn("turn", F.floor(arrival * ROUNDS))
    done, _ = sign_in.lockout(_in_rounds(spark, events, "sign-in-events"), delay_s=1200)
    return done.select("id", "user_key", "ip_key", "blocked")


@query("i4_sliding_failures", """
WITH fails AS (SELECT lower(username) AS user_key, at_s // 60 AS m FROM fx_logins WHERE NOT success),
slots AS (SELECT user_key, unnest(range(m - 14, m + 1)) AS start FROM fails)
SELECT user_key, CAST(make_timestamp(start * 60000000) AS timestamp) AS from_ts, count(*) AS failures FROM slots
WHERE (start + 15) * 60 <= (SELECT max(at_s) - 3600 FROM fx_logins WHERE NOT success) GROUP BY ALL""")
def i4_sliding_failures(spark, sf):
    logins = _stream(spark, sf, "fx_logins", "events").select(
        F.lower("username").alias("user_key"), "success", F.timestamp_seconds("at_s").alias("ts")
    )
    return streams.run_to_table(streams.sliding_failures(logins), "stream-failures")


_SESSIONS = """
WITH accessed AS (SELECT username, epoch_us(ts) // 1000000 AS s FROM fx_activity),
marked AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY username ORDER BY s) <= 86399 THEN 0 ELSE 1 END AS starts FROM accessed),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY username ORDER BY s ROWS UNBOUNDED PRECEDING) AS no FROM marked),
spans AS (SELECT username, make_timestamp(min(s) * 1000000) AS started, make_timestamp((max(s) + 86399) * 1000000) AS ended, count(*) AS accesses
  FROM numbered GROUP BY username, no)
SELECT * FROM spans"""


@query("i5_sessions", _SESSIONS)
def i5_sessions(spark, sf):
    return streams.sessions(_timed(derived(spark, sf, "fx_activity")))


@query("i5_stream_sessions", _SESSIONS + " WHERE ended <= (SELECT make_timestamp(max(s) * 1000000) - INTERVAL 1 HOUR FROM accessed)")
def i5_stream_sessions(spark, sf):
    stream = _timed(_stream(spark, sf, "fx_activity", "events"))
    return streams.run_to_table(streams.sessions(stream, "1 hour"), "stream-sessions")


@query("i6_stream_corrections", f"""WITH {_ENTRIES} SELECT category, norm, good AS "right" FROM mapping""")
def i6_stream_corrections(spark, sf):
    pairs = _stream(spark, sf, "fx_corrections", "customer").withColumnRenamed("right_value", "right")
    log = corrections.collect_corrections(pairs.select("category", "wrong", "right", "seq"))
    return dictionary.current_corrections(log)


_TURNED = f"""
turned AS (SELECT category, wrong, good, seq % {ROUNDS} AS turn, seq % {ROUNDS} * 1000000000 + seq AS seq FROM valid_corrections WHERE wrong <> ''),
pairs AS (SELECT category, {D.squeeze(D.fold('wrong'))} AS norm, good, seq, turn FROM turned),
turns AS (SELECT unnest(range({ROUNDS})) AS turn),
in_force AS (SELECT t.turn, category, norm, arg_max(good, seq) AS good FROM turns t JOIN pairs p ON p.turn < t.turn GROUP BY ALL),
own AS (SELECT * FROM (VALUES {{defaults}}) v(category, value) UNION SELECT category, value FROM fx_entries),
learned AS (SELECT t.turn, category, value FROM turns t, own UNION SELECT t.turn, category, good FROM turns t JOIN turned p ON p.turn < t.turn),
exact AS (SELECT turn, category, {D.squeeze(D.fold('value'))} AS norm, min(value) AS value FROM learned GROUP BY ALL)"""


@query("i6_corrected_documents", f"""
WITH {_VALID}, {_TURNED.format(defaults=_DEFAULTS)}, {_TOKENS},
tokens AS (SELECT * FROM fio_tokens UNION ALL SELECT * FROM text_tokens),
changed AS (SELECT t.doc_id, t.field, t.part_no, coalesce(m.good, e.value) AS "to"
  FROM tokens t LEFT JOIN in_force m ON m.turn = t.doc_id % {ROUNDS} AND m.category = t.category AND m.norm = t.norm
  LEFT JOIN exact e ON e.turn = t.doc_id % {ROUNDS} AND e.category = t.category AND e.norm = t.norm
  WHERE m.good IS NOT NULL OR e.value <> t.word),
words AS (SELECT * FROM fio_words UNION ALL SELECT * FROM text_words),
patched AS (SELECT w.doc_id, w.field, string_agg(coalesce(c."to", w.word), ' ' ORDER BY w.part_no) AS corrected, count(c."to") AS n_changed
  FROM words w LEFT JOIN changed c USING (doc_id, field, part_no) GROUP BY ALL)
SELECT f.doc_id, f.field, CASE WHEN n_changed > 0 THEN p.corrected ELSE f.value END AS corrected, coalesce(n_changed, 0) AS n_changed, CAST(f.doc_id % {ROUNDS} AS int) AS batch
FROM fx_fields f LEFT JOIN patched p USING (doc_id, field)""")
def i6_corrected_documents(spark, sf):
    """Documents in four micro-batches, each with the changes accepted while it was shown."""
    documents = derived(spark, sf, "fx_fields").select("doc_id", "field", "value", (c("doc_id") % ROUNDS).alias("turn"))
    part = F.when(c("category").isin("cities", "organizations"), "").otherwise(c("category"))
    field = F.when(c("category") == "cities", S.ADDRESS).when(c("category") == "organizations", S.PASSPORT).otherwise(S.CHILD_FIO)
    accepted = derived(spark, sf, "fx_corrections").select(
        (c("seq") % ROUNDS * 1_000_000_000 + c("seq")).alias("seq"), part.alias("field_part"), field.alias("field"), c("wrong").alias("from"), c("right_value").alias("to"), (c("seq") % ROUNDS).alias("turn"))
    events = corrections.document_events(documents, "turn").unionByName(corrections.accepted_events(accepted, "turn"))
    entries = dictionary.default_entries(spark).unionByName(derived(spark, sf, "fx_entries"))
    done, _ = corrections.correct_as_confirmed(_in_rounds(spark, events, "confirmed-events"), entries, fuzzy=False)
    return done.select("doc_id", "field", "corrected", "n_changed", "batch")


@query("i7_stream_progress", """
SELECT job_id, count(*) AS total, count(*) FILTER (WHERE status IN ('done', 'error')) AS completed FROM fx_items GROUP BY job_id""")
def i7_stream_progress(spark, sf):
    return streams.job_progress(_stream(spark, sf, "fx_items", "events"))
