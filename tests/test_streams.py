"""Streams over several files give what one batch job gives."""

import pathlib
import random
import shutil

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from formsift import schema as S
from formsift.operators import activity, dictionary, duplicates
from formsift.streaming import corrections, keyed, sign_in, streams
from tests.test_records import KEYS, LOGINS, random_keys, random_logins, replay


def files(spark, folder, name, rows, schema, parts):
    """Rows cut into files by order; each becomes one micro-batch."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1)
        part.write.parquet(f"{folder}/{name}/part={i}")
    spark.createDataFrame(rows[:1], schema).write.parquet(f"{folder}/schema/{name}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    return stream.select(*spark.createDataFrame([], schema).columns)


def test_duplicates_over_batches(spark, tmp_path):
    rows = random_keys(90, 7)
    stream = files(spark, tmp_path, "keys", rows, KEYS, 3)
    got = {tuple(r) for r in streams.mark_duplicates(stream).select("doc_id", "n_snils", "n_name_birth", "n_name").collect()}
    whole = duplicates.batch_duplicates(spark.createDataFrame(rows, KEYS))
    assert got == {tuple(r) for r in whole.select("doc_id", "n_snils", "n_name_birth", "n_name").collect()}


def test_lockout_over_batches(spark, tmp_path):
    rows = random_logins(200, 8)
    stream = files(spark, tmp_path, "logins", rows, LOGINS, 3)
    got = {r.id: r.blocked for r in streams.run_to_table(streams.lockout(stream, "1 day"), "t").collect()}
    assert got == replay(rows)
    batch = activity.exact_user_lockout(spark.createDataFrame(rows, LOGINS))
    assert got == {r.id: r.blocked for r in batch.collect()}


@pytest.mark.parametrize("delay", [0, 40])
def test_both_counters_over_batches(spark, tmp_path, delay):
    """Attempts come in disorder up to the delay; those further behind are told apart."""
    rng = random.Random(delay)
    rows, at = [], 0
    for i in range(240):
        at += rng.choice([0, 1, 20, 60, 400])
        rows.append((i, rng.choice(["A", "a ", "b", "c", "d", " ", None]), rng.choice(["1", "1", "2", "", None]), rng.random() < 0.1, at))
    arrived = sorted(rows, key=lambda r: (r[4] + rng.uniform(0, delay), r[0]))
    stray = (999, "a", "1", False, rows[10][4])
    stream = files(spark, tmp_path, "logins", [*arrived, stray], LOGINS, 4)
    judged, late = sign_in.lockout(stream, delay_s=delay)
    rule, want = activity.SignInRule(), {}
    for i, user, ip, ok, t in sorted(rows, key=lambda r: (r[4], r[0])):
        user, ip = (user or "").strip().lower() or None, (ip or "").strip() or None
        want[i] = rule.attempt(user, ip, t, ok)
    assert {r.id: r.blocked for r in judged.collect()} == want and True in want.values()
    assert [r.id for r in late.collect()] == [999]


def test_corrections_over_batches(spark, tmp_path):
    schema = "category string, wrong string, right string, seq long"
    rows = [("cities", "а", "А", 1), ("cities", "а", "А", 2), ("cities", "а", "Б", 3), ("cities", "а", "А", 4), ("cities", "б", "Б", 5), ("cities", "а", "А", 6)]
    log = corrections.collect_corrections(files(spark, tmp_path, "pairs", rows, schema, 3))
    assert sorted(r.seq for r in log.collect()) == [1, 2, 3, 4, 5]
    mapping = {r.norm: r.right for r in dictionary.current_corrections(log).collect()}
    assert mapping == {"а": "А", "б": "Б"}


def test_a_confirmed_pair_acts_from_the_next_batch_on(spark, tmp_path):
    """L4's changes go through A10 into the mapping; documents of the same batch don't see them."""
    fio, address = S.CHILD_FIO, S.ADDRESS
    doc = lambda i, field, value: ("document", i, field, value, None, None, None, None)
    took = lambda seq, part, field, a, b: ("accepted", None, field, None, seq, part, a, b)
    turns = [
        [doc(1, fio, "Бодров Иван"), took(1, "surnames", fio, "Бодров", " Бобров ")],
        [doc(2, fio, "Бодров Иван"), doc(3, address, "г. Липецкъ, дом"), took(2, "", address, "липецкъ", "Липецк"), took(3, "surnames", fio, "бодров", "Бобров")],
        [doc(4, fio, "БОДРОВ  Иван"), doc(5, address, "г. Липецкъ, дом"), took(4, "surnames", fio, "Бодров", "Будров"), took(5, "", fio, "", "x")],
        [doc(6, fio, "бодров иван"), doc(7, fio, "липецк липецк"), doc(8, None, None), doc(9, fio, "бобров Иван")],
    ]
    rows = [e for turn in turns for e in turn + [doc(0, fio, "")] * (5 - len(turn))]
    events = files(spark, tmp_path, "events", rows, corrections.EVENTS, 4)
    entries = spark.createDataFrame([("first_names", "Иван")], "category string, value string")
    done, log = corrections.correct_as_confirmed(events, entries, fuzzy=False)
    got = {r.doc_id: (r.corrected, r.n_changed, r.batch) for r in done.filter("doc_id > 0").collect()}
    assert got == {
        1: ("Бодров Иван", 0, 0), 2: ("Бобров Иван", 1, 1), 3: ("г. Липецкъ, дом", 0, 1), 4: ("Бобров Иван", 1, 2), 5: ("г. Липецк дом", 1, 2),
        6: ("Будров Иван", 2, 3), 7: ("липецк липецк", 0, 3), 8: (None, 0, 3), 9: ("Бобров Иван", 1, 3),
    }
    assert sorted((r.seq, r.category, r.right, r.batch) for r in log.collect()) == [
        (1, "surnames", "Бобров", 0), (2, "cities", "Липецк", 1), (4, "surnames", "Будров", 2)]


def test_state_is_the_same_for_any_history(spark, tmp_path):
    """What a batch reads is bounded over 20 batches; a repeated batch reads and writes the same."""
    rng = random.Random(1)
    state = keyed.KeyedState(spark, f"{tmp_path}/state", "a string, b long, v long", ["a", "b"], every=4, buckets=3)
    want, read = {}, []
    for number in range(20):
        rows = {(rng.choice(["x", "y", None]), rng.choice([1, 2, 3, None])): rng.randrange(99) for _ in range(rng.randrange(4))}
        changed = spark.createDataFrame([(*k, v) for k, v in rows.items()], "a string, b long, v long")
        for _ in range(2 if number % 3 == 0 else 1):
            before = {(r.a, r.b): r.v for r in state.in_force(number).collect()}
            assert before == want
            state.put(number, changed)
        read.append(len(state.in_force(number).inputFiles()))
        asked = spark.createDataFrame([("x", 1), (None, None)], "a string, b long")
        assert {(r.a, r.b): r.v for r in state.in_force(number, asked).collect()} == {k: v for k, v in want.items() if k in (("x", 1), (None, None))}
        want |= rows
    assert max(read) <= 4 * 3 and len(list((tmp_path / "state").iterdir())) <= 2 * 4 + 3


def test_duplicates_read_no_earlier_batch(spark, tmp_path, monkeypatch):
    """One number in every record: the state has one row for it, however many batches."""
    rows = [(i, f"f{i}", "1" * 11, "", "") for i in range(30)]
    found = streams.mark_duplicates(files(spark, tmp_path, "hot", rows, KEYS, 5)).collect()
    assert {r.doc_id: r.n_snils for r in found} == {i: i for i in range(1, 30)}


def test_progress_over_batches(spark, tmp_path):
    rows = [(i % 2, "done" if i % 3 else "pending") for i in range(12)]
    stream = files(spark, tmp_path, "items", rows, "job_id long, status string", 3)
    got = {r.job_id: (r.total, r.completed) for r in streams.job_progress(stream).collect()}
    assert got == {0: (6, 4), 1: (6, 4)}


def test_session_end_is_exclusive(spark):
    df = spark.createDataFrame([("u", 0), ("u", 86399), ("u", 86399 + 86400)], "username string, s long")
    rows = streams.sessions(df.select("username", F.timestamp_seconds("s").alias("ts"))).orderBy("started").collect()
    assert [r.accesses for r in rows] == [2, 1]


@pytest.mark.parametrize("as_folder", [False, True])
def test_stream_reads_the_table_and_no_other(spark, tmp_path, as_folder):
    """One file or a folder of files; a table whose name begins alike stays out."""
    rows = spark.range(40).select("id", (F.col("id") % 3).alias("v"))
    for name, table in (("part", rows), ("partsupp", rows.limit(7))):
        table.repartition(4 if as_folder else 1).write.parquet(f"{tmp_path}/written/{name}")
        if as_folder:
            shutil.move(f"{tmp_path}/written/{name}", f"{tmp_path}/{name}.parquet")
        else:
            (file,) = pathlib.Path(f"{tmp_path}/written/{name}").glob("part-*.parquet")
            shutil.move(file, f"{tmp_path}/{name}.parquet")
    got = streams.run_to_table(streams.read_stream(spark, str(tmp_path), "part", 1), "source").collect()
    assert sorted(r.id for r in got) == list(range(40))


def test_stream_of_no_table_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        streams.read_stream(spark, str(tmp_path), "part")
