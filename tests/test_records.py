"""Duplicates, numbering, dictionary, sign-in rules and journal against brute force."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from formsift import schema as S
from tests.conftest import SF_DIR
from formsift.operators import activity, canon, dictionary, duplicates, journal, ranking, regions

KEYS = "doc_id long, filename string, snils string, name string, birth string"


def random_keys(n, seed):
    """A third of all records share one name, another third one number."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        snils = "1" * 11 if rnd.random() < 0.33 else rnd.choice([None, f"{rnd.randrange(40):011d}"])
        name = "hot" if rnd.random() < 0.33 else rnd.choice(["", f"n{rnd.randrange(30)}"])
        rows.append((i, f"f{i}", snils, name, rnd.choice(["", "01012010", "02022011"])))
    return rows


def pair_reason(cur, prev, either_blank=True):
    if cur[2] and cur[2] == prev[2]:
        return S.REASON_SNILS
    if cur[3] and cur[3] == prev[3]:
        if cur[4] and cur[4] == prev[4]:
            return S.REASON_NAME_BIRTH
        if not cur[4] or (either_blank and not prev[4]):
            return S.REASON_NAME
    return None


def test_batch_duplicates_match_all_pairs(spark):
    rows = random_keys(240, 1)
    df = spark.createDataFrame(rows, KEYS)
    expected, links = {}, set()
    for cur in rows:
        found = [(p[0], p[1], pair_reason(cur, p)) for p in rows[: cur[0]] if pair_reason(cur, p)]
        links |= {(cur[0], *f) for f in found}
        if found:
            reasons = [f[2] for f in found]
            counts = tuple(reasons.count(r) for r in (S.REASON_SNILS, S.REASON_NAME_BIRTH, S.REASON_NAME))
            expected[cur[0]] = (*counts, *found[0])
    # Width 7 spreads every hot group over many buckets.
    got = {r[0]: tuple(r[1:]) for r in duplicates.batch_duplicates(df, buckets=4).collect()}
    assert got == expected
    chosen = df.filter("doc_id >= 200")
    listed = {tuple(r) for r in duplicates.matches_of(chosen, df).collect()}
    assert listed == {x for x in links if x[0] >= 200}


def test_journal_duplicates_match_all_pairs(spark):
    incoming, stored = random_keys(80, 2), random_keys(120, 3)
    a, b = spark.createDataFrame(incoming, KEYS), spark.createDataFrame(stored, KEYS)
    for either in (False, True):
        expected = {}
        for cur in incoming:
            found = [(p[0], pair_reason(cur, p, either)) for p in stored if pair_reason(cur, p, either)]
            if found:
                reasons = [f[1] for f in found]
                counts = tuple(reasons.count(r) for r in (S.REASON_SNILS, S.REASON_NAME_BIRTH, S.REASON_NAME))
                expected[cur[0]] = (*counts, *found[0])
        got = {r[0]: tuple(r[1:]) for r in duplicates.journal_duplicates(a, b, undated_rows=either).collect()}
        assert got == expected


def test_numbering_over_buckets(spark):
    ids = spark.range(0, 1000, 7)
    got = [tuple(r) for r in ranking.number_by_id(ids, "id", "no", buckets=8).orderBy("id").collect()]
    assert got == [(i, n) for n, i in enumerate(range(0, 1000, 7), 1)]
    boxes = spark.createDataFrame(
        [(1, i, (i * 37) % 11 * 100, i % 3, 0, 0) for i in range(60)], "page_id long, det_no int, y1 int, x1 int, x2 int, y2 int"
    )
    rows = regions.reading_order(boxes).orderBy("reading_no").collect()
    assert [r.reading_no for r in rows] == list(range(1, 61))
    assert [(r.y1, r.x1, r.det_no) for r in rows] == sorted((r.y1, r.x1, r.det_no) for r in rows)


def test_nearest_entries_lose_no_match(spark):
    rnd = random.Random(4)
    letters = "абвгдеклмнор"
    entries = sorted({"".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(150)})
    words = []
    for e in entries:
        w = list(e)
        w[rnd.randrange(len(w))] = rnd.choice(letters)
        if rnd.random() < 0.3:
            w.insert(rnd.randrange(len(w)), rnd.choice(letters))
        words.append("".join(w))
    words = sorted(set(words))
    for category in ("surnames", "organizations"):
        limit = S.MATCH_THRESHOLDS[category]
        expected = {}
        for w in words:
            best = min((-SequenceMatcher(None, w, e).ratio(), e) for e in entries)
            if -best[0] >= limit:
                expected[w] = (best[1], round(-best[0], 9))
        keys = spark.createDataFrame([(category, w) for w in words], "category string, norm string")
        table = spark.createDataFrame([(category, e) for e in entries], "category string, value string")
        got = {r.norm: (r.to, round(r.score, 9)) for r in dictionary.nearest_entries(keys, table).collect()}
        assert got == expected and expected


def test_the_letter_keys_never_meet_the_rows(spark, tmp_path):
    """The search starts from the distinct words, so that its conditions cannot run once a row."""
    rows = spark.createDataFrame([("surnames", "бодров")] * 3, "category string, norm string")
    rows.write.parquet(f"{tmp_path}/rows")
    entries = spark.createDataFrame([("surnames", "Бобров")], "category string, value string")
    found = dictionary.nearest_entries(spark.read.parquet(f"{tmp_path}/rows").distinct(), entries)
    assert [(r.norm, r.to) for r in found.collect()] == [("бодров", "Бобров")]
    assert found.inputFiles() and not any(str(tmp_path / "rows") in name for name in found.inputFiles())


@pytest.mark.parametrize("category, most", [("surnames", 0.12), ("cities", 0.05)])
def test_few_pairs_become_candidates(spark, category, most):
    """Distinct words of real texts: the share of all pairs that the letter keys let through."""
    def words(table):
        column = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
        found = spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(column.alias("norm")).filter("norm <> ''").distinct()
        return found.orderBy(F.xxhash64("norm")).limit(1500).select(F.lit(category).alias("category"), "norm")

    left, right = words("documents"), words("conversations").withColumn("to", F.col("norm"))
    pairs = dictionary.candidate_pairs(left, right).select("norm", "known").distinct().count()
    assert 0 < pairs <= most * left.count() * right.count(), pairs / (left.count() * right.count())


def test_dictionary_rules(spark):
    rows = [(1, S.CHILD_FIO, "Бодров алексей Влодимирович"), (1, S.ADDRESS, "г. Воронеш, ул"), (2, S.PASSPORT, "выдан РЖТ"), (3, S.PARENT_FIO, "Иванов")]
    df = spark.createDataFrame(rows, "doc_id long, field string, value string")
    corrections = spark.createDataFrame([("surnames", "бодров", "Бобров", 1)], "category string, wrong string, right string, seq long")
    entries = dictionary.dictionary_entries(dictionary.default_entries(spark), corrections)
    fio = dictionary.rebuilt(df, dictionary.propose(dictionary.fio_tokens(df), entries, corrections))
    assert {(r.doc_id, r.corrected) for r in fio.collect()} == {(1, "Бобров Алексей Владимирович")}
    proposed = dictionary.propose(dictionary.text_tokens(df), entries, corrections)
    assert {(r.doc_id, r.corrected) for r in dictionary.rebuilt(df, proposed).collect()} == {(1, "г. Воронеж ул"), (2, "выдан РЖД")}


def test_corrections_log(spark):
    schema = "category string, wrong string, right string, seq long"
    existing = spark.createDataFrame([("cities", "Липец", "Липецк", 1)], schema)
    confirmed = spark.createDataFrame([
        ("cities", " липец ", "Липецк", 2), ("cities", "липец", "Лип", 3), ("cities", "Липец", "Липецк", 4), ("cities", "", "x", 5),
    ], schema)
    kept = dictionary.new_corrections(existing, confirmed)
    assert sorted(r.seq for r in kept.collect()) == [3, 4]
    mapping = dictionary.current_corrections(existing.unionByName(kept)).collect()
    assert [(r.norm, r.right) for r in mapping] == [("липец", "Липецк")]


LOGINS = "id long, username string, ip string, success boolean, at_s long"


def random_logins(n, seed):
    rnd = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rnd.choice([0, 1, 20, 100, 400, 2500])
        user = "Hot" if rnd.random() < 0.5 else f"u{rnd.randrange(4)}"
        rows.append((i, rnd.choice([user, user.upper()]), f"ip{rnd.randrange(2)}", rnd.random() < 0.1, at))
    return rows


def replay(rows):
    """The recursive rule per user, attempt by attempt."""
    fails, out = {}, {}
    for i, user, _, success, at in rows:
        recent = [t for t in fails.get(user.lower(), []) if at - t < 900]
        out[i] = len(recent) >= 5
        fails[user.lower()] = recent if out[i] else ([] if success else [*recent, at])
    return out


def test_lockout(spark):
    rows = random_logins(600, 5)
    df = spark.createDataFrame(rows, LOGINS)

    def failures(cur, key):
        past = [r for r in rows if key(r) == key(cur) and cur[4] - 900 < r[4] < cur[4]]
        last = max((r[4] for r in past if r[3]), default=-1)
        return sum(not r[3] and r[4] > last for r in past)

    expected = {r[0]: (failures(r, lambda x: x[1].lower()), failures(r, lambda x: x[2])) for r in rows}
    got = {r.id: (r.user_failures, r.ip_failures) for r in activity.lockout(df).collect()}
    assert got == expected
    exact = {r.id: r.blocked for r in activity.exact_user_lockout(df).collect()}
    assert exact == replay(rows) and any(exact.values())


def test_append_grows_before_service_columns(spark):
    base = spark.createDataFrame([("1", "Иванов", "a.png", "Проверено")], f"`{S.ROW_NUMBER}` string, `{S.CHILD_FIO}` string, `{S.SOURCE_FILE}` string, `{S.REVIEW_STATUS}` string")
    new = spark.createDataFrame([(7, "=Петров", "физика", "b.png")], "id long, `ФИО ребенка` string, `Предметы` string, `Файл` string")
    out = journal.append_records(base, new, "id")
    assert out.columns == [S.ROW_NUMBER, S.CHILD_FIO, "Предметы", S.SOURCE_FILE, S.REVIEW_STATUS]
    assert tuple(out.filter(F.col("Предметы").isNotNull()).first()) == ("2", "'=Петров", "физика", "b.png", None)
    assert journal.find_column(S.JOURNAL_COLUMNS, "Телефон родителя") == S.PARENT_FIO


def test_log_rows_hold_no_business_values(spark):
    df = spark.createDataFrame([(1, "u", "x", "Иванов", "f.png")], f"id long, username string, action string, `{S.CHILD_FIO}` string, filename string")
    assert canon.pii_safe(df).columns == ["id", "username", "action"]


def test_numbering_of_sparse_identifiers(spark):
    """Hashed 64-bit identifiers: even buckets, and no window without a partition but over totals."""
    ids = spark.range(5000).select(F.xxhash64("id").alias("id"))
    numbered = ranking.number_by_id(ids, "id", "no", buckets=64)
    rows = sorted(tuple(r) for r in numbered.collect())
    assert [n for _, n in rows] == list(range(1, 5001))
    sizes = [r["count"] for r in ranking.with_bucket(ids, "id", 64).groupBy("_bucket").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 5000 / 64
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    lone = [line for line in plan.splitlines() if "Window [" in line and "], [_bucket#" in line and ", [_bucket#" not in line.split("windowspec")[1]]
    assert all("sum(_n" in line for line in lone)


def test_lockout_of_users_and_addresses(spark):
    """One hot address over many hours, blank users and addresses, equal seconds, successes."""
    rng = random.Random(12)
    rows, at = [], 0
    for i in range(700):
        at += 4000 if i % 120 == 119 else rng.choice([0, 0, 1, 5, 20, 40])
        user = rng.choice(["anna", " Anna ", "boris", "clara", "", None] + [f"u{k}" for k in range(12)])
        ip = rng.choice(["10.0.0.1"] * 5 + ["10.0.0.2", " ", None])
        rows.append((i, user, ip, rng.random() < 0.03, at))
    users, addresses, want = {}, {}, {}
    for i, user, ip, success, t in sorted(rows, key=lambda r: (r[4], r[0])):
        user, ip = (user or "").strip().lower(), (ip or "").strip()
        for counters in (users, addresses):
            for key in counters:
                counters[key] = [x for x in counters[key] if t - x < 900]
        want[i] = bool(user) and (len(users.get(user, [])) >= 5 or bool(ip) and len(addresses.get(ip, [])) >= 15)
        if user and not want[i]:
            for counters, key in ((users, user), (addresses, ip)):
                if key:
                    counters[key] = [] if success else counters.get(key, []) + [t]
    got = {r.id: r.blocked for r in activity.exact_lockout(spark.createDataFrame(rows, LOGINS)).collect()}
    assert got == want and 50 < sum(want.values()) < 650
    assert activity.sign_in_groups(activity.sign_in_keys(spark.createDataFrame(rows, LOGINS))).select("spell").distinct().count() > 3


def test_one_address_that_is_never_idle_makes_many_tasks(spark):
    """Attempts of a month of two addresses that share users, cut into stretches; the rule one by one."""
    rng = random.Random(12)
    rows, at = [], 0
    for i in range(6000):
        at += rng.choice([1, 5, 30, 60, 120, 240])
        rows.append((i, f"u{rng.randrange(12)}", "1" if rng.random() < 0.9 else "2", rng.random() < 0.04, at))
    rule = activity.SignInRule()
    want = {i: rule.attempt(user, ip, t, ok) for i, user, ip, ok, t in rows}
    logins = spark.createDataFrame(rows, LOGINS)
    spells = activity.sign_in_groups(activity.sign_in_keys(logins))
    largest = spells.groupBy("spell").count().agg({"count": "max"}).first()[0]
    assert largest > 4000 and at // activity.STRETCH_SECONDS > 100
    got = activity.exact_lockout(logins, spell_rows=1000).collect()
    assert len(got) == len(rows) and {r.id: r.blocked for r in got} == want and 100 < sum(want.values())
    got = activity.exact_lockout(logins, spell_rows=0, seconds=1000).collect()
    assert {r.id: r.blocked for r in got} == want
