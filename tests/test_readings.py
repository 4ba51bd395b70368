"""Votes, merges and adjudication of readings; pages; model answers."""

import itertools
import random

from pyspark.sql import functions as F

from formsift.functions.align import aligned_pairs
from formsift.operators import pages, reconcile, responses
from formsift.operators.reader import read_fields
from formsift.schema import BIRTH_DATE, CHILD_FIO, GAP, PASSPORT, PHONE, SNILS

SCHEMA = "doc_id long, field string, kind string, view_no int, value string, status string, error string"


def rows_of(doc_id, field, page, views, second=None):
    rows = [(doc_id, field, "page", 0, page, "read", None)]
    rows += [(doc_id, field, "view", i, v, "read", None) for i, v in enumerate(views, 1)]
    if second is not None:
        rows.append((doc_id, field, "adjudication", len(views) + 1, second, "read", None))
    return rows


def readings(spark, *documents):
    """Documents (field, page, views[, second]) numbered from 0."""
    rows = [row for i, doc in enumerate(documents) for row in rows_of(i, *doc)]
    return spark.createDataFrame(rows, SCHEMA)


CASES = [
    (PHONE, "[неразборчиво]", ["8 901 123 45 67", "+7 (900) 128-45-67", "9001234568"], "+7 (900) 123-45-67", True, ""),
    (PHONE, "9000000000", ["9001234567", "9001234568", "9001234569"], "9000000000", False, "9001234567 / 9001234568 / 9001234569"),
    (PHONE, "9001234567", ["900123456", "9001234567", "90012345678"], "9001234567", False, "900123456 / 90012345678"),
    (BIRTH_DATE, "45.13.2026", ["17.07.2014", "14.04.2014", "14.07.2017"], "14.07.2014", True, ""),
    (BIRTH_DATE, "21.02.2026", ["21.02.2026", "31.03.2026", "31.02.2027"], "21.02.2026", False, "31.02.2026 / 31.03.2026 / 31.02.2027"),
    (SNILS, "112", ["11223344695", "11223344585", "11223344596"], "112-233-445 95", True, ""),
    (SNILS, "112", ["11223344694", "11223344584", "11223344593"], "112", False, "112-233-445 94 / 11223344694 / 11223344584 / 11223344593"),
    (BIRTH_DATE, "14.07.2014", ["17.07.2014", "17.07.2014", "14.07.2014"], "14.07.2014", False, "17.07.2014"),
    (PASSPORT, "x", ["45 12 123456 от 01.02.2003", "45 12 123456 от 01.02.2004", "4512123456"], "x", False, None),
]


def test_multi_view(spark):
    df = reconcile.multi_view(readings(spark, *[case[:3] for case in CASES]))
    found = {r.doc_id: r for r in df.collect()}
    for i, (_, _, _, value, verified, alternative) in enumerate(CASES):
        row = found[i]
        assert (row.value, row.verified, row.status) == (value, verified, "read" if verified else "needs_review")
        if alternative is not None:
            assert row.alternative == alternative


def test_tie_positions_and_permutations(spark):
    views = ["9001234567", "9001234568", "9001234569"]
    docs = [(PHONE, "", list(order)) for order in itertools.permutations(views)]
    voted = reconcile.with_digit_vote(reconcile.tally(readings(spark, *docs))).collect()
    assert {(tuple(r.unresolved), r.consensus) for r in voted} == {((10,), "")}


def test_repeated_readings_count_as_votes(spark):
    rows = [(1, PHONE, "page", 0, "", "read", None)]
    rows += [(1, PHONE, "view", i, "9001234567", "read", None) for i in range(1, 2001)]
    rows += [(1, PHONE, "view", 3000 + i, "9001234568", "read", None) for i in range(1500)]
    row = reconcile.multi_view(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row.value, row.verified, len(row.options)) == ("9001234567", True, 2)


SECOND_READS = [
    ("9001234567", "9001234567", "9001234567", True, [10]),
    ("", "9001234568", "9001234568", True, [10]),
    ("9001234567", "9001234568", "9001234567", False, [10]),
    ("9001234567", "9009999999", "9001234567", False, [10]),
]


def test_adjudication(spark):
    views = ["9001234568", "9001234569"]
    docs = [(PHONE, page, views, second) for page, second, *_ in SECOND_READS]
    docs.append((PHONE, "9001234567", ["900123456", "9001234568"]))
    out = {r.doc_id: r for r in reconcile.adjudicate(reconcile.multi_view(readings(spark, *docs))).collect()}
    for i, (_, _, value, verified, conflicts) in enumerate(SECOND_READS):
        assert (out[i].value, out[i].verified, list(out[i].conflict_positions)) == (value, verified, conflicts)
    assert out[3].alternative.endswith(" / 9009999999") and out[3].adjudicated_alternative == "9009999999"
    assert out[4].length_conflict and list(out[4].conflict_positions) == []


def test_single_crop(spark):
    docs = [
        (CHILD_FIO, "Иванов Иван", ["иванов  ИВАН"]), (CHILD_FIO, "", ["Иванов Иван"]),
        (CHILD_FIO, "Иванов Иван", ["Петров Иван"]), (CHILD_FIO, "Иванов Иван", ["["]),
    ]
    out = {r.doc_id: r for r in reconcile.single_crop(readings(spark, *docs)).collect()}
    assert out[0].verified and out[1].value == "Иванов Иван"
    assert (out[2].value, out[2].verified, out[2].alternative) == ("Иванов Иван", False, "Петров Иван")
    assert out[3].status == "needs_review"


def test_audit(spark):
    rows = [(1, PHONE, "view", 1, "1", "read", None), (1, PHONE, "view", 2, None, None, "timeout")]
    row = reconcile.verification_audit(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row.status, row.reason, row.attempted, row.completed) == ("partial", "recognition_error", 2, 1)


def align(reference: str, predicted: str) -> list[tuple[str, str, int]]:
    """Edit alignment of two short texts; ties prefer a match, then a missing character.

    An extra character takes the position after the one it follows.
    """
    table = [list(range(len(predicted) + 1))]
    for i, letter in enumerate(reference, 1):
        above, row = table[-1], [i]
        for j, other in enumerate(predicted, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (letter != other)))
        table.append(row)
    pairs, i, j = [], len(reference), len(predicted)
    while i > 0 or j > 0:
        here = table[i][j]
        diagonal = i > 0 and j > 0 and here == table[i - 1][j - 1] + (reference[i - 1] != predicted[j - 1])
        missing = not diagonal and i > 0 and here == table[i - 1][j] + 1
        extra = not diagonal and not missing
        pairs.append((
            GAP if extra else reference[i - 1],
            GAP if missing else predicted[j - 1],
            i + 1 if extra else i,
        ))
        i, j = i - (not extra), j - (not missing)
    return pairs[::-1]


def test_alignment_stays_in_the_jvm(spark):
    rng = random.Random(6)
    digits = lambda: "".join(rng.choice("123") for _ in range(rng.randrange(17)))
    rows = [(i, digits(), digits()) for i in range(120)] + [(500, None, "1"), (501, "", ""), (502, "12", None)]
    rows += [(600 + i, a, a[:k] + a[k + 1:] if i % 2 else a[:k] + "9" + a[k:]) for i, (a, k) in enumerate(((digits() + "12", 1), ("9001234567", 4), ("112233", 6)) * 4)]
    got = aligned_pairs(spark.createDataFrame(rows, "id long, a string, b string"), "a", "b", "way")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Arrow" not in got._jdf.queryExecution().executedPlan().toString()
    want = {i: align(a or "", b or "") for i, a, b in rows}
    assert {r.id: [tuple(x) for x in r.way] for r in got.collect()} == want


def test_alignment():
    changes = [p for p in align("123456", "12456") if p[0] != p[1]]
    assert changes == [("3", "∅", 3)]
    changes = [p for p in align("12456", "123456") if p[0] != p[1]]
    assert changes == [("∅", "3", 3)]
    assert align("", "") == [] and align("1", "") == [("1", "∅", 1)] and align("", "1") == [("∅", "1", 1)]


PAGE_SCHEMA = (
    "doc_id long, page_no int, field_ord int, field string, value string, status string, source string, "
    "verified boolean, audit_status string, audit_reason string, attempted int, completed int"
)


PAGE_CASES = [
    ([("", "read", True), (" ", "read", True)], "", "needs_review", 1, False, 0),
    ([("[x", "read", True), ("", "read", True)], "[x", "needs_review", 1, False, 0),
    ([("[x", "unclear", False), ("5", "read", True)], "5", "read", 2, True, 0),
    ([("4", "needs_review", False), ("5", "read", True), ("4", "read", False)], "5", "needs_review", 2, False, 2),
    ([("4", "needs_review", False), ("5", "needs_review", False)], "4", "needs_review", 1, False, 1),
]


def test_page_merge(spark):
    rows = [
        (i, n, 0, PHONE, v, s, "vlm_page", ok, "completed", "", 3, 3)
        for i, (values, *_) in enumerate(PAGE_CASES) for n, (v, s, ok) in enumerate(values, 1)
    ]
    df = spark.createDataFrame(rows, PAGE_SCHEMA)
    merged = {r.doc_id: r for r in pages.merge_pages(df).collect()}
    lost = {r.doc_id: r["count"] for r in pages.page_conflicts(df).groupBy("doc_id").count().collect()}
    for i, (_, value, status, page, verified, n_conflicts) in enumerate(PAGE_CASES):
        row = merged[i]
        assert (row.value, row.status, row.page_no, row.verified) == (value, status, page, verified), i
        assert lost.get(i, 0) == n_conflicts


def test_answers(apply):
    def parsed(fn, texts):
        return apply(fn, texts)

    rows = ['{"a": "1"}', '```json\n{"a": {"b": 1}}\n```', 'x {"a": "1"} y {"a": "1", "b": "2"}', "{}", "no", "", "{'a': 1}", '{"a": {"b": {"c": 1}}}', None]
    assert parsed(responses.parse_model_json, rows) == [
        {"a": "1"}, {"a": '{"b":1}'}, {"a": "1", "b": "2"}, None, None, None, None, {"b": '{"c":1}'}, None]
    rows = ['{"a": "1"', 'x {"a": "1', '{"a": "1"} tail', "none"]
    assert parsed(responses.repair_model_json, rows) == [{"a": "1"}, {"a": "1"}, None, None]


def test_payload(spark):
    df = spark.createDataFrame([("data:x;base64,JVBERi0xLjc=",), ("iVBORw0K",), ("data:,a*b",), ("abc",)], "u string")
    content = responses.decode_payload(F.col("u"))
    kinds = [r.k for r in df.select(responses.payload_kind(content).alias("k")).collect()]
    assert kinds == ["pdf", "png", "other", "other"]
    assert [r.n for r in df.select(content.isNull().alias("n")).collect()] == [False, False, True, True]


def test_one_bad_document_costs_its_own_row(spark):
    def model(contents):
        if contents.eq("bad").any():
            raise ValueError("unreadable")
        return contents.str.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "doc_id long, content string")
    rows = {r.doc_id: (r.raw, r.error) for r in read_fields(df, model).collect()}
    assert rows == {1: ("A", None), 2: (None, "ValueError: unreadable"), 3: ("C", None)}
