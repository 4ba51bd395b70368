"""The quality queries over the final record use every reading and every page."""

import pytest
from pyspark.sql import functions as F

from formsift.operators import quality
from formsift.plans import catalog
from formsift.plans.flows import final_records
from formsift.schema import CHILD_FIO, PHONE
from formsift.sources import fixtures
from formsift.sources.fixtures import derived
from tests.conftest import SF_DIR
from tests.test_readings import readings
from tools.check import compare, duck


def test_other_views_adjudication_and_pages_count(spark):
    """View 1 is wrong, the majority right; two rivals are settled by the extra reading; one
    name stands on page 2 only."""
    read = readings(
        spark, (PHONE, "[неразборчиво]", ["9000000000", "9001234567", "9001234567"]),
        (PHONE, "x", ["9001234567", "9001234568", "9001234569"], "9001234568"),
    )
    schema = ("doc_id long, page_no int, field_ord int, field string, value string, status string, source string, "
              "verified boolean, audit_status string, audit_reason string, attempted int, completed int")
    audit = ("read", "vlm_page", True, "completed", "", 1, 1)
    values = spark.createDataFrame([
        (0, 1, 1, CHILD_FIO, "", *audit), (0, 2, 1, CHILD_FIO, "иванов иван", *audit), (0, 1, 2, PHONE, "9000000000", *audit)], schema)
    found = {(r.doc_id, r.field): r for r in final_records(read, values).collect()}
    assert "123-45-67" in found[0, PHONE].value
    assert "123-45-68" in found[1, PHONE].value and found[1, PHONE].verified
    assert found[0, CHILD_FIO].value == "Иванов Иван" and found[0, CHILD_FIO].status == "read"
    labels = spark.createDataFrame([(0, CHILD_FIO, "Иванов Иван")], "case_id long, field string, reference string")
    records = final_records(read, values).withColumnsRenamed({"doc_id": "case_id", "value": "predicted"})
    assert quality.label_predictions(labels, records).first().predicted == "Иванов Иван"


@pytest.mark.parametrize("name", ["c8_record_predictions", "d7_record_field_quality"])
def test_query_equals_its_check(spark, name):
    message, _, same = compare(spark, duck(SF_DIR), SF_DIR, name, catalog)
    assert same, message


def test_a_small_file_of_many_applicants_makes_even_tasks(spark, tmp_path):
    """What a task makes of the applicants does not grow with their number, nor with the file's size in bytes."""
    spark.range(1, 20001).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name, rows in (("fx_readings", 300000), ("fx_page_values", 80000)):
        made = derived(spark, str(tmp_path), name).groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert abs(sum(r["count"] for r in made) - rows) < 10, name
        assert max(r["count"] for r in made) < rows / 3, name


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_and_labels_meet_within_their_tasks(spark, monkeypatch):
    """Nothing but the deal of the applicants is shuffled, and no side is broadcast, however few bytes Spark expects."""
    monkeypatch.setattr(fixtures, "APPLICANTS_PER_TASK", 40)
    for name in ("c8_record_predictions", "g26_record_cer_wer"):
        plan = _plan(catalog.QUERIES[name](spark, SF_DIR))
        assert "Join" not in plan and "BroadcastExchange" not in plan, name
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert shuffles and all("hashpartitioning(c_custkey" in line for line in shuffles), name


def test_readings_are_decided_once_for_both_alignments(spark):
    found = catalog.QUERIES["d9_record_position_errors"](spark, SF_DIR)
    found.collect()
    assert "ReusedExchange" in _plan(found)


def test_label_records_equals_label_predictions(spark):
    labels = spark.createDataFrame(
        [(1, "a", "x"), (1, "b", None), (2, "a", "y"), (1, "a", "z")], "case_id long, field string, reference string")
    records = spark.createDataFrame(
        [(1, "a", "x", "read", True), (1, "b", None, None, None), (3, "a", "q", "read", True)],
        "case_id long, field string, predicted string, status string, verified boolean")
    expected = quality.label_predictions(labels, records)
    found = quality.label_records(labels, records)
    assert found.columns == expected.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
