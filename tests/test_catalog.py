"""The registered queries: contract, and agreement with DuckDB on a small table set."""

import duckdb
import pytest

import __spark_entry__ as driver
from formsift.plans import registry
from tests.conftest import SF_DIR
from tools.check import compare, duck

SAMPLE = [
    "g15_auto_format", "b2_canonical_fields", "h7_adjudication", "d1_page_merge", "c2_journal_duplicates",
    "a8_journal_export", "d8_confusion_matrix", "c3_field_regions", "e8_lockout", "i3_daily_activity",
]


def test_contract():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(driver.queries()) > 120
    assert all(isinstance(sql, str) and sql.strip() for sql in driver.oracle_sql().values())


def test_entry_counts_every_application(spark):
    applications = duckdb.sql(f"SELECT count(*) FROM '{SF_DIR}/customer.parquet'").fetchall()[0][0]
    assert sum(r.applications for r in driver.entry(spark).collect()) == applications


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_check(spark, name):
    message, _, same = compare(spark, duck(SF_DIR), SF_DIR, name, registry)
    assert same, message
