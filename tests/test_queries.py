"""Registered queries against their SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from checks.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "normalize_documents", "extract_fields", "rules_detail", "report_summary", "comparison_table",
    "match_validation", "match_duplicates", "batch_reports", "sla_summary_by_batch", "redact_json",
    "pixel_statistics", "manifest_typed", "evidence_requirements")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 200
