"""Every registered query against its SQL on the smallest tables, and the whole analysis on a small ledger."""

import json

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of
from ledgerloom.plans.analyze import analyze, store

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in queries() if n != "whole_analysis"])
def test_query_equals_its_sql(spark, db, name):
    frame = queries()[name](spark, SF_DIR)
    got, names = rows_of(frame.columns, frame.collect())
    if name in oracle_sql():
        result = db.execute(oracle_sql()[name])
        expected, expected_names = rows_of([c[0] for c in result.description], result.fetchall())
        assert names == expected_names and got == expected


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 25


def test_whole_analysis(spark, clean_sales, tmp_path):
    tables = analyze(clean_sales, "2026-06-01")
    row = tables["bundle"].first()
    numbers = json.loads(row["metrics_json"])
    assert numbers["current_revenue"] == 411900 and numbers["top_products"][0]["name"] == "Jute Rope"
    assert json.loads(row["customers_json"])["total"] == 5
    assert json.loads(row["anomalies_json"])["total"] == tables["anomalies"].count()
    assert "Financial Year End" not in json.loads(row["season_json"])["events"]
    store({k: tables[k] for k in ("revenue", "anomalies", "bundle")}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "anomalies")).count() == tables["anomalies"].count()
