"""Every registered query against its SQL twin (DuckDB) on the smoke tables, and the
driver's entry point."""

from __future__ import annotations

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as E
from sensorlake.plans.catalog import PAGE_SIZE, QUERIES

from tests.conftest import SMOKE_DIR

TABLES = ["events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMOKE_DIR, t)}.parquet')")
    return c


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def norm(v):
        if isinstance(v, float) and math.isnan(v):
            return "NaN"
        return v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql_or_is_listed():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) - set(o) == set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SMOKE_DIR)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, rows) == canon(ocols, res.fetchall())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["Timestamp", "PM2.5", "PM10", "CO2", "Temperature", "Humidity"]
    assert df.count() == 100


ZONE_SENSITIVE = ["decode_readings", "stream_ingest", "expiry", "epoch_ms", "format_columns", "csv_roundtrip", "temperature_residual", "table_pages_all", "stream_then_copy"]


@pytest.mark.parametrize("name", ZONE_SENSITIVE)
def test_results_do_not_depend_on_the_session_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = E.queries()[name](spark, SMOKE_DIR)
        rows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert canon(df.columns, rows) == canon(ocols, res.fetchall())


def test_all_pages_need_no_limit_that_grows(spark):
    plan = QUERIES["table_pages_all"](spark, SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    limits = [int(n) for n in re.findall(r"Limit (\d+)", plan)]
    assert limits and max(limits) <= PAGE_SIZE
