"""Every registered query against its DuckDB oracle on the smallest driver tables
(the driver's own gate runs the same comparison at sf0.01)."""

import collections
import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__ as E
from tabforge import oracle_sql, suite
from tabforge.fixtures import TABLES

QUERIES = dict(suite.QUERIES)
ORACLES = {k: v for k, v in oracle_sql.ORACLES.items() if k in QUERIES}


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(df.columns, rows) == _canon(ocols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 11
    assert "duplicates_found" in df.columns


TIME_SENSITIVE = ["validate_ranges", "validate_generated_users", "gen_datetime", "gen_date", "ledger_get",
                  "ledger_unexpired", "sink_roundtrip_orders_csv", "roundtrip_lineitem_replies",
                  "profile_orders", "read_json_events"]


@pytest.mark.parametrize("name", TIME_SENSITIVE)
def test_results_do_not_depend_on_session_time_zone(spark, sf_dir, duck, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        test_query_matches_oracle(spark, sf_dir, duck, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
