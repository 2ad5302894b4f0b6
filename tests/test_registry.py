"""Every registered query against its SQL counterpart."""

import datetime as dt
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from workload.oracle import ORACLE
from workload.queries import QUERIES

TABLES = "events"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    return con


def text(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, (dt.date, pd.Timestamp)):
        return pd.Timestamp(value).isoformat()
    return str(value)


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = canonical(entry_module.queries()[name](spark, sf_dir).toPandas())
    assert got == canonical(duck.execute(entry_module.oracle_sql()[name]).df())
    assert got[1]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql())


def test_entry(spark):
    rows = entry_module.entry(spark)
    assert rows.columns == ["hour", "event_type", "event_count"]
    assert rows.count() > 0
