"""Every registered graph query against its SQL, and entry()."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from graphlake.plans.fixtures import TABLES
from graphlake.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    def cell(x):
        if x is None or x != x:
            return "null"
        x = x.item() if hasattr(x, "item") else x
        return repr(round(x, 6)) if isinstance(x, float) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert driver.entry(spark).count() == 10


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
