"""Every registered query of the signal operators gives the rows of its SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers the queries
from ondine.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    made = QUERIES[name](spark, SF)
    got = rows(made.columns, made.collect())
    if name not in SQL:
        assert got or name.startswith("q_stream")
        return
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == sorted(made.columns)
    assert got == rows(found.columns, found.fetchall())


def test_names():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100
    assert __spark_entry__.entry and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
