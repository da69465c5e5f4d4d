"""The registry, and every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from bintangle.plans import assembly, problems

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = {**problems.QUERIES, **assembly.QUERIES}
ORACLES = {**problems.SQL, **assembly.SQL}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(columns, names, data):
    at = [names.index(c) for c in columns]
    fix = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else tuple(x) if isinstance(x, list) else x
    return sorted((tuple(fix(r[k]) for k in at) for r in data), key=repr)


def same(spark, duck, query, sql):
    df = query(spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert rows(columns, df.columns, df.collect()) == rows(columns, names, result.fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 600


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    same(spark, duck, CORE[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(ORACLES)))
def test_runs(spark, name):
    CORE[name](spark, SF).collect()
