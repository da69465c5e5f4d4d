"""Registered queries on the smallest tables: those with SQL against DuckDB, the others run."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from bintangle.llm.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    assert got
    if name in SQL:
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        result = con.execute(SQL[name])
        names = [x[0] for x in result.description]
        assert got == sorted((tuple(r[names.index(c)] for c in sorted(df.columns)) for r in result.fetchall()), key=repr)
