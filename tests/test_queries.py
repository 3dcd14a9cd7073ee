"""Every query with SQL gives the rows of its SQL in DuckDB."""

import os
from pathlib import Path

import duckdb
import pytest

from wedgeworks.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted(tuple(r[c] for c in order) for r in got.collect())
    assert rows == sorted(want.select(*(f'"{c}"' for c in order)).fetchall())
