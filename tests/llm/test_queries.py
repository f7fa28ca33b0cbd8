"""The llm queries with SQL against DuckDB on the smallest tables, and all of them run."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from papyrine.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLES:
        assert df.count() > 0
        return
    names = sorted(df.columns)
    told = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in told.description]
    key = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    assert sorted(columns) == names
    assert sorted(key(r[c] for c in names) for r in df.collect()) == sorted(key(r[columns.index(c)] for c in names) for r in told.fetchall())
