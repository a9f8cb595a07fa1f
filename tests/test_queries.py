"""Every query of the matrix engine against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quadlake import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    make, sql = Q.QUERIES[name]
    got = make(spark, SF)
    rows = sorted(map(tuple, got.select(*sorted(got.columns)).collect()))
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows == sorted(map(tuple, want.select(*(f'"{c}"' for c in sorted(want.columns))).fetchall()))
