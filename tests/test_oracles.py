"""Every core query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from weblens.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = duck.sql(ORACLES[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    want = sorted(tuple(canon(row[i]) for i in at) for row in r.fetchall())
    assert want  # a query without rows shows nothing
    assert sorted(tuple(map(canon, row)) for row in df.select(*cols).collect()) == want
