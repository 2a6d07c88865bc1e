"""The pN_ queries with SQL against DuckDB, and all of them without failure on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from weblens.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        c = duckdb.connect()
        for p in Path(DATA).glob("*.parquet"):
            c.sql(f"create view {p.stem} as select * from '{p}'")
        r = c.sql(ORACLES[name])
        at = [r.columns.index(x) for x in df.columns]
        assert sorted(tuple(x) for x in rows) == sorted(tuple(row[i] for i in at) for row in r.fetchall())
