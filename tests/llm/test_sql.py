"""The queries of this subpackage that SQL can express, against DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from spheregrid.llm import queries as training

DATA = os.environ.get("SPHEREGRID_TESTDATA", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(training.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = training.queries()[name](spark, DATA)
    found = con.execute(training.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)
