"""Every query with SQL against DuckDB on the driver tables; the others must at least run."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract

DATA = os.environ.get("SPHEREGRID_TESTDATA", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = {k: f for k, f in contract.queries().items() if not k.startswith("op") and k != "pipeline"}
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[k] for k in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    df = CORE[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in SQL:
        found = duck.execute(SQL[name])
        want_columns = [c[0] for c in found.description]
        want = found.fetchall()
        assert sorted(df.columns) == sorted(want_columns)
        got, want = rows(df.columns, got), rows(want_columns, want)
        assert len(got) == len(want)
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        assert not bad, (len(bad), bad[:3])
