"""Every registered core query against its SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from millrace import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{Path(sf_dir, t)}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert rows
    if name in queries.ORACLE_SQL:
        want = oracle.sql(queries.ORACLE_SQL[name])
        assert cols == sorted(want.columns)
        at = [want.columns.index(c) for c in cols]
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry_points(spark):
    assert entry_point.entry(spark).columns == ["word", "cnt"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(queries.QUERIES) <= set(entry_point.queries())
