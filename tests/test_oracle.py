"""Each query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from twinsieve.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    return c


def plain(rows):
    return sorted(tuple((x is None, repr(round(x, 9)) if isinstance(x, float) else repr(x)) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if name not in ORACLE:
        assert rows
        return
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert plain(rows) == plain(tuple(r[i] for i in at) for r in want.fetchall())
