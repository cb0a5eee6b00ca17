"""Every query against its oracle in DuckDB."""

import math
import os

import duckdb
import pytest

from trackloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and not math.isnan(x) else x
    return sorted(repr([clean(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.columns, df.collect())
    assert got == rows(want.columns, want.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
