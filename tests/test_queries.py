"""Every query that has a SQL counterpart against DuckDB, over whole tables."""

import duckdb
import pytest
from conftest import DATA

from lithoframe import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA))
    rows = got.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows)
    theirs = sorted(repr(tuple(plain(r[k]) for k in order)) for r in want.fetchall())
    assert ours == theirs
