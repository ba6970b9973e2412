"""Every registered query of the library against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftgraph import queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(D):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{D}/{name}'")
    return c


def same(rows):
    return sorted(str([round(v, 9) + 0.0 if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, spark, con):
    df, out = queries.queries()[name](spark, D), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(out.columns)
    at = [out.columns.index(c) for c in columns]
    assert same(df.select(*columns).collect()) == same([r[i] for i in at] for r in out.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
