"""The entry module's contract, and each query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = sorted(set(E.oracle_sql()) & set(E.engine.QUERIES))

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def canon(rows, order):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, duck, name):
    df = E.queries()[name](spark, DATA)
    rel = duck.execute(E.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    got = canon([tuple(r) for r in df.collect()], [df.columns.index(c) for c in sorted(df.columns)])
    want = canon(rel.fetchall(), [names.index(c) for c in sorted(names)])
    assert got == want


def test_entry(spark):
    assert E.entry(spark).count() == 5


def test_keys():
    assert set(E.oracle_sql()) <= set(E.queries())
