"""Every registered query runs, and says what its SQL says."""

import math
from collections import Counter

import pytest

import __spark_entry__
from palimpsest.plans import oracle
from palimpsest.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", oracle.SQL)
def test_same_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(oracle.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle.SQL)))
def test_others_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
