"""Every query that has SQL gives the SQL's rows, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from brightloom.plans import queries as plans
from brightloom.plans import sql

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    return repr(round(v, 7) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(sql.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(sql.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.queries()) <= set(entry.queries())


def test_simple_normalisation_is_exact(spark):
    from pyspark.sql import functions as F

    from brightloom.functions import text as tx

    d = spark.read.parquet(f"{DATA}/documents.parquet").where(F.col("text").rlike(tx.SIMPLE))
    assert d.where(tx.normalised(F.col("text")) != tx.normalised_full(F.col("text"))).count() == 0
