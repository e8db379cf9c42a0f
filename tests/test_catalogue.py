"""Every registered city-model query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from citytables.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, views, name):
    df = catalogue.queries()[name](spark, SF)
    rel = views.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert shown(df.collect(), df.columns) == shown(rel.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and [r["hilbert"] for r in rows] == sorted(r["hilbert"] for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
