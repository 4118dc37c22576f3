"""Every catalogue query against its SQL, and the entry."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from variorum.plans import queries as catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(names), sorted(repr(tuple(value(r[i]) for i in at)) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_like_the_sql(spark, con, name):
    d = catalogue.queries()[name](spark, SF)
    got = rows(d.columns, [tuple(r) for r in d.collect()])
    want = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert got == rows(names, want.fetchall())


def test_entry(spark):
    d = __spark_entry__.entry(spark)
    assert d.columns == ["doc_id", "page_index", "k", "side", "text", "witnesses", "editors", "qualifiers"] and d.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
