"""Each query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sightline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(cols, names, found):
    order = [names.index(c) for c in cols]
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


SQL = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, con, name):
    df, rel = QUERIES[name](spark, SF), con.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert rows(cols, df.columns, df.collect()) == rows(cols, rel.columns, rel.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
