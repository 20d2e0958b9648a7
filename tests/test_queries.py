"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from kinspark.plans import core_queries


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _form(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v)


def same_rows(spark, con, data, query, sql):
    df = query(spark, data)
    cols = sorted(df.columns)
    ours = sorted(tuple(_form(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert ours == sorted(tuple(_form(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(core_queries.ORACLE))
def test_core_query(spark, con, data, name):
    same_rows(spark, con, data, core_queries.QUERIES[name], core_queries.ORACLE[name])


@pytest.mark.parametrize("name", ["leader_dedup"])
def test_rows_only(spark, data, name):
    assert core_queries.QUERIES[name](spark, data).count() > 0
