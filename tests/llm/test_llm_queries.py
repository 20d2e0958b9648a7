"""The pN_ queries over the smallest tables, against DuckDB where SQL can say it."""

import glob
import os

import duckdb
import pytest

from kinspark.llm.oracle import ORACLE
from kinspark.llm.queries import QUERIES

FOUND = {
    "p1_found": ["rec_id", "group_id"], "p2_found": ["rec_id_a", "rec_id_b"], "p3_found": ["rec_id", "field_name", "ref_id"], "p4_found": ["rec_id_a", "rec_id_b"], "p5_found": ["split_name", "source_name", "rec_id"],
    "p7_found": ["vin", "rec_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
    if name in FOUND:
        assert df.columns == FOUND[name]
    if name in ORACLE:
        con = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        rel = con.sql(ORACLE[name])
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(rows) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
