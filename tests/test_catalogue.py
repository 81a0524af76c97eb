"""Each catalogue query against its DuckDB statement at the smallest scale."""

import glob
import os

import duckdb
import pytest

from docquery.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = db.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rows, key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
