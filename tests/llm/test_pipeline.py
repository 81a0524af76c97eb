"""The pipeline's stages against brute force on their own inputs, and the SQL of the queries that have it."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from docquery.llm import decontaminate
from docquery.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        rows = [tuple(r) for r in docs.collect()]
        kept[name] = {r[0] for r in rows}
        texts = [(r.doc_id, r.text) for r in before.collect()]
        if name == "exact_dedup":
            last = {}
            for i, t in texts:
                last[t] = max(i, last.get(t, i))
            assert kept[name] == set(last.values())
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert kept[name] == {r[0] for r in decontaminate.brute_force(texts, items) if r[3] == 0}
        if name == "packing":
            assert sorted(r[0] for r in rows) == sorted(i for i, _ in texts)
        else:
            assert docs.columns == columns and len(rows) == len(kept[name])
    assert len(corpus_pipeline.STAGES) == 5


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    df = QUERIES[name](spark, SF)
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
