"""Pages of sorted rows: the same rows however they are cut out, and no task that takes in the whole table."""

import json

import pytest

from docquery.catalogue import QUERIES
from docquery.operators import pages
from docquery.operators.query import aggregate, find
from docquery.plans.pipelines import Page, Skip, paged, parse_pipeline
from docquery.sources import dynamic
from docquery.sources.dynamic_pipeline import aggregate as dynamic_aggregate


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["limit_natural", "sort_skip_limit"])
def test_a_page_is_a_top_k(spark, name):
    plan = physical(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "offset=" in plan and "GlobalLimit" not in plan and "Sort" not in plan, plan


def test_skips_join_the_limit_after_them():
    stages = [{"$skip": 2}, {"$skip": 3}, {"$limit": 4}, {"$skip": 1}, {"$match": {"a": 1}}, {"$limit": 5}]
    got = paged(parse_pipeline(stages))
    assert got[:2] == [Page(5, 4), Skip(1)] and len(got) == 4


@pytest.mark.parametrize("most", [100_000, 5])
@pytest.mark.parametrize(("skip", "n"), [(0, 4), (3, 4), (3, 0), (8, 5), (20, 2), (2, 3)])
def test_pages(spark, monkeypatch, most, skip, n):
    monkeypatch.setattr(pages, "MOST", most)
    docs = [{"id": (i * 7) % 10, "v": i % 3} for i in range(10)]
    df = spark.createDataFrame([(d["id"], d["v"]) for d in docs], "id long, v long").repartition(3)
    raw = dynamic.from_documents(spark, docs)
    want = [d["id"] for d in sorted(docs, key=lambda d: (-d["v"], d["id"]))][skip:][: n or None]
    stages = [{"$sort": {"v": -1}}, *([{"$skip": skip}] if skip else []), *([{"$limit": n}] if n else [])]
    assert [r.id for r in find(df, {}, "-v", limit=n, offset=skip).collect()] == want
    assert [r.id for r in aggregate(df, stages).collect()] == want
    assert [json.loads(r.doc)["id"] for r in dynamic.find(raw, {}, "-v", limit=n, offset=skip).collect()] == want
    assert [json.loads(r.doc)["id"] for r in dynamic_aggregate(raw, stages).collect()] == want


def test_dynamic_pages_are_a_top_k(spark):
    raw = dynamic.from_documents(spark, [{"id": 1}])
    for df in (dynamic.find(raw, {}, limit=2, offset=3), dynamic_aggregate(raw, [{"$sort": {"id": 1}}, {"$skip": 3}, {"$limit": 2}])):
        assert "limit=5, offset=3" in physical(df), physical(df)
