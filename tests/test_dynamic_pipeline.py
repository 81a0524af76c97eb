"""Pipelines over documents of any shape: how sets are made and how often documents are read."""

import json
import re

from docquery.sources.dynamic import from_documents
from docquery.sources.dynamic_pipeline import aggregate


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sets_hold_first_of_equal_values(spark):
    docs = [{"id": i, "k": i % 3, "a": [1.0, 1, "x", None, True][i % 5]} for i in range(40)]
    docs += [{"id": 99, "k": 0}, {"id": 100, "k": 7}, {"id": -1, "k": 1, "a": "y", "b": 3}]
    stages = [{"$group": {"_id": "$k", "n": {"$count": {}}, "u": {"$addToSet": "$a"}, "f": {"$first": "$id"}, "v": {"$addToSet": "$b"}, "p": {"$push": "$b"}}}]
    got = {d["id"]: d for r in aggregate(from_documents(spark, docs), stages).collect() for d in [json.loads(r.doc)]}
    for k in (0, 1, 2, 7):
        mine = sorted((d for d in docs if d["k"] == k), key=lambda d: d["id"])
        sets = []
        for field in ("a", "b"):
            seen = []
            for d in mine:
                if field in d and not any(type(x) is type(d[field]) and x == d[field] or {type(x), type(d[field])} == {int, float} and x == d[field] for x in seen):
                    seen.append(d[field])
            sets.append(seen)
        assert got[k] == {"id": k, "n": float(len(mine)), "u": sets[0], "f": mine[0]["id"], "v": sets[1], "p": [d["b"] for d in mine if "b" in d]}
        assert list(map(type, got[k]["u"])) == list(map(type, sets[0]))


def test_equal_values_meet_before_a_set_is_made(spark):
    docs = from_documents(spark, [{"id": i, "w": ["a"]} for i in range(4)])
    plan = logical(aggregate(docs, [{"$unwind": "$w"}, {"$match": {"w": "a"}}, {"$group": {"_id": "$w", "s": {"$addToSet": "$w"}}}, {"$project": {"s": 1}}]))
    assert re.search(r"Aggregate \[key#\d+, at#\d+L, same#\d+\]", plan), plan
    assert plan.count("MapInArrow") == 2, plan  # up to the group, and after it
    assert "RepartitionByExpression" in plan, plan
