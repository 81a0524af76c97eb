"""Patterns written for both engines, against matches known by hand."""

import pytest
from pyspark.sql import functions as F

from docquery import aggregate
from docquery.plans.patterns import BadPattern, compiled, for_java
from docquery.sources import dynamic_pipeline
from docquery.sources.dynamic import from_documents

CASES = [
    ("[[:alpha:]]+", "", "fooA", True), ("^[[:alpha:]]+$", "", "foo1", False), ("^[[:^digit:]]+$", "", "foé", True), (r"foo\z", "", "foo\n", False), ("foo$", "", "foo\n", False), ("(?m)foo$", "", "foo\nbar", True),
    (r"\Qa.b\E+", "", "a.ba.b", True), (r"\Qa.b\E", "", "axb", False), (r"\p{Greek}", "", "xα", True), (r"^\P{L}+$", "", "12", True), ("a.c", "", "a\rc", True), ("a.c", "", "a\nc", False), ("a.c", "s", "a\nc", True),
    ("straße", "i", "STRAßE", True), ("É", "i", "é", True), ("x{2,3}", "", "axx", True), ("{,2}", "", "{,2}", True), ("[]a]+", "", "]", True), ("[&&[]", "", "[", True), ("[a-c&&b]", "", "a", True), (r"\bno\b", "", "ünoü", True),
    (r"^\s$", "", "\x0b", False), (r"\v", "", "\x0b", True), (r"^[^\S]$", "", " ", True), (r"\x{1F600}", "", "😀", True), (r"\101", "", "A", True), ("(?i)AB|c", "", "ab", True), ("a(?i)b|c", "", "aC", True), ("(?P<n>a)(?:b|)", "", "a", True), ("#x y", "", "#x y", True),
]


def test_both_engines(spark):
    for pattern, flags, text, want in CASES:
        assert bool(compiled(pattern, flags).search(text)) == want, pattern
    rows = spark.createDataFrame([(t,) for *_, t, _ in CASES], "t string")
    for pattern, flags, text, want in CASES:
        assert bool(rows.where(F.col("t") == text).where(F.col("t").rlike(for_java(pattern, flags))).count()) == want, pattern


@pytest.mark.parametrize("bad", ["a++", "a**", "*a", "(?=a)", "(?<!a)b", "(?>a)", r"(a)\1", "[a", "(a", "a)", r"\C", "[z-a]", "a{2000}", "[[:nope:]]", "a{3,2}"])
def test_rejected(bad):
    with pytest.raises(BadPattern):
        for_java(bad)


def test_lookup_of_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, g string")
    out = aggregate(docs, [{"$group": {"_id": "$g"}}, {"$project": {"refs": [1, 2]}}, {"$lookup": {"localField": "refs", "as": "x"}}]).collect()
    assert [[d.id for d in r.x] for r in out] == [[1, 2], [1, 2]]


def test_sort_before_group_makes_no_exchange(spark):
    docs = spark.createDataFrame([(i, i % 3, float(-i)) for i in range(50)], "id long, g long, v double")
    df = aggregate(docs, [{"$sort": {"v": 1}}, {"$group": {"_id": "$g", "first": {"$first": "$id"}, "all": {"$push": "$id"}}}])
    assert "rangepartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.id: (r.first, r.all[:2]) for r in df.collect()} == {0: (48, [48, 45]), 1: (49, [49, 46]), 2: (47, [47, 44])}
    sorted_ = aggregate(docs, [{"$sort": {"v": 1}}, {"$limit": 3}, {"$project": {"id": 1}}])
    assert [r.id for r in sorted_.collect()] == [49, 48, 47]
    assert [r.id for r in aggregate(docs, [{"$sort": {"v": 1}}, {"$project": {"id": 1}}]).collect()][:3] == [49, 48, 47]


DOCS = [{"id": 1, "c": "a", "v": 1, "t": ["x", "y"]}, {"id": "two", "c": 5, "v": "s", "t": []}, {"id": 3, "c": None, "v": None, "ref": [1, "two", 1, 9]}, {"id": 4, "v": 2.5, "t": "x", "ref": "two"}, {"id": 5, "c": "a", "v": [1], "o": {"p": [7, 8]}}]


def documents(spark, pipeline):
    return [dynamic_pipeline.loaded(r.doc) for r in dynamic_pipeline.aggregate(from_documents(spark, DOCS), pipeline).collect()]


def test_dynamic_groups_of_any_type(spark):
    out = {repr(d["id"]): d for d in documents(spark, [{"$group": {"_id": "$c", "n": {"$count": {}}, "sum": {"$sum": "$v"}, "avg": {"$avg": "$v"}, "least": {"$min": "$v"}, "most": {"$max": "$v"}, "first": {"$first": "$c"}, "all": {"$push": "$v"}, "set": {"$addToSet": "$c"}}}])}
    assert set(out) == {"'a'", "5", "None"}
    assert out["'a'"] == {"id": "a", "n": 2.0, "sum": 1.0, "avg": 1.0, "least": 1, "most": [1], "first": "a", "all": [1, [1]], "set": ["a"]}
    # A null and a missing key are one group; $first keeps the null of the first document.
    assert out["None"]["n"] == 2 and out["None"]["all"] == [None, 2.5] and out["None"]["first"] is None and out["None"]["set"] == [None]
    assert out["5"]["sum"] == 0 and out["5"]["avg"] is None and out["5"]["most"] == "s"


def test_dynamic_stages(spark):
    assert [d["id"] for d in documents(spark, [{"$sort": {"v": -1}}])] == ["two", 4, 1, 5, 3]
    assert [(d["id"], d.get("t")) for d in documents(spark, [{"$unwind": "$t"}, {"$sort": {"id": 1}}])] == [(1, "x"), (1, "y"), (4, "x")]
    kept = documents(spark, [{"$unwind": {"path": "$t", "preserveNullAndEmptyArrays": True}}, {"$sort": {"id": 1}}, {"$project": {"id": 1, "t": 1}}])
    assert kept == [{"id": 1, "t": "x"}, {"id": 1, "t": "y"}, {"id": 3}, {"id": 4, "t": "x"}, {"id": 5}, {"id": "two"}]
    assert [d["p"] for d in documents(spark, [{"$unwind": "$o.p"}, {"$project": {"p": "$o.p"}}, {"$sort": {"p": 1}}])] == [7, 8]
    found = documents(spark, [{"$match": {"ref": {"$exists": True}}}, {"$lookup": {"localField": "ref", "as": "x"}}, {"$sort": {"id": 1}}, {"$project": {"x": "$x.id"}}])
    assert found == [{"x": [1, "two"]}, {"x": ["two"]}]
    assert documents(spark, [{"$facet": {"n": [{"$count": "n"}], "top": [{"$sort": {"id": -1}}, {"$limit": 2}, {"$project": {"id": 1}}]}}]) == [{"n": [{"n": 5.0}], "top": [{"id": "two"}, {"id": 5}]}]
    assert documents(spark, [{"$addFields": {"w": {"$ifNull": ["$c", "none"]}}}, {"$match": {"w": "none"}}, {"$skip": 1}, {"$project": {"id": 1}}]) == [{"id": 4}]
