"""Stages, expressions and their errors on small inputs."""

import random
from datetime import datetime

import pytest

from docquery import aggregate, evaluate
from docquery.plans.errors import ParseError, UnsupportedTyped
from docquery.plans.expressions import parse_expression
from docquery.plans.pipelines import parse_pipeline


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "x", 5.0, ["a", "b"], 2), (2, "y", 1.0, [], 9), (3, "x", None, None, 1), (4, None, 7.0, ["a"], None), (5, "y", 1.0, ["c", "a"], 5)]
    return spark.createDataFrame(data, "id long, cat string, v double, tags array<string>, ref long").cache()


def got(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_group_orders_and_nulls(rows):
    out = {r["id"]: r for r in got(aggregate(rows, [{"$group": {"_id": "$cat", "n": {"$count": {}}, "s": {"$sum": "$v"}, "a": {"$avg": "$v"}, "f": {"$first": "$v"}, "l": {"$last": "$id"}, "p": {"$push": "$v"}, "u": {"$addToSet": "$v"}}}]))}
    assert out["x"] == {"id": "x", "n": 2.0, "s": 5.0, "a": 5.0, "f": 5.0, "l": 3.0, "p": [5.0], "u": [5.0]}
    assert out["y"]["p"] == [1.0, 1.0] and out["y"]["u"] == [1.0] and None in out


def test_first_follows_a_sort(rows):
    out = got(aggregate(rows, [{"$sort": {"cat": -1, "v": 1}}, {"$group": {"_id": None, "f": {"$first": "$id"}, "l": {"$last": "$id"}, "all": {"$push": "$id"}}}]))
    assert out[0]["all"] == [2.0, 5.0, 3.0, 1.0, 4.0] and out[0]["f"] == 2.0 and out[0]["l"] == 4.0


def test_unwind(rows):
    assert [(r["id"], r["tags"]) for r in got(aggregate(rows, [{"$unwind": "$tags"}, {"$sort": {"id": 1}}]))] == [(1, "a"), (1, "b"), (4, "a"), (5, "c"), (5, "a")]
    kept = got(aggregate(rows, [{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True}}]))
    assert len(kept) == 7 and sum(r["tags"] is None for r in kept) == 2
    assert len(got(aggregate(rows, [{"$unwind": "$cat"}]))) == 4


def test_unwind_nested(spark):
    df = spark.createDataFrame([(1, (["a", "b"], 3))], "id long, o struct<t:array<string>,k:long>")
    assert got(aggregate(df, [{"$unwind": "$o.t"}, {"$sort": {"o.t": 1}}])) == [{"id": 1, "o": {"t": "a", "k": 3}}, {"id": 1, "o": {"t": "b", "k": 3}}]


def test_lookup(rows):
    out = {r["id"]: [d["id"] for d in r["o"]] for r in got(aggregate(rows, [{"$lookup": {"localField": "ref", "as": "o"}}]))}
    assert out == {1: [2], 2: [], 3: [1], 4: [], 5: [5]}
    out = {r["id"]: [d["id"] for d in r["o"]] for r in got(aggregate(rows, [{"$addFields": {"refs": ["$ref", 1, "$ref", None, 77]}}, {"$lookup": {"localField": "refs", "as": "o"}}]))}
    assert out == {1: [2, 1], 2: [1], 3: [1], 4: [1], 5: [5, 1]}


def test_facet_of_nothing(rows):
    assert got(aggregate(rows, [{"$match": {"id": 99}}, {"$facet": {"a": [{"$limit": 1}], "n": [{"$count": "n"}]}}])) == [{"a": [], "n": [{"n": 0.0}]}]


def test_skip_limit_count(rows):
    assert [r["id"] for r in got(aggregate(rows, [{"$skip": 1}, {"$limit": 2}]))] == [2, 3]
    assert got(aggregate(rows, [{"$match": {"id": {"$in": []}}}, {"$count": "n"}])) == [{"n": 0.0}]


def test_branches_of_several_types(rows):
    with pytest.raises(UnsupportedTyped):
        aggregate(rows, [{"$project": {"x": {"$ifNull": ["$cat", "$v"]}}}])


@pytest.mark.parametrize(
    "bad",
    [[{"$what": 1}], [{"$match": {}, "$limit": 1}], [{"$project": {"a": 0}}], [{"$project": {}}], [{"$limit": 0}], [{"$skip": -1}], [{"$group": {"x": {"$sum": 1}}}], [{"$group": {"_id": 1, "x": {"$median": 1}}}],
     [{"$unwind": "x"}], [{"$lookup": {"localField": "a", "as": "b", "foreignField": "c"}}], [{"$lookup": {"as": "b"}}], [{"$facet": {"a": [{"$facet": {"b": []}}]}}], [{"$out": "x"}, {"$limit": 1}], [{"$sort": {"a": 2}}],
     [{"$project": {"a": {"$foo": 1}}}], [{"$project": {"a": "$$ROOT"}}], [{"$merge": {"into": "x", "whenMatched": "no"}}], [{"$count": "a.b"}]],
)
def test_bad_pipelines(bad):
    with pytest.raises(ParseError):
        parse_pipeline(bad)


EXPRESSIONS = [
    {"$add": ["$a", "$b", 1]}, {"$add": []}, {"$subtract": ["$a", "$b"]}, {"$multiply": ["$a", "$b"]}, {"$divide": ["$a", "$b"]}, {"$abs": "$a"}, {"$round": ["$a", 1]}, {"$round": "$a"}, {"$round": ["$a", -1]}, {"$add": ["$a", "$s"]},
    {"$cmp": ["$a", "$b"]}, {"$gt": ["$s", "$a"]}, {"$lte": ["$none", "$a"]}, {"$eq": ["$none", "$a"]}, {"$ne": ["$s", "$u"]}, {"$lt": ["$a", "$b"]}, {"$gte": ["$t", "$a"]},
    {"$cond": ["$a", "$s", "$u"]}, {"$cond": {"if": "$none", "then": 1, "else": 2}}, {"$switch": {"branches": [{"case": {"$gt": ["$a", 1]}, "then": "$s"}, {"case": "$b", "then": "$u"}]}}, {"$ifNull": ["$none", "$s", "$u"]},
    {"$concat": ["$s", "-", "$u"]}, {"$concat": []}, {"$concat": ["$s", "$a"]}, {"$replaceOne": {"input": "$s", "find": "$u", "replacement": "_"}}, {"$replaceAll": {"input": "$s", "find": "a", "replacement": "\\1$0"}}, {"$replaceAll": {"input": "$s", "find": "", "replacement": "x"}},
    {"$split": ["$s", "$u"]}, {"$split": ["$s", "."]}, {"$trim": {"input": "$s"}}, {"$ltrim": {"input": "$s", "chars": "a."}}, {"$rtrim": {"input": "$s", "chars": ""}}, {"$trim": {"input": "$a"}},
    {"$year": "$t"}, {"$week": "$t"}, {"$year": {"date": "$t", "timezone": "America/New_York"}}, {"$week": {"date": "$t", "timezone": "+09"}}, {"$add": ["$t", 1500]}, {"$subtract": ["$t", "$t2"]}, {"$subtract": ["$t", 10]}, {"$add": ["$t", "$t2"]},
    *({"$dateDiff": {"startDate": "$t", "endDate": "$t2", "unit": u, "timezone": z, "startOfWeek": "mon"}} for u in ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond") for z in ("UTC", "-03:30")),
]


def test_expressions_equal_plain_evaluation(spark):
    rng = random.Random(7)
    maybe = lambda f: None if rng.random() < 0.15 else f()
    when = lambda: datetime(rng.randint(1965, 2050), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59), rng.randint(0, 999) * 1000)
    word = lambda: "".join(rng.choice("aab. \t ") for _ in range(rng.randint(0, 5)))
    data = [(i, maybe(lambda: rng.choice([0.0, 2.5, -1.25, 0.125, 1234.5, 2.345])), maybe(lambda: float(rng.randint(-2, 2))), maybe(word), maybe(lambda: rng.choice(["a", ".", "ab", ""])), maybe(when), maybe(when)) for i in range(120)]
    df = spark.createDataFrame(data, "id long, a double, b double, s string, u string, t timestamp_ntz, t2 timestamp_ntz")
    from docquery.functions.expressions import compile_expression

    parsed = [parse_expression(e) for e in EXPRESSIONS]
    out = df.select("id", *(compile_expression(e, df.schema).col.alias(f"e{i}") for i, e in enumerate(parsed))).orderBy("id").collect()
    for i, (text, e) in enumerate(zip(EXPRESSIONS, parsed)):
        for row, r in zip(data, out):
            doc = {k: v for k, v in zip(("id", "a", "b", "s", "u", "t", "t2"), row) if v is not None}
            want = evaluate.evaluate(e, doc)
            want = None if want is evaluate.MISSING else want
            have = r[f"e{i}"]
            assert have == want or (isinstance(want, float) and have == pytest.approx(want, rel=1e-12)), (text, doc, have)


def test_date_add_and_trunc(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 31, 22, 30, 15, 7000))], "id long, t timestamp_ntz")
    one = lambda e: got(aggregate(df, [{"$project": {"x": e}}]))[0]["x"]
    assert one({"$dateAdd": {"startDate": "$t", "unit": "month", "amount": 1}}) == datetime(2024, 2, 29, 22, 30, 15, 7000)
    assert one({"$dateAdd": {"startDate": "$t", "unit": "day", "amount": 0.5}}) is None
    assert one({"$dateAdd": {"startDate": "$t", "unit": "week", "amount": -1}}) == datetime(2024, 1, 24, 22, 30, 15, 7000)
    assert one({"$dateAdd": {"startDate": "$t", "unit": "millisecond", "amount": 1}}) == datetime(2024, 1, 31, 22, 30, 15, 8000)
    assert one({"$dateTrunc": {"date": "$t", "unit": "month", "binSize": 5}}) == datetime(2023, 10, 1)  # 2000-01 and every fifth month
    assert one({"$dateTrunc": {"date": "$t", "unit": "week"}}) == datetime(2024, 1, 28)
    assert one({"$dateTrunc": {"date": "$t", "unit": "week", "startOfWeek": "wednesday"}}) == datetime(2024, 1, 31)
    assert one({"$dateTrunc": {"date": "$t", "unit": "day", "timezone": "Asia/Tokyo"}}) == datetime(2024, 1, 31, 15)
    assert one({"$dateTrunc": {"date": "$t", "unit": "minute", "binSize": 20}}) == datetime(2024, 1, 31, 22, 20)
