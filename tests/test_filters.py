"""Typed filters against plain Python on random documents; grammar errors."""

import random
from datetime import datetime

import pytest

from docquery import evaluate
from docquery.operators.query import Collection
from docquery.plans import values as V
from docquery.plans.errors import ParseError
from docquery.plans.filters import parse_filter, parse_modifier, parse_sort

SCHEMA = "id long, a double, s string, b boolean, t timestamp_ntz, xs array<double>, o struct<p:double,q:string>, ws array<string>"


def documents(n=150, seed=42):
    rng = random.Random(seed)
    maybe = lambda f: None if rng.random() < 0.2 else f()
    return [
        (i, maybe(lambda: float(rng.randint(-3, 3))), maybe(lambda: rng.choice(["", "a", "ab", "b", "Ab"])), maybe(lambda: rng.random() < 0.5), maybe(lambda: datetime(2024, 1, rng.randint(1, 4), 5, 6, 7, 123456)),
         maybe(lambda: [float(rng.randint(-2, 2)) for _ in range(rng.randint(0, 3))]), maybe(lambda: (maybe(lambda: float(rng.randint(0, 2))), maybe(lambda: rng.choice("xy")))), maybe(lambda: [rng.choice(["a", "ab", "c"]) for _ in range(rng.randint(0, 2))]))
        for i in range(n)
    ]


def as_document(row):
    names = ["id", "a", "s", "b", "t", "xs", "o", "ws"]
    d = {k: v for k, v in zip(names, row) if v is not None}
    if "o" in d:
        d["o"] = {k: v for k, v in zip("pq", d["o"]) if v is not None}
    if "t" in d:
        d["t"] = V.from_millis(V.millis(d["t"]))
    return d


VALUES = [None, 0, 1.0, -2, "", "a", "b", True, False, [], [1.0], [0.0, 1.0], {"$date": "2024-01-02T05:06:07.123Z"}]
FILTERS = [{f: {op: v}} for f in ("a", "s", "b", "t", "xs", "o.p", "o.q", "none", "xs.0") for op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte") for v in VALUES]
FILTERS += [
    {"a": {"$in": [1, "a", None]}}, {"a": {"$in": []}}, {"s": {"$nin": ["a", None]}}, {"xs": {"$in": [1.0, [0.0]]}}, {"xs": {"$all": [1.0, 0.0]}}, {"xs": {"$all": []}},
    {"xs": {"$size": 2}}, {"a": {"$size": 1}}, {"s": {"$exists": False}}, {"o.p": {"$exists": True}}, {"s": {"$regex": "^a"}}, {"s": {"$regex": "^A", "$options": "i"}}, {"ws": {"$regex": "b$"}},
    {"a": {"$type": "number"}}, {"b": {"$type": "true"}}, {"t": {"$type": 12}}, {"a": {"$not": {"$gt": 0}}}, {"$nor": [{"a": 1}, {"s": "a"}]}, {"$or": [{"a": {"$lt": 0}}, {"xs": 2}]},
    {"$and": [{"a": {"$gte": 0}}, {"b": True}]}, {"a": 1, "s": "a"}, {"xs": {"$gt": 0, "$lt": 1}}, {}, {"o": {"p": 1.0, "q": "x"}}, {"o": {"p": 1.0}}, {"o": {"q": "x", "p": 1.0}}, {"o": {"$ne": {"q": "x"}}},
]


def test_filters_equal_plain_evaluation(spark):
    rows = documents()
    c = Collection(spark.createDataFrame(rows, SCHEMA).cache())
    docs = [as_document(r) for r in rows]
    parsed = [parse_filter(f) for f in FILTERS]
    from pyspark.sql import functions as F

    from docquery.functions.filters import compile_filter

    marks = c.df.select("id", *(compile_filter(f, c.df.schema).alias(f"f{i}") for i, f in enumerate(parsed))).orderBy("id").collect()
    for i, (text, f) in enumerate(zip(FILTERS, parsed)):
        got = [r[f"f{i}"] for r in marks]
        assert None not in got, text
        assert got == [evaluate.matches(f, d) for d in docs], text
    assert F  # the filters above stay one plan


def test_sorts_equal_plain_evaluation(spark):
    rows = documents()
    c = Collection(spark.createDataFrame(rows, SCHEMA))
    docs = [as_document(r) for r in rows]
    for keys in (("a",), ("-a", "s"), ("s", "-b"), ("-t",), ("o.p", "-o.q")):
        want = [d["id"] for d in evaluate.sort_documents(docs, parse_sort(*keys))]
        assert [r.id for r in c.find().sort(*keys).rows().select("id").collect()] == want, keys


@pytest.mark.parametrize(
    "bad",
    [{"$what": 1}, {"a": {"$what": 1}}, {"$and": []}, {"$or": {}}, {"a": {"$in": 1}}, {"a": {"$not": 1}}, {"a": {"$type": "binary"}}, {"a": {"$regex": "(?=a)"}}, {"a": {"$regex": "("}},
     {"a": {"$size": "x"}}, {"a": {"$options": "i"}}, {"$or": [{"$text": {"$search": "x"}}]}, {"v": {"$knn": {"$query": [1], "$k": 0}}}, {"v": {"$knn": {"$query": [1]}}}, {"$text": {"$search": 1}}, {"a": {"$gt": {"$vector": [1]}}}],
)
def test_bad_filters(bad):
    with pytest.raises(ParseError):
        parse_filter(bad)


def test_error_says_where():
    with pytest.raises(ParseError) as e:
        parse_filter({"$and": [{"a": 1}, {"b": {"$foo": 1}}]})
    assert (e.value.path, e.value.op, e.value.unknown, e.value.source) == ("$and.1.b.$foo", "$foo", True, "filter")


@pytest.mark.parametrize("bad", [{}, {"$what": {"a": 1}}, {"$inc": {"a": "x"}}, {"$set": {"id": 1}}, {"$pop": {"a": 2}}, {"$rename": {"a": "id"}}, {"$set": 1}])
def test_bad_modifiers(bad):
    with pytest.raises(ParseError):
        parse_modifier(bad)


def test_order_of_types():
    values = [None, -1, 0, 2.5, "", "a", False, True, [], [1], {}, {"a": 1}, b"z", b"aa", V.ObjectId("0" * 24), datetime(2024, 1, 1)]
    keys = [V.key(v) for v in values]
    assert keys == sorted(keys)
    assert V.key(-0.0) == V.key(0) and V.key(V.MISSING) == V.key(None)


def test_extended_json_round_trip():
    doc = {"d": {"$date": "2024-01-02T03:04:05.006Z"}, "o": {"$oid": "0123456789abcdef01234567"}, "b": {"$binary": "AAE="}, "v": {"$vector": [1.0, 2.5]}, "bad": {"$oid": "xyz"}, "n": [1, {"x": None}]}
    assert V.encode(V.decode(doc)) == doc
