"""Stored collections, write verbs and sinks; dynamic mode; the shell; streams."""

import pytest

from docquery import evaluate
from docquery.cli import command
from docquery.plans.errors import CollectionExists, CollectionNotFound, DocExists, DocNotFound, DocWithoutId, IndexMismatch, PrimaryKeyError, UniqueViolation
from docquery.plans.filters import parse_filter, parse_modifier
from docquery.sources import dynamic
from docquery.sources.store import Store
from docquery.streaming import apply_pipeline

SCHEMA = "id long, k string, n long, tags array<string>"


@pytest.fixture()
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db")
    s.create("c", spark.createDataFrame([(1, "a", 1, ["x"]), (2, "b", 2, None), (3, "a", 3, ["x", "y"])], SCHEMA))
    return s


def rows(c):
    return sorted(tuple(r) for r in c.df.select("id", "k", "n", "tags").collect())


def test_insert_and_errors(store, spark):
    c = store.open("c")
    new, done = c.insert([(4, "d", 4, [])])
    assert done.written == 1 and new.count() == 4 and c.count() == 3  # the old version is still what it was
    for docs, error in (([(1, "z", 0, None)], DocExists), ([(9, "a", 0, None), (9, "b", 0, None)], DocExists), ([(None, "z", 0, None)], DocWithoutId)):
        with pytest.raises(error):
            store.open("c").insert(docs)
    assert store.open("c").count() == 4
    with pytest.raises(PrimaryKeyError):
        store.create("bad", c.df, "a.b")
    with pytest.raises(RuntimeError):
        c.insert([(5, "e", 5, [])])  # opened before another commit


def test_update_verbs(store):
    c, done = store.open("c").update({"k": "a"}, {"$inc": {"n": 10}, "$push": {"tags": "z"}})
    assert (done.matched, done.modified) == (2, 2)
    assert rows(c) == [(1, "a", 11, ["x", "z"]), (2, "b", 2, None), (3, "a", 13, ["x", "y", "z"])]
    same, done = c.update({"k": "a"}, {"$set": {"k": "a"}})
    assert (done.matched, done.modified) == (2, 0) and same is c
    c, _ = c.update({}, {"$set": {"k": "last"}}, sort=("-n",), limit=1)
    assert [r[1] for r in rows(c)] == ["a", "b", "last"]
    c, done = c.upsert_id(7, {"$set": {"k": "new"}})
    assert (done.matched, done.modified) == (0, 1) and c.find_id(7)["k"] == "new"
    with pytest.raises(DocNotFound):
        c.update_id(99, {"$set": {"k": "x"}})
    c, done = c.delete({"id": {"$gte": 3}})
    assert done.matched == 2 and c.count() == 2
    c, _ = c.upsert_one({"id": 2, "k": "bb", "n": 1, "tags": []})
    assert c.find_id(2)["k"] == "bb"


def test_constraints(store):
    c = store.open("c").ensure_index("n", "n", unique=True)
    with pytest.raises(UniqueViolation):
        c.insert([(8, "q", 3, None)])
    with pytest.raises(UniqueViolation):
        c.ensure_index("tags", "tags", unique=True)
    with pytest.raises(IndexMismatch):
        c.ensure_index("n", "k")
    assert c.ensure_index("n", "n", unique=True) is c and not c.drop_index("n").indexes


def test_sinks(store):
    c = store.open("c")
    assert c.aggregate([{"$match": {"k": "a"}}, {"$out": "out"}]).written == 2
    assert c.aggregate([{"$match": {"k": "zz"}}, {"$out": "out"}]).written == 0 and store.open("out").count() == 0
    with pytest.raises(CollectionExists):
        c.aggregate([{"$out": "c"}])
    assert c.aggregate([{"$match": {"k": "a"}}, {"$merge": "m"}]).written == 2
    assert c.aggregate([{"$addFields": {"n": {"$add": ["$n", 100]}}}, {"$merge": {"into": "m", "whenNotMatched": "discard"}}]).written == 2
    assert sorted(r.n for r in store.open("m").df.collect()) == [101, 103]
    assert c.aggregate([{"$merge": {"into": "m", "whenMatched": "keepExisting"}}]).written == 1
    with pytest.raises(DocExists):
        c.aggregate([{"$merge": {"into": "m", "whenMatched": "fail"}}])


def test_catalog(store, tmp_path, spark):
    store.rename("c", "d")
    assert store.list() == ["d"]
    store.backup(f"file://{tmp_path}/copy")
    store.drop("d")
    with pytest.raises(CollectionNotFound):
        store.open("d")
    assert Store(spark, f"file://{tmp_path}/copy").open("d").count() == 3


def test_shell(store):
    assert command(store, "count", "c", '{"k": "a"}') == 2
    assert [d["id"] for d in command(store, "find", "c", "{}", '{"n": -1}', "2")] == [3, 2]
    assert "PushedFilters" in command(store, "explain", "c", '{"n": {"$gt": 1}}')
    assert command(store, "insert", "c", '{"id": 5, "k": "e", "n": 5, "tags": []}').written == 1


def test_modifiers_equal_plain_evaluation(spark):
    from docquery.operators.modifiers import modify

    docs = [{"id": 1, "n": 1.0, "s": "a", "xs": [1.0, 2.0, 1.0]}, {"id": 2, "xs": []}, {"id": 3, "s": "b", "n": 5.0}]
    df = spark.createDataFrame([(d["id"], d.get("n"), d.get("s"), d.get("xs")) for d in docs], "id long, n double, s string, xs array<double>")
    for m in ({"$set": {"s": "a"}}, {"$inc": {"n": 0}}, {"$unset": {"s": 1}}, {"$rename": {"s": "r"}}, {"$pop": {"xs": 1}}, {"$pop": {"xs": -1}}, {"$push": {"xs": 9}}, {"$pull": {"xs": 1}}, {"$pull": {"xs": {"$gt": 1}}}, {"$pullAll": {"xs": [1, 2]}}, {"$addToSet": {"xs": 2}}, {"$addToSet": {"xs": 7}, "$inc": {"n": 1}}):
        out = {r["id"]: r.asDict() for r in modify(df, parse_modifier(m)).collect()}
        for d in docs:
            want, hit = evaluate.modified(d, parse_modifier(m))
            got = {k: v for k, v in out[d["id"]].items() if v is not None and k != "__modified"}
            assert (got, out[d["id"]]["__modified"]) == (want, hit), (m, d)


def test_dynamic_mode(spark):
    docs = [{"id": 1, "d": None}, {"id": 2, "d": 5}, {"id": 3, "d": "x"}, {"id": 4}, {"id": 5, "d": [1, "y"]}, {"id": 6, "d": {"object": 1}}, {"id": 7, "d": True}]
    df = dynamic.from_documents(spark, docs)
    import json

    ids = lambda f, *s, **k: [json.loads(r.doc)["id"] for r in dynamic.find(df, f, *s, **k).collect()]
    assert ids({"d": None}) == [1, 4] and ids({"d": {"$exists": False}}) == [4]
    assert ids({"d": {"$gt": 5}}) == [3, 5, 6, 7] and ids({"d.object": 1}) == [6]
    assert ids({}, "d") == [1, 4, 5, 2, 3, 7, 6] and ids({}, "-d", limit=2, offset=1) == [7, 5]
    assert ids({"d": {"$lt": 5}}) == [i["id"] for i in docs if evaluate.matches(parse_filter({"d": {"$lt": 5}}), i)]
    out = [json.loads(r.doc) for r in dynamic.project(df, {"id": 1, "x": {"$ifNull": ["$d", "none"]}}).collect()]
    assert out[3] == {"id": 1, "x": "none"} or {d["x"] if not isinstance(d["x"], list | dict) else 0 for d in out} >= {"none", 5, "x"}
    assert dynamic.canonical_key(df, "d").groupBy("key").count().count() == 6


def test_stateless_stream(spark, tmp_path):
    spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id long, t array<string>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, t array<string>").parquet(f"{tmp_path}/in")
    q = apply_pipeline(stream, [{"$unwind": "$t"}, {"$addFields": {"u": {"$concat": ["$t", "!"]}}}]).writeStream.format("memory").queryName("unwound").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.u for r in spark.sql("SELECT u FROM unwound").collect()) == ["a!", "b!"]
    with pytest.raises(ValueError):
        apply_pipeline(stream, [{"$limit": 1}])


def test_an_index_does_not_undo_another_write(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/two")
    store.create("c", spark.createDataFrame([(1, "a")], "id long, v string"))
    one, two = store.open("c"), store.open("c")
    one.insert([(2, "b")])
    with pytest.raises(RuntimeError):
        two.ensure_index("v", "v")
    with pytest.raises(RuntimeError):
        two.drop_index("v") if two.indexes else two.ensure_index("w", "v")
    assert store.open("c").count() == 2 and not store.open("c").indexes
    again, stale = store.open("c").ensure_index("v", "v"), store.open("c")
    again.drop_index("v")
    with pytest.raises(RuntimeError):  # the indexes have changed since
        stale.insert([(3, "c")])
