"""Text and vector search against plain Python."""

import math

import pytest

from docquery.operators.query import Collection, VectorIndex
from docquery.operators.text import TextIndex, analyze
from docquery.operators.vector import build_cells
from docquery.plans.errors import ParseError

DOCS = [(1, "Quick brown fox", "the fox runs"), (2, "lazy dog", "a quick dog and a brown fox"), (3, "fox", "fox fox fox"), (4, "empty", None), (5, "STRASSE ﬁne", "東京タワー")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, title string, body string").cache()


def search(docs, clause, **index):
    c = Collection(docs, text={"t": TextIndex(("title", "body"), **index)})
    return [(r["id"], r["_score"]) for r in c.find({"$text": clause}).rows().collect()]


def test_analyzer():
    assert analyze("Straße ﬁne, don't a-b 3.14 …") == ["strasse", "fine", "don't", "a", "b", "3.14"]
    assert analyze("東京タワー x 語") == ["東京", "京タ", "タワ", "ワー", "x", "語"]


def test_bm25(docs):
    got = search(docs, {"$search": "fox"})
    texts = {i: analyze(t) + analyze(b or "") for i, t, b in DOCS}
    n, avg, df = len(texts), sum(map(len, texts.values())) / len(texts), sum("fox" in w for w in texts.values())
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    want = {i: idf * w.count("fox") * 2.2 / (w.count("fox") + 1.2 * (0.25 + 0.75 * len(w) / avg)) for i, w in texts.items() if "fox" in w}
    assert dict(got) == pytest.approx(want) and [i for i, _ in got] == sorted(want, key=lambda i: (-want[i], i))


def test_clauses(docs):
    ids = lambda c, **k: sorted(i for i, _ in search(docs, c, **k))
    assert ids({"$search": '"brown fox"'}) == [1, 2] and ids({"$search": "qui*"}) == [1, 2]
    assert ids({"$search": "fox", "$require": "dog"}) == [2] and ids({"$search": "fox", "$exclude": ["dog"]}) == [1, 3]
    assert ids({"$search": "fox quick", "$defaultOperator": "and"}) == [1, 2] and ids({"$search": "", "$exclude": "dog"}) == []
    assert ids({"$search": "strasse"}) == [5] and ids({"$search": "京タ"}) == [5] and ids({"$search": "東京タ"}) == [5]
    assert search(docs, {"$search": "brown"}, weights={"title": 5.0})[0][0] == 1


def test_text_needs_an_index(docs):
    with pytest.raises(ParseError):
        Collection(docs).find({"$text": {"$search": "x"}}).rows()


def test_nearest_filters_before_the_cut(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(20)] + [(50, [1.0], 0), (51, None, 0)], "id long, v array<double>, k long")
    c = Collection(df, vectors={"l2": VectorIndex("v", "l2")})
    knn = {"v": {"$knn": {"$query": [4.4, 1.0], "$k": 3}}}
    assert [r["id"] for r in c.find(knn).rows().collect()] == [4, 5, 3]
    assert [r["id"] for r in c.find({**knn, "k": 1}).rows().collect()] == [5, 3, 7]
    assert [r["id"] for r in c.find({**knn, "k": 1}).sort("-k").limit(2).rows().collect()] == [3, 5]
    assert c.find({**knn, "_distance": {"$lt": 1}}).count() == 2
    assert [r["id"] for r in c.aggregate([{"$match": knn}, {"$limit": 1}]).rows().collect()] == [4]


def test_cells_find_most_neighbours(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").cache()
    cells, centers = build_cells(df, "embedding", 8, closure=2)
    exact, near = Collection(df, "vec_id"), Collection(df, "vec_id", vectors={"v": VectorIndex("embedding", "cosine", tuple(centers), cells, 4)})
    hit = 0
    for row in df.orderBy("vec_id").limit(5).collect():
        knn = {"embedding": {"$knn": {"$query": list(map(float, row["embedding"])), "$k": 10}}}
        hit += len({r[0] for r in exact.find(knn).ids().collect()} & {r[0] for r in near.find(knn).ids().collect()})
    assert hit >= 40
