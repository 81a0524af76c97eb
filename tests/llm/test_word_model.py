"""The model of unfolded words against plain counts, and what only it can tell."""

import glob
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquery.llm import common, quality, word_model
from docquery.llm.word_model import WORDS


def discounts(values):
    n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    if not n[0]:
        return [0.5] * 3
    y = n[0] / (n[0] + 2 * n[1])
    return [min(float(k), max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]


def cycle(text):
    s = [None, *text.split()]
    return list(zip(s, s[1:] + s[:1], strict=True))


def plain(texts, text, own):
    """Mean cost of a word of text; own: text is one of texts, whose own counts do not speak for it."""
    c = Counter(p for t in texts for p in cycle(t))
    follows, total = Counter(b for _, b in c), Counter()
    for (a, _), v in c.items():
        total[a] += v
    d, e = discounts(c.values()), discounts(follows.values())
    gamma0 = sum(e[min(v, 3) - 1] for v in follows.values()) / sum(follows.values())
    n, single, cost = Counter(cycle(text)), Counter(a for a, _ in cycle(text)), 0.0
    p = lambda w: max(0, follows[w] - e[min(follows[w], 3) - 1]) / sum(follows.values()) + gamma0 / WORDS
    gamma = lambda a: sum(d[min(v, 3) - 1] for (x, _), v in c.items() if x == a) / total[a]
    for w, k in single.items():
        cost -= k * (math.log(p(w) * gamma(w)) if total[w] - own * k > 0 else math.log(gamma0 / WORDS))
    for (a, b), k in n.items():
        left = c[a, b] - own * k
        if left > 0:
            cost -= k * math.log1p(max(0, left - d[min(left, 3) - 1]) / (total[a] * gamma(a) * p(b)))
    return cost / sum(n.values())


@pytest.mark.parametrize(("hot", "size"), [(1 << 17, 64 << 20), (0, 64 << 20), (40, 64 << 20), (0, 20)])
def test_costs_equal_plain_counts(spark, monkeypatch, hot, size):
    monkeypatch.setattr(word_model, "HOT", hot)
    monkeypatch.setattr(word_model, "RANGE_BYTES", size)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("aa bb Bb c ß dd e f".split()) for _ in range(rng.randint(1, 12))) for _ in range(20)]
    trusted = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    asked = [(i, t, "en", True) for i, t in enumerate(texts)] + [(50, "aa aa aa zz", "en", False), (51, "c  Bb\nc", "en", False), (51, "c  Bb\nc", "en", False), (52, " ", "en", False)]
    got = {r.id: r.words_nll for r in word_model.costs(spark.createDataFrame(asked, "id long, text string, key string, trusted boolean"), trusted).collect()}
    assert got.pop(52) is None and len(got) == 22
    for i, t, _, own in asked[:-1]:
        assert got[i] == pytest.approx(plain(texts, t, own), rel=1e-5), t


def test_quality_tells_letters_that_share_a_code(spark):
    """Junk whose folded bytes are those of trusted text, as letters of other scripts share codes."""
    rng = random.Random(5)
    words = ["".join(chr(0x3B1 + rng.randrange(6)) for _ in range(5)) for _ in range(40)]
    good = [(i, " ".join(rng.choice(words) for _ in range(40)), "el") for i in range(300)]
    bad = [(i + 1000, t.translate({0x3B1 + k: 0x3B1 + k - 9 for k in range(6)}), "el") for i, t, _ in good[:50]]
    data = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good], "doc_id long, quality long")
    out = {r.doc_id: r.accepted for r in quality.assess(data, labels).collect()}
    assert not any(out[i] for i, *_ in bad) and sum(out[i] for i, *_ in good) >= 290


def test_limits_at_a_larger_size(spark):
    """Of 571 documents labelled bad and 3,409 labelled good."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.assess(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").groupBy("quality", "accepted").count().collect()
    n = {(r["quality"], r["accepted"]): r["count"] for r in out}
    print(n)
    assert n[0, True] < 0.15 * 571 and n[1, False] < 0.03 * 3409


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They went with the driver's collections of garbage, one pass late, so that two passes were on disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in folders for p in glob.glob(f"{d}/*/shuffle_*")}
    there = files()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert df.collect() and files() - there  # a shuffle that is not written to a table stays
    there |= files()
    settled = common.settle(df, "test")
    end = time.time() + 3
    while files() - there and time.time() < end:
        time.sleep(0.1)
    assert not files() - there and settled.count() == 7 and spark.conf.get(name) == before


def test_sums_of_a_pass_are_one_row_a_document(spark, monkeypatch):
    """Of four documents with keys in many ranges, no pass leaves more than four rows."""
    monkeypatch.setattr(word_model, "HOT", 0)
    monkeypatch.setattr(word_model, "RANGE_BYTES", 20)
    settle, rows = word_model.settle, []

    def counted(df, tag):
        out = settle(df, tag)
        rows.append(out.count() if tag == "known" else 0)
        return out

    monkeypatch.setattr(word_model, "settle", counted)
    texts = [" ".join(f"w{(i * k) % 11}" for k in range(30)) for i in range(1, 5)]
    docs = spark.createDataFrame([(i, t, "en", False) for i, t in enumerate(texts)], "id long, text string, key string, trusted boolean")
    assert len(word_model.costs(docs, docs.selectExpr("text", "key AS lang")).collect()) == 4 and 0 < max(rows) <= 4


def test_ids_are_sent_once_however_many_ranges(spark):
    """Of 30 documents of 200 words, each with keys in nearly all of 40 ranges; hot keys are sought as they are found."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(200)) for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(texts), pa.array(["en"] * 30), pa.array([True] * 30)], names=["id", "text", "key", "trusted"])
    none = word_model.Keys(*(np.zeros(0, t) for t in (np.uint64, np.int64, np.float32, np.int16)))
    rows = pa.Table.from_batches(list(word_model.asked_keys(iter([batch]), {0: none, 1: none}, 40, range(40))))
    assert len(rows) == 81 and sum(len(x) for x in rows["docs"].to_pylist() if x) == 8 * 30
    h = np.random.default_rng(7).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    some = word_model.Keys(h[:500], *(np.zeros(500, t) for t in (np.int64, np.float32, np.int16)))
    (at, k), (place, hit) = some.seek(h), some.find(h)
    assert at.tolist() == np.flatnonzero(hit).tolist() and k.tolist() == place[hit].tolist() and len(at) >= 500
