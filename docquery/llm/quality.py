"""Quality by interpolated modified Kneser-Ney models of trusted text, thresholded by quantiles of each language.

Two models judge a document, and it has to lie within the limits of both:

* Pairs of unfolded words (word_model): a table that grows with the trusted text, joined in shards to the documents' counts.
* Four-grams over a folded byte alphabet of 44 symbols, for the shape of words that the first one does not know. A language
  has at most 44^4 of them however large the corpus is, so one task makes a language's table from its summed counts. Tables
  travel as 16-bit logarithms, 7.5 MB each; they are dealt into shards of at most SHARD_BYTES, each broadcast for one pass over
  its languages and destroyed when that is written.

No document is judged by its own counts. The first model leaves a trusted document's own counts out of its score. For the
second, texts fall into two halves (copies into one), and each half is scored by the trusted texts of the other. So every
trusted document gives counts and limits, and trusted and other documents are measured alike.

Limits are quantiles of a language's trusted documents of like length (a class for each factor of four), as means over few
symbols spread more than those over many; a class of fewer than LEAST_DOCS has the quantiles of its whole language.

Defined results: languages without a model of their own (fewer than LEAST_DOCS trusted documents, or not among the
MOST_LANGUAGES most frequent), and null ones, use the model of all languages (`*`); its limits are quantiles of the trusted
documents among them, or of all trusted ones if those are fewer than LEAST_DOCS. Texts of fewer than four bytes have no
perplexity, texts without words no word perplexity; what has none is accepted in that respect, as are all documents if no
text is trusted. Very long texts are scored whole, by blocks. Scores equal to a limit are accepted. Repeated rows are judged
alike. Empty tables give empty results. Further columns stay in what the filter returns and are ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm import blocks as B
from docquery.llm import word_model
from docquery.llm.common import discard, id_and_text, settle, small, small_batches, text_key, without

A = 44
SHARD_BYTES = 32 << 20
LEAST_DOCS, MOST_LANGUAGES = 30, 256
LOW, HIGH = 0.005, 0.995
#: A document may lie this far outside the quantiles (in nats a symbol or word) before it is rejected.
SLACK = 0.05
#: Distinct four-grams of all languages that a task holds before it passes them on.
HELD = 1_000_000
#: A step of the 16-bit logarithms: -log(1e-12) is 65,535 steps.
STEP = np.float32(27.631021 / 65535)

_SYMBOL = np.full(256, 32, np.int32)  # other ASCII
_SYMBOL[97:123] = np.arange(26)
_SYMBOL[65:91] = 26
_SYMBOL[32] = 27
_SYMBOL[[9, 10, 11, 12, 13]] = 28
_SYMBOL[48:58] = 29
_SYMBOL[[44, 46, 58, 59]] = 30
_SYMBOL[[34, 39, 45, 40, 41]] = 31
_SYMBOL[0xC0:] = 34
_SYMBOL[0xC3] = 33
_SYMBOL[0x80:0xC0] = 35 + np.arange(64) % 9


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the four-grams inside documents, and each document's first."""
    x = _SYMBOL[data]
    if len(x) < 4:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    two = x[:-1] * A + x[1:]
    four = two[:-2] * (A * A) + two[2:]
    ok = np.ones(len(x), bool)
    for t in range(1, 4):
        p = offsets[1:] - t
        ok[p[p >= offsets[:-1]]] = False
    at = np.flatnonzero(ok[: len(four)])
    return four[at], np.searchsorted(at, offsets)


@B.tidy
def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, half, g, c): all four-grams of a task's texts, summed up to a bounded number of distinct ones."""
    held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def compact() -> int:
        for k, parts in held.items():
            g, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            held[k] = [(g, np.bincount(at, np.concatenate([c for _, c in parts]), len(g)).astype(np.int64))]
        return sum(len(x[0][0]) for x in held.values())

    def flush() -> Iterator[pa.RecordBatch]:
        compact()
        while held:
            (lang, half), [(g, c)] = held.popitem()
            lang_ = pa.DictionaryArray.from_arrays(np.zeros(len(g), np.int8), pa.array([lang], pa.string())).dictionary_decode()
            yield pa.RecordBatch.from_arrays([lang_, pa.array(np.full(len(g), half, np.int32)), pa.array(g.astype(np.int32)), pa.array(c)], names=["lang", "half", "g", "c"])

    size = 0
    for batch in batches:
        names = list(zip(batch.column("lang").to_pylist(), batch.column("half").to_pylist(), strict=True))
        for a, b, data, offsets in B.blocks(batch.column("text")):
            codes, first = grams(data, offsets)
            which = {k: i for i, k in enumerate(dict.fromkeys(names[a:b]))}
            of = np.repeat(np.array([which[k] for k in names[a:b]], np.int32), np.diff(first))
            for k, i in which.items():
                held.setdefault(k, []).append(np.unique(codes[of == i], return_counts=True))
                size += len(held[k][-1][0])
            if size > 2 * HELD:
                size = compact()
                if size > HELD:
                    yield from flush()
                    size = 0
    yield from flush()


def logarithms(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Negative log probabilities, in steps, of all A^4 four-grams from the counts c of the distinct ones g."""
    levels = [(g, c)]
    for n in (3, 2, 1):  # lower orders count in how many contexts an n-gram occurs, not how often
        levels.append(np.unique(levels[-1][0] % A**n, return_counts=True))
    p = np.full(A, 1 / A, np.float32)
    for n, (g, c) in enumerate(levels[::-1], 1):
        of = [int((c == k).sum()) for k in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.0
        d = np.array([min(float(k), max(0.05, k - (k + 1) * y * of[k] / of[k - 1] if of[k - 1] else 0.5 * k)) if of[0] else 0.5 for k in (1, 2, 3)])
        cut = d[np.minimum(c, 3) - 1]
        ctx = g // A
        total, mass = np.bincount(ctx, c, A ** (n - 1)), np.bincount(ctx, cut, A ** (n - 1))
        back = np.where(total > 0, mass / np.maximum(total, 1), 1.0).astype(np.float32)
        # The lower order's probability of (context without its first symbol, next symbol).
        q = (p if n == 1 else np.tile(p, A)) * np.repeat(back, A)
        q[g] += (np.maximum(0, c - cut) / total[ctx]).astype(np.float32)
        p = q
    return np.round(-np.log(np.maximum(p, 1e-12)) / STEP).astype(np.uint16)


@B.tidy
def made(t: pa.Table) -> pa.Table:
    c = np.bincount(t.column("g").to_numpy(), t.column("c").to_numpy(), A**4)
    g = np.flatnonzero(c)
    return pa.table({"lang": [t.column("lang")[0].as_py()], "part": pa.array([t.column("part")[0].as_py()], pa.int32()), "steps": pa.array([logarithms(g, c[g].astype(np.int64)).tobytes()], pa.binary())})


#: Parts of a language's model: 0 and 1 for the texts of that half (counts of the other one); BOTH, with all counts.
BOTH = 2


def languages(trusted: DataFrame) -> list[str]:
    """Languages with a model of their own: a bounded number, the most frequent first."""
    many = trusted.where("lang IS NOT NULL").groupBy("lang").count().where(F.col("count") >= LEAST_DOCS).orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    return [r["lang"] for r in many.collect()]


def model(trusted: DataFrame, names: list[str], every: bool, whole: bool = False) -> DataFrame:
    """(lang, part, steps) of (text, lang): the named languages and, if asked for, all of them together (`*`); whole: of
    all counts, not of halves."""
    known = F.when(F.col("lang").isin(*names), F.col("lang")).otherwise("*") if names else F.lit("*")
    rows = trusted.where("text IS NOT NULL").select("text", known.alias("lang"), half(F.col("text")).alias("half"))
    counts = settle((rows if every else rows.where("lang <> '*'")).mapInArrow(lambda it: counted(it), "lang string, half int, g int, c long").groupBy("lang", "half", "g").agg(F.sum("c").alias("c")), "counts")
    both = counts.where("lang <> '*'")
    if every:
        both = both.unionByName(counts.groupBy("half", "g").agg(F.sum("c").alias("c")).withColumn("lang", F.lit("*")))
    parts = both.select("lang", (F.lit(BOTH) if whole else 1 - F.col("half")).alias("part"), "g", "c")
    out = settle(parts.groupBy("lang", "part").applyInArrow(lambda t: made(t), "lang string, part int, steps binary"), "model")
    discard(counts)
    return out


def half(text: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(text, F.lit(5)), F.lit(2)).cast("int")


def held_tables(tables: DataFrame, names: list[str]) -> dict[tuple[str, int], bytes]:
    """At most two tables of each of the names, one name at a time."""
    out = {}
    for name in names:
        t = tables.where(F.col("lang") == name).toArrow()
        out |= {(name, t.column("part")[i].as_py()): t.column("steps")[i].as_py() for i in range(len(t))}
    return out


def fit(trusted: DataFrame) -> dict[str, np.ndarray]:
    """Negative log probabilities of four-grams by language, from (text, lang)."""
    names = languages(trusted)
    return {lang: np.frombuffer(t, np.uint16) * STEP for (lang, _), t in held_tables(model(trusted, names, True, True), [*names, "*"]).items()}


@B.tidy
def scored(batches: Iterator[pa.RecordBatch], tables: dict[tuple[str, int], bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = list(zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True))
        for a, b, data, offsets in B.blocks(batch.column("text")):
            codes, first = grams(data, offsets)
            which = {k: i for i, k in enumerate(dict.fromkeys(keys[a:b]))}
            n, total = np.diff(first), np.full(b - a, np.nan)
            of = np.repeat(np.array([which[k] for k in keys[a:b]], np.int32), n)
            cost = np.zeros(len(codes) + 1)
            for k, i in which.items():
                steps = tables.get(k)  # none if all trusted texts of a language are in this half
                if steps is not None:
                    at = np.flatnonzero(of == i)
                    cost[at] = np.frombuffer(steps, np.uint16)[codes[at]]
            some = np.flatnonzero(n)
            if len(some):
                total[some] = np.add.reduceat(cost, first[:-1][some])
                total[some[-1]] = cost[first[some[-1]] : first[some[-1] + 1]].sum()
                total[some] *= float(STEP) / n[some]
            total[[k not in tables for k in keys[a:b]]] = np.nan
            yield batch.slice(a, b - a).select(["doc_id", "text_key", "key", "good", "id"]).append_column("length", pa.array((np.log2(np.maximum(n, 1)) / 2).astype(np.int32))).append_column("nll", pa.array(total, pa.float64(), mask=np.isnan(total)))


FIGURES = ["perplexity", "least", "most", "word_perplexity", "word_least", "word_most"]


def assess(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, text_key, model, perplexities and limits of both models, accepted of every row of docs; texts labelled with quality 1 are trusted."""
    with small_batches(docs.sparkSession):
        return _assess(docs, labels, low, high)


def _assess(docs: DataFrame, labels: DataFrame, low: float, high: float) -> DataFrame:
    spark = docs.sparkSession
    good = settle(labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("good_id")).distinct(), "trusted")
    rows = id_and_text(docs, F.col("lang").cast("string").alias("lang"), text_key().alias("text_key"))
    rows = rows.join(small(good, good.count()), F.col("doc_id") == F.col("good_id"), "left").withColumn("good", F.col("good_id").isNotNull()).drop("good_id")
    trusted = rows.where("good AND text IS NOT NULL").select("text", "lang")
    if trusted.isEmpty():
        return rows.select("doc_id", "text_key", F.lit(None).cast("string").alias("model"), *(F.lit(None).cast("double").alias(c) for c in FIGURES), F.lit(True).alias("accepted"))
    own = languages(trusted)
    rows = rows.withColumn("key", F.when(F.col("lang").isin(*own), F.col("lang")).otherwise("*") if own else F.lit("*"))
    every = not rows.where("key = '*'").isEmpty()  # without such rows nothing asks for the model of all languages
    tables = model(trusted, own, every)
    rows = rows.withColumn("part", half(F.coalesce("text", F.lit("")))).drop("lang").withColumn("id", F.xxhash64("text", "key", "good"))
    train = rows.where("good AND text IS NOT NULL")
    words = train.where("key <> '*'").select("text", F.col("key").alias("lang"))
    if every:
        words = words.unionByName(train.select("text", F.lit("*").alias("lang")))
    words = word_model.costs(rows.select("id", "text", "key", F.col("good").alias("trusted")), words)
    names, per, parts = [*own, *["*"] * every], max(1, SHARD_BYTES // (4 * A**4)), None
    for i in range(0, len(names), per):
        held = spark.sparkContext.broadcast(held_tables(tables, names[i : i + per]))
        part = rows if len(names) <= per else rows.where(F.col("key").isin(*names[i : i + per]))
        part = settle(part.mapInArrow(lambda it, held=held: scored(it, held.value), "doc_id long, text_key long, key string, good boolean, id long, length int, nll double"), "scores")
        held.destroy()
        parts = part if parts is None else parts.union(part)
    discard(tables)
    spark._jvm.System.gc()
    marks = settle(parts.join(words.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").drop("id", "of"), "marks")
    discard(words)
    accepted = F.lit(True)
    for c in ("nll", "words_nll"):
        by_length, by_key, every = bounds(marks.where("good"), c, low, high)
        marks = marks.join(F.broadcast(by_length), ["key", "length"], "left").join(F.broadcast(by_key), "key", "left").withColumn(f"q_{c}", F.coalesce(f"l_{c}", f"k_{c}", F.lit(every).cast("array<double>")))
        accepted = accepted & F.coalesce((F.col(c) >= F.col(f"q_{c}")[0] - SLACK) & (F.col(c) <= F.col(f"q_{c}")[1] + SLACK), F.lit(True))
    shown = lambda c: (F.exp(c), F.exp(F.col(f"q_{c}")[0] - SLACK), F.exp(F.col(f"q_{c}")[1] + SLACK))
    return marks.select("doc_id", "text_key", F.col("key").alias("model"), *(x.alias(n) for n, x in zip(FIGURES, [*shown("nll"), *shown("words_nll")], strict=True)), accepted.alias("accepted"))


def bounds(marks: DataFrame, c: str, low: float, high: float) -> tuple[DataFrame, DataFrame, list[float] | None]:
    """Quantiles by language and length, and by language (some 30 rows a language), and those of all documents."""
    marks = marks.where(f"{c} IS NOT NULL")
    q, n = F.percentile_approx(c, [low, high], 10_000), F.count(F.lit(1)).alias("n")
    by_length = marks.groupBy("key", "length").agg(q.alias(f"l_{c}"), n).where(F.col("n") >= LEAST_DOCS).drop("n")
    by_key = marks.groupBy("key").agg(q.alias(f"k_{c}"), n).where(f"key <> '*' OR n >= {LEAST_DOCS}").drop("n")
    return by_length, by_key, marks.agg(q).first()[0]


def quality_filter(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """docs without the rejected ones; all columns stay as they are."""
    return without(docs, assess(docs, labels, low, high).where("NOT accepted").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_text")))
