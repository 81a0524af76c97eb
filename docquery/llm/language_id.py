"""Hierarchical language identification with linear support vector machines.

Features are hashed pairs and triples of folded bytes, letters only, as square roots of relative frequencies. One machine
for each family against the rest chooses the family; inside it, one machine for each pair of languages votes. Each machine
is trained by one task on at most PER_LANGUAGE texts of each language, chosen by a hash of doc_id among the labelled rows
(a documented bound), and of the MOST_LANGUAGES most frequent languages. Texts become sparse features once; a language's are
packed in one row, which goes to each machine's task. Only machines go to the driver: features x (families + pairs) numbers,
however large the input.

Defined results: null texts and texts without a letter are `und` with score 0, as is everything if no row is labelled;
ties of votes go to the larger sum of margins, then to the smaller name; repeated rows are predicted alike; an empty table
gives an empty result; very long texts are read whole; further columns are ignored and only text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm import blocks as B
from docquery.llm.common import discard, id_and_text, settle

PER_LANGUAGE = 300
MOST_LANGUAGES = 400
FEATURES = 1 << 13
_FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv", "uralic": "fi et hu", "celtic": "ga cy br gd", "turkic": "tr az kk uz ky tt tk ug",
    "indo-aryan": "hi bn ur mr gu pa ne si as or sd sa", "iranian": "fa ps ku tg", "dravidian": "ta te kn ml",
    "semitic": "ar he am mt ti", "sinitic": "zh yue wuu", "austronesian": "id ms tl jv su mg mi haw sm",
    "bantu": "sw zu xh rw sn st",
}
FAMILY = {lang: family for family, langs in _FAMILIES.items() for lang in langs.split()}
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def family(lang: str) -> str:
    """The family of a language code; unknown codes are families of their own."""
    return FAMILY.get(lang.split("-")[0].lower(), lang)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES unit-length features for each document of a block."""
    low = B.LOWER[data]
    x = np.where(_LETTER[low], low, 32).astype(np.uint32)
    n, docs = len(x), len(offsets) - 1
    out = np.zeros(docs * FEATURES)
    doc = np.repeat(np.arange(docs, dtype=np.int64), np.diff(offsets)) * FEATURES
    two = x[:-1] * np.uint32(257) + x[1:] if n > 1 else np.zeros(0, np.uint32)
    three = two[:-1] * np.uint32(263) + x[2:] if n > 2 else np.zeros(0, np.uint32)
    for k, grams in ((2, two), (3, three)):
        h = ((grams * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
        same = doc[: len(grams)] == doc[k - 1 :]
        out += np.bincount((doc[: len(grams)] + h)[same], minlength=len(out))
    out = out.reshape(docs, FEATURES)
    return np.sqrt(out / np.maximum(1, out.sum(1, keepdims=True)))


class Sparse:
    """Rows of features: places and values of all rows in one, and where each row starts."""

    def __init__(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> None:
        self.at, self.value, self.starts = at, value, starts
        self.row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], len(self.starts) - 1)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * r[self.row], FEATURES)


def train_machine(x: Sparse, y: np.ndarray, c: float = 20.0, steps: int = 80) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, classes weighted alike; accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    w = v = np.zeros(FEATURES + 1)
    lipschitz, t = 1 + 2 * 2 * c, 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x.times(v) + v[-1])) * weight * y
        new = v - (v - 2 * np.append(x.back(slack), slack.sum())) / lipschitz
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def hashed(t: pa.Table) -> pa.Table:
    """A language's texts as sparse features in one row."""
    order = sorted(range(len(t)), key=lambda i: (t.column("doc_id")[i].as_py() is None, t.column("doc_id")[i].as_py(), t.column("text")[i].as_py()))
    at, value, sizes = [], [], []
    for a, b, data, offsets in B.blocks(t.column("text").take(pa.array(order)), 1 << 20):
        for d in range(0, b - a, 64):  # dense rows of 64 texts at a time
            o = offsets[d : min(d + 64, b - a) + 1]
            x = features(data[o[0] : o[-1]], o - o[0])
            row, col = np.nonzero(x)
            at.append(col.astype(np.int32))
            value.append(x[row, col].astype(np.float32))
            sizes.append(np.bincount(row, minlength=len(x)).astype(np.int32))
    pack = lambda xs: pa.array([np.concatenate(xs).tobytes()], pa.binary())
    return pa.table({"lang": [t.column("lang")[0].as_py()], "at": pack(at), "value": pack(value), "sizes": pack(sizes)})


def trained(t: pa.Table) -> pa.Table:
    """One machine from the languages of one task."""
    order = np.argsort(t.column("lang").to_pylist(), kind="stable").tolist()
    at, value, sizes = ([np.frombuffer(t.column(c)[i].as_buffer(), k) for i in order] for c, k in (("at", np.int32), ("value", np.float32), ("sizes", np.int32)))
    y = np.concatenate([np.full(len(n), 1.0 if t.column("positive")[i].as_py() else -1.0) for i, n in zip(order, sizes, strict=True)])
    x = Sparse(np.concatenate(at), np.concatenate(value), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))
    w, b = train_machine(x, y)
    return pa.table({"task": [t.column("task")[0].as_py()], "w": pa.array([w.astype("<f4").tobytes()], pa.binary()), "b": [b]})


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The machines from rows (doc_id, text, lang)."""
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    spark, langs = labelled.sparkSession, sorted(counts)
    if not langs:
        return {"families": {}, "machines": {}}
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family(lang), []).append(lang)
    tasks = [(f"family {f}", lang, f == family(lang)) for f in families for lang in langs] if len(families) > 1 else []
    tasks += [(f"pair {a} {b}", lang, lang == a) for group in families.values() for a, b in combinations(group, 2) for lang in (a, b)]
    if not tasks:
        return {"families": families, "machines": {}}
    h = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    share = spark.createDataFrame([(lang, int(min(1.0, 1.5 * per_language / n) * (1 << 30))) for lang, n in counts.items()], "lang string, below long")
    few = labelled.select("doc_id", "text", "lang", h.alias("h")).join(F.broadcast(share), "lang").where("h < below")
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("rank") <= per_language)
    table = spark.createDataFrame(tasks, "task string, lang string, positive boolean")
    packed = settle(few.select("lang", "doc_id", "text").groupBy("lang").applyInArrow(hashed, "lang string, at binary, value binary, sizes binary"), "features")
    rows = packed.join(F.broadcast(table), "lang").groupBy("task").applyInArrow(trained, "task string, w binary, b double").collect()
    discard(packed)
    return {"families": families, "machines": {r["task"]: (np.frombuffer(r["w"], "<f4"), r["b"]) for r in rows}}


class Predictor:
    def __init__(self, model: dict) -> None:
        self.families, self.machines = model["families"], model["machines"]
        self.names = list(self.machines)
        self.column = {name: i for i, name in enumerate(self.names)}
        self.w = np.stack([self.machines[n][0] for n in self.names], 1) if self.names else np.zeros((FEATURES, 0), np.float32)
        self.b = np.array([self.machines[n][1] for n in self.names])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margins = x @ self.w + self.b
        sure = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        names = list(self.families)
        if len(names) > 1:
            by = margins[:, [self.column[f"family {f}"] for f in names]]
            chosen, score = by.argmax(1), sure(by.max(1))
        else:
            chosen, score = np.zeros(len(x), int), np.ones(len(x))
        langs = np.empty(len(x), object)
        for k, f in enumerate(names):
            rows, group = np.flatnonzero(chosen == k), self.families[f]
            if not len(rows):
                continue
            votes, total = np.zeros((len(rows), len(group))), np.zeros((len(rows), len(group)))
            for (i, a), (j, b) in combinations(enumerate(group), 2):
                m = margins[rows, self.column[f"pair {a} {b}"]]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                total[:, i] += m
                total[:, j] -= m
            best = (votes + 0.5 * np.tanh(total / 1e3)).argmax(1)
            langs[rows] = np.array(group, object)[best]
            if len(group) > 1:
                score[rows] *= sure(total[np.arange(len(rows)), best] / (len(group) - 1))
        return langs, score


def predicted(batches: Iterator[pa.RecordBatch], model: Predictor) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lettered = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\pL"), False).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in B.blocks(batch.column("text"), 1 << 20):
            langs, score = np.full(b - a, "und", object), np.zeros(b - a)
            known = np.flatnonzero(lettered[a:b])
            if model.families and len(known):
                for c in range(0, len(known), 256):
                    rows = known[c : c + 256]
                    piece = np.concatenate([data[offsets[r] : offsets[r + 1]] for r in rows])
                    langs[rows], score[rows] = model.predict(features(piece, np.concatenate([[0], np.cumsum(offsets[rows + 1] - offsets[rows])])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(Predictor(model))
    return id_and_text(docs).mapInArrow(lambda it: predicted(it, held.value), "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that never take part in training: those whose CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_held_out(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    model = fit(id_and_text(docs, "lang").where(~held_out()), per_language)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
