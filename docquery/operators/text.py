"""Full-text search: an analyzer, a token table with its statistics, and BM25 over words, phrases and prefixes."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.functions.paths import find_path
from docquery.plans.filters import Clause, Text

GAP, MOST_PREFIX_TERMS = 100, 50
_CJK = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
# A word: letters, digits and marks, joined inside by an apostrophe or dot between letters, or a dot or comma between digits.
_WORD = re.compile(rf"[{_CJK}]+|[^\W{_CJK}]+(?:(?:(?<=[^\W\d_])['’.·:](?=[^\W\d_])|(?<=\d)[.,;'](?=\d))[^\W{_CJK}]+)*")
_IS_CJK = re.compile(rf"[{_CJK}]")


def analyze(text: str) -> list[str]:
    """NFKC, case folding, word segments with a letter or digit, overlapping pairs for CJK runs."""
    if text.isascii():
        return [w for w in _WORD.findall(text.lower()) if w.strip("_")]
    out = []
    for w in _WORD.findall(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())):
        if _IS_CJK.match(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        elif any(c.isalnum() for c in w):
            out.append(w)
    return out


@dataclass(frozen=True)
class TextIndex:
    fields: tuple[str, ...]
    weights: dict[str, float] = field(default_factory=dict)
    k1: float = 1.2
    b: float = 0.75


def _tokens(batches: Iterator[pa.RecordBatch], terms: frozenset[str] | None = None, prefixes: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """(doc, dl, tokens): the document's length and its tokens, of all terms or of the wanted ones."""
    for batch in batches:
        out: list[list[dict]] = []
        lengths = []
        for texts in batch.column(1).to_pylist():
            row, base, n = [], 0, 0
            for fi, values in enumerate(texts or []):
                for v in values or []:
                    words = analyze(v) if v is not None else []
                    row += [{"term": w, "pos": base + i, "field": fi} for i, w in enumerate(words) if terms is None or w in terms or (prefixes and w.startswith(prefixes))]
                    base, n = base + len(words) + GAP, n + len(words)
            out.append(row)
            lengths.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(out, pa.list_(pa.struct([("term", pa.string()), ("pos", pa.int64()), ("field", pa.int32())])))], names=["doc", "dl", "tokens"])


def _texts(df: DataFrame, pk: str, index: TextIndex) -> DataFrame:
    texts = []
    for f in index.fields:
        x = find_path(df.schema, f)
        texts.append(x.col if x.kind == "arr" and str(x.dtype.elementType) == "StringType()" else F.array(x.col) if x.kind == "str" else F.array().cast("array<string>"))
    return df.select(F.col(f"`{pk}`").alias("doc"), F.array(*texts).alias("texts"))


def _schema(rows: DataFrame) -> str:
    return f"doc {rows.schema['doc'].dataType.simpleString()}, dl long, tokens array<struct<term:string,pos:bigint,field:int>>"


def token_table(df: DataFrame, pk: str, index: TextIndex) -> DataFrame:
    """(doc, term, pos, field), one row a token; the derived table of a text index."""
    rows = _texts(df, pk, index)
    return rows.mapInArrow(_tokens, _schema(rows)).select("doc", F.explode("tokens").alias("t")).select("doc", "t.term", "t.pos", "t.field")


def wanted_tokens(df: DataFrame, pk: str, index: TextIndex, query: Text) -> DataFrame:
    """(doc, dl, tokens) of one pass over the texts; only tokens that the query can use are kept."""
    words = [(c, analyze(c.text)) for c in query.clauses]
    terms = frozenset(w for c, ws in words if not c.prefix for w in ws)
    prefixes = tuple(ws[-1] for c, ws in words if c.prefix and ws)
    rows = _texts(df, pk, index)
    return rows.mapInArrow(lambda it: _tokens(it, terms, prefixes), _schema(rows)).where("dl > 0")


def score(tokens: DataFrame, query: Text, index: TextIndex, dl: DataFrame | None = None) -> DataFrame:
    """(doc, _score) of the documents that match, higher is better. Only the query's terms go through the driver.

    dl: (doc, dl) of all documents with tokens, if `tokens` has only those that the query can use.
    """
    k1, b = index.k1 or 1.2, index.b or 0.75
    clauses: list[tuple[Clause, list[str]]] = []
    for c in query.clauses:
        words = analyze(c.text)
        if words:
            clauses.append((c, words))
    if not any(c.role != "not" for c, _ in clauses):
        return tokens.select("doc", F.lit(0.0).alias("_score")).limit(0)
    dl = tokens.groupBy("doc").agg(F.count(F.lit(1)).alias("dl")) if dl is None else dl
    stats = dl.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg")).first()
    n, avg = stats["n"], stats["avg"] or 1.0
    wanted = {w for c, ws in clauses if not c.prefix for w in ws}
    prefixes = [ws[-1] for c, ws in clauses if c.prefix]
    vocab = tokens.filter(reduce(lambda x, y: x | y, [F.col("term").isin(*sorted(wanted)) if wanted else F.lit(False), *(F.startswith("term", F.lit(p)) for p in prefixes)]))
    df: dict[str, int] = {r["term"]: r["df"] for r in vocab.filter(F.col("term").isin(*sorted(wanted))).groupBy("term").agg(F.count_distinct("doc").alias("df")).collect()} if wanted else {}
    expanded: dict[str, list[str]] = {}
    for p in dict.fromkeys(prefixes):
        rows = vocab.filter(F.startswith("term", F.lit(p))).groupBy("term").agg(F.count_distinct("doc").alias("df")).orderBy(F.desc("df"), "term").limit(MOST_PREFIX_TERMS).collect()
        expanded[p] = [r["term"] for r in rows]
        df |= {r["term"]: r["df"] for r in rows}
    idf = lambda w: math.log(1 + (n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5))
    used = sorted(set(df))
    if not used:
        return tokens.select("doc", F.lit(0.0).alias("_score")).limit(0)
    weight = F.lit(1.0)
    for i, f in enumerate(index.fields):
        if f in index.weights:
            weight = F.when(F.col("field") == i, float(index.weights[f])).otherwise(weight)
    # One row a document: positions and weighted frequency of each query term.
    per = tokens.filter(F.col("term").isin(*used)).groupBy("doc").agg(*(F.sum(F.when(F.col("term") == w, weight)).alias(f"tf{i}") for i, w in enumerate(used)), *(F.collect_list(F.when(F.col("term") == w, F.col("pos"))).alias(f"ps{i}") for i, w in enumerate(used))).join(dl, "doc")
    at = {w: i for i, w in enumerate(used)}

    def bm25(tf: Column, weight_: float) -> Column:
        return F.when(tf > 0, weight_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / avg))).otherwise(0.0)

    def term(w: str) -> Column:
        return bm25(F.col(f"tf{at[w]}"), idf(w)) if w in at else F.lit(0.0)

    def clause(c: Clause, words: list[str]) -> Column:
        if c.prefix and len(words) == 1:
            return reduce(lambda x, y: x + y, [term(w) for w in expanded[words[-1]]], F.lit(0.0))
        if len(words) == 1:
            return term(words[0])
        if any(w not in at for w in words):
            return F.lit(0.0)
        hits = F.filter(F.col(f"ps{at[words[0]]}"), lambda p: reduce(lambda x, y: x & y, [F.array_contains(F.col(f"ps{at[w]}"), p + i) for i, w in enumerate(words) if i], F.lit(True)))
        return bm25(F.size(hits).cast("double"), sum(map(idf, words)))

    marks = [(c, clause(c, ws)) for c, ws in clauses]
    must = [m for c, m in marks if c.role == "must" or (c.role == "should" and query.all_terms)]
    keep = reduce(lambda x, y: x & y, [m > 0 for m in must], F.lit(True))
    for c, m in marks:
        if c.role == "not":
            keep = keep & ~(m > 0)
    total = reduce(lambda x, y: x + y, [m for c, m in marks if c.role != "not"])
    return per.filter(keep).select("doc", total.alias("_score")).filter("_score > 0")


def search(df: DataFrame, pk: str, query: Text, index: TextIndex, tokens: DataFrame | None = None) -> DataFrame:
    """Rows of df that match, with _score."""
    if tokens is not None:
        found = score(tokens, query, index)
    else:  # the texts are analysed once, for the statistics and for the scores
        once = wanted_tokens(df, pk, index, query).persist(StorageLevel.MEMORY_AND_DISK)
        found = score(once.select("doc", F.explode("tokens").alias("t")).select("doc", "t.term", "t.pos", "t.field"), query, index, once.select("doc", "dl"))
    return df.join(found.withColumnRenamed("doc", "__doc"), F.col(f"`{pk}`") == F.col("__doc")).drop("__doc")
