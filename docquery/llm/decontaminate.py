"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all token windows.

Words are runs of digits, a-z (A-Z folded) and any character that is not ASCII. Each item gives its windows of `words`
consecutive words, or one window of all its words if it has fewer. A hash hit is confirmed by comparing the words
themselves. The set is broadcast in parts of at most PART_WINDOWS windows, whose number is counted first; each further
part is one more pass over the documents, and the parts' hits are then merged per document.

Defined results: null and empty texts have no words and are never hit; items without words are ignored; equal windows of
several items count for each of them; repeated rows are judged each alone, and so are texts that share a doc_id; very long texts
are scanned whole in one block, in time that follows their length; empty tables give empty results or no hits. Further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm import blocks as B
from docquery.llm.common import id_and_text, settle, text_key, without

#: Windows in one broadcast: some 120 bytes of text and hash each, so some 60 MB.
PART_WINDOWS = 500_000

WINDOWS = "item_id string, hash long, k int, words binary"
HITS = "row long, doc_id long, text_key long, n_words long, spans array<long>, items array<string>"


def item_windows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for start, end, data, offsets in B.blocks(batch.column(1)):
            h, s, e, first = B.word_hashes(data, offsets, B.ALNUM)
            low = B.LOWER[data]
            for r in range(start, end):
                a, b = first[r - start], first[r - start + 1]
                if a == b:
                    continue
                k = min(words, int(b - a))
                hashes, at = B.windows(h[a:b], np.array([0, b - a]), k)
                for x, i in zip(hashes.view(np.int64).tolist(), (at + a).tolist(), strict=True):
                    for field, value in zip(out, (batch.column(0)[r].as_py(), x, k, b" ".join(low[s[j] : e[j]].tobytes() for j in range(i, i + k))), strict=True):
                        field.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["item_id", "hash", "k", "words"])


class Probe:
    """The windows of one part: sorted hashes behind a bitmap, and the items of each window's exact words."""

    def __init__(self, rows: list) -> None:
        self.items: dict[bytes, list[str]] = {}
        by_k: dict[int, set[int]] = {}
        for r in rows:
            self.items.setdefault(bytes(r.words), []).append(r.item_id)
            by_k.setdefault(r.k, set()).add(r.hash)
        self.sorted = {k: np.sort(np.array(list(v), np.int64).view(np.uint64)) for k, v in by_k.items()}
        self.bits = {}
        for k, v in self.sorted.items():
            self.bits[k] = np.zeros(1 << 22, bool)
            self.bits[k][v >> np.uint64(42)] = True

    def found(self, k: int, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[k][hashes >> np.uint64(42)])
        at = np.searchsorted(self.sorted[k], hashes[maybe])
        at[at == len(self.sorted[k])] = 0
        return maybe[self.sorted[k][at] == hashes[maybe]]


def scan(batches: Iterator[pa.RecordBatch], probe: Probe) -> Iterator[pa.RecordBatch]:
    """For each document: word count, hit runs as (first word, end word) pairs, items found."""
    for batch in batches:
        for start, end, data, offsets in B.blocks(batch.column("text")):
            h, s, e, first = B.word_hashes(data, offsets, B.ALNUM)
            low = None
            hits: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for k in probe.sorted:
                hashes, at = B.windows(h, first, k)
                hit = at[probe.found(k, hashes)]
                for i, d in zip(hit.tolist(), (np.searchsorted(first, hit, "right") - 1).tolist(), strict=True):
                    low = B.LOWER[data] if low is None else low
                    if found := probe.items.get(b" ".join(low[s[j] : e[j]].tobytes() for j in range(i, i + k))):
                        hits.setdefault(d, []).append((i - int(first[d]), i - int(first[d]) + k))
                        items.setdefault(d, set()).update(found)
            n = end - start
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(start, n), batch.column("doc_id").slice(start, n), batch.column("text_key").slice(start, n), pa.array(np.diff(first), pa.int64()),
                 pa.array([[x for run in merged(hits[d]) for x in run] if d in hits else [] for d in range(n)], pa.list_(pa.int64())),
                 pa.array([sorted(items[d]) if d in items else [] for d in range(n)], pa.list_(pa.string()))],
                names=["row", "doc_id", "text_key", "n_words", "spans", "items"])


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open runs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, words: int = 8, part_windows: int = PART_WINDOWS) -> DataFrame:
    """row, doc_id, text_key, n_words, spans, items of every row of docs; items are item ids as strings."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    grams = settle(bench.where("item_id IS NOT NULL").mapInArrow(lambda it: item_windows(it, words), WINDOWS).distinct(), "windows")
    total = grams.count()
    parts = max(1, -(-total // part_windows))
    base = id_and_text(docs, text_key().alias("text_key")).withColumn("row", F.monotonically_increasing_id())
    if parts > 1:  # one more pass for each part, over rows that keep their numbers
        base = settle(base, "rows")
    out = None
    for p in range(parts):
        # A part holds whole windows: all items of a window's words are in one part, so it is bounded by its hash range.
        rows = grams.where(F.pmod("hash", F.lit(parts)) == p).collect()
        held = spark.sparkContext.broadcast(Probe(rows))
        found = base.mapInArrow(lambda it, held=held: scan(it, held.value), HITS)
        out = found if out is None else out.unionByName(found)
    if parts == 1:
        return out
    flat = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return flat.mapInArrow(merge_spans, HITS)


def merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [[x for run in merged(list(zip(v[::2], v[1::2], strict=True))) for x in run] for v in batch.column("spans").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(runs, pa.list_(pa.int64())))


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = 8, least_items: int = 1) -> DataFrame:
    """docs without those in which windows of at least `least_items` items occur; all columns stay as they are."""
    found = hits(docs, benchmark, words)
    return without(docs, found.where(F.size("items") >= least_items).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_text")))


def report(docs: DataFrame, benchmark: DataFrame, words: int = 8, least_items: int = 2) -> DataFrame:
    """The contract's row for every document."""
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    n = F.size("items")
    return hits(docs, benchmark, words).select("doc_id", "n_words", n_hit.alias("n_hit"), n.cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (n >= least_items).alias("contaminated"))


def brute_force(texts: list[tuple[int, str | None]], items: list[tuple[object, str | None]], words: int = 8) -> list[tuple]:
    """What report() gives, window by window in plain Python; for tests."""
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams: dict[tuple, set[str]] = {}
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - words + 1) if w else 0):
            grams.setdefault(tuple(w[i : i + words]), set()).add(str(item))
    out = []
    for doc, text in texts:
        w, hit, found = cut(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if got := grams.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out
