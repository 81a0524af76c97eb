"""Packing into optimal length buckets.

One global histogram of document lengths, of a fixed number of cells whatever the input, goes to the driver. Dynamic
programming over it chooses the bucket boundaries of least total padding. Inside each bucket, batches are filled up to a
token budget of padded length. Rows are numbered without gaps inside a bucket in pieces of bounded size.

Lengths below EXACT have a cell each; above it each doubling has STEPS cells, and a boundary is the greatest length that
occurs in its cell. The boundaries are optimal among these.

Defined results: a null text has length 0; documents of length 0 are in the first bucket; a document longer than the
budget is a batch of its own; equal lengths share a bucket; repeated rows are packed each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.common import id_and_text, settle

EXACT, STEPS = 512, 64
BUCKETS, BUDGET = 12, 16_384
PIECE_ROWS = 200_000
WORD = "[^\\x20\\x09-\\x0D]+"


def cell(length: str) -> F.Column:
    """A number that grows with the length: the length itself, or its place among STEPS per doubling."""
    return F.when(F.col(length) < EXACT, F.col(length)).otherwise(EXACT + F.floor(F.log2(F.col(length) / EXACT) * STEPS)).cast("long")


def boundaries(most: list[int], count: list[int], total: list[int], buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` runs of cells with the least padding; cells in ascending order."""
    n = len(most)
    if not n:
        return []
    m, c, s = np.array(most, float), np.concatenate([[0], np.cumsum(count)]).astype(float), np.concatenate([[0], np.cumsum(total)]).astype(float)
    best, cut = np.full(n + 1, np.inf), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        new, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            cost = best[:j] + m[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            back[j] = int(np.argmin(cost))
            new[j] = cost[back[j]]
        cut.append((new, back))
        best = new
    k = min(range(len(cut)), key=lambda i: cut[i][0][n])
    out, j = [], n
    while j > 0:
        out.append(most[j - 1])
        j, k = int(cut[k][1][j]), k - 1
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, slot, padding of every row; batch and slot count from 0 in a bucket."""
    spark = docs.sparkSession
    length = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = settle(id_and_text(docs).select("doc_id", length.alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "lengths")
    histogram = rows.groupBy(cell("n_tokens").alias("cell")).agg(F.max("n_tokens").alias("most"), F.count(F.lit(1)).alias("c"), F.sum("n_tokens").alias("s")).orderBy("cell").collect()
    bounds = boundaries([r["most"] for r in histogram], [r["c"] for r in histogram], [r["s"] for r in histogram], buckets)
    ends = F.lit(bounds or [0])
    rows = rows.withColumn("bucket", F.size(F.filter(ends, lambda e: e < F.col("n_tokens")))).withColumn("bucket_len", F.element_at(ends, F.col("bucket") + 1).cast("long"))

    # A gapless number inside the bucket, from pieces that no bucket, however large, outgrows.
    pieces = max(1, -(-sum(r["c"] for r in histogram) // piece_rows))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "row")).withColumn("piece", F.pmod("key", F.lit(pieces)))
    sizes = rows.groupBy("bucket", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    at = F.row_number().over(Window.partitionBy("bucket", "piece").orderBy("key", "row")) - 1
    rows = rows.withColumn("at", at).join(before, ["bucket", "piece"]).withColumn("at", F.col("at") + F.col("before"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_len"))))
    return rows.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("at") / fit).cast("long").alias("batch"), F.pmod(F.col("at"), fit).cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
