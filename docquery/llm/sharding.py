"""Sharding by a hypergeometric communication matrix: a uniform shuffle into shards of exact sizes.

Rows keep the source partition they were read in, numbered once and written to the shared folder, so a lost executor
changes nothing. From the partitions' row counts alone the driver draws how many rows each partition sends to each shard
(partitions x shards integers, exact margins). Each partition permutes its rows and deals them out by its row of the
matrix; each shard permutes what arrives. Shards are permuted in pieces of bounded size, so no task holds a shard.

Defined results: counts of shards differ by one at most; null texts have size 1 and CRC 0; repeated rows and null doc_ids
are dealt like any others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.common import id_and_text, settle

#: Rows of a partition or shard that are permuted in one task, about.
PIECE_ROWS = 200_000


def communication_matrix(sources: list[int], targets: list[int], seed: int) -> np.ndarray:
    """Row i says how many rows source i sends to each target; uniform over all ways of dealing, with exact margins."""
    rng, left = np.random.default_rng(seed), np.array(targets, np.int64)
    out = np.zeros((len(sources), len(targets)), np.int64)
    for i, n in enumerate(sources):
        if left.sum() < 1_000_000_000:
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:  # beyond that library's range: the places of n distinct rows among all that are left
            out[i] = np.bincount(np.searchsorted(np.cumsum(left), rng.choice(int(left.sum()), n, replace=False), "right"), minlength=len(targets))
        left -= out[i]
    return out


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 7, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit("")).cast("binary")
    rows = settle(id_and_text(docs).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.spark_partition_id().alias("file_part"), F.monotonically_increasing_id().alias("row")), "rows")

    # Source partitions above piece_rows are split by the row number: a source is (file_part, piece).
    rows = rows.withColumn("piece", F.floor((F.col("row").bitwiseAND((1 << 33) - 1)) / piece_rows))
    counts = sorted((r["file_part"], r["piece"], r["count"]) for r in rows.groupBy("file_part", "piece").count().collect())
    total = sum(c for *_, c in counts)
    matrix = communication_matrix([c for *_, c in counts], [total // shards + (k < total % shards) for k in range(shards)], seed)
    ends = [(p, q, np.cumsum(m).tolist()) for (p, q, _), m in zip(counts, matrix, strict=True)]
    table = spark.createDataFrame(ends, "file_part int, piece long, ends array<long>")

    local = Window.partitionBy("file_part", "piece").orderBy(F.xxhash64(F.lit(seed), "row"), "row")
    dealt = rows.withColumn("rank", F.row_number().over(local)).join(F.broadcast(table), ["file_part", "piece"])
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))

    # The second permutation: pieces by the leading part of a random key, then the rest of it within each piece.
    pieces = max(1, -(-total // (shards * piece_rows)))
    key = F.xxhash64(F.lit(seed + 1), "row")
    dealt = settle(dealt.select("doc_id", "size", "text_crc32", "shard", "row", key.alias("key"), F.pmod(key, F.lit(pieces)).alias("part")), "dealt")
    sizes = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "row")) - 1
    return dealt.withColumn("at", slot).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
