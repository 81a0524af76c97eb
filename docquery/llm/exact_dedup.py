"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary of each partition finds the digests that may be frequent; an exact recount verifies them. Rows of the
verified ones are decided on the map side against a broadcast of at most `counters` winners; all other rows are shuffled by
digest, where no group can exceed a known share of the input.

Defined results: a null text is an empty text; documents with equal texts form one group and the largest doc_id stays; rows
that repeat the winning doc_id and its text are the same document and share its decision, while other texts of that doc_id are
decided in their own groups; a null doc_id loses to any other and a group of null doc_ids keeps them. Very long texts cost their
SHA-256 once and travel as that. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import id_and_text, settle, text_key, without

#: Misra-Gries counters per partition: a digest holding more than 1/COUNTERS of a partition's rows is always found there.
COUNTERS = 256


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    kept: dict[str, int] = {}
    for batch in batches:
        counts = batch.column(0).value_counts()
        for digest, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist(), strict=True):
            kept[digest] = kept.get(digest, 0) + n
        if len(kept) > counters:  # lower all by the first count that does not fit, as so many single steps would
            least = sorted(kept.values(), reverse=True)[counters]
            kept = {d: n - least for d, n in kept.items() if n > least}
    yield pa.RecordBatch.from_pydict({"digest": pa.array(list(kept), pa.string()), "n": pa.array(list(kept.values()), pa.int64())})


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return _decided(docs, counters).drop("text_key")


def _decided(docs: DataFrame, counters: int, *more: F.Column) -> DataFrame:
    names = ["text_key"] * len(more)
    rows = settle(id_and_text(docs).select("doc_id", *more, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")), "digests")
    found = rows.select("digest").mapInArrow(lambda it: misra_gries(it, counters), "digest string, n long")
    # At most `counters` rows: the candidates with the largest lower bounds, of more than one row.
    likely = found.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    heavy = settle(rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "heavy")
    fields = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"), *names]
    hot = rows.join(F.broadcast(heavy), "digest").select(*fields)
    cold = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = cold.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return hot.unionByName(cold.join(groups, "digest").select(*fields))


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """docs without the rows whose text another row of a larger doc_id has; all columns stay as they are."""
    return without(docs, _decided(docs, counters, text_key().alias("text_key")).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_text")))
