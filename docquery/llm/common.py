"""Shared plumbing of the training-data operators: projections, tables in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of a join up to this many rows of a few integers each (some 16 MB) may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only what an operator needs, so further columns of the input can never clash with its own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one is set only where none is, and only if
    driver and executors are one process: elsewhere each machine would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docquery-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_root(spark)}/docquery/{tag}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor loses nothing. The
    shuffle files of the write go as it ends; else they stay until the driver's next collection of garbage, or the one after."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(df._settled)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Jobs inside send at most so many rows to Python at once: whole texts of a batch are in memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before))) if int(before) > 0 else str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose counted rows are within the bound, else leave it to a shuffled join that can be split."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_key() -> F.Column:
    """What tells apart texts of one doc_id; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows (gone_id, gone_text), doc_id and text_key. A doc_id that repeats with other texts keeps those, rows
    that repeat both share their decision, rows with a null doc_id stay; all columns stay."""
    gone = settle(gone.select(F.col("gone_id").cast("long").alias("__gone"), F.col("gone_text").alias("__text")).where("__gone IS NOT NULL").distinct(), "gone")
    return docs.join(small(gone, gone.count()), (F.col("doc_id").cast("long") == F.col("__gone")) & (text_key() == F.col("__text")), "left_anti")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (a, b): component is the smallest node reachable.

    Minimum labels spread along links and along pointers, so chains shorten by half each round. Hubs are no hot spot:
    minima are combined before the shuffle, and the joins are plain equi-joins that adaptive execution may split.
    """
    both = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("least"))
        stepped = labels.join(near, F.col("node") == F.col("n"), "left").select("node", F.col("component").alias("old"), F.least("component", "least").alias("mid"))
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("top"))
        new = settle(stepped.join(up, F.col("mid") == F.col("up"), "left").select("node", F.least("mid", "top").alias("component"), (F.least("mid", "top") != F.col("old")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        discard(labels)
        labels = new.select("node", "component")
        labels._settled = new._settled
        if not moved:
            discard(both)
            return labels
