"""From raw documents to packed batches: quality, exact copies, near-duplicates, benchmark passages, packing.

Each stage works on all that its predecessor kept and returns the columns of documents, the last one its packing. Empty and
null texts are kept by the quality stage (nothing speaks against them), one of them by exact dedup, and packed as length 0.
Extra columns stay; a null doc_id is never dropped, as no decision can name it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquery.llm.common import documents, settle
from docquery.llm.decontaminate import decontaminate
from docquery.llm.exact_dedup import exact_dedup
from docquery.llm.near_dedup import near_dedup
from docquery.llm.packing import pack
from docquery.llm.quality import quality_filter


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within the limits of their language."""
    return quality_filter(docs, documents(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest doc_id of each group of equal texts."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by a similarity of 0.8 of five-word shingles."""
    return near_dedup(docs, words=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of eight words of a benchmark item occurs."""
    return decontaminate(docs, documents(spark, sf_dir, "benchmark"), words=8, least_items=1)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in a batch of its length bucket."""
    return pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("packing", packing_stage)]

#: A language model, verified links and dynamic programming: not for SQL. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
