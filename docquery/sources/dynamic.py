"""Dynamic mode: documents of any shape as extended JSON strings, filtered and ordered in Arrow batches.

Slower than typed collections, and the only mode for fields of several types or explicit nulls. Sorting uses one binary key
whose byte order is the order of values, so Spark's own sort and top-k do the rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery import evaluate
from docquery.operators.pages import page
from docquery.plans import values as V
from docquery.plans.errors import ParseError
from docquery.plans.expressions import parse_expression
from docquery.plans.filters import SortKey, parse_filter, parse_modifier, parse_sort, split_ranked


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One document a line, as it stands."""
    return spark.read.text(path).select(F.col("value").alias("doc"))


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.col("doc").alias("value")).write.text(path)


def from_documents(spark: SparkSession, docs: list[dict]) -> DataFrame:
    return spark.createDataFrame([(json.dumps(V.encode(d)),) for d in docs], "doc string")


def typed(df: DataFrame, schema: Any) -> DataFrame:
    """Documents as typed columns; what does not fit the schema is missing."""
    return df.select(F.from_json("doc", schema).alias("d")).select("d.*")


def _inverted(key: bytes) -> bytes:
    return bytes(255 - b for b in key) + b"\xff"


def _keyed(batches: Iterator[pa.RecordBatch], f: Any, keys: list[SortKey], pk: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, order = [], []
        for text in batch.column(0).to_pylist():
            if text is None:
                continue
            doc = V.decode(json.loads(text))
            if evaluate.matches(f, doc):
                docs.append(text)
                order.append(b"".join(_inverted(k) if s.desc else k for s in keys for k in [evaluate.sort_key(doc, s)]) + V.key(evaluate.get(doc, pk)))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(order, pa.binary())], names=["doc", "key"])


def find(df: DataFrame, filter: Any = None, *sort: Any, limit: int = 0, offset: int = 0, pk: str = "id") -> DataFrame:  # noqa: A002
    """Column `doc` of the documents that match, in order."""
    f, keys = parse_filter(filter), parse_sort(*sort) if sort else []
    if split_ranked(f)[0] is not None:
        raise ParseError("ranked sources need a typed collection")
    out = df.select("doc").mapInArrow(lambda it: _keyed(it, f, keys, pk), "doc string, key binary").orderBy("key")
    return page(out, offset, limit).select("doc")


def project(df: DataFrame, fields: dict[str, Any]) -> DataFrame:
    """Documents of expressions; missing results have no field."""
    parsed = {k: parse_expression(v) for k, v in fields.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [V.decode(json.loads(t)) for t in batch.column(0).to_pylist() if t is not None]
            out = [json.dumps(V.encode({k: v for k, e in parsed.items() if (v := evaluate.evaluate(e, d)) is not V.MISSING})) for d in rows]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["doc"])

    return df.select("doc").mapInArrow(run, "doc string")


def update(df: DataFrame, filter: Any, modifier: dict, pk: str = "id") -> DataFrame:  # noqa: A002
    """All documents, those that match modified."""
    f, changes = parse_filter(filter), parse_modifier(modifier, pk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                d = V.decode(json.loads(t))
                out.append(json.dumps(V.encode(evaluate.modified(d, changes)[0])) if evaluate.matches(f, d) else t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["doc"])

    return df.select("doc").where("doc IS NOT NULL").mapInArrow(run, "doc string")


def canonical_key(df: DataFrame, path: str) -> DataFrame:
    """df with a column `key` to group and order by a field of any type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [V.key(evaluate.get(V.decode(json.loads(t)), path)) if t is not None else None for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["doc", "key"])

    return df.select("doc").mapInArrow(run, "doc string, key binary")
