"""Stored collections: immutable Parquet versions under a manifest that is swapped at once.

Readers pin the version they opened, writers hold a lock file, and a failed write leaves nothing visible. All access goes
through Hadoop's file systems, so the root may be any URI that Spark can write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.functions.compare import kind_of
from docquery.functions.paths import find_path
from docquery.operators.modifiers import modify
from docquery.operators.query import Collection, VectorIndex
from docquery.operators.text import TextIndex
from docquery.plans import pipelines as P
from docquery.plans.errors import CollectionExists, CollectionNotFound, DocExists, DocNotFound, DocWithoutId, IndexMismatch, PrimaryKeyError, UniqueViolation
from docquery.plans.filters import parse_modifier


@dataclass(frozen=True)
class Index:
    """fields may start with a minus; kind is range, text or vector."""

    name: str
    fields: tuple[str, ...]
    unique: bool = False
    sparse: bool = False
    kind: str = "range"
    options: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class WriteResult:
    matched: int = 0
    modified: int = 0
    written: int = 0


class Files:
    """The few file operations that commits need."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, jvm = spark, root.rstrip("/"), spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(self.conf)
        self.fs.setWriteChecksum(False)

    def at(self, name: str) -> Any:
        return self.path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool) -> None:
        stream = self.fs.create(self.at(name), overwrite)
        stream.write(bytearray(text.encode()))
        stream.close()

    def swap(self, name: str, text: str) -> None:
        """Replace a file by one rename."""
        new = f"{name}.{uuid.uuid4().hex}"
        self.write(new, text, True)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at(name).toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self.at(new).makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()), self.at(name).makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()), options)

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(self.root)) if s.isDirectory()) if self.fs.exists(self.path(self.root)) else []

    def copy(self, name: str, target: str) -> None:
        util = self.spark._jvm.org.apache.hadoop.fs.FileUtil
        to = self.path(target)
        util.copy(self.fs, self.at(name), to.getFileSystem(self.conf), to, False, self.conf)


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)

    def manifest(self, name: str) -> dict[str, Any]:
        if not self.files.exists(f"{name}/manifest.json"):
            raise CollectionNotFound(name)
        return json.loads(self.files.read(f"{name}/manifest.json"))

    def create(self, name: str, schema: T.StructType | DataFrame, pk: str = "id") -> Stored:
        """A new collection of a schema, or of the documents of a DataFrame."""
        if self.files.exists(f"{name}/manifest.json"):
            raise CollectionExists(name)
        if not pk or pk.startswith("$") or pk.startswith("-") or "." in pk:
            raise PrimaryKeyError(f"a bad primary key {pk!r}")
        docs = schema if isinstance(schema, DataFrame) else self.spark.createDataFrame([], schema)
        out = Stored(self, name, {"pk": pk, "version": 0, "indexes": []})
        return out.commit(out.valid(docs))

    def open(self, name: str) -> Stored:
        return Stored(self, name, self.manifest(name))

    def open_or_create(self, name: str, schema: Any, pk: str = "id") -> Stored:
        return self.open(name) if self.files.exists(f"{name}/manifest.json") else self.create(name, schema, pk)

    def list(self) -> list[str]:
        return [n for n in self.files.names() if self.files.exists(f"{n}/manifest.json")]

    def rename(self, old: str, new: str) -> Stored:
        self.manifest(old)
        if self.files.exists(f"{new}/manifest.json"):
            raise CollectionExists(new)
        self.files.fs.rename(self.files.at(old), self.files.at(new))
        return self.open(new)

    def drop(self, name: str) -> None:
        self.manifest(name)
        self.files.remove(name)

    def backup(self, target: str) -> None:
        """Copy each collection's pinned version; later writes make other directories."""
        other = Files(self.spark, target)
        for name in self.list():
            m = self.manifest(name)
            self.files.copy(f"{name}/v={m['version']}", f"{other.root}/{name}/v={m['version']}")
            other.write(f"{name}/manifest.json", json.dumps(m), True)

    def stats(self) -> dict[str, dict]:
        return {n: self.open(n).stats() for n in self.list()}


class Stored:
    """A collection at one version. Writing verbs return the collection at the next one with what they did."""

    def __init__(self, store: Store, name: str, meta: dict[str, Any]) -> None:
        self.store, self.name, self.meta, self.pk = store, name, meta, meta["pk"]

    @property
    def df(self) -> DataFrame:
        schema = T.StructType.fromJson(self.meta["schema"])
        return self.store.spark.read.schema(schema).parquet(f"{self.store.files.root}/{self.name}/v={self.meta['version']}")

    @property
    def indexes(self) -> list[Index]:
        return [Index(**{**i, "fields": tuple(i["fields"])}) for i in self.meta["indexes"]]

    def collection(self) -> Collection:
        text = {i.name: TextIndex(tuple(f.lstrip("-") for f in i.fields), **i.options) for i in self.indexes if i.kind == "text"}
        vectors = {i.name: VectorIndex(i.fields[0], **i.options) for i in self.indexes if i.kind == "vector"}
        return Collection(self.df, self.pk, self.name, text, vectors)

    def find(self, filter: Any = None):  # noqa: A002, ANN201
        return self.collection().find(filter)

    def find_id(self, key: Any) -> Any:
        return self.collection().find_id(key)

    def count(self) -> int:
        return self.df.count()

    # Constraints

    def valid(self, docs: DataFrame) -> DataFrame:
        if self.pk not in docs.columns:
            raise DocWithoutId(self.pk)
        if kind_of(docs.schema[self.pk].dataType) == "arr":
            raise PrimaryKeyError("arrays are no primary keys")
        if docs.filter(F.col(f"`{self.pk}`").isNull()).limit(1).count():
            raise DocWithoutId(self.pk)
        if docs.groupBy(F.col(f"`{self.pk}`")).count().filter("count > 1").limit(1).count():
            raise DocExists(self.pk)
        for i in self.indexes:
            if i.unique:
                self.unique(docs, i)
        return docs

    def unique(self, docs: DataFrame, i: Index) -> None:
        rows = docs
        keys = []
        for n, f in enumerate(i.fields):
            x = find_path(docs.schema, f.lstrip("-"))
            if x.kind == "arr":  # each distinct element is a key of its document
                rows = rows.withColumn(f"__k{n}", F.explode_outer(F.array_distinct(x.col)))
            else:
                rows = rows.withColumn(f"__k{n}", x.col if x.dtype is not None else F.lit(None).cast("string"))
            keys.append(f"__k{n}")
        if i.sparse:
            rows = rows.dropna(subset=keys)
        if rows.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise UniqueViolation(i.name)

    def ensure_index(self, name: str, *fields: str, unique: bool = False, sparse: bool = False, kind: str = "range", **options: Any) -> Stored:
        new = Index(name, fields, unique, sparse, kind, options)
        for i in self.indexes:
            if i.name == name:
                if i != new:
                    raise IndexMismatch(name)
                return self
        if unique:
            self.unique(self.df, new)
        return self.reindexed([*self.meta["indexes"], {**new.__dict__, "fields": list(fields)}])

    def drop_index(self, name: str) -> Stored:
        if all(i.name != name for i in self.indexes):
            raise IndexMismatch(name)
        return self.reindexed([i for i in self.meta["indexes"] if i["name"] != name])

    # Commits

    def commit(self, docs: DataFrame) -> Stored:
        """Write the next version and swap the manifest, if nobody else has since this version was opened."""
        files, version = self.store.files, self.meta["version"] + 1
        with self.alone():
            files.remove(f"{self.name}/v={version}")
            keys = [f.lstrip("-") for i in self.indexes if i.kind == "range" for f in i.fields[:1] if f.lstrip("-") in docs.columns]
            laid_out = docs.repartitionByRange(F.col(f"`{self.pk}`")).sortWithinPartitions(*(f"`{k}`" for k in dict.fromkeys([self.pk, *keys])))
            laid_out.write.parquet(f"{files.root}/{self.name}/v={version}")
            meta = {**self.meta, "version": version, "schema": json.loads(docs.schema.json())}
            files.swap(f"{self.name}/manifest.json", json.dumps(meta))
            return Stored(self.store, self.name, meta)

    @contextmanager
    def alone(self) -> Iterator[None]:
        """Hold the lock, with the manifest as it was when this version was opened."""
        files, lock = self.store.files, f"{self.name}/.lock"
        files.write(lock, "", False)  # fails if another writer is at it
        try:
            now = self.store.manifest(self.name) if files.exists(f"{self.name}/manifest.json") else {"version": 0, "indexes": self.meta["indexes"]}
            if now["version"] != self.meta["version"] or now["indexes"] != self.meta["indexes"]:
                raise RuntimeError(f"{self.name} was changed by another writer (version {now['version']})")
            yield
        finally:
            files.remove(lock)

    def reindexed(self, indexes: list[dict[str, Any]]) -> Stored:
        """The same version with other indexes."""
        with self.alone():
            meta = {**self.meta, "indexes": indexes}
            self.store.files.swap(f"{self.name}/manifest.json", json.dumps(meta))
            return Stored(self.store, self.name, meta)

    # Writing verbs

    def fitted(self, docs: Any) -> DataFrame:
        return docs if isinstance(docs, DataFrame) else self.store.spark.createDataFrame(docs, self.df.schema)

    def insert(self, docs: Any) -> tuple[Stored, WriteResult]:
        """All or nothing; a key that is there already, or twice among the new ones, fails."""
        new = self.fitted(docs)
        every = self.df.unionByName(new, allowMissingColumns=True)
        return self.commit(self.valid(every)), WriteResult(written=new.count())

    def update(self, filter: Any, modifier: Any, sort: tuple = (), limit: int = 0) -> tuple[Stored, WriteResult]:  # noqa: A002
        """Modify what the filter finds; a bounded update takes the first ones of the sort."""
        f = self.find(filter)
        if sort:
            f = f.sort(*sort)
        return self._apply(f.limit(limit).ids() if limit else f.ids(), modifier)

    def _apply(self, ids: DataFrame, modifier: Any) -> tuple[Stored, WriteResult]:
        keys = ids.select(F.col(f"`{self.pk}`").alias("__hit")).distinct()
        rows = self.df.join(keys, F.col(f"`{self.pk}`") == F.col("__hit"), "left")
        hit = rows.filter(F.col("__hit").isNotNull()).drop("__hit")
        changed = modifier(hit).withColumn("__modified", F.lit(True)) if callable(modifier) else modify(hit, parse_modifier(modifier, self.pk))
        changed = changed.persist()
        try:
            counts = changed.agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("__modified").cast("int")).alias("n")).first()
            if not counts["n"]:
                return self, WriteResult(counts["m"], 0)
            every = rows.filter(F.col("__hit").isNull()).drop("__hit").unionByName(changed.drop("__modified"), allowMissingColumns=True)
            return self.commit(self.valid(every)), WriteResult(counts["m"], counts["n"])
        finally:
            changed.unpersist()

    def update_one(self, doc: dict) -> tuple[Stored, WriteResult]:
        """Replace a document that must be there."""
        self.find_id(doc[self.pk])
        rest = self.df.filter(~F.col(f"`{self.pk}`").eqNullSafe(F.lit(doc[self.pk])))
        return self.commit(self.valid(rest.unionByName(self.fitted([doc]), allowMissingColumns=True))), WriteResult(1, 1)

    def upsert_one(self, doc: dict) -> tuple[Stored, WriteResult]:
        rest = self.df.filter(~F.col(f"`{self.pk}`").eqNullSafe(F.lit(doc[self.pk])))
        return self.commit(self.valid(rest.unionByName(self.fitted([doc]), allowMissingColumns=True))), WriteResult(0, 1)

    def update_id(self, key: Any, modifier: Any) -> tuple[Stored, WriteResult]:
        self.find_id(key)
        return self._apply(self.find({self.pk: key}).ids(), modifier)

    def upsert_id(self, key: Any, modifier: Any) -> tuple[Stored, WriteResult]:
        """update_id, or an insert of a document of that key alone, modified; reported as modified, not matched."""
        try:
            return self.update_id(key, modifier)
        except DocNotFound:
            alone = self.store.spark.createDataFrame([{self.pk: key}], T.StructType([f if f.name == self.pk else T.StructField(f.name, f.dataType) for f in self.df.schema]))
            new = modifier(alone) if callable(modifier) else modify(alone, parse_modifier(modifier, self.pk)).drop("__modified")
            return self.commit(self.valid(self.df.unionByName(new, allowMissingColumns=True))), WriteResult(0, 1)

    def delete(self, filter: Any = None, sort: tuple = (), limit: int = 0) -> tuple[Stored, WriteResult]:  # noqa: A002
        f = self.find(filter)
        if sort:
            f = f.sort(*sort)
        keys = (f.limit(limit) if limit else f).ids().select(F.col(f"`{self.pk}`").alias("__hit")).distinct()
        n = keys.count()
        if not n:
            return self, WriteResult()
        return self.commit(self.df.join(keys, F.col(f"`{self.pk}`") == F.col("__hit"), "left_anti")), WriteResult(n, n)

    def delete_id(self, key: Any) -> tuple[Stored, WriteResult]:
        self.find_id(key)
        return self.delete({self.pk: key})

    def aggregate(self, pipeline: list[dict], limits: bool = False):  # noqa: ANN201
        """Rows of a read-only pipeline; a sink writes at once and gives its WriteResult."""
        a = self.collection().aggregate(pipeline, limits)
        if a.read_only():
            return a.rows()
        sink = a.stages[-1]
        return self.out(a.rows(), sink) if isinstance(sink, P.Out) else self.merge(a.rows(), sink)

    def out(self, rows: DataFrame, sink: P.Out) -> WriteResult:
        if sink.target == self.name:
            raise CollectionExists("$out cannot replace its own source")
        target = self.store.open(sink.target) if sink.target in self.store.list() else Stored(self.store, sink.target, {"pk": "id", "version": 0, "indexes": []})
        rows = rows.persist()
        try:
            target.commit(target.valid(rows))
            return WriteResult(written=rows.count())
        finally:
            rows.unpersist()

    def merge(self, rows: DataFrame, sink: P.Merge) -> WriteResult:
        """A full outer join on the key decides each document once; nothing is written if nothing comes."""
        rows = rows.persist()
        try:
            n = rows.count()
            if not n:
                return WriteResult()
            there = sink.target in self.store.list()
            target = self.store.open(sink.target) if there else Stored(self.store, sink.target, {"pk": "id", "version": 0, "indexes": []})
            target.valid(rows)
            merged, written = merge_rows(target.df if there else rows.limit(0), rows, sink, target.pk)
            target.commit(target.valid(merged))
            return WriteResult(written=written)
        finally:
            rows.unpersist()

    def stats(self) -> dict[str, Any]:
        files = self.store.files
        summary = files.fs.getContentSummary(files.at(f"{self.name}/v={self.meta['version']}"))
        return {"documents": self.df.count(), "bytes": summary.getLength(), "version": self.meta["version"], "indexes": [i.name for i in self.indexes]}


def merge_rows(old: DataFrame, new: DataFrame, sink: P.Merge, pk: str = "id") -> tuple[DataFrame, int]:
    """The documents after a merge, and how many of the new ones were written."""
    a = old.select(F.struct("*").alias("a"), F.col(f"`{pk}`").alias("ka"))
    b = new.select(F.struct("*").alias("b"), F.col(f"`{pk}`").alias("kb"))
    both = a.join(b, F.col("ka") == F.col("kb"), "full_outer")
    kinds = both.groupBy(F.col("ka").isNotNull().alias("x"), F.col("kb").isNotNull().alias("y")).count().collect()
    n = {(r["x"], r["y"]): r["count"] for r in kinds}
    matched, fresh = n.get((True, True), 0), n.get((False, True), 0)
    if sink.matched == "fail" and matched:
        raise DocExists("$merge: a document is there already")
    if sink.unmatched == "fail" and fresh:
        raise DocNotFound("$merge: a document is not there")
    kept = F.col("ka").isNotNull() | (F.lit(sink.unmatched == "insert") & F.col("kb").isNotNull())
    fields = []
    for name in [*old.columns, *(c for c in new.columns if c not in old.columns)]:
        x = F.col("a").getField(name) if name in old.columns else None
        y = F.col("b").getField(name) if name in new.columns else None
        if x is not None and y is not None and old.schema[name].dataType != new.schema[name].dataType:
            y = y.cast(old.schema[name].dataType)
        null = F.lit(None)
        x, y = (null if x is None else x), (null if y is None else y)
        met = {"merge": F.coalesce(y, x), "replace": y, "keepExisting": x, "fail": x}[sink.matched]
        fields.append(F.when(F.col("ka").isNull(), y).when(F.col("kb").isNull(), x).otherwise(met).alias(name))
    written = (matched if sink.matched in ("merge", "replace") else 0) + (fresh if sink.unmatched == "insert" else 0)
    return both.filter(kept).select(*fields), written
