"""Queries over a collection: finds, counts, aggregations and their explanations, all as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.functions.compare import kind_of
from docquery.functions.filters import compile_filter
from docquery.operators import stages as S
from docquery.operators.text import TextIndex, search
from docquery.operators.vector import nearest, probe
from docquery.plans import pipelines as P
from docquery.plans.errors import DocNotFound, ParseError
from docquery.plans.filters import Everything, Knn, SortKey, Text, parse_filter, parse_sort, split_ranked, unsatisfiable


@dataclass(frozen=True)
class VectorIndex:
    path: str
    metric: str = "cosine"
    #: None is exact; else (centroids, rows by cell) of an inverted file, probed at `nprobe` cells.
    centers: tuple | None = None
    cells: DataFrame | None = None
    nprobe: int = 8


@dataclass(frozen=True)
class Collection:
    """Documents with a primary key. Any DataFrame will do; stored collections add the writing verbs."""

    df: DataFrame
    pk: str = "id"
    name: str = ""
    text: dict[str, TextIndex] = field(default_factory=dict)
    vectors: dict[str, VectorIndex] = field(default_factory=dict)

    def find(self, filter: Any = None) -> Find:  # noqa: A002
        return Find(self, parse_filter(filter))

    def find_id(self, key: Any) -> Any:
        row = self.find({self.pk: key}).rows().limit(1).collect()
        if not row:
            raise DocNotFound(key)
        return row[0]

    def aggregate(self, pipeline: list[dict], limits: bool = False) -> Aggregate:
        return Aggregate(self, P.parse_pipeline(pipeline), limits)

    def count(self) -> int:
        return self.df.count()

    def start(self, ranked: Any, rest: Any) -> S.Frame:
        """Rows of the ranked source and the filter, in their order."""
        if ranked is None:
            f = S.source(self.df, self.pk, self.name)
            return S.match(f, P.Match(rest))
        if isinstance(ranked, Text):
            if not self.text:
                raise ParseError("the collection has no text index", "$text")
            index = next(iter(self.text.values()))
            df = search(self.df, self.pk, ranked, index)
            f = S.source(df.filter(compile_filter(rest, df.schema)), self.pk, self.name)
            return S.sort(f, (SortKey("_score", True, True),))
        chosen = [v for n, v in self.vectors.items() if v.path == ranked.path and ranked.index in ("", n)]
        if ranked.index and not chosen:
            raise ParseError(f"no vector index {ranked.index} on {ranked.path}", "$knn")
        if len(chosen) > 1:
            raise ParseError("several vector indexes fit: name one by $index", "$knn")
        index = chosen[0] if chosen else VectorIndex(ranked.path)
        with_distance = T.StructType([*self.df.schema, T.StructField("_distance", T.DoubleType())])
        keep = None if isinstance(rest, Everything) else compile_filter(rest, with_distance)
        if index.cells is not None:
            df = probe(index.cells, list(index.centers or ()), ranked, self.pk, index.metric, index.nprobe, keep)
        else:
            df = nearest(self.df, ranked, self.pk, index.metric, keep)
        f = S.source(df, self.pk, self.name)
        return S.sort(f, (SortKey("_distance"),))


@dataclass(frozen=True)
class Find:
    collection: Collection
    filter: Any
    keys: tuple[SortKey, ...] = ()
    n: int = 0
    skip: int = 0
    hints: tuple[str, ...] = ()

    def sort(self, *keys: Any) -> Find:
        return replace(self, keys=tuple(parse_sort(*keys)))

    def limit(self, n: int) -> Find:
        return replace(self, n=n)

    def offset(self, n: int) -> Find:
        return replace(self, skip=n)

    def hint(self, *names: str) -> Find:
        """Accepted and recorded; the planner has no use for it."""
        return replace(self, hints=names)

    def frame(self) -> S.Frame:
        ranked, rest = split_ranked(self.filter)
        f = self.collection.start(ranked, rest)
        if self.keys:
            if isinstance(ranked, Knn):  # ties of the caller's keys break on the primary key, not on the distance
                f = replace(f, order=tuple(o for o in f.order if o.column == "__o0"))
            if any(k.score for k in self.keys) and not isinstance(ranked, Text):
                raise ParseError("textScore needs $text", "$meta", source="sort")
            f = S.sort(f, self.keys)
        if self.skip and self.n:
            return S.apply(f, P.Page(self.skip, self.n))
        if self.skip:
            f = S.apply(f, P.Skip(self.skip))
        return S.apply(f, P.Limit(self.n)) if self.n else f

    def rows(self) -> DataFrame:
        """The documents, in order if a sort or a page asks for one."""
        return self.frame().result()

    def count(self) -> int:
        if unsatisfiable(self.filter):
            return 0
        return self.frame().df.count()

    def ids(self) -> DataFrame:
        return self.frame().df.select(F.col(f"`{self.collection.pk}`"))

    def explain(self) -> str:
        return f"filter: {self.filter}\nsort: {self.keys}\nlimit {self.n} offset {self.skip} hints {self.hints}\n" + plan(self.rows())


@dataclass(frozen=True)
class Aggregate:
    collection: Collection
    stages: list[Any]
    limits: bool = False

    def read_only(self) -> bool:
        return not (self.stages and isinstance(self.stages[-1], P.Out | P.Merge))

    def frame(self) -> S.Frame:
        stages = self.stages if self.read_only() else self.stages[:-1]
        head, rest = P.fold_prefix(stages)
        if head:
            ranked, plain = split_ranked(head[0].filter)
            if ranked is not None:
                f = self.collection.start(ranked, plain)
                return S.run(f, [P.Match(Everything(), head[0].expressions), *rest], self.limits)
        return S.run(S.source(self.collection.df, self.collection.pk, self.collection.name), stages, self.limits)

    def rows(self) -> DataFrame:
        return self.frame().result()

    def count(self) -> int:
        return self.frame().df.count()

    def explain(self) -> str:
        return "".join(f"{i}: {s}\n" for i, s in enumerate(self.stages)) + plan(self.rows())


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def aggregate(df: DataFrame, pipeline: list[dict], pk: str = "id") -> DataFrame:
    """A pipeline over any DataFrame."""
    return Collection(df, pk).aggregate(pipeline).rows()


def find(df: DataFrame, filter: Any, *sort: Any, limit: int = 0, offset: int = 0, pk: str = "id") -> DataFrame:  # noqa: A002
    f = Collection(df, pk).find(filter)
    return (f.sort(*sort) if sort else f).limit(limit).offset(offset).rows()


def is_document(df: DataFrame) -> bool:
    """Whether every column has a document type."""
    return all(kind_of(f.dataType) for f in df.schema)
