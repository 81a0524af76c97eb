"""Pipeline stages as DataFrame plans.

A Frame carries its rows and, hidden in columns __o0, __o1, ..., what orders their arrival: the primary key, then sort keys and
element numbers. Nothing is numbered over the whole input unless a stage needs arrival order that is gone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.functions.compare import Typed, as_double, kind_of, plain
from docquery.functions.expressions import cast, compile_expression, truthy
from docquery.functions.filters import compile_filter
from docquery.functions.paths import find_path
from docquery.operators.pages import page
from docquery.plans import pipelines as P
from docquery.plans.errors import ParseError, UnsupportedTyped
from docquery.plans.filters import SortKey, unsatisfiable

MAX_GROUPS, MAX_ITEMS = 50_000, 10_000


@dataclass(frozen=True)
class Order:
    column: str
    desc: bool = False


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    order: tuple[Order, ...] = ()
    pk: str = "id"
    #: The collection itself, for $lookup.
    base: DataFrame | None = None
    name: str = ""
    #: Whether the result has to be put in order; until then an order is only known, not made.
    pending: bool = False

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.df.schema if not f.name.startswith("__o")])

    @property
    def visible(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__o")]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith("__o")]

    def sorting(self) -> list[Column]:
        return [F.desc_nulls_last(o.column) if o.desc else F.asc_nulls_first(o.column) for o in self.order]

    def fresh(self) -> str:
        return f"__o{len(self.hidden)}"

    def result(self) -> DataFrame:
        df = ordered(self) if self.pending else self.df
        return df.select(*(F.col(f"`{c}`") for c in self.visible))


def source(df: DataFrame, pk: str = "id", name: str = "") -> Frame:
    """A collection in the order of its primary key."""
    if pk not in df.columns:
        return Frame(df, (), pk, df, name)
    return Frame(df.withColumn("__o0", F.col(f"`{pk}`")), (Order("__o0"),), pk, df, name)


def run(frame: Frame, stages: list[Any], limits: bool = False) -> Frame:
    head, rest = P.fold_prefix(stages)
    for s in [*head, *P.paged(rest)]:
        frame = apply(frame, s, limits)
    return frame


def apply(f: Frame, s: Any, limits: bool = False) -> Frame:
    if isinstance(s, P.Match):
        return match(f, s)
    if isinstance(s, P.Project):
        return project(f, s)
    if isinstance(s, P.AddFields):
        return add_fields(f, s)
    if isinstance(s, P.Unwind):
        return unwind(f, s)
    if isinstance(s, P.Group):
        return group(f, s, limits)
    if isinstance(s, P.Sort):
        return sort(f, s.keys)
    if isinstance(s, P.Skip):
        return replace(f, df=page(ordered(f), s.n), pending=False)
    if isinstance(s, P.Limit):
        return replace(f, df=page(ordered(f), n=s.n), pending=False)
    if isinstance(s, P.Page):
        return replace(f, df=page(ordered(f), s.skip, s.n), pending=False)
    if isinstance(s, P.Count):
        return Frame(f.df.agg(F.count(F.lit(1)).cast("double").alias(s.name)), (), f.pk, f.base, f.name)
    if isinstance(s, P.Lookup):
        return lookup(f, s)
    if isinstance(s, P.Facet):
        return facet(f, s, limits)
    raise TypeError(f"a sink is run by its collection: {s!r}")


def ordered(f: Frame) -> DataFrame:
    return f.df.orderBy(*f.sorting()) if f.order else f.df


def match(f: Frame, s: P.Match) -> Frame:
    if unsatisfiable(s.filter):
        return replace(f, df=f.df.limit(0))
    df = f.df.filter(compile_filter(s.filter, f.schema))
    for e in s.expressions:
        df = df.filter(truthy(compile_expression(e, f.schema)))
    return replace(f, df=df)


def _named(x: Typed, name: str) -> Column | None:
    """A field that is always missing has no column."""
    return None if x.dtype is None else x.col.alias(name)


def project(f: Frame, s: P.Project) -> Frame:
    out = [c for k, e in s.fields.items() if (c := _named(compile_expression(e, f.schema), k)) is not None]
    return replace(f, df=f.df.select(*out, *f.hidden))


def add_fields(f: Frame, s: P.AddFields) -> Frame:
    new = {k: compile_expression(e, f.schema) for k, e in s.fields.items()}
    kept = [F.col(f"`{c}`") if c not in new else new[c].col.alias(c) for c in f.visible if c not in new or new[c].dtype is not None]
    more = [x.col.alias(k) for k, x in new.items() if k not in f.visible and x.dtype is not None]
    return replace(f, df=f.df.select(*kept, *more, *f.hidden))


def rebuilt(parent: Typed, path: list[str], value: Column) -> Column:
    """The object with one nested field replaced."""
    if not path:
        return value
    child = Typed(parent.col.getField(path[0]), parent.dtype[path[0]].dataType)
    return F.when(parent.col.isNotNull(), F.struct(*((rebuilt(child, path[1:], value) if n == path[0] else parent.col.getField(n)).alias(n) for n in parent.dtype.names)))


def unwind(f: Frame, s: P.Unwind) -> Frame:
    x = find_path(f.schema, s.path)
    if x.kind != "arr":
        return f if s.preserve else replace(f, df=f.df.filter(x.col.isNotNull()))
    at, first = f.fresh(), s.path.split(".")
    explode = F.posexplode_outer if s.preserve else F.posexplode
    df = f.df.select("*", explode(x.col).alias(at, "__item"))
    value = F.col("__item")
    if s.preserve:  # null and empty arrays keep their row, without the field
        value = F.when(F.col(at).isNotNull(), value)
    new = value if len(first) == 1 else rebuilt(Typed(F.col(f"`{first[0]}`"), f.schema[first[0]].dataType), first[1:], value)
    df = df.withColumn(first[0], new).drop("__item")
    return replace(f, df=df, order=(*f.order, Order(at)) if f.order else ())


def sort_key(x: Typed, desc: bool) -> list[Column]:
    """Columns whose native order is the model's: arrays sort by their least or greatest element."""
    if x.kind == "missing":
        return []
    if x.kind != "arr":
        return [plain(x)] if x.kind != "bin" else [F.octet_length(x.col), x.col]
    least = F.when(F.exists(x.col, lambda e: e.isNull()), None).otherwise(F.array_min(x.col)) if not desc else F.array_max(x.col)
    return [F.coalesce(F.size(x.col) == 0, F.lit(False)) & x.col.isNotNull(), least]


def sort(f: Frame, keys: tuple[SortKey, ...]) -> Frame:
    """Stable: ties stay in arrival order. Only the order's columns are made: what follows may have no use for sorted rows."""
    df, new, n = f.df, [], len(f.hidden)
    for k in keys:
        x = Typed(F.col("_score"), T.DoubleType()) if k.score else find_path(f.schema, k.path)
        for c in sort_key(x, k.desc):
            df, new, n = df.withColumn(f"__o{n}", c), [*new, Order(f"__o{n}", k.desc)], n + 1
    return replace(f, df=df, order=(*new, *f.order), pending=True)


def arrival(f: Frame) -> Column:
    """One orderable value for the arrival order; descending keys are negated numbers or inverted through a rank."""
    parts = []
    for o in f.order:
        t = f.df.schema[o.column].dataType
        if not o.desc:
            parts.append(F.struct(F.col(o.column).isNotNull(), F.col(o.column)))
        elif isinstance(t, T.NumericType):
            parts.append(F.struct(F.col(o.column).isNull(), -F.col(o.column).cast("double")))
        elif isinstance(t, T.BooleanType):
            parts.append(F.struct(F.col(o.column).isNull(), ~F.col(o.column)))
        elif isinstance(t, T.TimestampNTZType | T.TimestampType | T.DateType):
            parts.append(F.struct(F.col(o.column).isNull(), -F.unix_micros(F.col(o.column).cast("timestamp"))))
        elif isinstance(t, T.StringType):
            parts.append(F.struct(F.col(o.column).isNull(), F.translate(F.concat(F.hex(F.col(o.column)), F.lit("/")), "0123456789ABCDEF/", "fedcba9876543210~")))
        else:
            raise UnsupportedTyped(f"arrival order by descending {t.simpleString()}")
    return F.struct(*parts) if parts else F.struct(F.lit(0))


def accumulate(op: str, x: Typed, at: Column) -> Column | None:
    number = x.kind == "num"
    if op == "$sum":
        return F.coalesce(F.sum(as_double(x)), F.lit(0.0)) if number else F.lit(0.0)
    if op == "$avg":
        return F.avg(as_double(x)) if number else F.lit(None).cast("double")
    if op == "$count":
        return F.count(F.lit(1)).cast("double")
    if x.dtype is None:
        return F.lit(None) if op in ("$min", "$max") else F.array().cast("array<string>") if op in ("$push", "$addToSet") else None
    v = plain(x)
    if op in ("$min", "$max"):
        return (F.min if op == "$min" else F.max)(v)
    if op in ("$first", "$last"):
        return (F.min_by if op == "$first" else F.max_by)(v, at)
    pairs = F.array_sort(F.collect_list(F.when(x.col.isNotNull(), F.struct(at.alias("o"), v.alias("v")))))
    items = F.transform(pairs, lambda p: p.v)
    return items if op == "$push" else F.array_distinct(items)


def group(f: Frame, s: P.Group, limits: bool = False) -> Frame:
    key = compile_expression(s.key, f.schema)
    at = arrival(f) if any(op in ("$first", "$last", "$push", "$addToSet") for op, _ in s.fields.values()) else F.lit(0)
    out = {k: accumulate(op, compile_expression(e, f.schema), at) for k, (op, e) in s.fields.items()}
    aggs = [c.alias(k) for k, c in out.items() if c is not None]
    k = (plain(key) if key.dtype is not None else F.lit(None).cast("string")).alias("id")
    df = f.df.groupBy(k).agg(*aggs) if aggs else f.df.select(k).distinct()
    if limits:  # as an option only: Spark spills where an embedded engine must stop
        for name, (op, _) in s.fields.items():
            if op in ("$push", "$addToSet"):
                df = df.withColumn(name, F.when(F.size(name) > MAX_ITEMS, F.raise_error(F.lit(f"{op} {name}: more than {MAX_ITEMS} items"))).otherwise(F.col(name)))
        if df.limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
            raise ParseError(f"more than {MAX_GROUPS} groups", "$group")
    return Frame(df, (), f.pk, f.base, f.name)


def lookup(f: Frame, s: P.Lookup) -> Frame:
    """The documents of the same collection that a field's keys name, as an array in the field's order."""
    if s.source and f.name and s.source != f.name:
        raise ParseError("only self-joins are supported", "$lookup", "from")
    if f.base is None or f.pk not in f.base.columns:
        raise ParseError("the collection has no primary key", "$lookup")
    x, pk = find_path(f.schema, s.local), f.base.schema[f.pk].dataType
    names = f.base.columns
    right = f.base.select(F.col(f"`{f.pk}`").alias("__key"), F.struct(*(F.col(f"`{n}`") for n in names)).alias("__doc"))
    doc = right.schema["__doc"].dataType
    keep = [c for c in f.df.columns if c != s.name]
    element = x.dtype.elementType if x.kind == "arr" else x.dtype
    if element is None or kind_of(element) != kind_of(pk):
        return replace(f, df=f.df.select(*keep, F.array().cast(T.ArrayType(doc)).alias(s.name)))
    if x.kind != "arr":
        df = f.df.withColumn("__local", x.col).join(right, F.col("__local") == F.col("__key"), "left")
        return replace(f, df=df.select(*keep, F.when(F.col("__doc").isNotNull(), F.array("__doc")).otherwise(F.array().cast(T.ArrayType(doc))).alias(s.name)))
    # Equal arrays find the same documents, so distinct arrays are looked up and rows take what their array has found.
    rows = f.df.withColumn("__row", F.array_distinct(F.filter(x.col, lambda e: e.isNotNull())))
    keys = rows.select("__row").distinct().select("__row", F.posexplode("__row").alias("__pos", "__local"))
    found = keys.join(right, F.col("__local") == F.col("__key")).groupBy(F.col("__row").alias("__at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__doc"))), lambda p: p["__doc"]).alias("__found"))
    df = rows.join(found, F.col("__row") == F.col("__at"), "left")
    return replace(f, df=df.select(*keep, F.coalesce("__found", F.array().cast(T.ArrayType(doc))).alias(s.name)))


def facet(f: Frame, s: P.Facet, limits: bool = False) -> Frame:
    """One row of arrays; each branch is one aggregate of one row over its own reading of the input, so nothing is kept in
    memory or on disk that somebody would have to release. Spark reuses the exchanges that branches share."""
    out = None
    for name, stages in s.branches.items():
        b = run(f, stages, limits)
        doc = F.struct(*(F.col(f"`{c}`") for c in b.visible))
        items = F.transform(F.array_sort(F.collect_list(F.struct(arrival(b).alias("o"), doc.alias("d")))), lambda p: p.d) if b.order else F.collect_list(doc)
        one = b.df.agg(items.alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return Frame(out, (), f.pk, f.base, f.name)
