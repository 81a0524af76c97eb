"""Aggregation pipelines over documents of any shape (extended JSON strings).

Stages that look at one document run in Arrow batches, neighbours in one pass; groups, sorts, joins and pages are Spark's own, over bytes whose order
is the order of values. A frame carries `doc` and `ord`, the bytes of its arrival order: the primary key, then sort keys and
element numbers. Nothing is sorted until a page or the result asks for it, and accumulators are plain aggregates: sums, counts,
least and greatest by bytes, first and last by arrival.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery import evaluate
from docquery.operators.pages import page
from docquery.plans import pipelines as P
from docquery.plans import values as V
from docquery.plans.errors import ParseError
from docquery.plans.filters import split_ranked

SCHEMA = "doc string, ord binary"


@dataclass(frozen=True)
class Documents:
    df: DataFrame
    base: DataFrame
    pk: str = "id"
    ordered: bool = False
    #: Stages that look at one document, f(document, order) to such pairs, still to run on df.
    steps: tuple[Callable[[Any, bytes], Iterable[tuple]], ...] = ()


def loaded(text: str) -> Any:
    return V.decode(json.loads(text))


def dumped(doc: Any) -> str:
    return json.dumps(V.encode(doc))


def written(doc: Any, order: bytes) -> Iterator[tuple]:
    yield dumped(doc), order


def each(df: DataFrame, f: Callable[[Any, bytes], Iterable[tuple]], schema: str = SCHEMA, steps: tuple = ()) -> DataFrame:
    """Rows of f(document, order) for what the steps make of each row (doc, ord)."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def flow(doc: Any, order: bytes, i: int = 0) -> Iterable[tuple]:
        if i == len(steps):
            return f(doc, order)
        return (row for d, o in steps[i](doc, order) for row in flow(d, o, i + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "long": pa.int64()}
        types = [kinds[c.strip().split(" ")[1]] for c in schema.split(",")]
        for batch in batches:
            rows = [row for text, order in zip(batch.column("doc").to_pylist(), batch.column("ord").to_pylist(), strict=True) if text is not None for row in flow(loaded(text), order)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return df.select("doc", "ord").mapInArrow(run, schema)


def inverted(key: bytes) -> bytes:
    return bytes(255 - b for b in key) + b"\xff"


def start(df: DataFrame, pk: str) -> Documents:
    """Dealt out by their text: a small file is few tasks' work for Spark, but documents take Python long."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select("doc", F.lit(b"").alias("ord")).repartition(tasks, "doc")
    first = lambda d, _: [(d, V.key(evaluate.get(d, pk)))]
    return Documents(rows, each(rows, written, steps=(first,)), pk, steps=(first,))


def then(f: Documents, step: Callable[[Any, bytes], Iterable[tuple]]) -> Documents:
    return replace(f, steps=(*f.steps, step))


def settled(f: Documents) -> Documents:
    """All steps run."""
    return replace(f, df=each(f.df, written, steps=f.steps), steps=()) if f.steps else f


def run(f: Documents, stages: list[Any]) -> Documents:
    head, rest = P.fold_prefix(stages)
    for s in [*head, *P.paged(rest)]:
        f = apply(f, s)
    return f


def apply(f: Documents, s: Any) -> Documents:
    if isinstance(s, P.Match):
        if split_ranked(s.filter)[0] is not None:
            raise ParseError("ranked sources need a typed collection")
        kept = lambda d: evaluate.matches(s.filter, d) and all(evaluate.truthy(evaluate.evaluate(e, d)) for e in s.expressions)
        return then(f, lambda d, o: [(d, o)] if kept(d) else [])
    if isinstance(s, P.Project):
        return then(f, lambda d, o: [(fields(s.fields, d, {}), o)])
    if isinstance(s, P.AddFields):
        return then(f, lambda d, o: [(fields(s.fields, d, d), o)])
    if isinstance(s, P.Unwind):
        return then(f, lambda d, o: unwound(d, o, s))
    if isinstance(s, P.Group):
        return group(f, s)
    if isinstance(s, P.Sort):
        order = lambda d, o: b"".join(inverted(k) if x.desc else k for x in s.keys for k in [evaluate.sort_key(d, x)]) + o
        return replace(then(f, lambda d, o: [(d, order(d, o))]), ordered=True)
    f = settled(f)
    if isinstance(s, P.Skip):
        return replace(f, df=page(f.df.orderBy("ord"), s.n))
    if isinstance(s, P.Limit):
        return replace(f, df=page(f.df.orderBy("ord"), n=s.n))
    if isinstance(s, P.Page):
        return replace(f, df=page(f.df.orderBy("ord"), s.skip, s.n))
    if isinstance(s, P.Count):
        n = f.df.agg(F.count(F.lit(1)).alias("n"))
        return replace(f, df=n.select(F.to_json(F.struct(F.col("n").cast("double").alias(s.name))).alias("doc"), F.lit(b"").alias("ord")))
    if isinstance(s, P.Lookup):
        return lookup(f, s)
    if isinstance(s, P.Facet):
        return facet(f, s)
    raise ParseError("sinks need a stored collection")


def fields(wanted: dict[str, Any], doc: Any, into: dict) -> dict:
    new = {k: evaluate.evaluate(e, doc) for k, e in wanted.items()}
    return {k: v for k, v in {**into, **new}.items() if v is not V.MISSING}


def unwound(doc: dict, order: bytes, s: P.Unwind) -> Iterator[tuple]:
    *way, last = s.path.split(".")
    items = evaluate.get(doc, s.path)
    if isinstance(items, list) and items:
        for i, x in enumerate(items):
            yield with_field(doc, [*way, last], x), order + struct.pack(">I", i)
    elif not isinstance(items, list) and items is not None and items is not V.MISSING:
        yield doc, order + struct.pack(">I", 0)  # any other value stands for itself
    elif s.preserve:
        yield without_field(doc, [*way, last]), order + struct.pack(">I", 0)


def with_field(doc: Any, way: list[str], value: Any) -> Any:
    return {**doc, way[0]: value if len(way) == 1 else with_field(doc[way[0]], way[1:], value)}


def without_field(doc: Any, way: list[str]) -> Any:
    if not isinstance(doc, dict) or way[0] not in doc:
        return doc
    if len(way) == 1:
        return {k: v for k, v in doc.items() if k != way[0]}
    return {**doc, way[0]: without_field(doc[way[0]], way[1:])}


def group(f: Documents, s: P.Group) -> Documents:
    """Key bytes name the group; each accumulator has the columns that its aggregate needs.

    Values of sets are rows of their own, numbered by their accumulator: equal ones meet, and the first stays, before a set is made.
    """
    names = list(s.fields)
    sets = [i for i, (op, _) in enumerate(s.fields.values()) if op == "$addToSet"]
    columns = "".join(f", n{i} double, v{i} string, b{i} binary" for i in range(len(names)) if i not in sets)

    def rows(doc: Any, order: bytes) -> Iterator[tuple]:
        key = evaluate.evaluate(s.key, doc)
        name = V.key(key)
        out: list[Any] = [name, dumped(None if key is V.MISSING else key), order, None, None, None]
        for i, (op, e) in enumerate(s.fields.values()):
            v = evaluate.evaluate(e, doc) if op != "$count" else 1
            if i in sets:
                if v is not V.MISSING:
                    yield (name, None, order, i, V.key(v), dumped(v), *[None] * (3 * (len(names) - len(sets))))
                continue
            number = float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None
            known = v is not V.MISSING
            if op in ("$min", "$max"):
                known = known and v is not None
            needs = op not in ("$sum", "$avg", "$count")
            out += [number, dumped(v) if known and needs else None, V.key(v) if known and needs else None]
        yield tuple(out)

    def total(i: int, op: str) -> Column:
        n, v, b = F.col(f"n{i}"), F.col(f"v{i}"), F.col(f"b{i}")
        if op == "$sum":
            return F.coalesce(F.sum(n), F.lit(0.0)).cast("string")
        if op == "$avg":
            return F.coalesce(F.avg(n).cast("string"), F.lit("null"))
        if op == "$count":
            return F.count(F.lit(1)).cast("double").cast("string")
        if op in ("$min", "$max"):
            return F.coalesce((F.min_by if op == "$min" else F.max_by)(v, b), F.lit("null"))
        if op in ("$first", "$last"):
            return (F.min_by if op == "$first" else F.max_by)(F.struct(v), F.col("ord"))[f"v{i}"]
        return listed(v, F.col("ord"))

    def listed(v: Column, order: Column) -> Column:
        items = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(order.alias("ord"), v.alias("v")))))
        return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x.v), ","), F.lit("]"))

    flat = each(f.df, rows, "key binary, id string, ord binary, at long, same binary, item string" + columns, f.steps)
    totals = [total(i, op).alias(f"x{i}") for i, (op, _) in enumerate(s.fields.values()) if i not in sets]
    if sets:
        once = flat.groupBy("key", "at", "same").agg(F.first("id").alias("id"), F.min("ord").alias("ord"), F.min_by("item", "ord").alias("item"), *totals)
        of = lambda i: listed(F.when(F.col("at") == i, F.col("item")), F.col("ord"))
        values = [of(i) if i in sets else F.max(F.when(F.col("at").isNull(), F.col(f"x{i}"))) for i in range(len(names))]
        out = once.groupBy("key").agg(F.first("id", ignorenulls=True).alias("id"), *(v.alias(f"x{i}") for i, v in enumerate(values)))
    else:
        out = flat.groupBy("key").agg(F.first("id").alias("id"), *totals)
    # Values are JSON already; a missing one leaves its field out.
    part = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(json.dumps(name) + ": "), x))
    doc = F.concat(F.lit("{"), F.concat_ws(", ", part("id", F.col("id")), *(part(n, F.col(f"x{i}")) for i, n in enumerate(names))), F.lit("}"))
    return replace(f, df=out.select(doc.alias("doc"), F.col("key").alias("ord")), ordered=False, steps=())


def lookup(f: Documents, s: P.Lookup) -> Documents:
    """Documents of the collection by the keys of a field, in the field's order, each once."""

    def keys(doc: Any, order: bytes) -> Iterator[tuple]:
        v = evaluate.get(doc, s.local)
        seen: set[bytes] = set()
        for i, x in enumerate(v if isinstance(v, list) else [v]):
            if x is not V.MISSING and x is not None and (k := V.key(x)) not in seen:
                seen.add(k)
                yield order, i, k

    local = each(f.df, keys, "at binary, pos long, key binary")
    right = f.base.select(F.col("ord").alias("pk"), F.col("doc").alias("found"))
    # Rows are known by their order, which holds the primary key or the group's key, and is theirs alone.
    found = local.join(right, F.col("key") == F.col("pk")).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("pos", "found"))).alias("x"))
    found = found.select("at", F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x.found), ","), F.lit("]")).alias("items"))
    df = f.df.join(found, F.col("ord") == F.col("at"), "left").select(F.to_json(F.struct("doc", F.coalesce("items", F.lit("[]")).alias("items"))).alias("doc"), "ord")
    return replace(f, df=each(df, lambda d, o: iter([(dumped({**loaded(d["doc"]), s.name: loaded(d["items"])}), o)])))


def facet(f: Documents, s: P.Facet) -> Documents:
    """One document of arrays; each branch is one aggregate of one row."""
    out = None
    for i, stages in enumerate(s.branches.values()):
        b = settled(run(f, stages))
        items = F.transform(F.array_sort(F.collect_list(F.struct("ord", "doc"))), lambda x: x.doc)
        one = b.df.agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias(f"x{i}"))
        out = one if out is None else out.crossJoin(one)  # one row each
    parts = [F.concat(F.lit(json.dumps(n) + ": "), F.col(f"x{i}")) for i, n in enumerate(s.branches)]
    return replace(f, df=out.select(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("doc"), F.lit(b"").alias("ord")))


def aggregate(df: DataFrame, pipeline: list[dict], pk: str = "id") -> DataFrame:
    """Column `doc` of a pipeline's documents, in order if it has a $sort that nothing has undone."""
    f = settled(run(start(df, pk), P.parse_pipeline(pipeline)))
    return (f.df.orderBy("ord") if f.ordered else f.df).select("doc")
