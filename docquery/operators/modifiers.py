"""Update modifiers as columns: the new document, and whether it differs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.functions.compare import Typed, literal
from docquery.functions.filters import element_filter
from docquery.functions.paths import find_path, root
from docquery.plans import values as V
from docquery.plans.errors import ParseError, UnsupportedTyped
from docquery.plans.filters import Change


def assign(df: DataFrame, path: str, value: Column, dtype: T.DataType) -> DataFrame:
    """df with a path set, intermediate objects created."""
    first, *rest = path.split(".")
    x = root(df.schema, first)
    return df.withColumn(first, _put(x, rest, value, dtype, path))


def _put(x: Typed, rest: list[str], value: Column, dtype: T.DataType, path: str) -> Column:
    if not rest:
        return value
    if x.dtype is None:
        return F.struct(_put(Typed(F.lit(None), None), rest[1:], value, dtype, path).alias(rest[0]))
    if not isinstance(x.dtype, T.StructType):
        raise ParseError(f"{path}: not an object on the way", "$set", path)
    fields = []
    for n in x.dtype.names:
        child = Typed(x.col.getField(n), x.dtype[n].dataType)
        fields.append((_put(child, rest[1:], value, dtype, path) if n == rest[0] else child.col).alias(n))
    if rest[0] not in x.dtype.names:
        fields.append(_put(Typed(F.lit(None), None), rest[1:], value, dtype, path).alias(rest[0]))
    return F.struct(*fields)


def _fitted(v: Any, x: Typed) -> tuple[Column, T.DataType]:
    """A value in the type that the field has."""
    lit = literal(v)
    if x.dtype is None:
        return lit.col, lit.dtype or T.StringType()
    if lit.dtype is not None and lit.kind != x.kind:
        raise UnsupportedTyped(f"a {lit.kind} in a field of {x.kind} needs dynamic mode")
    return lit.col.cast(x.dtype), x.dtype


def modify(df: DataFrame, changes: list[Change]) -> DataFrame:
    """df with all changes made in order and a column __modified."""
    hit = F.lit(False)
    names = [c for c in df.columns]
    for c in changes:
        x = find_path(df.schema, c.path)
        if c.op == "$set":
            value, t = _fitted(c.value, x)
            df = mark(df, ~value.eqNullSafe(x.col) if x.dtype is not None else value.isNotNull())
            df = assign(df, c.path, value, t)
        elif c.op == "$unset":
            if x.dtype is not None:
                df = mark(df, x.col.isNotNull())
                df = assign(df, c.path, F.lit(None).cast(x.dtype), x.dtype)
        elif c.op == "$inc":
            if x.dtype is not None and x.kind != "num":
                raise ParseError("$inc needs a number", "$inc", c.path)
            t = x.dtype or T.DoubleType()
            if isinstance(t, T.IntegralType) and c.value != int(c.value):
                t = T.DoubleType()
            df = mark(df, F.lit(True))  # even by zero
            df = assign(df, c.path, F.coalesce(x.col.cast(t), F.lit(0).cast(t)) + F.lit(c.value).cast(t), t)
        elif c.op == "$rename":
            if x.dtype is None:
                continue
            y = find_path(df.schema, c.value)
            if y.dtype is not None and y.dtype != x.dtype:
                raise UnsupportedTyped("$rename onto a field of another type needs dynamic mode")
            df = mark(df, x.col.isNotNull())
            df = df.withColumn("__from", x.col)
            moved = F.col("__from") if y.dtype is None else F.coalesce("__from", y.col)
            df = assign(df, c.value, moved, x.dtype)
            df = assign(df, c.path, F.lit(None).cast(x.dtype), x.dtype).drop("__from")
        else:
            df = _array(df, c, x)
    if "__modified" not in df.columns:
        df = df.withColumn("__modified", hit)
    return df.select(*names, *(n for n in df.columns if n not in names))


def mark(df: DataFrame, changed: Column) -> DataFrame:
    before = F.col("__modified") if "__modified" in df.columns else F.lit(False)
    return df.withColumn("__modified", before | F.coalesce(changed, F.lit(False)))


def _array(df: DataFrame, c: Change, x: Typed) -> DataFrame:
    if x.dtype is None:
        if c.op == "$addToSet":
            value = literal([c.value])
            return assign(mark(df, F.lit(True)), c.path, value.col, value.dtype)
        return df
    if not isinstance(x.dtype, T.ArrayType):
        raise ParseError(f"{c.op} needs an array", c.op, c.path)
    element = x.dtype.elementType
    if c.op == "$pop":
        new = F.when(F.size(x.col) > 0, F.slice(x.col, 1, F.size(x.col) - 1) if c.value == 1 else F.slice(x.col, 2, F.size(x.col))).otherwise(x.col)
        changed = F.size(x.col) > 0
    elif c.op == "$push":
        value, _ = _fitted(c.value, Typed(F.lit(None), element))
        new, changed = F.when(x.col.isNotNull(), F.array_append(x.col, value)), x.col.isNotNull()
    elif c.op == "$addToSet":
        value, _ = _fitted(c.value, Typed(F.lit(None), element))
        there = F.exists(x.col, lambda e: e.eqNullSafe(value))
        new = F.when(x.col.isNull(), F.array(value)).when(there, x.col).otherwise(F.array_append(x.col, value))
        changed = ~F.coalesce(there, F.lit(False))
    else:
        if c.op == "$pullAll" or c.condition is None:
            gone = c.value if c.op == "$pullAll" else [c.value]
            same = [literal(v) for v in gone if V.tag(v) == V.NULL or literal(v).kind == Typed(F.lit(None), element).kind]
            drop = lambda e: _any([e.eqNullSafe(v.col.cast(element)) for v in same])
        else:
            drop = lambda e: element_filter(c.condition, Typed(e, element))
        new = F.filter(x.col, lambda e: ~drop(e))
        changed = F.size(new) != F.size(x.col)
    return assign(mark(df, changed), c.path, new, x.dtype)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
