"""The two ways to resolve a dotted path: of finds and sorts, and of expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.functions.compare import Typed, missing


def root(schema: T.StructType, name: str) -> Typed:
    for f in schema:
        if f.name == name:
            return Typed(F.col(f"`{name}`"), f.dataType)
    return missing()


def find_path(schema: T.StructType, path: str) -> Typed:
    """Fields of objects and decimal indexes of arrays; anything else is missing."""
    first, *rest = path.split(".")
    x = root(schema, first)
    for part in rest:
        x = step(x, part)
    return x


def step(x: Typed, part: str) -> Typed:
    if isinstance(x.dtype, T.StructType) and part in x.dtype.names:
        return Typed(x.col.getField(part), x.dtype[part].dataType)
    if isinstance(x.dtype, T.ArrayType) and part.isdecimal():
        return Typed(F.get(x.col, F.lit(int(part))), x.dtype.elementType)
    return missing()


def expression_path(schema: T.StructType, path: str) -> Typed:
    """Like find_path, but a name on an array of objects maps the rest of the path over them, without those that lack it."""
    first, *rest = path.split(".")
    return _walk(root(schema, first), rest)


def _walk(x: Typed, rest: list[str]) -> Typed:
    for i, part in enumerate(rest):
        if isinstance(x.dtype, T.ArrayType) and not part.isdecimal():
            if not isinstance(x.dtype.elementType, T.StructType):
                return Typed(F.when(x.col.isNotNull(), F.array().cast("array<string>")), T.ArrayType(T.StringType()))
            inner = _walk(Typed(F.lit(None), x.dtype.elementType), rest[i:])
            if inner.dtype is None:
                return Typed(F.when(x.col.isNotNull(), F.array().cast("array<string>")), T.ArrayType(T.StringType()))
            element, tail = x.dtype.elementType, rest[i:]
            return Typed(F.filter(F.transform(x.col, lambda e: _walk(Typed(e, element), tail).col), lambda v: v.isNotNull()), T.ArrayType(inner.dtype))
        x = step(x, part)
    return x
