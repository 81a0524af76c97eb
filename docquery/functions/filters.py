"""Filter trees to boolean columns that are never null."""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.functions.compare import Typed, against, kind_of, literal, order
from docquery.functions.paths import find_path, step
from docquery.plans import filters as P
from docquery.plans import values as V
from docquery.plans.errors import UnsupportedTyped
from docquery.plans.patterns import for_java


def compile_filter(f: Any, schema: T.StructType) -> Column:
    return _compile(f, lambda path: find_path(schema, path), schema)


def element_filter(f: Any, element: Typed) -> Column:
    """A condition on one array element: its own fields, or itself under the path `value`."""

    def resolve(path: str) -> Typed:
        if isinstance(element.dtype, T.StructType):
            first, *rest = path.split(".")
            x = Typed(element.col.getField(first), element.dtype[first].dataType) if first in element.dtype.names else literal(None)
            for part in rest:
                x = step(x, part)
            return x
        return element if path == "value" else literal(None)

    return _compile(f, resolve, T.StructType())


def _compile(f: Any, at: Any, schema: T.StructType) -> Column:
    if isinstance(f, P.Everything):
        return F.lit(True)
    if isinstance(f, P.And):
        return reduce(operator.and_, (_compile(p, at, schema) for p in f.parts))
    if isinstance(f, P.Or):
        return reduce(operator.or_, (_compile(p, at, schema) for p in f.parts))
    if isinstance(f, P.Nor):
        return ~reduce(operator.or_, (_compile(p, at, schema) for p in f.parts))
    if isinstance(f, P.Not):
        return ~_compile(f.part, at, schema)
    if isinstance(f, P.Custom):
        return F.coalesce(f.make(schema), F.lit(False))
    if isinstance(f, P.Cmp):
        return compare(at(f.path), f.op, f.value)
    if isinstance(f, P.In):
        return member(at(f.path), f.values)
    x = at(f.path)
    if isinstance(f, P.Exists):
        return x.col.isNotNull() if f.yes else x.col.isNull()
    if isinstance(f, P.Type):
        return has_type(x, f.tag)
    if isinstance(f, P.Regex):
        return regex(x, f)
    if isinstance(f, P.Size):
        return F.coalesce(F.size(x.col) == F.lit(f.n), F.lit(False)) & x.col.isNotNull() if x.kind == "arr" else F.lit(False)
    raise TypeError(f"not a filter: {f!r}")


def compare(x: Typed, op: str, v: Any) -> Column:
    if x.kind != "arr" or isinstance(v, V.Vector):
        if x.kind == "arr" and op == "eq":
            return F.coalesce(x.col == literal(v).col, F.lit(False))
        return against(x, op, v)
    element = x.dtype.elementType
    some = F.coalesce(F.exists(x.col, lambda e: against(Typed(e, element), op, v)), F.lit(False))
    null = against(Typed(F.lit(None).cast("double"), T.DoubleType()), op, v)  # a missing field is null
    whole = F.lit(False)
    if isinstance(v, list | tuple) and not v:
        whole = {"eq": F.size(x.col) == 0, "gt": F.size(x.col) > 0, "gte": F.lit(True), "lt": F.lit(False), "lte": F.size(x.col) == 0}[op]
    elif isinstance(v, list | tuple) and kind_of(element) == kind_of(literal(list(v)).dtype.elementType):
        whole = order(x, op, literal(list(v)))
    elif isinstance(v, list | tuple):
        raise UnsupportedTyped("arrays of different types are compared in dynamic mode")
    return F.when(x.col.isNull(), null).otherwise(some | F.coalesce(whole, F.lit(False)))


def member(x: Typed, values: tuple) -> Column:
    """$in: one IN list for values of the column's own type, and a null test if null is listed."""
    if not values:
        return F.lit(False)
    simple = {"num": V.NUMBER, "str": V.STRING}.get(x.kind)
    if simple:
        own = [v for v in values if V.tag(v) == simple]
        out = F.coalesce(x.col.isin(*own), F.lit(False)) if own else F.lit(False)
        if any(V.tag(v) == V.OBJECT_ID for v in values) and x.kind == "str":
            out = out | F.coalesce(x.col.isin(*(v.hex for v in values if V.tag(v) == V.OBJECT_ID)), F.lit(False))
        return out | x.col.isNull() if any(v is None for v in values) else out
    return reduce(operator.or_, (compare(x, "eq", v) for v in values))


def has_type(x: Typed, tag: int) -> Column:
    if tag == V.NULL:
        return F.lit(False)  # null and missing are one here, and missing has no type
    if x.kind == "bool":
        return F.coalesce(x.col if tag == V.TRUE else ~x.col, F.lit(False)) if tag in (V.TRUE, V.FALSE) else F.lit(False)
    own = {"num": V.NUMBER, "str": V.STRING, "arr": V.ARRAY, "obj": V.OBJECT, "date": V.DATE}.get(x.kind)
    return x.col.isNotNull() if own == tag else F.lit(False)


def regex(x: Typed, f: P.Regex) -> Column:
    pattern = for_java(f.pattern, f.flags)
    if x.kind == "str":
        out = F.coalesce(x.col.rlike(pattern), F.lit(False))
        prefix = P.literal_prefix(f.pattern, f.flags)
        return F.coalesce(x.col.startswith(prefix), F.lit(False)) & out if prefix else out
    if x.kind == "arr" and kind_of(x.dtype.elementType) == "str":
        # Elements up to the first that is no string.
        head = F.when(F.array_position(F.transform(x.col, lambda e: e.isNull()), F.lit(True)) > 0, F.slice(x.col, F.lit(1), (F.array_position(F.transform(x.col, lambda e: e.isNull()), F.lit(True)) - 1).cast("int"))).otherwise(x.col)
        return F.coalesce(F.exists(head, lambda e: F.coalesce(e.rlike(pattern), F.lit(False))), F.lit(False))
    return F.lit(False)
