"""Typed values and their total order: types first, then values, null and missing lowest. No implicit casts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.plans import values as V
from docquery.plans.errors import UnsupportedTyped


@dataclass(frozen=True)
class Typed:
    """A column with its static type; dtype None is a field that the schema lacks, always missing."""

    col: Column
    dtype: T.DataType | None

    @property
    def kind(self) -> str:
        return kind_of(self.dtype)


def missing() -> Typed:
    return Typed(F.lit(None), None)


#: Numbers that rank the kinds; booleans have one for each value.
RANK = {"num": V.NUMBER, "str": V.STRING, "bool": V.FALSE, "arr": V.ARRAY, "obj": V.OBJECT, "bin": V.BINARY, "vec": V.VECTOR, "oid": V.OBJECT_ID, "date": V.DATE}


def kind_of(t: T.DataType | None) -> str:
    if t is None or isinstance(t, T.NullType):
        return "missing"
    for types, kind in ((T.NumericType, "num"), (T.StringType, "str"), (T.BooleanType, "bool"), (T.ArrayType, "arr"), (T.StructType, "obj"), (T.BinaryType, "bin"), ((T.TimestampNTZType, T.TimestampType, T.DateType), "date")):
        if isinstance(t, types):
            return kind
    raise UnsupportedTyped(f"no document type: {t.simpleString()}")


def as_double(x: Typed) -> Column:
    return x.col if isinstance(x.dtype, T.DoubleType) else x.col.cast("double")


def as_date(x: Typed) -> Column:
    """Milliseconds are the model's resolution."""
    return F.date_trunc("MILLISECOND", x.col.cast("timestamp_ntz")).cast("timestamp_ntz")


def plain(x: Typed) -> Column:
    return {"num": as_double, "date": as_date}.get(x.kind, lambda y: y.col)(x)


def literal(v: Any) -> Typed:
    """A value as a typed column."""
    if v is None:
        return missing()
    if isinstance(v, bool):
        return Typed(F.lit(v), T.BooleanType())
    if isinstance(v, int | float):
        return Typed(F.lit(float(v)), T.DoubleType())
    if isinstance(v, str):
        return Typed(F.lit(v), T.StringType())
    if isinstance(v, datetime):
        return Typed(F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz"), T.TimestampNTZType())
    if isinstance(v, bytes | bytearray):
        return Typed(F.lit(bytes(v)), T.BinaryType())
    if isinstance(v, V.ObjectId):
        return Typed(F.lit(v.hex), T.StringType())
    if isinstance(v, V.Vector):
        return Typed(F.array(*(F.lit(float(i)).cast("float") for i in v.items)), T.ArrayType(T.FloatType()))
    if isinstance(v, dict):
        parts = {k: literal(x) for k, x in v.items()}
        return structure(parts)
    items = [literal(x) for x in v]
    known = [x for x in items if x.dtype is not None]
    if len({x.kind for x in known}) > 1:
        raise UnsupportedTyped("an array of several types needs dynamic mode")
    t = known[0].dtype if known else T.StringType()
    return Typed(F.array(*(x.col.cast(t) for x in items)) if items else F.array().cast(T.ArrayType(t)), T.ArrayType(t))


def structure(parts: dict[str, Typed]) -> Typed:
    """An object; fields that are always missing are left out."""
    parts = {k: x for k, x in parts.items() if x.dtype is not None}
    if not parts:
        return missing()
    return Typed(F.struct(*(x.col.alias(k) for k, x in parts.items())), T.StructType([T.StructField(k, x.dtype) for k, x in parts.items()]))


def comparable(a: Typed, b: Typed) -> tuple[Column, Column] | None:
    """Both columns in one type if native comparison gives the model's order, None if the types differ."""
    if a.kind != b.kind:
        return None
    if a.kind == "arr":
        if kind_of(a.dtype.elementType) != kind_of(b.dtype.elementType) and "missing" not in (kind_of(a.dtype.elementType), kind_of(b.dtype.elementType)):
            raise UnsupportedTyped("arrays of different types are compared in dynamic mode")
        t = T.ArrayType(T.DoubleType()) if kind_of(a.dtype.elementType) == "num" else a.dtype
        return a.col.cast(t), b.col.cast(t)
    if a.kind == "obj":
        names = [f.name for f in a.dtype]
        if names != [f.name for f in b.dtype]:
            raise UnsupportedTyped("objects of different fields are compared in dynamic mode")
        return a.col, b.col.cast(a.dtype)
    if a.kind == "bin":  # shorter before longer
        wrap = lambda c: F.when(c.isNotNull(), F.struct(F.octet_length(c), c))
        return wrap(a.col), wrap(b.col)
    return plain(a), plain(b)


def rank(x: Typed) -> Column:
    """The type tag of a value; null's if it is null or missing."""
    if x.kind == "missing":
        return F.lit(V.NULL)
    if x.kind == "bool":
        return F.when(x.col, V.TRUE).when(~x.col, V.FALSE).otherwise(V.NULL)
    return F.when(x.col.isNotNull(), RANK[x.kind]).otherwise(V.NULL)


def order(a: Typed, op: str, b: Typed) -> Column:
    """a op b over the total order, never null. op: eq, ne, gt, gte, lt, lte."""
    if op == "ne":
        return ~order(a, "eq", b)
    if a.kind == b.kind == "missing":
        return F.lit(op in ("eq", "gte", "lte"))
    if op == "eq":
        if a.kind == "obj" and b.kind == "obj" and [f.name for f in a.dtype] != [f.name for f in b.dtype]:
            return a.col.isNull() & b.col.isNull()
        if "missing" in (a.kind, b.kind):
            return (b if a.kind == "missing" else a).col.isNull()
        pair = comparable(a, b)
        return pair[0].eqNullSafe(pair[1]) if pair else a.col.isNull() & b.col.isNull()
    native = {"gt": lambda x, y: x > y, "gte": lambda x, y: x >= y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y}[op]
    pair = comparable(a, b) if "missing" not in (a.kind, b.kind) else None
    if pair is None:
        return native(rank(a), rank(b))
    null_low = native(F.lit(0), F.lit(1)), native(F.lit(1), F.lit(0)), F.lit(op in ("gte", "lte"))
    return F.when(a.col.isNull() & b.col.isNull(), null_low[2]).when(a.col.isNull(), null_low[0]).when(b.col.isNull(), null_low[1]).otherwise(native(*pair))


def against(x: Typed, op: str, v: Any) -> Column:
    """x op literal in the form that a Parquet scan can use: a native comparison, and a null arm where null qualifies."""
    t = V.tag(v)
    below, met = {"lt": (True, False), "lte": (True, True), "gt": (False, False), "gte": (False, True), "eq": (False, True)}[op]
    if x.kind == "missing":
        return F.lit(met if t == V.NULL else below)
    null = x.col.isNull()
    if t == V.NULL:
        return {"eq": null, "lte": null, "gte": F.lit(True), "lt": F.lit(False), "gt": ~null}[op]
    if x.kind == "bool" and t in (V.TRUE, V.FALSE):
        if op == "eq":
            return x.col.eqNullSafe(F.lit(v))
        return order(x, op, literal(v))
    mine = RANK[x.kind]
    if x.kind == "str" and t == V.OBJECT_ID:
        mine, v = V.OBJECT_ID, v.hex
    if mine != t or x.kind == "bool":
        if x.kind == "bool":
            mine = V.FALSE
        yes = {"eq": False, "lt": mine < t, "lte": mine < t, "gt": mine > t, "gte": mine > t}[op]
        return (F.lit(True) if below else ~null) if yes else (null if below else F.lit(False))
    if x.kind == "obj" and op == "eq" and list(v) != [f.name for f in x.dtype]:
        return _sparse_object(x, v)
    if x.kind == "date":
        return _date_against(x, op, v) if op == "eq" or not below else null | _date_against(x, op, v)
    pair = comparable(Typed(x.col, x.dtype), literal(v))
    if x.kind == "num" and not isinstance(x.dtype, T.DoubleType):
        pair = (x.col, F.lit(int(v) if v == int(v) and abs(v) < 2**53 else float(v))) if v == v and abs(v) != float("inf") else pair
    if op == "eq":
        return pair[0].eqNullSafe(pair[1])
    got = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[op](*pair)
    return null | got if below else F.coalesce(got, F.lit(False)) if x.kind in ("arr", "obj", "bin") else got & ~null


def _sparse_object(x: Typed, v: dict) -> Column:
    """Equality with an object of fewer fields: the others are missing, the order of those there is the same."""
    names = [f.name for f in x.dtype]
    if [n for n in names if n in v] != list(v):
        return F.lit(False)
    parts = [against(Typed(x.col[f.name], f.dataType), "eq", v.get(f.name)) for f in x.dtype]
    out = x.col.isNotNull()
    for p in parts:
        out = out & p
    return out


def _date_against(x: Typed, op: str, v: datetime) -> Column:
    """Whole milliseconds as a range of the raw column, so the scan can still use it."""
    at = V.millis(v)
    low, high = (literal(V.from_millis(t)).col for t in (at, at + 1))
    c = x.col
    got = {"eq": (c >= low) & (c < high), "gt": c >= high, "gte": c >= low, "lt": c < low, "lte": c < high}[op]
    return got & c.isNotNull()
