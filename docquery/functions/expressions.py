"""Expressions to typed columns. What goes wrong at run time is null, never an error."""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.functions.compare import Typed, as_date, as_double, kind_of, literal, missing, order, plain, structure
from docquery.functions.dates import DATE, compile_date, from_ms, null_number, to_ms
from docquery.functions.paths import expression_path
from docquery.plans import expressions as E
from docquery.plans.errors import UnsupportedTyped

DOUBLE, STRING = T.DoubleType(), T.StringType()
SPACE = r"\x{0}\x{9}-\x{d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}"


def null_string() -> Typed:
    return Typed(F.lit(None).cast("string"), STRING)


def compile_expression(e: Any, schema: T.StructType) -> Typed:
    if isinstance(e, E.Field):
        x = expression_path(schema, e.path)
        return Typed(as_date(x), DATE) if x.kind == "date" else x
    if isinstance(e, E.Literal):
        return literal(e.value)
    if isinstance(e, E.Object):
        return structure({k: compile_expression(x, schema) for k, x in e.fields.items()})
    if isinstance(e, E.Array):
        items = [compile_expression(x, schema) for x in e.items]
        t = common([x for x in items if x.dtype is not None]) if any(x.dtype is not None for x in items) else STRING
        return Typed(F.array(*(cast(x, t) for x in items)) if items else F.array().cast(T.ArrayType(t)), T.ArrayType(t))
    return _operator(e, [compile_expression(a, schema) for a in e.args] if e.name != "$switch" else [], schema)


def truthy(x: Typed) -> Column:
    """False, zero, null and missing are not."""
    if x.kind == "missing":
        return F.lit(False)
    if x.kind == "bool":
        return F.coalesce(x.col, F.lit(False))
    return F.coalesce(x.col != 0, F.lit(False)) if x.kind == "num" else x.col.isNotNull()


def finite(c: Column) -> Typed:
    return Typed(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c), DOUBLE)


def common(items: list[Typed]) -> T.DataType:
    """The one type of branches; several kinds need dynamic mode."""
    kinds = {x.kind for x in items}
    if len(kinds) > 1:
        raise UnsupportedTyped(f"branches of types {', '.join(sorted(kinds))} need dynamic mode")
    return DOUBLE if kinds == {"num"} else DATE if kinds == {"date"} else items[0].dtype


def cast(x: Typed, t: T.DataType) -> Column:
    return F.lit(None).cast(t) if x.dtype is None else plain(x) if kind_of(t) in ("num", "date") else x.col.cast(t)


def branches(pairs: list[tuple[Column | None, Typed]]) -> Typed:
    """CASE WHEN of (condition, value), the last condition None for ELSE."""
    known = [x for _, x in pairs if x.dtype is not None]
    if not known:
        return missing()
    t = common(known)
    out: Any = F
    for c, x in pairs:
        out = out.when(c, cast(x, t)) if c is not None else out.otherwise(cast(x, t)) if out is not F else cast(x, t)
    return Typed(out, t)


def _operator(e: E.Op, a: list[Typed], schema: T.StructType) -> Typed:
    name = e.name
    arg = lambda k: compile_expression(e.named[k], schema)
    if name in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"):
        return Typed(order(a[0], name[1:], a[1]), T.BooleanType())
    if name == "$cmp":
        return Typed(F.when(order(a[0], "lt", a[1]), -1.0).when(order(a[0], "gt", a[1]), 1.0).otherwise(0.0), DOUBLE)
    if name == "$cond":
        return branches([(truthy(a[0]), a[1]), (None, a[2])])
    if name == "$switch":
        pairs = [(truthy(compile_expression(c, schema)), compile_expression(v, schema)) for c, v in e.args]
        return branches([*pairs, (None, arg("default") if "default" in e.named else missing())])
    if name == "$ifNull":
        known = [x for x in a if x.dtype is not None]
        return Typed(F.coalesce(*(cast(x, common(known)) for x in known)), common(known)) if known else missing()
    if name in ("$add", "$subtract", "$multiply", "$divide", "$abs", "$round"):
        return _arithmetic(name, a)
    if name in ("$concat", "$split"):
        return _strings(name, a)
    if name in ("$replaceOne", "$replaceAll"):
        return _replace(name, arg("input"), arg("find"), arg("replacement"))
    if name in ("$trim", "$ltrim", "$rtrim"):
        return _trim(name, arg("input"), arg("chars") if "chars" in e.named else None)
    return compile_date(name, e.named, arg)


def _arithmetic(name: str, a: list[Typed]) -> Typed:
    dates = [x for x in a if x.kind == "date"]
    if any(x.kind not in ("num", "date") for x in a):
        return null_number()
    if name == "$add" and dates:
        if len(dates) > 1:
            return null_number()
        total = reduce(operator.add, (as_double(x) for x in a if x.kind == "num"), F.lit(0.0))
        return Typed(from_ms(to_ms(as_date(dates[0])) + F.when(F.abs(total) < 1e15, total).cast("long")), DATE)
    if name == "$subtract" and dates:
        if len(dates) == 2:
            return Typed((to_ms(as_date(a[0])) - to_ms(as_date(a[1]))).cast("double"), DOUBLE)
        if a[0].kind == "date":
            n = as_double(a[1])
            return Typed(from_ms(to_ms(as_date(a[0])) - F.when(F.abs(n) < 1e15, n).cast("long")), DATE)
        return null_number()
    if dates:
        return null_number()
    n = [as_double(x) for x in a]
    if name in ("$add", "$multiply"):
        return finite(reduce(operator.add if name == "$add" else operator.mul, n, F.lit(0.0 if name == "$add" else 1.0)))
    if name == "$subtract":
        return finite(n[0] - n[1])
    if name == "$divide":
        return finite(F.try_divide(n[0], n[1]))
    if name == "$abs":
        return Typed(F.abs(n[0]), DOUBLE)
    # Half to even on the double itself; a bad place is null, and large values have no fraction to round.
    x, place = n[0], n[1] if len(n) > 1 else F.lit(0.0)
    scale = F.pow(F.lit(10.0), place)
    big = F.abs(x * scale) >= float(2**52)
    down = F.rint(x / F.pow(F.lit(10.0), -place)) * F.pow(F.lit(10.0), -place)
    return Typed(F.when((place == F.floor(place)) & place.between(-20, 100), F.when(place < 0, down).when(big, x).otherwise(F.rint(x * scale) / scale)), DOUBLE)


def _strings(name: str, a: list[Typed]) -> Typed:
    if any(x.kind != "str" for x in a):
        return null_string() if name == "$concat" else Typed(F.lit(None).cast("array<string>"), T.ArrayType(STRING))
    if name == "$concat":
        return Typed(F.concat(*(x.col for x in a)) if a else F.lit(""), STRING)
    by = F.concat(F.lit("\\Q"), F.replace(a[1].col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return Typed(F.when(a[1].col != "", F.split(a[0].col, by, -1)), T.ArrayType(STRING))


def _replace(name: str, s: Typed, find: Typed, by: Typed) -> Typed:
    if not s.kind == find.kind == by.kind == "str":
        return null_string()
    t, f, r = s.col, find.col, by.col
    known = t.isNotNull() & f.isNotNull() & r.isNotNull()
    if name == "$replaceAll":
        return Typed(F.when(known, F.when(f == "", F.concat(r, t)).otherwise(F.replace(t, f, r))), STRING)
    at = F.call_function("locate", f, t)
    first = F.concat(F.substr(t, F.lit(1), at - 1), r, F.substr(t, at + F.length(f)))
    return Typed(F.when(known, F.when(f == "", F.concat(r, t)).when(at == 0, t).otherwise(first)), STRING)


def _trim(name: str, s: Typed, chars: Typed | None) -> Typed:
    if s.kind != "str" or (chars is not None and chars.kind != "str"):
        return null_string()
    if chars is None:
        parts = {"$trim": f"^[{SPACE}]+|[{SPACE}]+$", "$ltrim": f"^[{SPACE}]+", "$rtrim": f"[{SPACE}]+$"}
        return Typed(F.regexp_replace(s.col, parts[name].replace("$", r"\z"), ""), STRING)
    cut = {"$trim": F.btrim, "$ltrim": F.ltrim, "$rtrim": F.rtrim}[name]
    return Typed(F.when(chars.col == "", s.col).otherwise(cut(s.col, chars.col)), STRING)
