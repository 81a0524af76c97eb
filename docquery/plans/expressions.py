"""Aggregation expressions: field references, literals, objects, arrays and 28 operators."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any
from zoneinfo import ZoneInfo

from docquery.plans.errors import ParseError
from docquery.plans.values import decode

#: Operators of listed arguments: least and most counts; None is any.
LISTED = {"$add": (0, None), "$subtract": (2, 2), "$multiply": (0, None), "$divide": (2, 2), "$abs": (1, 1), "$round": (1, 2), "$concat": (0, None), "$split": (2, 2), "$ifNull": (2, None)} | {f"${c}": (2, 2) for c in ("eq", "ne", "gt", "gte", "lt", "lte", "cmp")}
#: Operators of named arguments: needed and optional ones.
NAMED = {
    "$replaceOne": (("input", "find", "replacement"), ()), "$replaceAll": (("input", "find", "replacement"), ()),
    "$trim": (("input",), ("chars",)), "$ltrim": (("input",), ("chars",)), "$rtrim": (("input",), ("chars",)),
    "$dateAdd": (("startDate", "unit", "amount"), ("timezone",)), "$dateDiff": (("startDate", "endDate", "unit"), ("timezone", "startOfWeek")),
    "$dateTrunc": (("date", "unit"), ("binSize", "timezone", "startOfWeek")), "$year": (("date",), ("timezone",)), "$week": (("date",), ("timezone",)),
}
OPERATORS = [*LISTED, *NAMED, "$cond", "$switch"]
UNITS = ["year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond"]
DAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
_FIXED = ("unit", "timezone", "startOfWeek", "binSize")


@dataclass(frozen=True)
class Field:
    path: str


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Object:
    fields: dict[str, Any]


@dataclass(frozen=True)
class Array:
    items: tuple


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple = ()
    named: dict[str, Any] = field(default_factory=dict)


def parse_expression(v: Any) -> Any:
    if isinstance(v, str) and v.startswith("$"):
        if v.startswith("$$"):
            raise ParseError(f"variables are not supported: {v}")
        if not v[1:] or "" in v[1:].split("."):
            raise ParseError(f"a bad field path {v}")
        return Field(v[1:])
    if isinstance(v, list):
        return Array(tuple(_at(str(i), x) for i, x in enumerate(v)))
    if not isinstance(v, dict):
        return Literal(v)
    signs = [k for k in v if k.startswith("$")]
    if not signs:
        return Object({k: _at(k, x) for k, x in v.items()})
    if not isinstance(decoded := decode(v), dict):
        return Literal(decoded)
    if len(v) > 1:
        raise ParseError("an operator must be the only field of its object", signs[0])
    ((name, x),) = v.items()
    if name == "$literal":
        return Literal(decode(x))
    try:
        return _operator(name, x)
    except ParseError as e:
        raise e.under(name) from None


def _at(key: str, v: Any) -> Any:
    try:
        return parse_expression(v)
    except ParseError as e:
        raise e.under(key) from None


def _operator(name: str, x: Any) -> Op:
    if name in LISTED:
        least, most = LISTED[name]
        items = x if isinstance(x, list) else [x]
        if len(items) < least or (most is not None and len(items) > most):
            raise ParseError(f"{name} takes {least if least == most else f'{least} to {most}' if most else f'at least {least}'} arguments", name)
        if name == "$split" and items[1] == "":
            raise ParseError("$split needs a separator", name)
        return Op(name, tuple(_at(str(i), y) for i, y in enumerate(items)))
    if name in NAMED:
        need, may = NAMED[name]
        if name in ("$year", "$week") and not (isinstance(x, dict) and "date" in x):
            x = {"date": x[0] if isinstance(x, list) and len(x) == 1 else x}
        if not isinstance(x, dict):
            raise ParseError(f"{name} takes an object", name)
        for k in x:
            if k not in need + may:
                raise ParseError(f"unknown argument {k}", name, k)
        for k in need:
            if k not in x:
                raise ParseError(f"{name} needs {k}", name)
        return Op(name, named={k: _fixed(name, k, y) if k in _FIXED else _at(k, y) for k, y in x.items()})
    if name == "$cond":
        if isinstance(x, list) and len(x) == 3:
            x = dict(zip(("if", "then", "else"), x, strict=True))
        if not isinstance(x, dict) or set(x) != {"if", "then", "else"}:
            raise ParseError("$cond takes if, then and else", name)
        return Op(name, tuple(_at(k, x[k]) for k in ("if", "then", "else")))
    if name == "$switch":
        if not isinstance(x, dict) or not isinstance(x.get("branches"), list) or not x["branches"] or set(x) - {"branches", "default"}:
            raise ParseError("$switch takes branches and default", name)
        args = []
        for i, b in enumerate(x["branches"]):
            if not isinstance(b, dict) or set(b) != {"case", "then"}:
                raise ParseError("a branch takes case and then", name, f"branches.{i}")
            args.append((_at(f"branches.{i}.case", b["case"]), _at(f"branches.{i}.then", b["then"])))
        return Op(name, tuple(args), {"default": _at("default", x["default"])} if "default" in x else {})
    raise ParseError(f"unknown operator {name}", name, unknown=True)


def _fixed(op: str, k: str, v: Any) -> Any:
    """Arguments that must be literals."""
    if k == "binSize":
        if isinstance(v, bool) or not isinstance(v, int | float) or v != int(v) or not 1 <= v <= 2**31 - 1:
            raise ParseError("binSize must be a positive whole number", op, k)
        return int(v)
    if not isinstance(v, str) or v.startswith("$"):
        raise ParseError(f"{k} must be a literal string", op, k)
    if k == "unit":
        if v.lower() not in UNITS:
            raise ParseError(f"unknown unit {v}", op, k)
        return v.lower()
    if k == "startOfWeek":
        match = [d for d in DAYS if v.lower() in (d, d[:3])]
        if not match:
            raise ParseError(f"unknown day {v}", op, k)
        return match[0]
    if m := re.fullmatch(r"([+-])(\d\d)(?::?(\d\d))?", v):
        if int(m[2]) > 23 or int(m[3] or 0) > 59:
            raise ParseError(f"bad time zone {v}", op, k)
        return f"{m[1]}{m[2]}:{m[3] or '00'}"
    try:
        ZoneInfo(v)
    except (ValueError, OSError, KeyError):
        raise ParseError(f"bad time zone {v}", op, k) from None
    return v
