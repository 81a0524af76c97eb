"""Filters, sort keys, expressions and modifiers on plain Python documents: dynamic mode, and the oracle of the tests."""

from __future__ import annotations

import copy
import math
import re
from datetime import timedelta
from functools import cmp_to_key, lru_cache
from typing import Any
from zoneinfo import ZoneInfo

from docquery.plans import expressions as E
from docquery.plans import filters as P
from docquery.plans import values as V
from docquery.plans.patterns import compiled
from docquery.plans.values import MISSING


def get(doc: Any, path: str) -> Any:
    """The path of finds: array parts by decimal number only."""
    for part in path.split("."):
        if isinstance(doc, dict):
            doc = doc.get(part, MISSING)
        elif isinstance(doc, list) and part.isdecimal() and int(part) < len(doc):
            doc = doc[int(part)]
        else:
            return MISSING
    return doc


def compare(a: Any, b: Any) -> int:
    x, y = V.key(a), V.key(b)
    return (x > y) - (x < y)


def matches(f: Any, doc: Any) -> bool:
    if isinstance(f, P.Everything):
        return True
    if isinstance(f, P.And):
        return all(matches(p, doc) for p in f.parts)
    if isinstance(f, P.Or):
        return any(matches(p, doc) for p in f.parts)
    if isinstance(f, P.Nor):
        return not any(matches(p, doc) for p in f.parts)
    if isinstance(f, P.Not):
        return not matches(f.part, doc)
    v = get(doc, f.path)
    if isinstance(f, P.Cmp):
        return _cmp(v, f.op, f.value)
    if isinstance(f, P.In):
        return any(_cmp(v, "eq", x) for x in f.values)
    if isinstance(f, P.Exists):
        return (v is not MISSING) == f.yes
    if isinstance(f, P.Type):
        return v is not MISSING and V.tag(v) == f.tag
    if isinstance(f, P.Size):
        return isinstance(v, list) and len(v) == f.n
    if isinstance(f, P.Regex):
        rule = _rule(f.pattern, f.flags)
        if isinstance(v, str):
            return bool(rule.search(v))
        for x in v if isinstance(v, list) else ():
            if not isinstance(x, str):
                return False
            if rule.search(x):
                return True
        return False
    raise TypeError(f"not for documents: {f!r}")


@lru_cache(1000)
def _rule(pattern: str, flags: str) -> re.Pattern:
    return compiled(pattern, flags)


def _cmp(v: Any, op: str, want: Any) -> bool:
    def one(x: Any) -> bool:
        if op != "eq" and isinstance(x, V.Vector):
            return False
        c = compare(x, want)
        return {"eq": c == 0, "gt": c > 0, "gte": c >= 0, "lt": c < 0, "lte": c <= 0}[op]

    if isinstance(v, list):
        return (isinstance(want, list) and one(v)) or any(map(one, v))
    return one(v)


def sort_key(doc: Any, k: P.SortKey) -> bytes:
    v = get(doc, k.path)
    if isinstance(v, list) and v:
        return (max if k.desc else min)(map(V.key, v))
    return V.key(v)


def sort_documents(docs: list[dict], keys: list[P.SortKey], pk: str = "id") -> list[dict]:
    def order(a: dict, b: dict) -> int:
        for k in keys:
            x, y = sort_key(a, k), sort_key(b, k)
            if x != y:
                return (-1 if x < y else 1) * (-1 if k.desc else 1)
        return compare(get(a, pk), get(b, pk))

    return sorted(docs, key=cmp_to_key(order))


def path_value(doc: Any, parts: list[str]) -> Any:
    """The path of expressions: names map over arrays of objects."""
    for i, part in enumerate(parts):
        if isinstance(doc, list) and not part.isdecimal():
            found = [path_value(x, parts[i:]) for x in doc if isinstance(x, dict)]
            return [x for x in found if x is not MISSING]
        doc = get(doc, part) if isinstance(doc, dict | list) else MISSING
        if doc is MISSING:
            return MISSING
    return doc


def truthy(v: Any) -> bool:
    return not (v is None or v is MISSING or v is False or (isinstance(v, int | float) and not isinstance(v, bool) and v == 0))


def _num(v: Any) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def _finite(x: float) -> float | None:
    return x if math.isfinite(x) else None


def evaluate(e: Any, doc: Any) -> Any:
    if isinstance(e, E.Field):
        return path_value(doc, e.path.split("."))
    if isinstance(e, E.Literal):
        return e.value
    if isinstance(e, E.Object):
        return {k: v for k, x in e.fields.items() if (v := evaluate(x, doc)) is not MISSING}
    if isinstance(e, E.Array):
        return [None if (v := evaluate(x, doc)) is MISSING else v for x in e.items]
    name = e.name
    if name == "$cond":
        return evaluate(e.args[1 if truthy(evaluate(e.args[0], doc)) else 2], doc)
    if name == "$switch":
        for case, then in e.args:
            if truthy(evaluate(case, doc)):
                return evaluate(then, doc)
        return evaluate(e.named["default"], doc) if "default" in e.named else None
    a = [evaluate(x, doc) for x in e.args]
    if name == "$ifNull":
        return next((x for x in a[:-1] if x is not None and x is not MISSING), a[-1])
    if name[1:] in ("eq", "ne", "gt", "gte", "lt", "lte", "cmp"):
        c = compare(a[0], a[1])
        return {"eq": c == 0, "ne": c != 0, "gt": c > 0, "gte": c >= 0, "lt": c < 0, "lte": c <= 0, "cmp": float(c)}[name[1:]]
    if name in ("$add", "$subtract", "$multiply", "$divide", "$abs", "$round"):
        return _arithmetic(name, a)
    if name == "$concat":
        return "".join(a) if all(isinstance(x, str) for x in a) else None
    if name == "$split":
        return a[0].split(a[1]) if all(isinstance(x, str) for x in a) and a[1] else None
    n = {k: evaluate(v, doc) if k not in E._FIXED else v for k, v in e.named.items()}
    if name in ("$replaceOne", "$replaceAll"):
        s, f, r = n["input"], n["find"], n["replacement"]
        if not all(isinstance(x, str) for x in (s, f, r)):
            return None
        return r + s if f == "" else s.replace(f, r, 1 if name == "$replaceOne" else -1)
    if name in ("$trim", "$ltrim", "$rtrim"):
        chars = n.get("chars", "\0\t\n\v\f\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))))
        if not isinstance(n["input"], str) or not isinstance(chars, str):
            return None
        cut = {"$trim": str.strip, "$ltrim": str.lstrip, "$rtrim": str.rstrip}[name]
        return cut(n["input"], chars) if chars else n["input"]
    return _date(name, n)


def _arithmetic(name: str, a: list[Any]) -> Any:
    dates = [x for x in a if V.tag(x) == V.DATE]
    if any(not _num(x) and V.tag(x) != V.DATE for x in a):
        return None
    if dates and name == "$add":
        return V.from_millis(V.millis(dates[0]) + int(sum(x for x in a if _num(x)))) if len(dates) == 1 else None
    if dates and name == "$subtract":
        if len(dates) == 2:
            return float(V.millis(a[0]) - V.millis(a[1]))
        return V.from_millis(V.millis(a[0]) - int(a[1])) if _num(a[1]) else None
    if dates:
        return None
    if name == "$add":
        return _finite(float(sum(a)))
    if name == "$multiply":
        return _finite(float(math.prod(a)))
    if name == "$subtract":
        return _finite(float(a[0] - a[1]))
    if name == "$divide":
        return _finite(a[0] / a[1]) if a[1] else None
    if name == "$abs":
        return float(abs(a[0]))
    place = a[1] if len(a) > 1 else 0
    if place != int(place) or not -20 <= place <= 100:
        return None
    scaled = a[0] * 10.0**place
    if place >= 0 and abs(scaled) >= 2**52:
        return float(a[0])
    return round(a[0] / 10.0**-place) * 10.0**-place if place < 0 else round(scaled) / 10.0**place


def _date(name: str, n: dict) -> Any:
    zone = n.get("timezone", "UTC")
    shift = None
    if m := re.fullmatch(r"([+-])(\d\d):(\d\d)", zone):
        shift = timedelta(hours=int(m[2]), minutes=int(m[3])) * (-1 if m[1] == "-" else 1)

    def local(t: Any) -> Any:
        from datetime import UTC

        return t + shift if shift is not None else t.replace(tzinfo=UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None)

    if name in ("$year", "$week"):
        if V.tag(n["date"]) != V.DATE:
            return None
        t = local(n["date"])
        return float(t.year) if name == "$year" else float((t.timetuple().tm_yday - 1 + 7 - (t.isoweekday() % 7)) // 7)
    if name == "$dateDiff":
        if V.tag(n["startDate"]) != V.DATE or V.tag(n["endDate"]) != V.DATE:
            return None
        unit, first = n["unit"], E.DAYS.index(n.get("startOfWeek", "sunday"))
        ms = {"hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}

        def index(t: Any) -> int:
            if unit in ms:
                return V.millis(t) // ms[unit]
            t = local(t)
            days = (t - V.EPOCH).days
            return {"year": t.year, "quarter": t.year * 4 + (t.month - 1) // 3, "month": t.year * 12 + t.month, "week": (days - 3 - first) // 7, "day": days}[unit]

        return float(index(n["endDate"]) - index(n["startDate"]))
    raise NotImplementedError(f"{name} in dynamic mode")


def modified(doc: dict, changes: list[P.Change]) -> tuple[dict, bool]:
    """The document after the changes, and whether they count as one."""
    out, hit = copy.deepcopy(doc), False
    for c in changes:
        *way, last = c.path.split(".")
        old = get(out, c.path)
        if c.op == "$unset":
            if old is not MISSING:
                _parent(out, way).pop(last)
                hit = True
            continue
        if c.op == "$rename":
            if old is not MISSING:
                _parent(out, way).pop(last)
                *to, name = c.value.split(".")
                _parent(out, to)[name] = old
                hit = True
            continue
        if c.op == "$set":
            new = c.value
            hit |= old is MISSING or not V.same(old, new)
        elif c.op == "$inc":
            if old is not MISSING and not _num(old):
                raise ValueError("$inc needs a number")
            new, hit = (0 if old is MISSING else old) + c.value, True
        else:
            if old is MISSING:
                if c.op != "$addToSet":
                    continue
                old = []
            if not isinstance(old, list):
                raise ValueError(f"{c.op} needs an array")
            if c.op == "$pop":
                new = old[:-1] if c.value == 1 else old[1:]
            elif c.op == "$push":
                new = [*old, c.value]
            elif c.op == "$addToSet":
                new = old if any(V.same(x, c.value) for x in old) else [*old, c.value]
            else:
                gone = c.value if c.op == "$pullAll" else [c.value]
                test = (lambda x, c=c: matches(c.condition, x if isinstance(x, dict) else {"value": x})) if c.condition is not None else (lambda x, g=gone: any(V.same(x, y) for y in g))
                new = [x for x in old if not test(x)]
            hit |= len(new) != len(old) or get(out, c.path) is MISSING
        _parent(out, way)[last] = new
    return out, hit


def _parent(doc: dict, way: list[str]) -> dict:
    for part in way:
        doc = doc.setdefault(part, {})
        if not isinstance(doc, dict):
            raise ValueError(f"{part} is no object")
    return doc
