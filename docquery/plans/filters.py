"""Find filters, sort specifications and update modifiers."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from docquery.plans.errors import ParseError
from docquery.plans.patterns import BadPattern, for_java
from docquery.plans.values import TYPE_NAMES, Vector, decode

OPERATORS = ["$and", "$or", "$nor", "$not", "$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$all", "$exists", "$type", "$regex", "$options", "$size", "$text", "$knn"]
MODIFIERS = ["$set", "$unset", "$inc", "$rename", "$pop", "$push", "$pull", "$pullAll", "$addToSet"]
MAX_K, MAX_EF = 10_000, 65_536


@dataclass(frozen=True)
class Everything: ...


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Nor:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class Cmp:
    path: str
    op: str
    value: Any


@dataclass(frozen=True)
class In:
    path: str
    values: tuple


@dataclass(frozen=True)
class Exists:
    path: str
    yes: bool


@dataclass(frozen=True)
class Type:
    path: str
    tag: int


@dataclass(frozen=True)
class Regex:
    path: str
    pattern: str
    flags: str = ""


@dataclass(frozen=True)
class Size:
    path: str
    n: float


@dataclass(frozen=True)
class Custom:
    make: Callable


@dataclass(frozen=True)
class Clause:
    text: str
    phrase: bool = False
    prefix: bool = False
    role: str = "should"


@dataclass(frozen=True)
class Text:
    clauses: tuple[Clause, ...]
    all_terms: bool = False


@dataclass(frozen=True)
class Knn:
    path: str
    query: tuple[float, ...]
    k: int
    ef: int = 0
    index: str = ""


def parse_filter(doc: Any) -> Any:
    """The filter tree of a document; callables and columns are taken as they are."""
    if doc is None:
        return Everything()
    if callable(doc):
        return Custom(doc)
    if not isinstance(doc, dict):
        raise ParseError("the filter must be an object", source="filter")
    try:
        out = _conjunction(decode(doc), top=True)
    except ParseError as e:
        e.source = e.source or "filter"
        raise
    ranked_only_at_top(out)
    return out


def _conjunction(doc: dict, top: bool = False) -> Any:
    parts = []
    for k, v in doc.items():
        try:
            parts.append(_logic(k, v) if k.startswith("$") else _field(k, v))
        except ParseError as e:
            raise e.under(k) from None
    if not parts:
        return Everything()
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def _logic(op: str, v: Any) -> Any:
    if op in ("$and", "$or", "$nor"):
        if not isinstance(v, list):
            raise ParseError(f"{op} must be an array", op)
        if not v:
            raise ParseError(f"{op} must not be empty", op)
        parts = []
        for i, x in enumerate(v):
            if not isinstance(x, dict):
                raise ParseError(f"{op} takes objects only", op, str(i))
            try:
                parts.append(_conjunction(x))
            except ParseError as e:
                raise e.under(str(i)) from None
        return {"$and": And, "$or": Or, "$nor": Nor}[op](tuple(parts))
    if op == "$text":
        return parse_text(v)
    if op in OPERATORS:
        raise ParseError(f"{op} needs a field", op)
    raise ParseError(f"unknown operator {op}", op, unknown=True)


def _is_operators(v: Any) -> bool:
    return isinstance(v, dict) and any(k.startswith("$") for k in v)


def _field(path: str, v: Any) -> Any:
    if not _is_operators(v):
        return Cmp(path, "eq", v)
    parts: list[Any] = []
    if "$options" in v and "$regex" not in v:
        raise ParseError("$options needs $regex", "$options")
    if "$knn" in v and len(v) > 1:
        raise ParseError("$knn must be the only operator of its field", "$knn")
    for op, x in v.items():
        if op == "$options":
            continue
        try:
            parts.append(_condition(path, op, x, v.get("$options", "")))
        except ParseError as e:
            raise e.under(op) from None
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def _condition(path: str, op: str, x: Any, options: Any) -> Any:
    if op in ("$eq", "$ne"):
        return Cmp(path, "eq", x) if op == "$eq" else Nor((Cmp(path, "eq", x),))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if isinstance(x, Vector):
            raise ParseError("vectors have no order", op)
        return Cmp(path, op[1:], x)
    if op in ("$in", "$nin", "$all"):
        if not isinstance(x, list):
            raise ParseError(f"{op} must be an array", op)
        if op == "$all":
            return And(tuple(Cmp(path, "eq", y) for y in x)) if x else Everything()
        return In(path, tuple(x)) if op == "$in" else Nor((In(path, tuple(x)),)) if x else Everything()
    if op == "$not":
        if not _is_operators(x):
            raise ParseError("$not takes an object of operators", op)
        if "$knn" in x:
            raise ParseError("$knn cannot be negated", "$knn")
        return Not(_field(path, x))
    if op == "$exists":
        return Exists(path, not (x is None or x is False or (isinstance(x, int | float) and not isinstance(x, bool) and x == 0)))
    if op == "$type":
        tag = TYPE_NAMES.get(x) if isinstance(x, str) else int(x) if isinstance(x, int | float) and x in TYPE_NAMES.values() else None
        if tag is None:
            raise ParseError(f"unknown type {x!r}", op)
        return Type(path, tag)
    if op == "$regex":
        if not isinstance(x, str) or not isinstance(options, str):
            raise ParseError("$regex and $options must be strings", op)
        if set(options) - set("ims"):
            raise ParseError("$options may hold i, m and s only", "$options")
        try:
            for_java(x, options)
        except BadPattern as e:
            raise ParseError(f"bad pattern: {e}", op) from None
        return Regex(path, x, options)
    if op == "$size":
        if isinstance(x, bool) or not isinstance(x, int | float):
            raise ParseError("$size must be a number", op)
        return Size(path, x)
    if op == "$knn":
        return _knn(path, x)
    if op in OPERATORS:
        raise ParseError(f"{op} is not an operator of a field", op)
    raise ParseError(f"unknown operator {op}", op, unknown=True)


def _knn(path: str, x: Any) -> Knn:
    if not isinstance(x, dict):
        raise ParseError("$knn must be an object", "$knn")
    whole = lambda v: isinstance(v, int | float) and not isinstance(v, bool) and v == int(v)
    for k in x:
        if k not in ("$query", "$k", "$ef", "$index"):
            raise ParseError(f"{k} is {'reserved' if k in ('$maxDistance', '$minScore', '$prefilter', '$nprobe') else 'no field'} of $knn", "$knn", k)
    query, k, ef = x.get("$query"), x.get("$k"), x.get("$ef", 0)
    items = query.items if isinstance(query, Vector) else tuple(query) if isinstance(query, list) else None
    if not items or not all(isinstance(i, int | float) and not isinstance(i, bool) for i in items):
        raise ParseError("$query must be numbers", "$knn", "$query")
    if not whole(k) or not 1 <= k <= MAX_K:
        raise ParseError(f"$k must be a whole number from 1 to {MAX_K}", "$knn", "$k")
    if ef and (not whole(ef) or not k <= ef <= MAX_EF):
        raise ParseError(f"$ef must be a whole number from $k to {MAX_EF}", "$knn", "$ef")
    if not isinstance(x.get("$index", ""), str):
        raise ParseError("$index must be a string", "$knn", "$index")
    return Knn(path, tuple(map(float, items)), int(k), int(ef), x.get("$index", ""))


def search_clauses(search: str, role: str = "should") -> list[Clause]:
    """Quoted phrases, words with a trailing star, and words."""
    out = []
    for phrase, word in re.findall(r'"([^"]*)(?:"|$)|(\S+)', search):
        if word:
            if bare := word.rstrip("*") if word.endswith("*") else word:
                out.append(Clause(bare, prefix=word.endswith("*"), role=role))
        elif phrase.strip():
            out.append(Clause(phrase.strip(), phrase=True, role=role))
    return out


def parse_text(v: Any) -> Text:
    if not isinstance(v, dict):
        raise ParseError("$text must be an object", "$text")
    for k in v:
        if k not in ("$search", "$defaultOperator", "$require", "$exclude", "$language", "$caseSensitive", "$diacriticSensitive"):
            raise ParseError(f"{k} is no field of $text", "$text", k)
    if not isinstance(v.get("$search"), str):
        raise ParseError("$text needs a string $search", "$text", "$search")
    mode = v.get("$defaultOperator", "or")
    if not isinstance(mode, str) or mode.lower() not in ("and", "or", ""):
        raise ParseError("$defaultOperator must be and or or", "$text", "$defaultOperator")
    out = search_clauses(v["$search"])
    for k, role in (("$require", "must"), ("$exclude", "not")):
        entries = v.get(k, [])
        entries = [entries] if isinstance(entries, str) else entries
        if not isinstance(entries, list) or not all(isinstance(e, str) for e in entries):
            raise ParseError(f"{k} must be a string or strings", "$text", k)
        for e in entries:
            out += search_clauses(e, role)
    return Text(tuple(out), mode.lower() == "and")


def split_ranked(f: Any) -> tuple[Any, Any]:
    """The ranked source of a filter, if any, and the filter without it."""
    if isinstance(f, Text | Knn):
        return f, Everything()
    if isinstance(f, And):
        ranked, rest = None, []
        for p in f.parts:
            r, p = split_ranked(p)
            ranked = ranked or r
            if not isinstance(p, Everything):
                rest.append(p)
        return ranked, rest[0] if len(rest) == 1 else And(tuple(rest)) if rest else Everything()
    return None, f


def ranked_only_at_top(f: Any) -> None:
    found: list[Any] = []

    def walk(x: Any, open_: bool) -> None:
        if isinstance(x, Text | Knn):
            if not open_:
                raise ParseError("ranked sources stand at the top or inside $and only", "$text" if isinstance(x, Text) else "$knn", source="filter")
            found.append(x)
        for p in getattr(x, "parts", ()):
            walk(p, open_ and isinstance(x, And))
        if isinstance(x, Not):
            walk(x.part, False)

    walk(f, True)
    if len(found) > 1:
        raise ParseError("only one ranked source is allowed", source="filter")


def unsatisfiable(f: Any) -> bool:
    if isinstance(f, In):
        return not f.values
    if isinstance(f, And):
        return any(map(unsatisfiable, f.parts))
    return isinstance(f, Or) and all(map(unsatisfiable, f.parts))


def literal_prefix(pattern: str, flags: str) -> str:
    """What every match of an anchored pattern starts with; for a predicate that the scan can use."""
    if set(flags) & set("im") or not pattern.startswith("^") or "|" in pattern:
        return ""
    m = re.match(r"[\w \-/@:,]*", pattern[1:])
    text = m[0]
    return text[:-1] if pattern[1 + len(text) : 2 + len(text)] in ("*", "?", "{") else text


@dataclass(frozen=True)
class SortKey:
    path: str
    desc: bool = False
    score: bool = False


def parse_sort(*specs: Any) -> list[SortKey]:
    """Strings with an optional minus, or objects of +1, -1 and {"$meta": "textScore"}."""
    out = []
    for s in specs:
        if isinstance(s, str):
            if not s.strip("-"):
                raise ParseError("an empty sort field", source="sort")
            out.append(SortKey(s.removeprefix("-"), s.startswith("-")))
        elif isinstance(s, dict) and s:
            for k, v in s.items():
                if v == {"$meta": "textScore"}:
                    out.append(SortKey(k, True, True))
                elif isinstance(v, int | float) and not isinstance(v, bool) and v in (1, -1):
                    out.append(SortKey(k, v == -1))
                else:
                    raise ParseError("a sort direction must be 1 or -1", "$sort", k, "sort")
        else:
            raise ParseError("a sort must be strings or an object", source="sort")
    return out


@dataclass(frozen=True)
class Change:
    op: str
    path: str
    value: Any = None
    condition: Any = field(default=None, compare=False)


def parse_modifier(doc: Any, pk: str = "id") -> list[Change]:
    """The changes of a modifier document, in its order."""
    if not isinstance(doc, dict):
        raise ParseError("the modifier must be an object", source="modifier")
    out: list[Change] = []
    for op, fields in doc.items():
        if op not in MODIFIERS:
            raise ParseError(f"unknown modifier {op}", op, op, "modifier", unknown=True)
        if not isinstance(fields, dict):
            raise ParseError(f"{op} must be an object", op, op, "modifier")
        for path, v in decode(fields).items():
            at = f"{op}.{path}"
            if not path or path.startswith("$"):
                raise ParseError("a bad field name", op, at, "modifier")
            number = isinstance(v, int | float) and not isinstance(v, bool)
            if op == "$inc" and not number:
                raise ParseError("$inc takes numbers", op, at, "modifier")
            if op == "$pop" and not (number and v in (1, -1)):
                raise ParseError("$pop takes 1 or -1", op, at, "modifier")
            if op == "$rename" and not (isinstance(v, str) and v):
                raise ParseError("$rename takes a field name", op, at, "modifier")
            if op == "$pullAll" and not isinstance(v, list):
                raise ParseError("$pullAll takes an array", op, at, "modifier")
            if path.split(".")[0] == pk or (op == "$rename" and v.split(".")[0] == pk):
                raise ParseError("the primary key cannot change", op, at, "modifier")
            condition = _field("value", v) if op == "$pull" and _is_operators(v) else _conjunction(v) if op == "$pull" and isinstance(v, dict) and v else None
            out.append(Change(op, path, v, condition))
    if not out:
        raise ParseError("empty modifier", source="modifier")
    return out
