"""Aggregation pipelines: fourteen stages and nine accumulators."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from docquery.plans.errors import ParseError
from docquery.plans.expressions import Literal, parse_expression
from docquery.plans.filters import And, Everything, SortKey, parse_filter

STAGES = ["$match", "$project", "$addFields", "$set", "$unwind", "$group", "$sort", "$skip", "$limit", "$count", "$lookup", "$facet", "$out", "$merge"]
ACCUMULATORS = ["$sum", "$avg", "$min", "$max", "$count", "$first", "$last", "$push", "$addToSet"]


@dataclass(frozen=True)
class Match:
    filter: Any
    expressions: tuple = ()


@dataclass(frozen=True)
class Project:
    fields: dict[str, Any]


@dataclass(frozen=True)
class AddFields:
    fields: dict[str, Any]


@dataclass(frozen=True)
class Unwind:
    path: str
    preserve: bool = False


@dataclass(frozen=True)
class Group:
    key: Any
    fields: dict[str, tuple[str, Any]]


@dataclass(frozen=True)
class Sort:
    keys: tuple[SortKey, ...]


@dataclass(frozen=True)
class Skip:
    n: int


@dataclass(frozen=True)
class Limit:
    n: int


@dataclass(frozen=True)
class Page:
    """A $skip and the $limit right after it."""

    skip: int
    n: int


@dataclass(frozen=True)
class Count:
    name: str


@dataclass(frozen=True)
class Lookup:
    local: str
    name: str
    source: str = ""


@dataclass(frozen=True)
class Facet:
    branches: dict[str, list]


@dataclass(frozen=True)
class Out:
    target: str


@dataclass(frozen=True)
class Merge:
    target: str
    matched: str = "merge"
    unmatched: str = "insert"


def parse_pipeline(stages: Any, inner: bool = False) -> list[Any]:
    if not isinstance(stages, list):
        raise ParseError("the pipeline must be an array", source="pipeline")
    out = []
    for i, s in enumerate(stages):
        try:
            if not isinstance(s, dict) or len(s) != 1:
                raise ParseError("a stage must be an object of one field")
            ((name, v),) = s.items()
            if name not in STAGES:
                raise ParseError(f"unknown stage {name}", name, unknown=True)
            if name in ("$out", "$merge") and (inner or i < len(stages) - 1):
                raise ParseError(f"{name} must be the last stage of a pipeline", name)
            if name == "$facet" and inner:
                raise ParseError("$facet cannot be nested", name)
            try:
                out.append(_PARSERS[name](v))
            except ParseError as e:
                e.op = e.op or name
                raise e.under(name) from None
        except ParseError as e:
            e.source = "pipeline"
            raise e.under(str(i)) from None
    return out


def output_name(name: Any, op: str) -> str:
    if not isinstance(name, str) or not name or name.startswith("$") or "." in name or "\0" in name:
        raise ParseError(f"a bad output field {name!r}", op)
    return name


def _match(v: Any) -> Match:
    if not isinstance(v, dict):
        raise ParseError("$match must be an object", "$match")
    expressions: list[Any] = []

    def strip(d: dict, top: bool) -> dict:
        out = {}
        for k, x in d.items():
            if k == "$expr" and top:
                expressions.append(parse_expression(x))
            elif k == "$and" and top and isinstance(x, list) and all(isinstance(y, dict) for y in x) and x:
                rest = [s for y in x if (s := strip(y, True)) or not y]
                if rest:
                    out[k] = rest
            else:
                out[k] = x
        return out

    return Match(parse_filter(strip(v, True)), tuple(expressions))


def _fields(v: Any, op: str, project: bool) -> dict[str, Any]:
    if not isinstance(v, dict) or not v:
        raise ParseError(f"{op} must be an object with fields", op)
    out = {}
    for k, x in v.items():
        output_name(k, op)
        if project and (isinstance(x, bool) or isinstance(x, int | float)):
            if not x:
                raise ParseError("exclusion is not supported", op, k)
            x = f"${k}"
        try:
            out[k] = parse_expression(x)
        except ParseError as e:
            raise e.under(k) from None
    return out


def _unwind(v: Any) -> Unwind:
    spec = {"path": v} if isinstance(v, str) else v
    if not isinstance(spec, dict) or set(spec) - {"path", "preserveNullAndEmptyArrays"}:
        raise ParseError("$unwind takes a path and preserveNullAndEmptyArrays", "$unwind")
    path, keep = spec.get("path"), spec.get("preserveNullAndEmptyArrays", False)
    if not isinstance(path, str) or not path.startswith("$") or path.startswith("$$") or len(path) < 2:
        raise ParseError("the path of $unwind must start with one $", "$unwind", "path")
    if not isinstance(keep, bool):
        raise ParseError("preserveNullAndEmptyArrays must be a boolean", "$unwind", "preserveNullAndEmptyArrays")
    return Unwind(path[1:], keep)


def _group(v: Any) -> Group:
    if not isinstance(v, dict) or len({"_id", "id"} & set(v)) != 1:
        raise ParseError("$group takes one key, _id or id", "$group")
    key, fields = None, {}
    for k, x in v.items():
        try:
            if k in ("_id", "id"):
                key = parse_expression(x)
                continue
            output_name(k, "$group")
            if not isinstance(x, dict) or len(x) != 1:
                raise ParseError("a field of $group takes one accumulator", "$group")
            ((op, arg),) = x.items()
            if op not in ACCUMULATORS:
                raise ParseError(f"unknown accumulator {op}", op, unknown=True)
            if op == "$count" and arg != {}:
                raise ParseError("$count takes an empty object", op)
            fields[k] = (op, parse_expression(arg) if op != "$count" else Literal(1))
        except ParseError as e:
            raise e.under(k) from None
    return Group(key, fields)


def _sort(v: Any) -> Sort:
    if not isinstance(v, dict) or not v:
        raise ParseError("$sort must be an object with fields", "$sort")
    for k, x in v.items():
        if isinstance(x, bool) or x not in (1, -1):
            raise ParseError("a sort direction must be 1 or -1", "$sort", k)
    return Sort(tuple(SortKey(k, x == -1) for k, x in v.items()))


def _number(op: str, least: int, make: Any) -> Any:
    def parse(v: Any) -> Any:
        if isinstance(v, bool) or not isinstance(v, int | float) or v != int(v) or v < least:
            raise ParseError(f"{op} must be a whole number of {least} or more", op)
        return make(int(v))

    return parse


def _lookup(v: Any) -> Lookup:
    if not isinstance(v, dict):
        raise ParseError("$lookup must be an object", "$lookup")
    for k in v:
        if k not in ("from", "localField", "foreignField", "as"):
            raise ParseError(f"{k} is not supported in $lookup", "$lookup", k)
    if not isinstance(v.get("localField"), str) or not v["localField"]:
        raise ParseError("$lookup needs localField", "$lookup", "localField")
    if v.get("foreignField", "id") != "id":
        raise ParseError("foreignField must be id: only self-joins on the primary key are supported", "$lookup", "foreignField")
    if not isinstance(v.get("from", ""), str):
        raise ParseError("from must be a string", "$lookup", "from")
    return Lookup(v["localField"], output_name(v.get("as"), "$lookup"), v.get("from", ""))


def _facet(v: Any) -> Facet:
    if not isinstance(v, dict) or not v:
        raise ParseError("$facet must be an object with pipelines", "$facet")
    out = {}
    for k, x in v.items():
        output_name(k, "$facet")
        try:
            out[k] = parse_pipeline(x, inner=True)
        except ParseError as e:
            raise e.under(k) from None
    return Facet(out)


def _out(v: Any) -> Out:
    if not isinstance(v, str) or not v:
        raise ParseError("$out must be a collection name", "$out")
    return Out(v)


def _merge(v: Any) -> Merge:
    spec = {"into": v} if isinstance(v, str) else v
    if not isinstance(spec, dict):
        raise ParseError("$merge must be a name or an object", "$merge")
    for k in spec:
        if k not in ("into", "on", "whenMatched", "whenNotMatched"):
            raise ParseError(f"{k} is not supported in $merge", "$merge", k)
    if not isinstance(spec.get("into"), str) or not spec["into"]:
        raise ParseError("$merge needs a collection name", "$merge", "into")
    if spec.get("on", "id") != "id":
        raise ParseError("on must be id", "$merge", "on")
    for k, names in (("whenMatched", ("merge", "replace", "keepExisting", "fail")), ("whenNotMatched", ("insert", "discard", "fail"))):
        if spec.get(k, names[0]) not in names:
            raise ParseError(f"{k} must be one of {', '.join(names)}", "$merge", k)
    return Merge(spec["into"], spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert"))


_PARSERS = {
    "$match": _match, "$project": lambda v: Project(_fields(v, "$project", True)), "$addFields": lambda v: AddFields(_fields(v, "$addFields", False)),
    "$set": lambda v: AddFields(_fields(v, "$set", False)), "$unwind": _unwind, "$group": _group, "$sort": _sort,
    "$skip": _number("$skip", 0, Skip), "$limit": _number("$limit", 1, Limit), "$count": lambda v: Count(output_name(v, "$count")),
    "$lookup": _lookup, "$facet": _facet, "$out": _out, "$merge": _merge,
}


def paged(stages: list[Any]) -> list[Any]:
    """Each $limit takes in the $skip stages right before it."""
    out: list[Any] = []
    for s in stages:
        if isinstance(s, Skip) and out and isinstance(out[-1], Skip):
            s = Skip(out.pop().n + s.n)
        elif isinstance(s, Limit) and out and isinstance(out[-1], Skip):
            s = Page(out.pop().n, s.n)
        out.append(s)
    return out


def fold_prefix(stages: list[Any]) -> tuple[list[Any], list[Any]]:
    """Leading $match stages become one; what follows them stays."""
    i = 0
    while i < len(stages) and isinstance(stages[i], Match):
        i += 1
    if i < 2:
        return stages[:i], stages[i:]
    parts = [s.filter for s in stages[:i] if not isinstance(s.filter, Everything)]
    one = parts[0] if len(parts) == 1 else And(tuple(parts)) if parts else Everything()
    return [Match(one, tuple(e for s in stages[:i] for e in s.expressions))], stages[i:]
