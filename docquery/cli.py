"""A small shell: python -m docquery.cli ROOT COMMAND [COLLECTION] [JSON ...]."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from docquery.plans.values import encode
from docquery.sources.store import Store

COMMANDS = "list find count aggregate explain insert update upsert delete index dropindex rename drop stats backup"


def command(store: Store, name: str, *args: str) -> object:
    if name == "list":
        return store.list()
    if name == "backup":
        return store.backup(args[0])
    if name == "stats" and not args:
        return store.stats()
    target, *rest = args
    if name == "rename":
        return store.rename(target, rest[0]).name
    if name == "drop":
        return store.drop(target)
    coll, docs = store.open(target), [json.loads(x) for x in rest]
    first = docs[0] if docs else None
    rows = lambda df: [encode(r.asDict(recursive=True)) for r in df.collect()]
    if name == "find":
        q = coll.find(first)
        if len(docs) > 1 and docs[1]:
            q = q.sort(docs[1])
        return rows((q.limit(docs[2]) if len(docs) > 2 else q).rows())
    if name == "count":
        return coll.find(first).count()
    if name == "explain":
        return coll.find(first).explain()
    if name == "aggregate":
        out = coll.aggregate(first)
        return rows(out) if hasattr(out, "collect") else out
    if name == "index":
        return coll.ensure_index(rest and first["name"], *first["fields"], **{k: v for k, v in first.items() if k not in ("name", "fields")}).meta["indexes"]
    if name == "dropindex":
        return coll.drop_index(first).meta["indexes"]
    if name == "stats":
        return coll.stats()
    verb = {"insert": lambda: coll.insert(first if isinstance(first, list) else [first]), "update": lambda: coll.update(first, docs[1]), "upsert": lambda: coll.upsert_one(first), "delete": lambda: coll.delete(first)}.get(name)
    if verb is None:
        raise SystemExit(f"unknown command {name}; commands: {COMMANDS}")
    return verb()[1]


if __name__ == "__main__":
    if len(sys.argv) < 3:
        raise SystemExit(f"{__doc__}\ncommands: {COMMANDS}")
    print(command(Store(SparkSession.builder.getOrCreate(), sys.argv[1]), *sys.argv[2:]))
