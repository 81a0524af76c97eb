"""Modified Kneser-Ney pairs of unfolded words, as a table that grows with the trusted text and is joined in shards.

A text is a cycle: one mark, its words between ASCII white space byte for byte, and the mark again. So each word is once the
next word and once the context, and a text's cost is a sum over its distinct words and pairs, each looked up on its own:

    cost = words * unknown - sum n(w) * known(w) - sum n(a, b) * log(1 + (c(a, b) - D) / (mass(a) * p(b)))

with mass(a) what discounting takes off the counts of context a, p the continuation distribution over pairs, and known(w) =
unknown + log p(w) + log (mass(w) / total(w)). Pairs and words are known by 64-bit hashes; words carry their language's.

The key space is cut into ranges of bounded size. Rows of a range travel packed: sorted keys as differences, byte planes
together, compressed, some six bytes a row. Counts of a range are merged by one task; what it needs to know of its words (mass
and continuations) comes from the ranges of the words, which have summed them over all pairs. Documents' pre-aggregated (key,
document, count) rows meet the counts range by range, in PASSES passes over the ranges, so that only a share of them is on disk.
Rows and answers name a document by its place in its block, a run of texts whose ids are sent once a pass: the more ranges there
are, the fewer keys of a document lie in one, and an id for each would soon outweigh them. A block's name is a digest of its ids.

Keys that occur so often that at most HOT can, are broadcast with their values and never shuffled (a heavy-hitter split):
no range has a hot key of the documents. On the driver are HOT words and pairs at most and eight numbers a language.

Trusted texts are scored without their own counts: c less the text's own n, and a word found nowhere else is unknown. Totals and
continuation counts stay as they are.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import blocks as B
from docquery.llm.common import discard, settle

#: Passes over the documents; bytes of packed rows in a range, of some 1.5 a byte of text; at least so many ranges a pass.
PASSES, RANGE_BYTES, LEAST_RANGES = 5, 24 << 20, 3
#: At most so many words, and so many pairs, are broadcast.
HOT = 1 << 17
#: Bytes of text whose pairs or keys are packed together: a row for each of them and each range.
COUNTED_BYTES = 8 << 20
#: Upper bits of keys by which those are told that no hot key has.
CELL_BITS = 21
#: Equally likely words of the lowest order.
WORDS = 1 << 20
NS = ["n1", "n2", "n3", "n4", "rows", "total"]
PACKED = "p int, kind int, lang string, k int, g binary, x binary, y binary, z binary, docs binary, " + ", ".join(f"{n} long" for n in NS)
PAIRS, FOLLOWS, REPLIES, BLOCK, ASKED_PAIRS, ASKED_WORDS = range(6)
ANSWERS = "block long, ids binary, at binary, known binary"
_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 5, *[pa.int64()] * len(NS)]
_NAMES = ["p", "kind", "lang", "k", "g", "x", "y", "z", "docs", *NS]


# Packing


def squeezed(x: np.ndarray) -> bytes:
    """The bytes of an array by their places in a number, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def opened(raw: pa.Scalar, kind: type) -> np.ndarray:
    buf = memoryview(raw.as_buffer())
    n, size = int.from_bytes(buf[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(pa.py_buffer(buf[8:]), decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def squeezed_keys(g: np.ndarray) -> bytes:
    return squeezed(np.diff(g, prepend=np.uint64(0)))


def opened_keys(raw: pa.Scalar) -> np.ndarray:
    return np.cumsum(opened(raw, np.uint64), dtype=np.uint64)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of rows (p, kind, lang, k, g, x, y, z, docs, counts...); missing trailing values are null."""
    rows = [(*r, *[None] * (len(_NAMES) - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def table_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows)])


def place(g: np.ndarray, parts: int) -> np.ndarray:
    """The range of a key, by its upper half."""
    return (((g >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def slices(g: np.ndarray, parts: int, mine: range | None = None) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of the ranges that occur among sorted keys."""
    mine = mine or range(parts)
    cuts = np.searchsorted(place(g, parts), np.arange(mine.start, mine.stop + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        yield mine.start + int(i), int(cuts[i]), int(cuts[i + 1])


# Words and pairs of texts


def cycles(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, document) of all pairs; words carry the hash of their document's language."""
    starts, stops, first = B.spans(data, offsets, B.NOT_SPACE)
    h, n = B.hashes(data, starts, stops), np.diff(first)
    doc = np.repeat(np.arange(len(n)), n + 1)
    at = first[:-1] + np.arange(len(n))  # the marks' places
    a = np.zeros(len(doc), np.uint64)
    rest = np.ones(len(doc), bool)
    rest[at] = False
    a[rest] = h
    a = B.mix(a + B.mix(langs)[doc])
    b = np.empty_like(a)
    b[:-1] = a[1:]
    b[at + n] = a[at]
    return a, b, doc


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return B.mix(a * B._M3 + b)


def lang_hash(names: list) -> np.ndarray:
    raw = [(x or "").encode() for x in names]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return B.hashes(data, offsets[:-1], offsets[1:])


def blocks_of(batch: pa.RecordBatch, column: str, limit: int = B.BLOCK_BYTES) -> Iterator[tuple[int, int, list[str], np.ndarray, tuple]]:
    """(start, end, languages, each document's place among them, cycles) of a batch's blocks."""
    names = batch.column(column).to_pylist()
    known = {x: i for i, x in enumerate(dict.fromkeys(names))}
    of, hashed = np.array([known[x] for x in names], np.int64), lang_hash(list(known))
    for s, e, data, offsets in B.blocks(batch.column("text"), limit):
        yield s, e, list(known), of[s:e], cycles(data, offsets, hashed[of[s:e]])


# The model


def pairs_row(p: int, lang: str, a: np.ndarray, b: np.ndarray, c: np.ndarray, *more: int) -> tuple:
    """Distinct pairs as places in a sorted list of their words, in the order of the contexts."""
    w, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)].astype(np.uint32), at[len(a) :].astype(np.uint32)
    order = np.argsort(ia.astype(np.uint64) << np.uint64(32) | ib)
    return (p, PAIRS, lang, 0, squeezed_keys(w), squeezed(ia[order]), squeezed(ib[order]), squeezed(c[order].astype(np.uint64)), None, *more)


def opened_pairs(t: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return opened_keys(t.column("g")[i]), opened(t.column("x")[i], np.uint32), opened(t.column("y")[i], np.uint32), opened(t.column("z")[i], np.uint64).astype(np.int64)


@B.tidy
def counted(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed pairs of each block, language and range."""
    for batch in batches:
        for _, _, langs, of, (a, b, doc) in blocks_of(batch, "lang", COUNTED_BYTES):
            g, li, out = pair(a, b), of[doc], []
            for i in np.unique(of):
                at = np.flatnonzero(li == i)
                at = at[np.argsort(g[at])]
                new = np.flatnonzero(np.diff(g[at], prepend=~g[at[0]]))
                c, at = np.diff(np.append(new, len(at))), at[new]
                out += [pairs_row(p, langs[i], a[at[s:e]], b[at[s:e]], c[s:e]) for p, s, e in slices(g[at], parts)]
            yield batch_of(out)


@B.tidy
def merged(t: pa.Table) -> pa.Table:
    """One row of a range and language, with the counts of counts."""
    a, b, c = [], [], []
    for i in range(len(t)):
        w, ia, ib, n = opened_pairs(t, i)
        a.append(w[ia])
        b.append(w[ib])
        c.append(n)
    a, b, c = map(np.concatenate, (a, b, c))
    g = pair(a, b)
    at = np.argsort(g)
    new = np.flatnonzero(np.diff(g[at], prepend=~g[at[0]]))
    c, at = np.add.reduceat(c[at], new), at[new]
    return table_of([pairs_row(t.column("p")[0].as_py(), t.column("lang")[0].as_py(), a[at], b[at], c, *counts_of_counts(c))])


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [*(int((c == k).sum()) for k in (1, 2, 3, 4)), len(c), int(c.sum())]


@B.tidy
def asked_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """For the ranges of the words: each range's words as contexts (total, pairs of count 1, 2, more) and as followers."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        for i in range(len(t)):
            w, ia, ib, c = opened_pairs(t, i)
            by = np.minimum(c, 3)
            stats = [np.bincount(ia, c, len(w)), *(np.bincount(ia[by == k], minlength=len(w)) for k in (1, 2, 3)), np.bincount(ib, minlength=len(w))]
            stats = [x.astype(np.uint64) for x in stats]
            p, lang = t.column("p")[i].as_py(), t.column("lang")[i].as_py()
            yield batch_of([(q, FOLLOWS, lang, p, squeezed_keys(w[s:e]), squeezed(stats[0][s:e]), squeezed(np.concatenate([x[s:e] for x in stats[1:4]])), squeezed(stats[4][s:e])) for q, s, e in slices(w, parts)])


@B.tidy
def summed_words(t: pa.Table, d: dict[str, tuple[float, ...]]) -> pa.Table:
    """A range's words with their sums, and what each range of pairs asked for, in the order of its list of words."""
    q, lang = t.column("p")[0].as_py(), t.column("lang")[0].as_py()
    asked = [opened_keys(t.column("g")[i]) for i in range(len(t))]
    w, at = np.unique(np.concatenate(asked), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in asked])])
    column = lambda c: [opened(t.column(c)[i], np.uint64) for i in range(len(t))]
    add = lambda xs: np.bincount(at, np.concatenate(xs).astype(float), len(w))
    total, follows, by = add(column("x")).astype(np.uint64), add(column("z")).astype(np.uint64), [np.split(x, 3) for x in column("y")]
    mass = sum(d[lang][k] * add([x[k] for x in by]) for k in (0, 1, 2)).astype(np.float32)
    out = [(q, FOLLOWS, lang, 0, squeezed_keys(w), squeezed(total), squeezed(mass), squeezed(follows), None, *counts_of_counts(follows.astype(np.int64)))]
    for i in range(len(t)):
        mine = at[cuts[i] : cuts[i + 1]]
        out.append((t.column("k")[i].as_py(), REPLIES, lang, q, None, None, squeezed(mass[mine]), squeezed(follows[mine])))
    return table_of(out)


def discounts(rows: DataFrame) -> dict[str, tuple[float, ...]]:
    """(d1, d2, d3, share of the mass that they take, total) of each language."""
    out = {}
    for r in rows.groupBy("lang").agg(*(F.sum(n).alias(n) for n in NS)).collect():
        n = [r["n1"], r["n2"], r["n3"], r["n4"]]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        d = [min(float(k), max(0.05, k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k)) if n[0] else 0.5 for k in (1, 2, 3)]
        out[r["lang"]] = (*d, (d[0] * n[0] + d[1] * n[1] + d[2] * (r["rows"] - n[0] - n[1])) / r["total"], float(r["total"]))
    return out


class Values:
    """What words and pairs are worth, from the discounts of pairs (high) and of continuations (low)."""

    def __init__(self, high: dict[str, tuple[float, ...]], low: dict[str, tuple[float, ...]]) -> None:
        self.langs = sorted(high)
        self.d = np.array([high[k][:3] for k in self.langs])
        self.low = low

    def p(self, lang: str, follows: np.ndarray) -> np.ndarray:
        *e, gamma, total = self.low[lang]
        return np.maximum(0, follows - np.array(e)[np.minimum(follows, 3).astype(int) - 1]) / total + gamma / WORDS

    def unknown(self, lang: str) -> float:
        return -float(np.log(self.low[lang][3] / WORDS))

    def known(self, lang: str, total: np.ndarray, mass: np.ndarray, follows: np.ndarray) -> np.ndarray:
        return np.log(self.p(lang, follows) * mass / total) + self.unknown(lang)

    def of(self, words: bool, left: np.ndarray, r: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The worth of one occurrence, with `left` counts from elsewhere; r is known(w), or 1 / (mass(a) * p(b))."""
        if words:
            return np.where(left > 0, r, 0.0)
        less = self.d[lang, np.clip(left, 1, 3) - 1]
        return np.where(left > 0, np.log1p(np.maximum(0.0, left - less) * r), 0.0)


def fit(trusted: DataFrame, parts: int) -> tuple[DataFrame, DataFrame, Values]:
    """Packed pairs, packed words with the replies to the ranges of pairs, and their values, from (text, lang)."""
    rows = trusted.mapInArrow(lambda it: counted(it, parts), PACKED)
    pairs = settle(rows.groupBy("p", "lang").applyInArrow(lambda t: merged(t), PACKED), "pairs")
    high = discounts(pairs)
    asked = pairs.mapInArrow(lambda it: asked_words(it, parts), PACKED)
    words = settle(asked.groupBy("p", "lang").applyInArrow(lambda t: summed_words(t, high), PACKED), "words")
    return pairs, words, Values(high, discounts(words.where(F.col("kind") == FOLLOWS)))


# Keys that many documents share


def frequent_words(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            w, total, mass, follows = opened_keys(batch.column("g")[i]), *(opened(batch.column(c)[i], k) for c, k in (("x", np.uint64), ("y", np.float32), ("z", np.uint64)))
            at = np.flatnonzero(total >= least)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("lang")[i].as_py()] * len(at), pa.string()), B.signed(w[at]), B.signed(total[at]), pa.array(mass[at].astype(float)), B.signed(follows[at])], names=["lang", "w", "total", "mass", "follows"])


def frequent_pairs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch])
        for i in range(len(t)):
            w, ia, ib, c = opened_pairs(t, i)
            at = np.flatnonzero(c >= least)
            yield pa.RecordBatch.from_arrays([pa.array([t.column("lang")[i].as_py()] * len(at), pa.string()), B.signed(w[ia[at]]), B.signed(w[ib[at]]), pa.array(c[at])], names=["lang", "a", "b", "c"])


class Keys:
    """Sorted keys with counts, what Values.of needs, and their language."""

    def __init__(self, g: np.ndarray, c: np.ndarray, r: np.ndarray, lang: np.ndarray) -> None:
        at = np.argsort(g)
        self.g, self.c, self.r, self.lang = g[at], c[at].astype(np.int64), r[at], lang[at]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and which of them are there."""
        if not len(self.g):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        k = np.minimum(np.searchsorted(self.g, h), len(self.g) - 1)
        return k, self.g[k] == h

    @functools.cached_property
    def cells(self) -> np.ndarray:
        """Which of the values of the upper CELL_BITS bits occur."""
        out = np.zeros(1 << CELL_BITS, bool)
        out[self.g >> np.uint64(64 - CELL_BITS)] = True
        return out

    def seek(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of those among unsorted keys that are there, and their places."""
        at = np.flatnonzero(self.cells[h >> np.uint64(64 - CELL_BITS)])
        k, hit = self.find(h[at])
        return at[hit], k[hit]


def hot_keys(pairs: DataFrame, words: DataFrame, values: Values) -> dict[int, Keys]:
    """Pairs and words that hold more than 1 / HOT of all trusted words: at most HOT of each."""
    least = int(sum(r[0] for r in pairs.agg(F.sum("total")).collect() if r[0]) // HOT + 1) if HOT else 1 << 62
    w = words.where(F.col("kind") == FOLLOWS).mapInArrow(lambda it: frequent_words(it, least), "lang string, w long, total long, mass double, follows long").toArrow()
    p = pairs.mapInArrow(lambda it: frequent_pairs(it, least), "lang string, a long, b long, c long").toArrow()
    number = lambda t, c: t.column(c).to_numpy()
    lang = lambda t: np.array([values.langs.index(x) for x in t.column("lang").to_pylist()], np.int64)
    li, key = lang(w), number(w, "w").view(np.uint64)
    known, follow = np.zeros(len(key)), np.zeros(len(key))
    for i, name in enumerate(values.langs):
        at = np.flatnonzero(li == i)
        args = [number(w, c)[at] for c in ("total", "mass", "follows")]
        known[at], follow[at] = values.known(name, *args), values.p(name, args[2])
    # Both words of such a pair are among the words: they occur as often at least.
    order = np.argsort(key)
    at = lambda c: order[np.searchsorted(key[order], number(p, c).view(np.uint64))] if len(p) else np.zeros(0, np.int64)
    ia, ib = at("a"), at("b")
    r = 1 / (number(w, "mass")[ia] * follow[ib])
    return {0: Keys(pair(key[ia], key[ib]), number(p, "c"), r, lang(p)), 1: Keys(key, number(w, "total"), known, li)}


# Documents


@B.tidy
def measured(batches: Iterator[pa.RecordBatch], values: Values, hot: dict[int, Keys]) -> Iterator[pa.RecordBatch]:
    """(id, key, words, known): the number of words, and what the hot keys take off the cost."""
    for batch in batches:
        own = batch.column("trusted").to_numpy(zero_copy_only=False).astype(np.int64)
        for s, e, _, _, (a, b, doc) in blocks_of(batch, "key"):
            total = np.zeros(e - s)
            for kind, g in ((0, pair(a, b)), (1, a)):
                keys = hot[kind]
                at, k = keys.seek(g)
                code, n = np.unique(doc[at] * max(1, len(keys.g)) + k, return_counts=True)
                d, k = code // max(1, len(keys.g)), code % max(1, len(keys.g))
                total += np.bincount(d, n * values.of(kind == 1, keys.c[k] - n * own[s:e][d], keys.r[k], keys.lang[k]), e - s)
            words = np.bincount(doc, minlength=e - s) - 1
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(s, e - s), batch.column("key").slice(s, e - s), pa.array(words), pa.array(total)], names=["id", "key", "words", "known"])


@B.tidy
def asked_keys(batches: Iterator[pa.RecordBatch], hot: dict[int, Keys], parts: int, mine: range) -> Iterator[pa.RecordBatch]:
    """Documents' keys in the ranges `mine`, without the hot ones: distinct keys, how many documents each, those and 2 n + trusted."""
    for batch in batches:
        ids, own = batch.column("id").to_numpy(), batch.column("trusted").to_numpy(zero_copy_only=False)
        for s, e, _, _, (a, b, doc) in blocks_of(batch, "key", COUNTED_BYTES):
            out, mark = [], own[s:e].astype(np.uint32)
            about = ids[s:e].astype(np.int64).tobytes()
            name = int.from_bytes(hashlib.blake2b(about, digest_size=8).digest(), "little", signed=True)
            for kind, g in ((0, pair(a, b)), (1, a)):
                p = place(g, parts)
                at = np.flatnonzero((p >= mine.start) & (p < mine.stop))
                at = np.delete(at, hot[kind].seek(g[at])[0])
                if not len(at):
                    continue
                h, d = g[at], doc[at]
                order = np.argsort(h, kind="stable")  # documents stay in order
                h, d = h[order], d[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
                n, h, d = np.diff(np.append(new, len(h))), h[new], d[new]
                for q, i, j in slices(h, parts, mine):
                    first = np.flatnonzero(np.diff(h[i:j], prepend=~h[i]))
                    more = squeezed(2 * n[i:j].astype(np.uint32) + mark[d[i:j]])
                    out.append((q, ASKED_PAIRS + kind, None, 0, squeezed_keys(h[i:j][first]), squeezed(np.diff(np.append(first, j - i)).astype(np.uint32)), squeezed(d[i:j].astype(np.uint32)), more, None, name, e - s))
            if out:
                yield batch_of([*out, (mine.start + name % len(mine), BLOCK, None, 0, None, None, None, None, about, name, e - s)])


def model_keys(t: pa.Table, kinds: np.ndarray, values: Values) -> dict[int, Keys]:
    """The pairs and words of a range."""
    found: dict[int, list[tuple]] = {0: [], 1: []}
    langs = t.column("lang").to_pylist()
    for i in np.flatnonzero(kinds == PAIRS):
        lang = langs[i]
        w, ia, ib, c = opened_pairs(t, int(i))
        replies = sorted((t.column("k")[int(j)].as_py(), int(j)) for j in np.flatnonzero(kinds == REPLIES) if langs[j] == lang)
        mass, follows = (np.concatenate([opened(t.column(x)[j], k) for _, j in replies]) for x, k in (("y", np.float32), ("z", np.uint64)))
        a, b = w[ia], w[ib]
        with np.errstate(divide="ignore"):
            p = values.p(lang, np.maximum(follows, 1))
            found[0].append((pair(a, b), c, (1 / (mass.astype(float)[ia] * p[ib])).astype(np.float32), np.full(len(c), values.langs.index(lang), np.int16)))
    for i in np.flatnonzero(kinds == FOLLOWS):
        w = opened_keys(t.column("g")[int(i)])
        total, mass, follows = (opened(t.column(c)[int(i)], k) for c, k in (("x", np.uint64), ("y", np.float32), ("z", np.uint64)))
        found[1].append((w, total, values.known(langs[i], total, mass, follows).astype(np.float32), np.full(len(w), values.langs.index(langs[i]), np.int16)))
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int16))
    return {k: Keys(*map(np.concatenate, zip(*(v or [empty]), strict=True))) for k, v in found.items()}


@B.tidy
def looked_up(t: pa.Table, values: Values) -> pa.Table:
    """ANSWERS: what a range of keys takes off the cost of each block's documents, as places and sums, and ids of blocks."""
    t = t.combine_chunks()
    kinds, names, sizes = (pc.fill_null(t.column(c), 0).to_numpy() for c in ("kind", "n1", "n2"))
    asked = np.flatnonzero(kinds >= ASKED_PAIRS)
    model = model_keys(t, kinds, values) if len(asked) else {}
    out = [(int(names[i]), t.column("docs")[i].as_py(), None, None) for i in map(int, np.flatnonzero(kinds == BLOCK))]
    asked = asked[np.argsort(names[asked], kind="stable")]
    for mine in np.split(asked, np.flatnonzero(np.diff(names[asked])) + 1) if len(asked) else []:
        size = int(sizes[mine[0]])
        total = np.zeros(size)
        for i in map(int, mine):
            kind = int(kinds[i]) - ASKED_PAIRS
            keys = model[kind]
            k, hit = keys.find(opened_keys(t.column("g")[i]))
            reps = opened(t.column("x")[i], np.uint32)
            hit = np.repeat(hit, reps)
            k, d, n = np.repeat(k, reps)[hit], opened(t.column("y")[i], np.uint32)[hit], opened(t.column("z")[i], np.uint32)[hit].astype(np.int64)
            n, own = n >> 1, n & 1
            total += np.bincount(d, n * values.of(kind == 1, keys.c[k] - n * own, keys.r[k], keys.lang[k]), size)
        some = np.flatnonzero(total)
        if len(some):
            out.append((int(names[mine[0]]), None, squeezed(np.diff(some, prepend=0).astype(np.uint32)), squeezed(total[some].astype(np.float32))))
    return pa.table([pa.array(x, k) for x, k in zip(list(zip(*out, strict=True)) or [[]] * 4, [pa.int64(), *[pa.binary()] * 3], strict=True)], ["block", "ids", "at", "known"])


def resolved(t: pa.Table) -> pa.Table:
    """(id, known): a block's answers, summed. Blocks of one name have the same ids, which are summed further on anyway."""
    ids = [x for x in t.column("ids").to_pylist() if x is not None]
    if not ids:  # a task that ran again saw its rows in another order: rather none than wrong sums
        raise RuntimeError("answers for a block whose ids are not there")
    ids = np.frombuffer(ids[0], np.int64)
    total = np.zeros(len(ids))
    for i, x in enumerate(t.column("at").is_valid().to_pylist()):
        if x:
            total[np.cumsum(opened(t.column("at")[i], np.uint32))] += opened(t.column("known")[i], np.float32)
    once, back = np.unique(ids, return_inverse=True)
    return pa.table({"id": once, "known": np.bincount(back, total, len(once))})


def costs(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(id, words_nll) of (id, text, key, trusted): the mean cost of a word, null without words. Ids stand for equal rows."""
    spark = docs.sparkSession
    docs = docs.where("text IS NOT NULL").select("id", "text", "key", "trusted")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = max(LEAST_RANGES, -(-3 * size // (2 * RANGE_BYTES * PASSES)))
    parts = PASSES * each
    pairs, words, values = fit(trusted, parts)
    docs = docs.where(F.col("key").isin(*values.langs))
    hot = spark.sparkContext.broadcast(hot_keys(pairs, words, values))
    n = docs.mapInArrow(lambda it: measured(it, values, hot.value), "id long, key string, words long, known double").groupBy("id")
    n = settle(n.agg(F.max("key").alias("key"), F.max("words").alias("words"), F.count(F.lit(1)).alias("copies"), F.sum("known").alias("hot")), "words")
    known = None
    for k in range(PASSES):
        mine = range(k * each, (k + 1) * each)
        rows = docs.mapInArrow(lambda it, mine=mine: asked_keys(it, hot.value, parts, mine), PACKED)
        here = F.col("p").between(mine.start, mine.stop - 1)
        rows = rows.unionByName(pairs.where(here)).unionByName(words.where(here))
        sums = rows.groupBy("p").applyInArrow(lambda t: looked_up(t, values), ANSWERS).groupBy("block").applyInArrow(lambda t: resolved(t), "id long, known double")
        # A row of a document and pass at most stays on disk, not one of each range.
        before, known = known, settle(sums.groupBy("id").agg(F.sum("known").alias("known")) if known is None else sums.unionByName(known).groupBy("id").agg(F.sum("known").alias("known")), "known")
        if before is not None:
            discard(before)
    discard(pairs, words)
    hot.destroy()
    unknown = F.element_at(F.create_map(*(F.lit(x) for k in values.langs for x in (k, values.unknown(k)))), F.col("key"))
    # Equal rows were looked up each, and are averaged. The mark counts as a word of its own.
    cost = unknown - (F.col("hot") + F.coalesce("known", F.lit(0.0))) / (F.col("copies") * (F.col("words") + 1))
    out = settle(n.join(known, "id", "left").select("id", F.when(F.col("words") > 0, cost).alias("words_nll")), "costs")
    discard(n, known)
    return out
