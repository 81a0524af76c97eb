"""Vectorised work on the bytes of Arrow string columns: words, their hashes, shingles, digests of sets.

Nothing here loops over words or characters in Python. A block is a run of whole documents of bounded size in bytes, so
memory follows the block (or the longest single document), not the batch or the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}

#: ASCII capitals folded, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words of digits, letters and all that is not ASCII (after folding).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def trim() -> None:
    """Give back memory that a worker has freed: Spark keeps its workers, and each would keep its greatest task's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is GNU's
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(f: Callable) -> Callable:
    """A function of a task's batches, or of a group, that gives back memory when it ends."""

    @functools.wraps(f)
    def whole(*args: Any, **more: Any) -> Any:
        out = f(*args, **more)
        if isinstance(out, Iterator):
            return then_trim(out)
        trim()
        return out

    return whole


def then_trim(it: Iterator) -> Iterator:
    yield from it
    trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        m = max(n, BLOCK_BYTES)
        for k, base in (("p", _ODD), ("i", _INV)):
            x = np.full(m, base, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["i"][:n]


def string_column(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column with nulls as empty texts and 64-bit offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts, each of at most limit bytes or one text."""
    col = string_column(col)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes for which `inside` holds, within documents; first run of each document."""
    n = len(data)
    m = inside[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = m[:-1], m[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    starts, stops = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def hashes(low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of low[start:stop], by differences of one running polynomial for each piece of bounded size."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + BLOCK_BYTES, "right")))
        a, b = int(starts[i]), int(stops[j - 1])
        p, inverse = powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((low[a:b].astype(np.uint64) + np.uint64(1)) * p[: b - a], out=total[1:])
        s, e = starts[i:j] - a, stops[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _M3)
        i = j
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the folded words, and the first word of each document."""
    low = LOWER[data]
    starts, stops, first = spans(low, offsets, inside)
    return hashes(low, starts, stops), starts, stops, first


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words that lie within one document, and the index of each one's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        acc *= _M3
        acc += h[j : j + n]
    ok = np.ones(len(h), bool)
    for t in range(1, k):
        p = first[1:] - t
        ok[p[p >= first[:-1]]] = False
    at = np.flatnonzero(ok[:n])
    return mix(acc[at]), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each document; shorter documents have their whole sequence as one."""
    h, _, _, first = word_hashes(data, offsets, NOT_SPACE)
    w, at = windows(h, first, k)
    cut = np.searchsorted(at, first)
    out = []
    for d in range(len(offsets) - 1):
        if cut[d + 1] > cut[d]:
            out.append(np.unique(w[cut[d] : cut[d + 1]]))
        elif first[d + 1] > first[d]:
            out.append(windows(h[first[d] : first[d + 1]], np.array([0, first[d + 1] - first[d]]), int(first[d + 1] - first[d]))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
