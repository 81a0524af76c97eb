"""Secret scans: an Aho-Corasick automaton finds keywords, anchored patterns run only at its hits, checksums decide.

The automaton reads the bytes of each text with A-Z folded, so hits are byte positions; patterns are matched at a hit
and nowhere else. Runs of hexadecimal digits have no keyword; they are found as runs of bytes. Kinds with an embedded
checksum or structure (GitHub and npm tokens: CRC-32 in base 62; JSON web tokens: a decodable header; PEM private keys: a
DER length) are kept only if it holds.

Defined results: null and empty texts have no spans; repeated rows are scanned alike; spans are code points with an
exclusive end. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docquery.llm import blocks as B
from docquery.llm.common import id_and_text

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9_])")
JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ )?PRIVATE KEY-----")
#: All kinds, in the order that settles ties of the start.
KINDS = ["assign", "access", "hex", "checked", "jwt", "pem"]
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "eyj": "jwt", "-----begin ": "pem"} | {f"{p}_": "checked" for p in ("ghp", "gho", "ghu", "ghs", "ghr", "npm")}
HEX = np.zeros(256, bool)
HEX[48:58] = HEX[97:103] = True
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_holds(body: str) -> bool:
    """36 characters: 30 random ones, then their CRC-32 in base 62, six digits."""
    n, want = zlib.crc32(body[:30].encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        want = _BASE62[r] + want
    return body[30:] == want


def jwt_holds(token: str) -> bool:
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def pem_holds(body: bytes) -> bool:
    """The key is a DER sequence of exactly the length that it states."""
    try:
        der = base64.b64decode(re.sub(rb"\s", b"", body), validate=True)
    except (binascii.Error, ValueError):
        return False
    if len(der) < 2 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    k = der[1] & 0x7F
    return 0 < k <= 4 and len(der) == 2 + k + int.from_bytes(der[2 : 2 + k], "big")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (ACCESS, lambda m: len(m[0]) >= 16),
    "checked": (CHECKED, lambda m: checksum_holds(m[1].decode())),
    "jwt": (JWT, lambda m: jwt_holds(m[0].decode())),
    "pem": (PEM, lambda m: pem_holds(m[1])),
}


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = automaton()
    for batch in batches:
        for start, end, data, offsets in B.blocks(batch.column("text")):
            found = hex_runs(data, offsets)
            low = B.LOWER[data].tobytes().decode("latin-1")
            raw = data.tobytes()
            at: list[tuple[int, str]] = sorted((last - n + 1, kind) for last, (n, kind) in words.iter(low))
            docs = np.searchsorted(offsets, [p for p, _ in at], "right") - 1
            after: dict[str, int] = {}
            for (p, kind), d in zip(at, docs.tolist(), strict=True):
                rule, holds = RULES[kind]
                if p < after.get(kind, 0) or not (m := rule.match(raw, p, int(offsets[d + 1]))):
                    continue
                after[kind] = m.end()
                if holds(m):
                    found.setdefault(d, []).append((p - int(offsets[d]), KINDS.index(kind), m.end() - int(offsets[d])))
            yield rows(batch.column("doc_id").slice(start, end - start), raw, offsets, found)


def hex_runs(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    s, e, _ = B.spans(data, offsets, HEX)
    long = np.flatnonzero(e - s >= 32)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for a, b, d in zip(s[long].tolist(), e[long].tolist(), (np.searchsorted(offsets, s[long], "right") - 1).tolist(), strict=True):
        found.setdefault(d, []).append((a - int(offsets[d]), 2, b - int(offsets[d])))
    return found


def rows(ids: pa.Array, raw: bytes, offsets: np.ndarray, found: dict[int, list[tuple[int, int, int]]]) -> pa.RecordBatch:
    counts, base, spans = np.zeros((3, len(ids)), np.int64), [_EMPTY] * len(ids), [""] * len(ids)
    for d, got in found.items():
        got.sort()
        text = raw[offsets[d] : offsets[d + 1]]
        if not text.isascii():  # bytes to code points
            lead = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
            points = np.concatenate([[0], lead])
            got = [(int(points[a]), k, int(points[b])) for a, k, b in got]
        for _, k, _ in got:
            if k < 3:
                counts[k, d] += 1
        base[d] = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in got if k < 3).encode()).hexdigest()
        spans[d] = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in got)
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, counts), pa.array(base, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


_EMPTY = hashlib.sha256(b"").hexdigest()


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    return id_and_text(docs).mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def brute_force(text: str | None) -> list[tuple[int, str, int]]:
    """The base spans (start, kind, end) by plain expressions over the whole text; for tests."""
    text, out = text or "", []
    for kind, rule, ok in (("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(rule, text) if ok(m)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))
