"""The value model: type tags and their total order, extended JSON, and order-preserving bytes."""

from __future__ import annotations

import base64
import binascii
import math
import struct
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from typing import Any

NULL, NUMBER, STRING, FALSE, TRUE, ARRAY, OBJECT, BINARY, VECTOR, OBJECT_ID, DATE = 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12
#: Names that $type knows, with their tags; binary cannot be named.
TYPE_NAMES = {"null": NULL, "number": NUMBER, "string": STRING, "false": FALSE, "true": TRUE, "array": ARRAY, "object": OBJECT, "vectorF32": VECTOR, "objectId": OBJECT_ID, "dateTime": DATE}


class _Missing:
    def __repr__(self) -> str:
        return "MISSING"

    def __bool__(self) -> bool:
        return False


#: A field that is not there; encodes and compares like null, but does not exist.
MISSING = _Missing()


@dataclass(frozen=True)
class Vector:
    items: tuple[float, ...]


@dataclass(frozen=True)
class ObjectId:
    hex: str


EPOCH = datetime(1970, 1, 1)
_TAGS = ((int | float, NUMBER), (str, STRING), (list | tuple, ARRAY), (dict, OBJECT), (bytes | bytearray, BINARY), (Vector, VECTOR), (ObjectId, OBJECT_ID), (datetime, DATE))


def millis(t: datetime) -> int:
    if t.tzinfo:
        t = t.astimezone(UTC).replace(tzinfo=None)
    return (t - EPOCH) // timedelta(milliseconds=1)


def from_millis(ms: int) -> datetime:
    return EPOCH + timedelta(milliseconds=ms)


def tag(v: Any) -> int:
    if v is None or v is MISSING:
        return NULL
    if isinstance(v, bool):
        return TRUE if v else FALSE
    for kind, t in _TAGS:
        if isinstance(v, kind):
            return t
    raise TypeError(f"no document value: {type(v).__name__}")


def key(v: Any) -> bytes:
    """Bytes whose unsigned order is the total order of values: the tag, then the value in its type's own order."""
    t = tag(v)
    head = bytes([t])
    if t in (NULL, FALSE, TRUE):
        return head
    if t == NUMBER:
        return head + _float_key(float(v))
    if t == STRING:
        return head + v.encode("utf-8", "surrogatepass").replace(b"\0", b"\0\xff") + b"\0"
    if t == ARRAY:
        return head + b"".join(map(key, v)) + b"\0"
    if t == OBJECT:
        return head + b"".join(k.encode().replace(b"\0", b"\0\xff") + b"\0" + key(x) for k, x in v.items()) + b"\0"
    if t == BINARY:
        return head + struct.pack(">I", len(v)) + bytes(v)
    if t == VECTOR:
        return head + struct.pack(f"<{len(v.items)}f", *v.items)
    if t == OBJECT_ID:
        return head + bytes.fromhex(v.hex)
    return head + struct.pack(">Q", millis(v) + (1 << 63))


def _float_key(x: float) -> bytes:
    (n,) = struct.unpack(">Q", struct.pack(">d", 0.0 if x == 0 else x))
    return struct.pack(">Q", n ^ 0xFFFFFFFFFFFFFFFF if n >> 63 else n | (1 << 63))


def same(a: Any, b: Any) -> bool:
    """Structural equality, blind to the order of fields."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list | tuple) and isinstance(b, list | tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return key(a) == key(b)


def decode(v: Any) -> Any:
    """Extended JSON to values; wrappers with a bad payload stay objects."""
    if isinstance(v, list):
        return [decode(x) for x in v]
    if not isinstance(v, dict):
        return v
    if len(v) == 1:
        ((k, x),) = v.items()
        try:
            if k == "$date" and not isinstance(x, bool):
                if isinstance(x, int | float):
                    return from_millis(int(x))
                if isinstance(x, str):
                    return from_millis(millis(datetime.fromisoformat(x.replace("Z", "+00:00"))))
            if k == "$oid" and isinstance(x, str) and len(x) == 24:
                return ObjectId(bytes.fromhex(x).hex())
            if k == "$binary" and isinstance(x, str):
                return base64.b64decode(x, validate=True)
            if k == "$vector" and isinstance(x, list) and x and all(isinstance(i, int | float) and not isinstance(i, bool) and math.isfinite(i) for i in x):
                return Vector(struct.unpack(f"<{len(x)}f", struct.pack(f"<{len(x)}f", *x)))
        except (ValueError, OverflowError, binascii.Error, struct.error):
            pass
    return {k: decode(x) for k, x in v.items()}


def encode(v: Any) -> Any:
    """Values to extended JSON."""
    if isinstance(v, datetime):
        return {"$date": from_millis(millis(v)).isoformat(timespec="milliseconds") + "Z"}
    if isinstance(v, ObjectId):
        return {"$oid": v.hex}
    if isinstance(v, bytes | bytearray):
        return {"$binary": base64.b64encode(v).decode()}
    if isinstance(v, Vector):
        return {"$vector": list(v.items)}
    if isinstance(v, list | tuple):
        return [encode(x) for x in v]
    if isinstance(v, dict):
        return {k: encode(x) for k, x in v.items()}
    return v
