"""MessagePack, after its public specification: Python values, and columns by Arrow UDF.

Timestamps (extension -1) become datetimes in UTC; other extensions become (code, bytes).
"""

from __future__ import annotations

import base64
import json
import struct
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
# Markers with a fixed body.
_SCALARS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_LENGTHS = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xC7: ("ext", ">B"), 0xC8: ("ext", ">H"), 0xC9: ("ext", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}
_FIXEXT = {0xD4: 1, 0xD5: 2, 0xD6: 4, 0xD7: 8, 0xD8: 16}


class Truncated(ValueError):
    """The bytes end within a value."""


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise Truncated(f"{n} bytes wanted at {self.at}")
        self.at += n
        return out

    def number(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def value(self):
        m = self.take(1)[0]
        if m < 0x80:
            return m
        if m >= 0xE0:
            return m - 256
        if m < 0x90:
            return self.sized("map", m & 15)
        if m < 0xA0:
            return self.sized("list", m & 15)
        if m < 0xC0:
            return self.sized("str", m & 31)
        if m in _SCALARS:
            return self.number(_SCALARS[m])
        if m in _LENGTHS:
            kind, form = _LENGTHS[m]
            return self.sized(kind, self.number(form))
        if m in _FIXEXT:
            return self.sized("ext", _FIXEXT[m])
        if m == 0xC0:
            return None
        if m in (0xC2, 0xC3):
            return m == 0xC3
        raise ValueError(f"marker {m:#x} is not in use")

    def sized(self, kind: str, n: int):
        if kind == "str":
            return self.take(n).decode("utf-8")
        if kind == "bin":
            return self.take(n)
        if kind == "list":
            return [self.value() for _ in range(n)]
        if kind == "map":
            return {self.key(): self.value() for _ in range(n)}
        code = struct.unpack(">b", self.take(1))[0]
        body = self.take(n)
        return _timestamp(body) if code == -1 else (code, body)

    def key(self):
        k = self.value()
        return k if isinstance(k, (str, int, bytes, bool, float)) or k is None else str(k)


def _timestamp(body: bytes) -> datetime:
    if len(body) == 4:
        sec, nano = struct.unpack(">I", body)[0], 0
    elif len(body) == 8:
        both = struct.unpack(">Q", body)[0]
        nano, sec = both >> 34, both & (1 << 34) - 1
    else:
        nano, sec = struct.unpack(">Iq", body)
    return _EPOCH + timedelta(seconds=sec, microseconds=nano // 1000)


def unpack(data: bytes):
    """One value that takes all bytes."""
    r = Reader(data)
    out = r.value()
    if r.at != len(data):
        raise ValueError(f"{len(data) - r.at} bytes after the value")
    return out


def unpack_all(data: bytes) -> tuple[list, bool]:
    """Values one after another, and whether the last one is torn (it is left out)."""
    r, out = Reader(data), []
    while r.at < len(data):
        try:
            out.append(r.value())
        except Truncated:
            return out, True
    return out, False


def _head(n: int, fix: int | None, limit: int, forms: list[tuple[int, str]]) -> bytes:
    if fix is not None and n < limit:
        return bytes([fix | n])
    for marker, form in forms:
        if n < 1 << 8 * struct.calcsize(form):
            return bytes([marker]) + struct.pack(form, n)
    raise ValueError("too long")


def pack(v) -> bytes:
    if v is None:
        return b"\xc0"
    if isinstance(v, bool):
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        if 0 <= v < 128:
            return bytes([v])
        if -32 <= v < 0:
            return bytes([v + 256])
        for m in (0xCC, 0xCD, 0xCE, 0xCF) if v >= 0 else (0xD0, 0xD1, 0xD2, 0xD3):
            try:
                return bytes([m]) + struct.pack(_SCALARS[m], v)
            except struct.error:
                continue
        raise ValueError("integer out of range")
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        raw = v.encode()
        return _head(len(raw), 0xA0, 32, [(0xD9, ">B"), (0xDA, ">H"), (0xDB, ">I")]) + raw
    if isinstance(v, (bytes, bytearray)):
        return _head(len(v), None, 0, [(0xC4, ">B"), (0xC5, ">H"), (0xC6, ">I")]) + bytes(v)
    if isinstance(v, datetime):
        d = v - _EPOCH
        sec, nano = d.days * 86400 + d.seconds, d.microseconds * 1000
        if nano == 0 and 0 <= sec < 1 << 32:
            return b"\xd6\xff" + struct.pack(">I", sec)
        if 0 <= sec < 1 << 34:
            return b"\xd7\xff" + struct.pack(">Q", nano << 34 | sec)
        return b"\xc7\x0c\xff" + struct.pack(">Iq", nano, sec)
    if isinstance(v, dict):
        return _head(len(v), 0x80, 16, [(0xDE, ">H"), (0xDF, ">I")]) + b"".join(pack(k) + pack(x) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return _head(len(v), 0x90, 16, [(0xDC, ">H"), (0xDD, ">I")]) + b"".join(map(pack, v))
    raise TypeError(f"{type(v).__name__} can't be packed")


def _plain(v):
    if isinstance(v, bytes):
        return base64.b64encode(v).decode()
    if isinstance(v, datetime):
        return v.isoformat().replace("+00:00", "Z")
    if isinstance(v, tuple):
        return {"ext": v[0], "data": base64.b64encode(v[1]).decode()}
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def to_json(data: bytes | None) -> str | None:
    """JSON text of one value; null for bytes that are no value."""
    try:
        return None if data is None else json.dumps(_plain(unpack(data)), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def msgpack_to_json(data: pd.Series) -> pd.Series:
    return data.map(to_json)


@F.pandas_udf(T.BinaryType())
def json_to_msgpack(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else pack(json.loads(x)))
