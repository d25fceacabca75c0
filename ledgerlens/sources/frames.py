"""Typed frames: lists of byte strings to values and back, after a list of type names."""

from __future__ import annotations

import base64
from dataclasses import dataclass

from ledgerlens.functions import msgpack, numbers

_TEXT = {"string": "utf-8", "utf8": "utf-8", "utf-8": "utf-8", "ascii": "ascii", "latin1": "latin-1", "binary": "latin-1", "utf16le": "utf-16-le", "ucs2": "utf-16-le"}


def _uint_bytes(v: int) -> bytes:
    if not 0 <= v <= numbers.MAX_SAFE:
        raise ValueError("unsigned integer out of range")
    return v.to_bytes(max(1, (v.bit_length() + 7) // 8), "little")


def _uint(raw: bytes, nullable: bool) -> int | None:
    if not raw:
        if nullable:
            return None
        raise ValueError("no bytes for an integer that can't be null")
    v = int.from_bytes(raw, "little")
    if v > numbers.MAX_SAFE:
        raise ValueError("integer too wide")
    return v


def encode(kind: str, v) -> bytes:
    if kind in _TEXT:
        return b"" if v is None else str(v).encode(_TEXT[kind])
    if kind == "hex":
        return bytes.fromhex(v or "")
    if kind == "base64":
        return base64.b64decode(v or "")
    if kind == "bool":
        return b"\x01" if v else b""
    if kind in ("uint", "unsigned", "nuint", "nunsigned"):
        if v is None:
            if kind[0] == "n":
                return b""
            raise ValueError("null for an integer that can't be null")
        return _uint_bytes(v)
    if kind in ("int", "integer", "nint", "ninteger"):
        if v is None and kind[0] != "n":
            raise ValueError("null for an integer that can't be null")
        return numbers.int_to_bytes(v)
    if kind in ("number", "nnumber"):
        if v is None and kind[0] != "n":
            raise ValueError("null for a number that can't be null")
        return numbers.number_to_bytes(v)
    if kind in ("object", "json", "any"):
        return b"" if v is None else msgpack.pack(v)
    if kind in ("buffer", "bytes"):
        return b"" if v is None else bytes(v)
    raise TypeError(f"unknown type of a frame: {kind}")


def decode(kind: str, raw: bytes):
    if kind in _TEXT:
        return raw.decode(_TEXT[kind])
    if kind == "hex":
        return raw.hex()
    if kind == "base64":
        return base64.b64encode(raw).decode()
    if kind == "bool":
        return bool(raw) and raw[0] != 0
    if kind in ("uint", "unsigned", "nuint", "nunsigned"):
        return _uint(raw, kind[0] == "n")
    if kind in ("int", "integer", "nint", "ninteger", "number", "nnumber"):
        v = numbers.bytes_to_int(raw) if "int" in kind else numbers.bytes_to_number(raw)
        if v is None and kind[0] != "n":
            raise ValueError("no bytes for a number that can't be null")
        return v
    if kind in ("object", "json", "any"):
        return msgpack.unpack(raw) if raw else None
    if kind in ("buffer", "bytes"):
        return raw
    raise TypeError(f"unknown type of a frame: {kind}")


@dataclass(frozen=True)
class FrameSchema:
    """kinds by position; the first ``required`` must be there; with ``extra`` more frames may follow as bytes."""

    kinds: tuple[str, ...]
    required: int | None = None
    extra: bool = False

    def __post_init__(self):
        for k in self.kinds:
            try:
                decode(k, b"")
            except TypeError:
                raise
            except ValueError:
                pass

    @property
    def least(self) -> int:
        return len(self.kinds) if self.required is None else self.required

    def encode(self, values: list) -> list[bytes]:
        if len(values) < self.least or (len(values) > len(self.kinds) and not self.extra):
            raise ValueError("wrong number of frames")
        return [encode(k, v) for k, v in zip(self.kinds, values)] + [bytes(x) for x in values[len(self.kinds) :]]

    def decode(self, frames: list[bytes]) -> list:
        if len(frames) < self.least or (len(frames) > len(self.kinds) and not self.extra):
            raise ValueError("wrong number of frames")
        return [decode(k, f) for k, f in zip(self.kinds, frames)] + list(frames[len(self.kinds) :])


# Frames of the messages by name, requests and their responses.
MESSAGES = {
    "dispatch": (FrameSchema(("buffer", "buffer"), extra=True), FrameSchema((), extra=True)),
    "request_vote": (FrameSchema(("buffer", "buffer", "string", "uint", "uint", "uint")), FrameSchema(("uint", "bool"))),
    "append_entries": (FrameSchema(("buffer", "buffer", "string", "uint", "uint", "uint", "uint"), extra=True), FrameSchema(("uint", "bool", "uint", "uint"), required=2)),
    "install_snapshot": (FrameSchema(("buffer", "buffer", "string", "uint", "uint", "uint", "uint", "uint", "buffer")), FrameSchema(("uint", "uint"), required=1)),
    "request_update": (FrameSchema(("buffer", "buffer", "buffer")), FrameSchema(("bool", "object"), required=1)),
    "config_update": (FrameSchema(("buffer", "buffer", "object")), FrameSchema(("uint", "object"), required=1)),
    "request_entries": (FrameSchema(("buffer", "buffer", "uint", "nuint", "uint"), required=3), FrameSchema(("uint", "object", "uint"), required=2, extra=True)),
    "request_config": (FrameSchema(("buffer", "buffer")), FrameSchema(("bool", "object", "object"))),
    "request_log_info": (FrameSchema(("buffer", "buffer")), FrameSchema(("bool", "object", "uint", "uint", "uint", "uint", "uint", "uint", "uint"))),
    "state_broadcast": (FrameSchema(("buffer", "uint", "uint"), extra=True), FrameSchema(())),
}
