"""Signed and floating codecs of frames: Arrow UDFs over the same byte forms."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SAFE = (1 << 53) - 1


def int_to_bytes(v: int | None) -> bytes | None:
    """Least number of bytes of two's complement, least byte first; null is empty."""
    if v is None:
        return b""
    if abs(v) > MAX_SAFE:
        raise ValueError("integer out of the safe range")
    n = 1
    while not -(1 << 8 * n - 1) <= v < 1 << 8 * n - 1:
        n += 1
    return v.to_bytes(n, "little", signed=True)


def bytes_to_int(raw: bytes | None) -> int | None:
    """Empty is null; up to 7 bytes hold an integer, the 8th only extends the sign."""
    if not raw:
        return None
    v = int.from_bytes(raw, "little", signed=True)
    if len(raw) > 8 or abs(v) > MAX_SAFE:
        raise ValueError("integer too wide")
    return v


def number_to_bytes(v: float | int | None) -> bytes:
    """Safe integers as integers, anything else as an 8-byte double."""
    if v is None:
        return b""
    if float(v).is_integer() and abs(v) <= MAX_SAFE and not (v == 0 and str(v).startswith("-")):
        return int_to_bytes(int(v))
    return struct.pack("<d", v)


def bytes_to_number(raw: bytes | None) -> float | None:
    if not raw:
        return None
    if len(raw) > 8:
        raise ValueError("number too wide")
    return struct.unpack("<d", raw)[0] if len(raw) == 8 else float(bytes_to_int(raw))


@F.pandas_udf(T.LongType())
def int_value(raw: pd.Series) -> pd.Series:
    return raw.map(bytes_to_int).astype("Int64")


@F.pandas_udf(T.BinaryType())
def int_bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda x: int_to_bytes(None if pd.isna(x) else int(x)))


@F.pandas_udf(T.DoubleType())
def number_value(raw: pd.Series) -> pd.Series:
    return raw.map(bytes_to_number).astype("float64")


@F.pandas_udf(T.BinaryType())
def number_bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda x: number_to_bytes(None if pd.isna(x) else x))
