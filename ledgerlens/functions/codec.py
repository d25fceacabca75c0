"""Decoders and encoders of log entries and their scalars as SQL expressions.

Layout of an entry: 12 bytes request id, 1 byte type, 7 bytes term (least byte first), data.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

REQUEST_ID_BYTES = 12
HEADER_BYTES = 20
STATE, CONFIG, CHECKPOINT = 0, 1, 2
MAX_SAFE = (1 << 53) - 1
ZERO_ID = bytes(REQUEST_ID_BYTES)


def _byte(data: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, 1)), 16, 10).cast("bigint")


def _checked(value: Column, entry: Column, least: int = HEADER_BYTES) -> Column:
    return F.when(F.length(entry) >= least, value).when(entry.isNotNull(), F.raise_error(F.lit("a log entry is shorter than its header")))


def entry_type(entry: Column) -> Column:
    return _checked(_byte(entry, 12).cast("int"), entry)


def uint_le(data: Column, start: int, size: int) -> Column:
    """Unsigned little-endian integer of ``size`` bytes at ``start``."""
    digits = F.concat(*[F.hex(F.substring(data, start + i + 1, 1)) for i in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("bigint")


def entry_term(entry: Column) -> Column:
    return _checked(uint_le(entry, 13, 7), entry)


def request_id(entry: Column) -> Column:
    return _checked(F.substring(entry, 1, REQUEST_ID_BYTES), entry)


def request_key(entry: Column, encoding: str = "base64") -> Column:
    raw = request_id(entry)
    return F.base64(raw) if encoding == "base64" else F.lower(F.hex(raw))


def entry_data(entry: Column) -> Column:
    return _checked(F.substring(entry, HEADER_BYTES + 1, 2147483647), entry)


def le_hex(value: Column, size: int) -> Column:
    """Hex of an unsigned integer, least byte first, padded to ``size`` bytes."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def build_entry(rid: Column, kind: Column, term: Column, data: Column) -> Column:
    """Bytes of an entry; rid is 12 bytes, null for the all-zero id."""
    checked = F.when(term.between(0, MAX_SAFE), term).otherwise(F.raise_error(F.lit("term out of range")))
    head = F.unhex(F.concat(F.coalesce(F.hex(rid), F.lit("00" * REQUEST_ID_BYTES)), F.lpad(F.hex(kind.cast("bigint")), 2, "0"), le_hex(checked, 7)))
    return F.concat(head, data)


def id_from_text(text: Column) -> Column:
    """12 bytes of an id written as 24 lowercase hex digits or 16 base64 letters; else null."""
    return F.when(text.rlike("^[0-9a-f]{24}$"), F.unhex(text)).when(text.rlike("^[A-Za-z0-9+/]{16}$"), F.unbase64(text))


def is_ident(raw: Column) -> Column:
    return F.coalesce(F.length(raw) == REQUEST_ID_BYTES, F.lit(False))


def is_ident_text(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{24}$"), F.lit(False))


def id_seconds(rid: Column) -> Column:
    """Seconds since the epoch: the first four bytes, most significant first."""
    return F.conv(F.hex(F.substring(rid, 1, 4)), 16, 10).cast("bigint")


def new_ident(seconds: Column, process: Column, counter: Column) -> Column:
    """12 bytes: seconds (4), the five bytes that name the writer, a counter that wraps at 3 bytes."""
    number = F.lpad(F.hex(F.pmod(counter, F.lit(1 << 24))), 6, "0")
    name = F.when(F.length(process) == 5, F.hex(process)).otherwise(F.raise_error(F.lit("a writer's name has five bytes")))
    return F.unhex(F.concat(F.lpad(F.hex(seconds.cast("bigint")), 8, "0"), name, number))


def writer_name(host: str, pid: int) -> bytes:
    """Five bytes: the first three of the host's MD5, then the process number's lower two."""
    return hashlib.md5(host.encode()).digest()[:3] + (pid & 0xFFFF).to_bytes(2, "big")


def update_request(data: Column, rid: Column) -> Column:
    """struct(data, request_id): the bytes of an update with the id that makes it idempotent."""
    return F.struct(data.alias("data"), rid.alias("request_id"))


def is_update_request(request: Column) -> Column:
    return request["data"].isNotNull() & is_ident(request["request_id"])


def id_is_set(rid: Column) -> Column:
    return rid != F.lit(ZERO_ID)


def request_expired(seconds: Column, now_ms: int, ttl_ms: int | None) -> Column:
    """Strictly older than the time to live; without one nothing ever expires."""
    return F.lit(False) if ttl_ms is None else seconds * 1000 < F.lit(now_ms - ttl_ms)


def request_sanity(seconds: Column, now_ms: int, ttl_ms: int | None, past_ms: int = 0, future_ms: int = 0) -> Column:
    """-1 too old, 1 from the far future, 0 acceptable."""
    if ttl_ms is None:
        return F.lit(0)
    at = seconds * 1000
    return F.when(at < F.lit(now_ms - (ttl_ms - past_ms)), -1).when(at > F.lit(now_ms + future_ms), 1).otherwise(0)


def bool_value(raw: Column) -> Column:
    """Empty is false; otherwise the first byte decides."""
    return F.coalesce((F.length(raw) > 0) & (F.substring(raw, 1, 1) != F.lit(b"\x00")), F.lit(False))


def uint_value(raw: Column, nullable: bool = False) -> Column:
    """Unsigned little-endian integer of 0 to 7 significant bytes; an empty one is null or an error."""
    n = F.length(raw)
    digits = F.array_join(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: F.hex(F.substring(raw, 1, 2147483647).substr(i + 1, F.lit(1)))), "")
    value = F.conv(digits, 16, 10).cast("bigint")
    empty = F.lit(None).cast("bigint") if nullable else F.raise_error(F.lit("no bytes for an integer that can't be null")).cast("bigint")
    return F.when(n > 7, F.raise_error(F.lit("integer too wide")).cast("bigint")).when(n == 0, empty).otherwise(value)


def uint_bytes(value: Column) -> Column:
    """The least number of bytes, least byte first; zero takes one."""
    digits = F.hex(value)
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    pairs = F.transform(F.sequence((F.length(even) / 2).cast("int") - 1, F.lit(0), F.lit(-1)), lambda i: even.substr(2 * i + 1, F.lit(2)))
    return F.unhex(F.array_join(pairs, ""))


def segment_base_name(index: Column) -> Column:
    return F.lpad(F.lower(F.hex(index)), 14, "0")


def segment_path(index: Column, suffix: str = ".rlog") -> Column:
    """<5 hex>/<2>/<2>/<14 hex><suffix>"""
    name = segment_base_name(index)
    return F.concat_ws("/", F.substring(name, 1, 5), F.substring(name, 6, 2), F.substring(name, 8, 2), F.concat(name, F.lit(suffix)))


def index_of_path(path: Column) -> Column:
    """First index of a segment's path; null where the name or its folders don't match."""
    rx = r"([0-9a-f]{5})/([0-9a-f]{2})/([0-9a-f]{2})/([0-9a-f]{14})\.rlog$"
    name = F.regexp_extract(path, rx, 4)
    folders = F.concat(*[F.regexp_extract(path, rx, i) for i in (1, 2, 3)])
    return F.when((name != "") & (folders == F.substring(name, 1, 9)), F.conv(name, 16, 10).cast("bigint"))


def segment_first_index(index: Column, capacity: int, log_first: int = 1) -> Column:
    return F.greatest(F.lit(log_first).cast("bigint"), index - index % capacity)


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def next_power_of_two(n: Column) -> Column:
    """Least power of two not under n; 0 and less give 0."""
    bits = F.length(F.bin(n - 1))
    return F.when(n <= 0, F.lit(0).cast("bigint")).when(n == 1, F.lit(1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int")))


def majority_of(n: Column) -> Column:
    return F.shiftright(n, 1) + 1


def regexp_escape(text: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(text, r"([-/\\^$*+?.()|\[\]{}])", r"\\$1")
