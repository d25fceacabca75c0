import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import codec, msgpack, numbers


def one(spark, column, **values):
    row = [tuple(values.values())]
    return spark.createDataFrame(row, list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, kind, term, data",
    [
        ("1112131415161718191a1b1c02ffffffffffff1fc0", 2, 9007199254740991, "c0"),
        ("5956dc8826f27e10dcccab20002a000000000000666f6f", 0, 42, "666f6f"),
        ("000000000000000000000000022b000000000000c0", 2, 43, "c0"),
    ],
)
def test_entry_both_ways(spark, raw, kind, term, data):
    b = bytearray.fromhex(raw)
    e = F.col("e")
    d = spark.createDataFrame([(b,)], "e binary")
    got = d.select(codec.entry_type(e), codec.entry_term(e), F.lower(F.hex(codec.entry_data(e))), F.lower(F.hex(codec.request_id(e))), codec.build_entry(codec.request_id(e), codec.entry_type(e), codec.entry_term(e), codec.entry_data(e))).first()
    assert got[:4] == (kind, term, data, raw[:24]) and bytes(got[4]) == bytes(b)


def test_short_entry_is_an_error(spark):
    with pytest.raises(Exception, match="shorter"):
        spark.createDataFrame([(bytearray(10),)], "e binary").select(codec.entry_type(F.col("e"))).collect()


def test_ids(spark):
    for text, sec in (("5816b41e26f27e0494708988", 1477882910), ("WBa0HibyfgSUcImI", 1477882910), ("0" * 24, 0)):
        assert one(spark, codec.id_seconds(codec.id_from_text(F.col("t"))), t=text) == sec
    for bad in ("foo", "5816B41E26F27E0494708988", ""):
        assert one(spark, codec.is_ident_text(F.col("t")), t=bad) is False
    assert one(spark, codec.is_ident(F.col("t")), t=bytearray(12)) and not one(spark, codec.is_ident(F.col("t")), t=bytearray(16))


def test_expiry_boundaries(spark):
    ttl, now = 10_000, 1_000_000_000_000
    f = lambda sec: (one(spark, codec.request_expired(F.col("s"), now, ttl), s=sec), one(spark, codec.request_sanity(F.col("s"), now, ttl, 2000, 1000), s=sec))
    at = now // 1000
    assert f(at - 10) == (False, -1)
    assert f(at - 11) == (True, -1)
    assert f(at - 8) == (False, 0)
    assert f(at + 1) == (False, 0)
    assert f(at + 2) == (False, 1)
    assert one(spark, codec.request_expired(F.col("s"), now, None), s=0) is False


def test_uint_and_paths(spark):
    for v in (0, 1, 255, 256, 65535, 1 << 24, (1 << 53) - 1):
        raw = one(spark, codec.uint_bytes(F.col("v")), v=v)
        assert int.from_bytes(raw, "little") == v and len(raw) == max(1, (v.bit_length() + 7) // 8)
        assert one(spark, codec.uint_value(F.col("r")), r=bytearray(raw)) == v
    assert one(spark, codec.uint_value(F.col("r"), nullable=True), r=bytearray()) is None
    with pytest.raises(Exception):
        one(spark, codec.uint_value(F.col("r")), r=bytearray())
    assert one(spark, codec.segment_path(F.col("i")), i=0x1FFFFFFF02) == "00001/ff/ff/00001fffffff02.rlog"
    assert one(spark, codec.index_of_path(F.col("p")), p="x/00000/00/01/00000000123456.rlog") == 0x123456
    assert one(spark, codec.index_of_path(F.col("p")), p="x/00000/00/00/00000000123456.rlog") is None
    assert one(spark, codec.index_of_path(codec.segment_path(F.col("i"))), i=0x123456) == 0x123456
    want = [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6]
    assert [r[0] for r in spark.range(11).select(codec.majority_of(F.col("id"))).collect()] == want
    got = spark.range(1, 200).select("id", codec.next_power_of_two(F.col("id")).alias("p"), codec.is_power_of_two(F.col("id")).alias("q")).collect()
    for r in got:
        assert r.p == 1 << (r.id - 1).bit_length() and r.q == (r.id & (r.id - 1) == 0)


def test_numbers_golden_and_sweeps():
    assert numbers.number_to_bytes((1 << 53) - 1).hex() == "ffffffffffff1f"
    assert numbers.number_to_bytes(-(1 << 53) + 1).hex() == "010000000000e0"
    assert numbers.number_to_bytes(3.141592653589793).hex() == "182d4454fb210940"
    assert numbers.number_to_bytes(2.718281828459045).hex() == "6957148b0abf0540"
    assert numbers.number_to_bytes(1.7976931348623157e308).hex() == "ffffffffffffef7f"
    rng = random.Random(3)
    for v in [s * (1 << k) + o for s in (1, -1) for k in range(53) for o in (-1, 0, 1)] + [rng.randrange(-(1 << 53) + 1, 1 << 53) for _ in range(500)]:
        if abs(v) <= numbers.MAX_SAFE:
            assert numbers.bytes_to_int(numbers.int_to_bytes(v)) == v and numbers.bytes_to_number(numbers.number_to_bytes(v)) == v
    for _ in range(200):
        v = rng.uniform(-1e9, 1e9)
        assert numbers.bytes_to_number(numbers.number_to_bytes(v)) == v
    assert numbers.int_to_bytes(None) == b"" and numbers.bytes_to_int(b"") is None
    with pytest.raises(ValueError):
        numbers.int_to_bytes(1 << 53)
    with pytest.raises(ValueError):
        numbers.bytes_to_number(bytes(9))


def test_number_columns(spark):
    d = spark.createDataFrame([(-5,), (1 << 40,), (None,)], "v bigint")
    got = [r.x for r in d.select(numbers.int_value(numbers.int_bytes("v")).alias("x")).collect()]
    assert got == [-5, 1 << 40, None]
    d = spark.createDataFrame([(0.5,), (7.0,)], "v double")
    assert [r.x for r in d.select(numbers.number_value(numbers.number_bytes("v")).alias("x")).collect()] == [0.5, 7.0]


def test_msgpack_round_trip():
    at = datetime(2024, 5, 6, 7, 8, 9, 123000, tzinfo=timezone.utc)
    for v in (None, True, False, 0, 127, 128, -1, -32, -33, 1 << 33, -(1 << 40), 1.5, "", "ż" * 40, b"x" * 300, [1, [2, None]], {"a": {"b": [1]}, "c": "d" * 70000}, at, list(range(20)), {str(i): i for i in range(20)}):
        assert msgpack.unpack(msgpack.pack(v)) == v
    assert msgpack.unpack(b"\xd4\x05\x07") == (5, b"\x07")
    assert msgpack.pack(None) == b"\xc0"
    whole = msgpack.pack({"a": 1}) + msgpack.pack({"b": 2})
    assert msgpack.unpack_all(whole) == ([{"a": 1}, {"b": 2}], False)
    assert msgpack.unpack_all(whole[:-1]) == ([{"a": 1}], True)
    with pytest.raises(ValueError):
        msgpack.unpack(b"\xc1")


def test_msgpack_columns(spark):
    d = spark.createDataFrame([('{"a":[1,null,"x"]}',), (None,)], "j string")
    got = [r.x for r in d.select(msgpack.msgpack_to_json(msgpack.json_to_msgpack("j")).alias("x")).collect()]
    assert got == ['{"a":[1,null,"x"]}', None]
