"""Dumps of logs, snapshots and state files as plain files and rows for people to read."""

from __future__ import annotations

import base64
import gzip
import io
import json
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import msgpack

from . import formats

DECODERS = ("json", "hex", "length", "text")


def decoded(data: Column, how: str) -> Column:
    """Payloads as text: MessagePack as JSON (null where it is none), hex digits, their length, or UTF-8."""
    if how not in DECODERS:
        raise ValueError(f"payloads are decoded as one of {', '.join(DECODERS)}: {how}")
    if how == "json":
        return msgpack.msgpack_to_json(data)
    return {"hex": F.lower(F.hex(data)), "length": F.octet_length(data).cast("string"), "text": data.cast("string")}[how]


def _put(path: str, data: bytes) -> None:
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "wb") as f:
        f.write(data)
    os.replace(tmp, path)


def dump_entries(log: DataFrame, folder: str, as_json: bool = False) -> DataFrame:
    """Writes <16 hex digits of the index>.meta (type:base64 id:term) and .data for each entry; (log_index, name) of all.

    The folder must be mounted on all nodes. Each file appears whole; a task that is run again
    writes the same ones anew. With ``as_json`` payloads are MessagePack and written as JSON.
    The files are written when the result is first used.
    """
    os.makedirs(folder, exist_ok=True)

    def work(batches):
        for b in batches:
            names = []
            for index, kind, rid, term, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                name = f"{index:016x}"
                text = msgpack.to_json(data) if as_json else None
                if as_json and text is None:
                    raise formats.FormatError(f"the payload of entry {index} is no MessagePack")
                _put(os.path.join(folder, f"{name}.meta"), f"{kind}:{base64.b64encode(rid).decode()}:{term}".encode())
                _put(os.path.join(folder, f"{name}.data"), text.encode() if as_json else data or b"")
                names.append(name)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string())], ["log_index", "name"])

    at = log.select(F.col("log_index").cast("bigint"), F.col("entry_type").cast("int"), F.coalesce("request_id", F.lit(bytes(12))), F.col("term").cast("bigint"), "data")
    return at.mapInArrow(work, "log_index bigint, name string")


def read_dump(spark: SparkSession, folder: str) -> DataFrame:
    """(name, meta, data) of a folder of dumped entries."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([0-9a-f]{16})\.(meta|data)$", 1).alias("name"), F.regexp_extract("path", r"\.(meta|data)$", 1).alias("part"), "content")
    part = lambda p: F.max(F.when(F.col("part") == p, F.col("content")))
    return files.filter("name <> ''").groupBy("name").agg(part("meta").cast("string").alias("meta"), part("data").alias("data"))


def _values(spark: SparkSession, path: str, payload, unzip: bool) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches):
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = payload(raw)
                if unzip:
                    data = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
                values, torn = msgpack.unpack_all(data)
                if torn:
                    raise formats.FormatError(f"the last value of {p} is cut off")
                for at in range(0, len(values), 4096):
                    some = [json.dumps(msgpack._plain(v), ensure_ascii=False, separators=(",", ":")) for v in values[at : at + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(some)), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some)], ["path", "seq", "value"])

    return files.mapInArrow(work, "path string, seq bigint, value string")


def dump_snapshot(spark: SparkSession, path: str, unzip: bool = False) -> DataFrame:
    """(path, seq, value): the MessagePack values of snapshots as JSON; ``unzip`` where payloads are gzip."""

    def payload(raw: bytes) -> bytes:
        return raw[formats.parse_snapshot(raw)["data_offset"] :]

    return _values(spark, path, payload, unzip)


def dump_state(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, value): the history of state files, each change as JSON."""
    return _values(spark, path, lambda raw: raw, False)
