"""Snapshot files, state files, configuration files and the detection of file kinds."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import tomllib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats, hjson

SNAPSHOT = "path string, log_index bigint, log_term bigint, data_size bigint, data_offset bigint, meta map<string,string>"


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind) by leading tokens: segment, snapshot or other."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    token = F.substring("content", 1, 4)
    return f.select("path", "length", F.when(token == F.lit(b"RLOG"), "segment").when(token == F.lit(b"SNAP"), "snapshot").otherwise("other").alias("kind"))


def read_snapshots(spark: SparkSession, path: str, chunk: int = 65536) -> tuple[DataFrame, DataFrame]:
    """(meta, chunks): one row a file, and its payload as (path, log_index, log_term, byte_offset, total_length, chunk).

    An empty snapshot is one empty last chunk.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def head(batches):
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                i = formats.parse_snapshot(raw)
                row = (p, i["log_index"], i["log_term"], i["data_size"], i["data_offset"], [(str(k), str(v)) for k, v in i["meta"].items()])
                types = [pa.string()] + [pa.int64()] * 4 + [pa.map_(pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["path", "log_index", "log_term", "data_size", "data_offset", "meta"])

    def body(batches):
        names = ["path", "log_index", "log_term", "byte_offset", "total_length", "chunk"]
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                i = formats.parse_snapshot(raw)
                data = raw[i["data_offset"] :]
                for at in range(0, max(1, len(data)), chunk):
                    row = (p, i["log_index"], i["log_term"], at, len(data), data[at : at + chunk])
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.string()] + [pa.int64()] * 4 + [pa.binary()])], names)

    return files.mapInArrow(head, SNAPSHOT), files.mapInArrow(body, "path string, log_index bigint, log_term bigint, byte_offset bigint, total_length bigint, chunk binary")


def write_snapshot(path: str, index: int, term: int, data: bytes, meta: dict | None = None, history: str | None = None) -> None:
    """Whole or not at all; the file before is kept under the name ``history`` if one is given."""
    tmp = f"{path}.{os.getpid()}.tmp"
    with open(tmp, "wb") as f:
        f.write(formats.build_snapshot(index, term, data, meta))
        f.flush()
        os.fsync(f.fileno())
    if history and os.path.exists(path):
        os.replace(path, history)
    os.replace(tmp, path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, field, value, torn): a row per changed property, value as JSON text ('null' is a value)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches):
        names = ["path", "seq", "field", "value", "torn"]
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                changes, torn = formats.state_changes(raw)
                rows = [(p, i, k, json.dumps(v, separators=(",", ":")), torn) for i, c in enumerate(changes) for k, v in c.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()])], names)

    return files.mapInArrow(work, "path string, seq bigint, field string, value string, torn boolean")


def fold_state(changes: DataFrame, fields: list[str]) -> DataFrame:
    """The last value of each known property; an explicit null is one."""
    return changes.filter(F.col("field").isin(fields)).groupBy("path", "field").agg(F.max_by("value", "seq").alias("value"))


def append_state(path: str, change: dict, state: dict, rotate_bytes: int = 512 * 1024, history: str | None = None) -> dict:
    """Appends the changed properties that the state has, or starts a new file with all of them."""
    from ledgerlens.functions import msgpack

    known = {k: v for k, v in change.items() if k in state}
    after = state | known
    if os.path.exists(path) and os.path.getsize(path) < rotate_bytes:
        with open(path, "ab") as f:
            f.write(msgpack.pack(known))
            f.flush()
            os.fsync(f.fileno())
        return after
    tmp = f"{path}.{os.getpid()}.tmp"
    with open(tmp, "wb") as f:
        f.write(msgpack.pack(after))
        f.flush()
        os.fsync(f.fileno())
    if history and os.path.exists(path):
        os.replace(path, history)
    os.replace(tmp, path)
    return after


def history_to_remove(spark_files: DataFrame, keep: int = 60) -> DataFrame:
    """files(name): rotated names beyond the newest ``keep``, by time stamp and base-36 counter."""
    rx = r"-(\d{4}-\d{2}-\d{2}-\d{6})-([0-9a-z]+)$"
    from pyspark.sql import Window

    f = spark_files.select("name", F.regexp_extract("name", rx, 1).alias("at"), F.regexp_extract("name", rx, 2).alias("n")).filter("at <> ''")
    order = [F.desc("at"), F.desc(F.length("n")), F.desc("n")]
    return f.withColumn("rank", F.row_number().over(Window.partitionBy(F.regexp_replace("name", rx, "")).orderBy(*order))).filter(F.col("rank") > keep).select("name")


def _load_yaml(f):
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{f.name}: yaml needs PyYAML, which isn't installed") from e
    return yaml.safe_load(f)


def read_config(path: str, namespace: str | None = None) -> dict:
    """json, toml, hjson or, where PyYAML is installed, yaml; a namespace is a dotted path, keys of which may hold dots themselves."""
    ext = os.path.splitext(path)[1].lower()
    load = {".json": json.load, ".toml": tomllib.load, ".hjson": hjson.load, ".yaml": _load_yaml, ".yml": _load_yaml}.get(ext)
    if load is None:
        raise ValueError(f"configuration files end in .json, .toml, .hjson, .yaml or .yml: {path}")
    with open(path, "rb") as f:
        out = load(f)
    rest = namespace or ""
    while rest:
        if not isinstance(out, dict):
            raise KeyError(namespace)
        parts = rest.split(".")
        for n in range(len(parts), 0, -1):
            if ".".join(parts[:n]) in out:
                out, rest = out[".".join(parts[:n])], ".".join(parts[n:])
                break
        else:
            raise KeyError(namespace)
    return out


def work_folder(spark, name: str) -> str:
    """A new folder of the driver's session that all nodes see: under spark.checkpoint.dir, or, on one machine, a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        if "://" in shared and not shared.startswith("file:"):
            raise ValueError(f"segment files need a folder that all nodes mount; spark.checkpoint.dir is {shared}")
        root = "/" + shared.removeprefix("file:").lstrip("/")
    elif spark.sparkContext.master.split("[")[0] == "local":
        root = tempfile.mkdtemp(prefix="ledgerlens-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    else:
        raise ValueError("segment files need a folder that all nodes mount: set spark.checkpoint.dir")
    path = os.path.join(root, "ledgerlens", f"{name}-{uuid.uuid4().hex[:12]}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path
