"""Log directories as Spark data sources.

``read_log`` reads segments of any file system that Spark reads, with the index range
applied to the files' names before any is opened. ``RlogSource`` is a Python data source of
folders that all workers mount: it prunes segments by pushed filters, maps files so that
only the wanted entries' bytes (without payloads: their heads) are read, streams with the next
index as its offset, and writes segments. A write's files appear one after another on commit,
each whole; a driver that is lost between them leaves the first ones.
"""

from __future__ import annotations

import contextlib
import json
import mmap
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from . import formats

SCHEMA = "log_index bigint, term bigint, entry_type int, request_id binary, data binary, entry_size bigint, segment_first_index bigint, byte_offset bigint"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def _batches(raw: bytes, named: int | None, lo: int, hi: int, payload: bool, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    info = formats.parse_segment(raw, named)
    out: list[tuple] = []
    for index, at, size, entry in formats.segment_entries(raw, info, lo, hi, None if payload else 20):
        out.append((index, int.from_bytes(entry[13:20], "little"), entry[12], entry[:12], entry[20:] if payload else None, size, info["first_index"], at))
        if len(out) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _COLUMNS)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _COLUMNS)


def overlapping(starts: list[int], lo: int, hi: int) -> list[int]:
    """Of sorted first indexes those whose segments may hold lo..hi: from the floor of lo on."""
    out = [s for s in starts if s <= hi]
    floor = max((s for s in out if s <= lo), default=None)
    return [s for s in out if floor is None or s >= floor]


def list_segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, segment_first_index, file_size) of the segment files, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rlog").load(path)
    from ledgerlens.functions.codec import index_of_path

    return files.select("path", index_of_path(F.col("path")).alias("segment_first_index"), F.col("length").alias("file_size")).filter("segment_first_index is not null")


def read_log(spark: SparkSession, path: str, first: int = 1, last: int = (1 << 53) - 1, payload: bool = True) -> DataFrame:
    """Entries of first..last; segments outside are never opened."""
    names = {r.segment_first_index: r.path for r in list_segments(spark, path).select("segment_first_index", "path").collect()}
    wanted = [names[s] for s in overlapping(sorted(names), first, last)]
    if not wanted:
        return spark.createDataFrame([], SCHEMA)
    files = spark.read.format("binaryFile").load(wanted).select("path", "content")

    def work(batches):
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _batches(raw, formats.segment_index(p), first, last, payload)

    return files.mapInArrow(work, SCHEMA)


def inspect_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment: its header, counts and sizes."""
    schema = "path string, segment_first_index bigint, capacity int, entry_count int, next_index bigint, free_count int, data_offset bigint, data_size bigint, file_size bigint, meta map<string,string>"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rlog").load(path).select("path", "content")

    def work(batches):
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                i = formats.parse_segment(raw, formats.segment_index(p))
                n = len(i["ends"])
                row = (p, i["first_index"], i["capacity"], n, i["first_index"] + n, i["capacity"] - n, i["data_offset"], i["ends"][-1] if n else 0, len(raw), [(str(k), str(v)) for k, v in i["meta"].items()])
                types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in schema.replace("map<string,string>", "map").split(", ")])

    return files.mapInArrow(work, schema)


@contextlib.contextmanager
def _mapped(path: str):
    """The file's bytes, of which only those that are used are read."""
    with open(path, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            raise formats.FormatError(f"{path} is empty")
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as raw:
            yield raw


class _Range(InputPartition):
    def __init__(self, path: str, index: int, lo: int, hi: int):
        self.path, self.index, self.lo, self.hi = path, index, lo, hi


def _walk(root: str) -> dict[int, str]:
    found = {}
    for top, _, names in os.walk(root):
        for n in names:
            p = os.path.join(top, n)
            i = formats.segment_index(p)
            if i is not None:
                found[i] = p
    return found


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.payload = options["path"], options.get("payload", "true") == "true"
        self.lo, self.hi = 1, (1 << 53) - 1

    def pushFilters(self, filters):
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == ("log_index",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.hi = min(self.hi, f.value - isinstance(f, LessThan))
            yield f  # Spark applies it once more

    def partitions(self):
        names = _walk(self.root)
        return [_Range(names[s], s, self.lo, self.hi) for s in overlapping(sorted(names), self.lo, self.hi)] or [_Range("", 0, 1, 0)]

    def read(self, partition):
        if partition.path:
            with _mapped(partition.path) as raw:
                yield from _batches(raw, partition.index, partition.lo, partition.hi, self.payload)


class _StreamReader(DataSourceStreamReader):
    """The offset is the next index to read; only whole, committed entries count."""

    def __init__(self, options):
        self.root, self.start = options["path"], int(options.get("startIndex", "1"))
        self.payload = options.get("payload", "true") == "true"

    def initialOffset(self):
        return {"next": self.start}

    def latestOffset(self):
        names = _walk(self.root)
        for s in sorted(names, reverse=True):
            with _mapped(names[s]) as raw:
                n = len(formats.parse_segment(raw, s)["ends"])
            if n:
                return {"next": max(self.start, s + n)}
        return {"next": self.start}

    def partitions(self, start, end):
        names = _walk(self.root)
        lo, hi = start["next"], end["next"] - 1
        return [_Range(names[s], s, lo, hi) for s in overlapping(sorted(names), lo, hi)]

    def read(self, partition):
        with _mapped(partition.path) as raw:
            for b in _batches(raw, partition.index, partition.lo, partition.hi, self.payload):
                yield from (tuple(r.values()) for r in b.to_pylist())


class _Message(WriterCommitMessage):
    def __init__(self, moves):
        self.moves = moves


class _Writer(DataSourceWriter):
    """Rows dealt by segment (``deal_segments``) become segment files; they appear on commit."""

    def __init__(self, options):
        self.root, self.capacity = options["path"], int(options.get("capacity", str(formats.DEFAULT_CAPACITY)))
        self.first, self.meta = int(options.get("firstIndex", "1")), json.loads(options.get("meta", "{}"))

    def write(self, rows):
        held: dict[int, list] = {}
        for r in rows:
            start = max(self.first, r["log_index"] - r["log_index"] % self.capacity)
            held.setdefault(start, []).append((r["log_index"], formats.build_entry(bytes(r["request_id"]) if r["request_id"] else None, r["entry_type"], r["term"], bytes(r["data"]))))
        moves = []
        for start, entries in held.items():
            entries.sort()
            if [i for i, _ in entries] != list(range(start, start + len(entries))):
                raise formats.FormatError(f"entries of segment {start} are not dense")
            final = os.path.join(self.root, formats.segment_name(start))
            tmp = f"{final}.{uuid.uuid4().hex}.tmp"
            os.makedirs(os.path.dirname(final), exist_ok=True)
            with open(tmp, "wb") as f:
                f.write(formats.build_segment(start, [e for _, e in entries], self.capacity, self.meta))
            moves.append((tmp, final))
        return _Message(moves)

    def commit(self, messages):
        for m in messages:
            for tmp, final in m.moves if m else ():
                os.replace(tmp, final)

    def abort(self, messages):
        for m in messages:
            for tmp, _ in m.moves if m else ():
                if os.path.exists(tmp):
                    os.remove(tmp)


class RlogSource(DataSource):
    @classmethod
    def name(cls):
        return "rlog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RlogSource)


def deal_segments(log: DataFrame, capacity: int, first: int = 1) -> DataFrame:
    """log(log_index, term, entry_type, request_id, data): a segment's rows in one partition."""
    from ledgerlens.functions.codec import segment_first_index

    return log.select("log_index", "term", "entry_type", "request_id", "data").repartition(segment_first_index(F.col("log_index"), capacity, first))


def write_log(log: DataFrame, path: str, capacity: int = formats.DEFAULT_CAPACITY, first: int = 1, meta: dict | None = None) -> None:
    register(log.sparkSession)
    deal_segments(log, capacity, first).write.format("rlog").mode("append").option("path", path).option("capacity", str(capacity)).option("firstIndex", str(first)).option("meta", json.dumps(meta or {})).save()
