"""Helpers shared by the training-data operators: shared scratch tables and salted ranks."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIRS: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where the session names none and all runs on one machine (local tests) is a folder of
    our own made; on a cluster executors would not see it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"intermediate tables need a folder that all nodes share: set spark.checkpoint.dir (master: {master})")
    key = id(spark.sparkContext)
    if key not in _OWN_DIRS:
        _OWN_DIRS[key] = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
    return _OWN_DIRS[key]


def delete_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries that run inside leave no shuffle files: what they write is read again, not made again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive lost executors.

    They are removed by ``drop``, at the end of ``temporary`` or, at the latest, when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/ledgerlens/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self._clean)
        if _OPEN:
            _OPEN[-1].append(self)

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.base}/{name}{self._n}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            delete_path(self.spark, path)

    def _clean(self) -> None:
        atexit.unregister(self._clean)
        try:
            if self.spark.sparkContext._jsc is not None:
                delete_path(self.spark, self.base)
        except Exception:  # noqa: BLE001 - the JVM may already be gone at interpreter exit
            pass


#: Rows that the planner may send to all tasks through the driver, at some 100 bytes each there.
BROADCAST_ROWS = 200_000


def by_merge(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, joined by a sorted merge if it has over BROADCAST_ROWS rows, or as the planner likes.

    The planner weighs a table by the bytes of its files and columns. These say little of its rows:
    compressed ids take a twentieth of their room in a hash table, an explode isn't counted at
    all. So what grows with the corpus would be gathered on the driver. Without rows: always merged.
    """
    return df.hint("merge") if rows is None or rows > BROADCAST_ROWS else df


_OPEN: list[list[Scratch]] = []


@contextlib.contextmanager
def temporary():
    """Scratch tables that are made inside go when it ends: what is left must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for scratch in _OPEN.pop():
            scratch._clean()


def with_rank(df: DataFrame, by: list[str], order: list[Column], out: str, salts: int = 256) -> DataFrame:
    """0-based gapless rank of each row within ``by`` without one task per group.

    Rows are dealt to (group, salt) cells; each cell is ranked alone and starts at the
    sum of the cells before it. The table of cell counts has at most salts rows a group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    cells = salted.groupBy(*by, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(*by, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_salt").orderBy(*order)
    ranked = salted.withColumn("_in", F.row_number().over(inside) - 1)
    keys = [*by, "_salt"]
    a, b = ranked.alias("a"), starts.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    rest = [F.col(f"a.`{c}`") for c in df.columns]
    return a.join(b, cond).select(*rest, (F.col("b._start") + F.col("a._in")).cast("long").alias(out))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
