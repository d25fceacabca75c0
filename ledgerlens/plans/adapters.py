"""Driver tables as log tables: DataFrames and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import codec

CAPACITY = 1024
TTL_MS = 8 * 3600 * 1000
#: 2024-01-20 00:00:00 UTC: the "now" of queries that have one.
NOW_MS = 1705708800000


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: dense log_index, a term for each day, ids of 12 bytes; checkpoints have the zero id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 2).otherwise(0)
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rid = F.concat(F.lower(F.lpad(F.hex(seconds), 8, "0")), F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 16))
    index = F.col("event_id") + 1
    return e.select(
        index.alias("log_index"),
        (F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("bigint").alias("term"),
        kind.alias("entry_type"),
        F.md5(F.concat_ws(":", F.col("user_id").cast("string"), "event_type", "props").cast("binary")).alias("request_key"),
        F.unhex(F.when(kind == 2, F.lit("00" * 12)).otherwise(rid)).alias("request_id"),
        F.col("props").cast("binary").alias("data"),
        (F.octet_length("props") + 20).cast("bigint").alias("entry_size"),
        codec.segment_first_index(index, CAPACITY).alias("segment_first_index"),
        "ts",
        "user_id",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


LOG_SQL = f"""
log as (
  select event_id + 1 as log_index,
    cast(1 + date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as term,
    cast(case event_type when 'signup' then 1 when 'error' then 2 else 0 end as integer) as entry_type,
    md5(concat_ws(':', cast(user_id as varchar), event_type, props)) as request_key,
    case when event_type = 'error' then '{"00" * 12}' else printf('%08x', cast(floor(epoch(ts)) as bigint)) || substr(md5(cast(event_id as varchar)), 1, 16) end as rid,
    cast(20 + octet_length(encode(props)) as bigint) as entry_size,
    greatest(1, event_id + 1 - (event_id + 1) % {CAPACITY}) as segment_first_index,
    ts, user_id, value, props, cast(json_extract_string(props, '$.k') as integer) as k,
    case when event_type = 'error' then 0 else cast(floor(epoch(ts)) as bigint) end as seconds
  from events)"""


def progress(spark: SparkSession, sf_dir: str, peers: int = 5) -> DataFrame:
    """Recorded progress: in each term, the last index that each of ``peers`` peers acknowledged."""
    log = events_log(spark, sf_dir)
    return log.groupBy(F.col("term").alias("leader_term"), (F.col("user_id") % peers).cast("int").alias("peer_id")).agg(F.max("log_index").alias("match_index"))


PROGRESS_SQL = "progress as (select term as leader_term, cast(user_id % 5 as integer) as peer_id, max(log_index) as match_index from log group by all)"


def votes(spark: SparkSession, sf_dir: str, peers: int = 5) -> DataFrame:
    """Recorded votes: rounds of 20 events are elections; a vote is granted for values over 30."""
    log = events_log(spark, sf_dir)
    at = F.floor((F.col("log_index") - 1) / 20).cast("bigint")
    return log.select(at.alias("election_term"), F.col("log_index").alias("seq"), (F.col("user_id") % peers).cast("int").alias("peer_id"), (F.col("value") > 30).alias("granted"))


VOTES_SQL = "votes as (select (log_index - 1) // 20 as election_term, log_index as seq, cast(user_id % 5 as integer) as peer_id, value > 30 as granted from log)"


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 configurations, by the keys' remainders: suppliers are the old side, customers the new; every third peer has moved."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")

    def side(t, key, name, moved):
        host = F.pmod(key + F.when(key % 3 == 0, moved).otherwise(0), F.lit(250))
        url = F.concat(F.lit("tcp://10.0.0."), host.cast("string"), F.lit(":8047"))
        return t.select((key % 25).cast("int").alias("config"), F.lit(name).alias("side"), key.alias("peer_id"), url.alias("peer_url"))

    return side(s, F.col("s_suppkey"), "old", 0).unionByName(side(c, F.col("c_custkey"), "new", 1))


PEERS_SQL = """
peers as (
  select cast(s_suppkey % 25 as integer) as config, 'old' as side, s_suppkey as peer_id, 'tcp://10.0.0.' || cast(s_suppkey % 250 as varchar) || ':8047' as peer_url from supplier
  union all
  select cast(c_custkey % 25 as integer), 'new', c_custkey, 'tcp://10.0.0.' || cast((c_custkey + case when c_custkey % 3 = 0 then 1 else 0 end) % 250 as varchar) || ':8047' from customer)"""


def broadcast(spark: SparkSession, sf_dir: str, batch: int = 7) -> DataFrame:
    """A change feed of the log: batches of ``batch`` entries, of which every eleventh is lost and every fifth comes twice."""
    log = events_log(spark, sf_dir)
    no = F.floor((F.col("log_index") - 1) / batch).cast("bigint")
    b = log.groupBy(no.alias("no")).agg(F.max("term").alias("term"), F.max("log_index").alias("last_index"), F.count(F.lit(1)).alias("n"))
    b = b.filter(F.col("no") % 11 != 10)
    copies = F.when(F.col("no") % 5 == 4, F.array(F.lit(0), F.lit(15))).otherwise(F.array(F.lit(0)))
    return b.select("*", F.explode(copies).alias("late")).select((F.col("no") * 10 + F.col("late")).alias("arrival"), "term", "last_index", "n")


BROADCAST_SQL = """
broadcast as (
  select no * 10 + late as arrival, term, last_index, n from (
    select *, unnest(case when no % 5 = 4 then [0, 15] else [0] end) as late from (
      select (log_index - 1) // 7 as no, max(term) as term, max(log_index) as last_index, count(*) as n from log group by 1)
    where no % 11 <> 10))"""
