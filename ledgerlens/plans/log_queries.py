"""Queries over the events log: reads, decoders, filters, aggregates, windows and reports."""

from __future__ import annotations

import gzip

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions import codec, msgpack
from ledgerlens.operators import log as ops
from ledgerlens.operators import replay, requests
from ledgerlens.sources import dumps, files, rlog

from .adapters import CAPACITY, LOG_SQL, NOW_MS, TTL_MS, events_log
from .registry import register

_W = f"with {LOG_SQL}"


def _q(name: str, sql: str):
    return register(name, f"{_W} {sql}")


def _rid(col: str = "request_id"):
    return F.lower(F.hex(col))


def _entry(log):
    return log.withColumn("entry", codec.build_entry(F.col("request_id"), F.col("entry_type"), F.col("term"), F.col("data")))


@_q("log_scan", "select log_index, term, entry_type, rid, cast(props as varchar) as data, entry_size, segment_first_index from log")
def log_scan(s, d):
    return events_log(s, d).select("log_index", "term", "entry_type", _rid().alias("rid"), F.col("data").cast("string").alias("data"), "entry_size", "segment_first_index")


@_q("log_point_read", "select log_index, term, entry_type, entry_size from log where log_index = 77")
def log_point_read(s, d):
    return ops.get_entry(events_log(s, d), 77).select("log_index", "term", "entry_type", "entry_size")


@_q("log_range_read", "select log_index, term, entry_type, rid from log where log_index between 100 and 250")
def log_range_read(s, d):
    return ops.get_entries(events_log(s, d), 100, 250).select("log_index", "term", "entry_type", _rid().alias("rid"))


@_q("log_read_after", "select log_index, term, entry_type from log where log_index > 100 and log_index <= 150")
def log_read_after(s, d):
    return ops.read_entries(events_log(s, d), 100, 50, upper=400).select("log_index", "term", "entry_type")


@_q("log_budget_read", "select log_index, entry_size, cast(run as bigint) as running_bytes from (select *, sum(entry_size) over (order by log_index) as run from log where log_index between 500 and 3000) where run <= 4096 or log_index = 500")
def log_budget_read(s, d):
    return ops.read_budget(events_log(s, d), 500, 3000, 4096).select("log_index", "entry_size", "running_bytes")


@_q("log_count_fitting", "select count(*) as fitting from (select sum(entry_size) over (order by log_index) as run from log where log_index >= 700) where run <= 2000")
def log_count_fitting(s, d):
    return ops.count_fitting(events_log(s, d), 700, 2000)


@_q("log_partial_entry", "select log_index, substr(props, 3, 3) as part from log")
def log_partial_entry(s, d):
    return _entry(events_log(s, d)).select("log_index", F.substring("entry", 23, 3).cast("string").alias("part"))


@_q("log_bounds", "select min(log_index) as first_index, max(log_index) as last_index, max_by(term, log_index) as last_term, count(*) as entries, cast(sum(entry_size) as bigint) as bytes from log")
def log_bounds(s, d):
    return ops.bounds(events_log(s, d))


@_q("segment_report", f"""select segment_first_index, cast({CAPACITY} - segment_first_index % {CAPACITY} as bigint) as capacity, count(*) as entry_count, max(log_index) + 1 as next_index,
 cast({CAPACITY} - segment_first_index % {CAPACITY} - count(*) as bigint) as free_count, cast(sum(entry_size) as bigint) as data_size,
 cast(16 + 4 * ({CAPACITY} - segment_first_index % {CAPACITY}) as bigint) as index_size, cast(segment_first_index + {CAPACITY} - segment_first_index % {CAPACITY} - 1 as bigint) as last_allowed_index
 from log group by segment_first_index""")
def segment_report(s, d):
    return ops.segments(events_log(s, d), CAPACITY)


@_q("segment_names", "select distinct segment_first_index, substr(n, 1, 5) || '/' || substr(n, 6, 2) || '/' || substr(n, 8, 2) || '/' || n || '.rlog' as path from (select segment_first_index, printf('%014x', segment_first_index) as n from log)")
def segment_names(s, d):
    return events_log(s, d).select("segment_first_index").distinct().withColumn("path", codec.segment_path(F.col("segment_first_index")))


@_q("segment_name_round_trip", "select distinct segment_first_index, segment_first_index as parsed from log")
def segment_name_round_trip(s, d):
    named = events_log(s, d).select("segment_first_index").distinct()
    return named.withColumn("parsed", codec.index_of_path(codec.segment_path(F.col("segment_first_index"))))


@_q("segment_floor", "select o_orderkey as wanted, (select max(segment_first_index) from log where segment_first_index <= o_orderkey) as segment from orders")
def segment_floor(s, d):
    """Floor lookup: the segment of an index is arithmetic; its existence is an equi-join."""
    have = events_log(s, d).select("segment_first_index").distinct()
    wanted = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("wanted"))
    top = have.agg(F.max("segment_first_index").alias("_top"))
    # beyond the last segment the floor is the last one
    at = wanted.join(F.broadcast(top)).withColumn("_at", F.when(F.col("wanted") >= 1, F.least("_top", codec.segment_first_index(F.col("wanted"), CAPACITY))))
    return at.join(have, at._at == have.segment_first_index, "left").select("wanted", F.col("segment_first_index").alias("segment"))


@_q("entry_offsets", "select log_index, segment_first_index as segment, cast(coalesce(sum(entry_size) over (partition by segment_first_index order by log_index rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_offset from log")
def entry_offsets(s, d):
    return ops.byte_offsets(events_log(s, d), CAPACITY).select("log_index", "segment", "byte_offset")


@_q("segment_listing", "select printf('%014x', log_index) || ':' || printf('%08x', byte_offset) || ':' || printf('%08x', entry_size) as row from (select *, cast(coalesce(sum(entry_size) over (partition by segment_first_index order by log_index rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_offset from log)")
def segment_listing(s, d):
    return ops.byte_offsets(events_log(s, d), CAPACITY).select(ops.listing_row(F.col("log_index"), F.col("byte_offset"), F.col("entry_size")).alias("row"))


@_q("entry_bytes", """select log_index, rid || printf('%02x', entry_type) || lower(printf('%02x', term % 256)) || printf('%02x', term // 256) || '0000000000' || lower(hex(encode(props))) as entry from log""")
def entry_bytes(s, d):
    return _entry(events_log(s, d)).select("log_index", _rid("entry").alias("entry"))


@_q("entry_decode", "select log_index, entry_type, term, rid, props as data, seconds from log")
def entry_decode(s, d):
    e = _entry(events_log(s, d)).select("log_index", "entry")
    x = F.col("entry")
    return e.select("log_index", codec.entry_type(x).alias("entry_type"), codec.entry_term(x).alias("term"), codec.request_key(x, "hex").alias("rid"), codec.entry_data(x).cast("string").alias("data"), codec.id_seconds(codec.request_id(x)).alias("seconds"))


@_q("request_key_base64", "select log_index, to_base64(unhex(rid)) as request_key from log")
def request_key_base64(s, d):
    return _entry(events_log(s, d)).select("log_index", codec.request_key(F.col("entry")).alias("request_key"))


@_q("request_time", "select log_index, to_timestamp(seconds)::timestamp as request_ts from log where entry_type <> 2")
def request_time(s, d):
    return events_log(s, d).filter("entry_type <> 2").select("log_index", F.timestamp_seconds(codec.id_seconds(F.col("request_id"))).cast("timestamp_ntz").alias("request_ts"))


@_q("ident_check", "select log_index, regexp_matches(rid, '^[0-9a-f]{24}$') as is_ident from log")
def ident_check(s, d):
    return events_log(s, d).select("log_index", codec.is_ident_text(_rid()).alias("is_ident"))


@_q("state_entries", "select log_index, entry_type from log where entry_type = 0")
def state_entries(s, d):
    return events_log(s, d).filter(F.col("entry_type") == codec.STATE).select("log_index", "entry_type")


@_q("entry_type_counts", "select entry_type, count(*) as n, min(log_index) as first_index, max(log_index) as last_index, cast(sum(entry_size) as bigint) as bytes from log group by entry_type")
def entry_type_counts(s, d):
    return events_log(s, d).groupBy("entry_type").agg(F.count(F.lit(1)).alias("n"), F.min("log_index").alias("first_index"), F.max("log_index").alias("last_index"), F.sum("entry_size").cast("bigint").alias("bytes"))


@_q("segment_includes", f"select log_index, log_index between {CAPACITY} and {2 * CAPACITY - 1} as allowed from log")
def segment_includes(s, d):
    lo = CAPACITY
    return events_log(s, d).select("log_index", F.col("log_index").between(lo, 2 * CAPACITY - 1).alias("allowed"))


@_q("request_expired", f"select log_index, seconds * 1000 < {NOW_MS} - {TTL_MS} as expired from log where entry_type <> 2")
def request_expired(s, d):
    sec = codec.id_seconds(F.col("request_id"))
    return events_log(s, d).filter("entry_type <> 2").select("log_index", codec.request_expired(sec, NOW_MS, TTL_MS).alias("expired"))


@_q("request_sanity", f"select log_index, cast(case when seconds * 1000 < {NOW_MS} - ({TTL_MS} - 60000) then -1 when seconds * 1000 > {NOW_MS} + 60000 then 1 else 0 end as integer) as sanity from log where entry_type <> 2")
def request_sanity(s, d):
    sec = codec.id_seconds(F.col("request_id"))
    return events_log(s, d).filter("entry_type <> 2").select("log_index", codec.request_sanity(sec, NOW_MS, TTL_MS, 60000, 60000).alias("sanity"))


@_q("request_id_set", "select log_index, rid from log where rid <> '000000000000000000000000'")
def request_id_set(s, d):
    return events_log(s, d).filter(codec.id_is_set(F.col("request_id"))).select("log_index", _rid().alias("rid"))


@_q("payload_size_ok", "select log_index, octet_length(encode(props)) between 1 and 9 as ok from log")
def payload_size_ok(s, d):
    return events_log(s, d).select("log_index", requests.payload_ok(F.col("data"), 9).alias("ok"))


@_q("request_first_wins", "select request_key, min(log_index) as log_index, count(*) as n from log where entry_type <> 2 group by request_key")
def request_first_wins(s, d):
    return requests.first_wins(events_log(s, d).filter("entry_type <> 2"))


@_q("request_last_index", "select request_key, max(log_index) as log_index, min(log_index) as first_index from log where entry_type <> 2 group by request_key")
def request_last_index(s, d):
    return requests.request_index(events_log(s, d).filter("entry_type <> 2"))


@_q("request_lookup", "select l.log_index as asked, r.at as found from log l left join (select request_key, max(log_index) as at from log where entry_type = 1 group by request_key) r using (request_key)")
def request_lookup(s, d):
    log = events_log(s, d)
    idx = requests.request_index(log.filter("entry_type = 1")).select("request_key", F.col("log_index").alias("found"))
    return log.select("request_key", F.col("log_index").alias("asked")).join(idx, "request_key", "left").select("asked", "found")


@_q("newest_fresh_ids", f"select log_index, rid from log where entry_type <> 2 and not seconds * 1000 < {NOW_MS} - {TTL_MS} order by log_index desc limit 100")
def newest_fresh_ids(s, d):
    return requests.fresh_index(events_log(s, d), NOW_MS, TTL_MS, 100).select("log_index", _rid().alias("rid"))


@_q("prune_index", f"select coalesce(min(case when entry_type <> 2 and not seconds * 1000 < {NOW_MS} - {TTL_MS} then log_index end) - 1, max(log_index)) as prune_index from log")
def prune_index(s, d):
    return requests.prune_index(events_log(s, d), NOW_MS, TTL_MS)


@_q("compaction_index", f"select least(500, coalesce(min(case when entry_type <> 2 and not seconds * 1000 < {NOW_MS} - {TTL_MS} then log_index end) - 1, max(log_index))) as compaction_index from log")
def compaction_index(s, d):
    return requests.compaction_index(events_log(s, d), 500, NOW_MS, TTL_MS)


@_q("cache_cleanup", f"""select rid, log_index from log where entry_type <> 2 and log_index >= (select min(log_index) from log where entry_type <> 2 and not seconds * 1000 < {NOW_MS} - {TTL_MS}
 and log_index >= (select min(log_index) from (select log_index from log where entry_type <> 2 order by log_index desc limit 300)))""")
def cache_cleanup(s, d):
    ids = events_log(s, d).filter("entry_type <> 2").select("request_id", F.col("log_index").alias("first_index"))
    return requests.cache_after_cleanup(ids, NOW_MS, TTL_MS, 300).select(_rid().alias("rid"), F.col("first_index").alias("log_index"))


@_q("update_classes", f"""select l.log_index as asked, case when l.seconds * 1000 >= {NOW_MS} - 86400000 and p.log_index is not null then 'pending'
 when k.log_index is null and not (l.seconds * 1000 >= {NOW_MS} - {TTL_MS} and l.seconds * 1000 <= {NOW_MS}) then 'expired' when k.log_index is null then 'append' when k.log_index <= 5000 then 'applied' else 'wait' end as status
 from log l left join (select log_index from log where log_index % 3 = 0) k on l.log_index = k.log_index left join (select log_index from log where log_index % 50 = 0 and seconds * 1000 >= {NOW_MS} - 86400000) p on l.log_index = p.log_index where l.entry_type <> 2""")
def update_classes(s, d):
    log = events_log(s, d).filter("entry_type <> 2")
    known = log.filter("log_index % 3 = 0").select("request_id", "log_index")
    waiting = log.filter((F.col("log_index") % 50 == 0) & (codec.id_seconds(F.col("request_id")) * 1000 >= NOW_MS - 86400000)).select("request_id")
    asked = log.select("request_id", "data", F.col("log_index").alias("asked"))
    out = requests.classify_updates(asked, known, waiting, is_leader=True, leader_id=None, last_applied=5000, now_ms=NOW_MS, ttl_ms=TTL_MS, max_bytes=1 << 20)
    return out.select("asked", "status")


@_q("config_update_classes", f"""select l.log_index as asked, cast(case when k.log_index <= 5000 then 1 when k.log_index is not null then 2
 when not (l.seconds * 1000 >= {NOW_MS} - {TTL_MS} and l.seconds * 1000 <= {NOW_MS}) then 4 when l.k % 2 = 1 then 2 else 3 end as integer) as status
 from log l left join (select log_index from log where log_index % 3 = 0) k on l.log_index = k.log_index where l.entry_type = 1""")
def config_update_classes(s, d):
    log = events_log(s, d)
    asked = log.filter("entry_type = 1").select("request_id", F.col("log_index").alias("asked"), (F.col("k") % 2 == 0).alias("peers_ok"))
    known = log.filter("entry_type = 1 and log_index % 3 = 0").select("request_id", "log_index")
    out = requests.classify_config_updates(asked, known, is_leader=True, in_transition=True, reply_waiting=False, update_id=None, commit_index=5000, now_ms=NOW_MS, ttl_ms=TTL_MS)
    return out.select("asked", "status")


@_q("resolved_requests", "select log_index, rid from log where entry_type = 0 and log_index <= 1234")
def resolved_requests(s, d):
    return requests.resolved(events_log(s, d).filter("entry_type = 0"), 1234).select("log_index", _rid().alias("rid"))


@_q("duplicate_calls", "select log_index, coalesce(lag(k) over (partition by user_id order by log_index) = k, false) as bounced from log")
def duplicate_calls(s, d):
    calls = events_log(s, d).select("log_index", F.col("log_index").alias("seq"), F.col("user_id").alias("peer_id"), F.col("k").alias("message_id"))
    return requests.bounced_duplicates(calls).select("log_index", "bounced")


@_q("correlated_responses", "select a.log_index as request, b.log_index as response from log a join log b on b.log_index = a.log_index + 3 and a.k = b.k where a.entry_type = 0 and b.entry_type = 1")
def correlated_responses(s, d):
    log = events_log(s, d)
    waits = log.filter("entry_type = 0").select(F.concat_ws(":", (F.col("log_index") + 3).cast("string"), "k").alias("message_id"), F.col("log_index").alias("request"))
    come = log.filter("entry_type = 1").select(F.concat_ws(":", F.col("log_index").cast("string"), "k").alias("message_id"), F.col("log_index").alias("response"))
    return requests.correlate(come, waits).select("request", "response")


@_q("term_spans", "select term, min(log_index) as first_index, max(log_index) as last_index, count(*) as entries from log group by term")
def term_spans(s, d):
    return ops.term_spans(events_log(s, d))


@_q("term_lookup", "select i as index, case when i = 0 then 0 else term end as term from (select unnest(generate_series(0, (select max(log_index) + 100 from log))) as i) left join log on log_index = i")
def term_lookup(s, d):
    log = events_log(s, d)
    wanted = s.range(0, ops.bounds(log).first().last_index + 101).select(F.col("id").alias("index"))
    return ops.term_at(log, wanted, 0, 0)


@_q("fold_last_value", "select user_id, k, max(log_index) as log_index, max_by(value, log_index) as value from log where entry_type = 0 group by user_id, k")
def fold_last_value(s, d):
    return ops.fold_last(events_log(s, d).filter("entry_type = 0"), ["user_id", "k"], "value")


@_q("fold_null_is_value", "select user_id, max(log_index) as log_index, case when max_by(k, log_index) % 4 = 0 then null else max_by(value, log_index) end as value from log group by user_id")
def fold_null_is_value(s, d):
    log = events_log(s, d).withColumn("value", F.when(F.col("k") % 4 != 0, F.col("value")))
    return ops.fold_last(log, ["user_id"], "value")


@_q("snapshot_and_tail", "select user_id, max(log_index) as log_index, max_by(value, log_index) as value from log group by user_id")
def snapshot_and_tail(s, d):
    log = events_log(s, d)
    snap = ops.fold_last(log.filter("log_index <= 700"), ["user_id"], "value")
    return replay.snapshot_and_tail(snap, log.filter("log_index > 700"), ["user_id"], "value")


@_q("last_config", "select max(log_index) as log_index from log where entry_type = 1")
def last_config(s, d):
    return events_log(s, d).agg(F.max(F.when(F.col("entry_type") == codec.CONFIG, F.col("log_index"))).alias("log_index"))


@_q("user_gaps", "select user_id, log_index, gap from (select user_id, log_index, log_index - lag(log_index) over (partition by user_id order by log_index) as gap from log) where gap > 100")
def user_gaps(s, d):
    return ops.gaps_by_key(events_log(s, d), "user_id", 100)


@_q("contiguity_errors", """select log_index, term, gap, term_falls from (
  select a.log_index, a.term, b.log_index is null as gap, a.term < b.term as term_falls
  from (select log_index, case when log_index % 50 = 0 then term - 1 else term end as term from log where log_index % 97 <> 0) a
  left join (select log_index, case when log_index % 50 = 0 then term - 1 else term end as term from log where log_index % 97 <> 0) b on b.log_index = a.log_index - 1
  where a.log_index > 1) where gap or term_falls""")
def contiguity_errors(s, d):
    """Of a log with entries taken out and terms lowered here and there."""
    term = F.when(F.col("log_index") % 50 == 0, F.col("term") - 1).otherwise(F.col("term"))
    return ops.contiguity_errors(events_log(s, d).filter("log_index % 97 <> 0").withColumn("term", term))


@_q("append_assigns_indexes", "select log_index, term from log where log_index <= (select max(log_index) - 100 from log) union all select (select max(log_index) - 100 from log) + row_number() over (order by event_id), cast(99 as bigint) from events")
def append_assigns_indexes(s, d):
    """The log once more behind itself, over its last hundred entries."""
    log = events_log(s, d)
    last = ops.bounds(log).first().last_index
    new = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.lit(99).cast("bigint").alias("term"))
    return ops.append(log.select("log_index", "term"), new, last, index=last - 99)


@_q("truncated_log", "select log_index, term from log where log_index < 321")
def truncated_log(s, d):
    return ops.truncate(events_log(s, d), 321).select("log_index", "term")


@_q("snapshot_decisions", "select s.i as log_index, s.t as log_term, case when l.term = s.t then 'keep_tail' else 'discard' end as decision from (select unnest(generate_series(1, (select max(log_index) + 100 from log))) as i, 3 as t) s left join log l on l.log_index = s.i")
def snapshot_decisions(s, d):
    log = events_log(s, d)
    snaps = s.range(1, ops.bounds(log).first().last_index + 101).select(F.col("id").alias("log_index"), F.lit(3).alias("log_term"))
    return ops.snapshot_decision(log, snaps)


@_q("installed_snapshot_tail", "select log_index, term from log where log_index > 400 and exists (select 1 from log where log_index = 400 and term = (select term from log where log_index = 400))")
def installed_snapshot_tail(s, d):
    log = events_log(s, d).select("log_index", "term")
    term = log.filter("log_index = 400").first().term
    return ops.install_snapshot(log, 400, term)


@_q("prunable_segments", f"select segment_first_index from (select distinct segment_first_index from log) where segment_first_index < (select max(segment_first_index) from log where segment_first_index <= 5000)")
def prunable_segments(s, d):
    return replay.prunable(ops.segments(events_log(s, d), CAPACITY), 5000).select("segment_first_index")


@_q("range_dump", "select printf('%016x', log_index) as name, cast(entry_type as varchar) || ':' || to_base64(unhex(rid)) || ':' || cast(term as varchar) as meta, props as data from log where log_index = 5 or log_index between 10 and 20 or log_index <= 2")
def range_dump(s, d):
    log = events_log(s, d)
    b = ops.bounds(log).first()
    wanted = log.filter(ops.in_ranges(F.col("log_index"), ops.parse_ranges("5,10:20,:2", b.first_index, b.last_index)))
    return wanted.select(F.lpad(F.lower(F.hex("log_index")), 16, "0").alias("name"), ops.dump_row(F.col("entry_type"), F.base64("request_id"), F.col("term")).alias("meta"), F.col("data").cast("string").alias("data"))


@_q("user_iterations", "select user_id, log_index, k - lag(k) over (partition by user_id order by log_index) = 1 as follows from log")
def user_iterations(s, d):
    w = Window.partitionBy("user_id").orderBy("log_index")
    return events_log(s, d).select("user_id", "log_index", (F.col("k") - F.lag("k").over(w) == 1).alias("follows"))


@_q("power_of_two", "select log_index, log_index & (log_index - 1) = 0 as is_power, cast(pow(2, ceil(log2(log_index))) as bigint) as next_power, log_index // 2 + 1 as majority from log")
def power_of_two(s, d):
    n = F.col("log_index")
    return events_log(s, d).select("log_index", codec.is_power_of_two(n).alias("is_power"), codec.next_power_of_two(n).alias("next_power"), codec.majority_of(n).alias("majority"))


@_q("flag_decode", "select log_index, k % 5 <> 0 as flag from log")
def flag_decode(s, d):
    raw = F.when(F.col("k") % 5 == 0, F.lit(b"")).otherwise(F.lit(b"\x01"))
    return events_log(s, d).select("log_index", codec.bool_value(raw).alias("flag"))


@_q("uint_round_trip", "select log_index, log_index * 1000003 as value from log")
def uint_round_trip(s, d):
    return events_log(s, d).select("log_index", codec.uint_value(codec.uint_bytes(F.col("log_index") * 1000003)).alias("value"))


@_q("visible_entries", "select log_index, term from log where log_index <= (select max(log_index) - 100 from log)")
def visible_entries(s, d):
    from ledgerlens.operators import feed

    log = events_log(s, d).select("log_index", "term")
    return feed.visible(log, ops.bounds(log.withColumn("entry_size", F.lit(1))).first().last_index - 100)


def _stored(s, d, name: str) -> str:
    """The log written to segment files, in a folder of its own for each query."""
    log = events_log(s, d)
    path = files.work_folder(s, name)
    rlog.write_log(log.select("log_index", "term", "entry_type", "request_id", "data"), path, CAPACITY)
    return path


@_q("stored_log", "select log_index, term, entry_type, rid, cast(props as varchar) as data, entry_size, segment_first_index from log")
def stored_log(s, d):
    """Written to segment files and read back."""
    return rlog.read_log(s, _stored(s, d, "stored_log")).select("log_index", "term", "entry_type", _rid().alias("rid"), F.col("data").cast("string").alias("data"), "entry_size", "segment_first_index")


@_q("stored_range", "select log_index, term, entry_size, cast(sum(entry_size) over (partition by segment_first_index order by log_index) - entry_size as bigint) as byte_offset from log qualify log_index between 1000 and 1100")
def stored_range(s, d):
    """A range over a segment boundary, through the data source's filter pushdown, without payloads."""
    path = _stored(s, d, "stored_range")
    log = s.read.format("rlog").option("payload", "false").load(path)
    return ops.get_entries(log, 1000, 1100, first_index=1).select("log_index", "term", "entry_size", "byte_offset")


@_q("stored_segments", f"""select segment_first_index, cast(least({CAPACITY}, {CAPACITY} - segment_first_index % {CAPACITY}) as integer) as capacity, cast(count(*) as integer) as entry_count, max(log_index) + 1 as next_index, cast(sum(entry_size) as bigint) as data_size
 from log group by segment_first_index""")
def stored_segments(s, d):
    """What the files' own headers and offset tables say."""
    return rlog.inspect_segments(s, _stored(s, d, "stored_segments")).select("segment_first_index", "capacity", "entry_count", "next_index", "data_size")


@_q("stored_log_bounds", "select min(log_index) as first_index, max(log_index) as last_index, max_by(term, log_index) as last_term, count(*) as entries, cast(sum(entry_size) as bigint) as bytes from log")
def stored_log_bounds(s, d):
    return ops.bounds(rlog.read_log(s, _stored(s, d, "stored_log_bounds"), payload=False))


@_q("stored_tail", "select log_index, term from log where log_index > 500")
def stored_tail(s, d):
    """Read on from a known entry, every entry checked against its predecessor."""
    log = rlog.read_log(s, _stored(s, d, "stored_tail"), first=501, payload=False).select("log_index", "term")
    return ops.verified(log, 500)


@_q("fresh_view", "select log_index, log_index <= 500 as fresh from log")
def fresh_view(s, d):
    """Whether a view that has applied 500 entries is fresh for a reader who last wrote at each index."""
    return events_log(s, d).select("log_index", requests.fresh_view(F.lit(500), F.col("log_index")).alias("fresh"))


@_q("escaped_patterns", "select log_index, regexp_replace(props, '([-/\\\\^$*+?.()|\\[\\]{}])', '\\\\\\1', 'g') as pattern, true as found from log")
def escaped_patterns(s, d):
    pattern = codec.regexp_escape(F.col("data").cast("string"))
    return events_log(s, d).select("log_index", pattern.alias("pattern"), F.rlike(F.col("data").cast("string"), F.concat(F.lit("^"), pattern, F.lit("$"))).alias("found"))


@_q("dumped_entries", "select printf('%016x', log_index) as name, cast(entry_type as varchar) || ':' || to_base64(unhex(rid)) || ':' || cast(term as varchar) as meta, props as data from log where log_index between 90 and 110")
def dumped_entries(s, d):
    """A range written as files for people to read, and read back."""
    folder = files.work_folder(s, "dumped_entries")
    dumps.dump_entries(ops.get_entries(events_log(s, d), 90, 110), folder).count()
    return dumps.read_dump(s, folder).select("name", "meta", F.col("data").cast("string").alias("data"))


@_q("decoded_payloads", "select log_index, cast(octet_length(encode(props)) as varchar) as length, lower(hex(encode(props))) as hex, props as text from log")
def decoded_payloads(s, d):
    return events_log(s, d).select("log_index", *(dumps.decoded(F.col("data"), how).alias(how) for how in ("length", "hex", "text")))


@_q("snapshot_dump", "select row_number() over (order by log_index) - 1 as seq, '{\"user\":' || cast(user_id as varchar) || ',\"k\":' || cast(k as varchar) || '}' as value from log where log_index <= 500")
def snapshot_dump(s, d):
    """A snapshot of gzipped MessagePack values, written to a file and dumped as JSON."""
    rows = ops.get_entries(events_log(s, d), 1, 500).select("user_id", "k").collect()  # of the snapshot's 500 entries
    path = f"{files.work_folder(s, 'snapshot_dump')}/snap"
    files.write_snapshot(path, 500, 1, gzip.compress(b"".join(msgpack.pack({"user": r.user_id, "k": r.k}) for r in rows)))
    return dumps.dump_snapshot(s, path, unzip=True).select("seq", "value")


@_q("snapshot_file", "select cast(500 as bigint) as log_index, cast(7 as bigint) as log_term, cast(sum(octet_length(encode(props))) as bigint) as data_size, sha256(string_agg(props, '' order by log_index)) as digest from log where log_index <= 500")
def snapshot_file(s, d):
    """Header and chunks of a snapshot file over the first 500 payloads."""
    rows = ops.get_entries(events_log(s, d), 1, 500).select("data").collect()  # of the snapshot's 500 entries
    path = f"{files.work_folder(s, 'snapshot_file')}/snap"
    files.write_snapshot(path, 500, 7, b"".join(bytes(r.data) for r in rows))
    meta, chunks = files.read_snapshots(s, path, chunk=100)
    whole = chunks.groupBy("log_index").agg(F.array_sort(F.collect_list(F.struct("byte_offset", F.hex("chunk").alias("c")))).alias("cs"))
    digest = F.sha2(F.unhex(F.array_join(F.transform("cs", lambda x: x["c"]), "")), 256)
    return meta.join(whole, "log_index").select("log_index", "log_term", "data_size", digest.alias("digest"))


@_q("state_file", "select 'iteration' as field, cast(max(log_index) as varchar) as value from log where log_index <= 50 union all select 'user', cast(max_by(user_id, log_index) as varchar) from log where log_index <= 50 union all select 'name', 'null'")
def state_file(s, d):
    """A state file that a change was appended to for each of 50 entries, folded to its last values."""
    rows = ops.get_entries(events_log(s, d), 1, 50).select("log_index", "user_id").collect()  # of 50 entries
    path = f"{files.work_folder(s, 'state_file')}/state"
    state = {"iteration": 0, "user": 0, "name": "none"}
    for r in rows:
        state = files.append_state(path, {"iteration": r.log_index, "user": r.user_id, "name": None, "foreign": 1}, state)
    return files.fold_state(files.read_state(s, path), list(state)).select("field", "value")


@_q("file_kinds_found", "select 'segment' as kind, count(distinct segment_first_index) as n from log union all select 'snapshot', 1 union all select 'other', 1")
def file_kinds_found(s, d):
    path = _stored(s, d, "file_kinds_found")
    files.write_snapshot(f"{path}/snap", 1, 1, b"x")
    files.append_state(f"{path}/state", {"a": 1}, {"a": 0})
    return files.file_kinds(s, path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_q("replayed_replies", """select log_index, bounced, max(own) over (partition by user_id, run) as answer
 from (select *, sum(case when bounced then 0 else 1 end) over (partition by user_id order by log_index) as run, case when not bounced then log_index * 10 end as own
  from (select log_index, user_id, coalesce(lag(k) over (partition by user_id order by log_index) = k, false) as bounced from log))""")
def replayed_replies(s, d):
    calls = events_log(s, d).select("log_index", F.col("log_index").alias("seq"), F.col("user_id").alias("peer_id"), F.col("k").alias("message_id"), (F.col("log_index") * 10).alias("reply"))
    return requests.replayed_replies(calls).select("log_index", "bounced", "answer")


_TYPES = ["+", "?", "$", "=", "&", "<", "^", "%", "stats", "", "==", "x"]


@_q("message_routes", f"""select log_index, case when user_id % 9 = 0 then 'refused' when kind in ('+', '?', '$') and user_id % 5 = 0 then 'ignored'
 when kind = '+' then 'append_entries' when kind = '?' then 'request_vote' when kind = '$' then 'install_snapshot' when kind = '=' then 'request_update' when kind = '&' then 'config_update'
 when kind = '<' then 'request_entries' when kind = '^' then 'request_config' when kind = '%' then 'request_log_info' when kind = '' then 'dropped' else 'custom' end as route
 from (select log_index, user_id, {_TYPES}[1 + log_index % 12] as kind from log)""")
def message_routes(s, d):
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("log_index") % 12 + 1).cast("int")).cast("binary")
    secret = F.when(F.col("user_id") % 9 == 0, "no").otherwise("yes").cast("binary")
    ident = F.when(F.col("user_id") % 5 == 0, F.lit(b"")).otherwise(F.col("request_id"))
    return events_log(s, d).select("log_index", requests.message_route(kind, secret, ident, b"yes").alias("route"))


@_q("custom_requests", "select log_index as message_id, case when k % 3 = 0 then cast(length(props) as varchar) else upper(props) end as reply from log where k % 3 < 2")
def custom_requests(s, d):
    kind = F.when(F.col("k") % 3 == 0, "size").when(F.col("k") % 3 == 1, "shout").otherwise("unknown")
    calls = events_log(s, d).select(F.col("log_index").alias("message_id"), kind.alias("message_type"), F.array("data").alias("args"))
    text = F.element_at("args", 1).cast("string")
    return requests.serve(calls, {"size": lambda m: m.withColumn("reply", F.length(text).cast("string")), "shout": lambda m: m.withColumn("reply", F.upper(text))})


@_q("new_idents", "select log_index, printf('%08x', seconds) || '0102030405' || printf('%06x', log_index % 16777216) as ident from log")
def new_idents(s, d):
    ident = codec.new_ident(codec.id_seconds(F.col("request_id")), F.lit(bytes([1, 2, 3, 4, 5])), F.col("log_index"))
    return events_log(s, d).select("log_index", F.lower(F.hex(ident)).alias("ident"))


@_q("update_requests", "select log_index, cast(octet_length(encode(props)) as bigint) as bytes, rid as request_id, k % 4 <> 0 as valid from log")
def update_requests(s, d):
    rid = F.when(F.col("k") % 4 == 0, F.substring("request_id", 1, 11)).otherwise(F.col("request_id"))
    log = events_log(s, d).select("log_index", "request_id", codec.update_request(F.col("data"), rid).alias("request"))
    return log.select("log_index", F.octet_length("request.data").cast("bigint").alias("bytes"), F.lower(F.hex("request_id")).alias("request_id"), codec.is_update_request(F.col("request")).alias("valid"))
