"""Queries over recorded votes, progress, memberships and change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import consensus, feed, membership, reports

from . import adapters as a
from .registry import register


def _q(name: str, sql: str, *ctes: str):
    return register(name, f"with {', '.join(ctes)}{sql}" if sql.startswith(",") else f"with {', '.join(ctes)} {sql}" if ctes else sql)


_LOG, _PROG, _VOTES, _PEERS, _CAST = a.LOG_SQL, a.PROGRESS_SQL, a.VOTES_SQL, a.PEERS_SQL, a.BROADCAST_SQL


@_q("vote_tally", "select election_term, count(*) filter (where granted) as votes, count(*) as voters, count(*) >= 3 as majority_voted, count(*) filter (where granted) >= 3 as won from (select election_term, peer_id, min_by(granted, seq) as granted from votes group by all) group by election_term", _LOG, _VOTES)
def vote_tally(s, d):
    return consensus.tally(a.votes(s, d), ["election_term"], 5)


@_q("joint_vote_tally", """, sides as (select 'old' as side, unnest([0, 1, 2]) as peer_id union all select 'new', unnest([0, 3, 4])), one as (select election_term, peer_id, min_by(granted, seq) as granted from votes group by all),
 each as (select election_term, side, count(o.peer_id) as voters, count(*) filter (where granted) as votes from (select distinct election_term from votes) e cross join sides left join one o using (election_term, peer_id) group by all)
 select election_term, min(voters) >= 2 as majority_voted, min(votes) >= 2 as won from each group by election_term""", _LOG, _VOTES)
def joint_vote_tally(s, d):
    members = s.createDataFrame([("old", 0), ("old", 1), ("old", 2), ("new", 0), ("new", 3), ("new", 4)], "side string, peer_id int")
    return consensus.joint_tally(a.votes(s, d), ["election_term"], members)


@_q("quorum_index", "select leader_term, case when count(*) >= 3 then list_sort(list(match_index), 'DESC')[3] else 0 end as majority_index from progress group by leader_term", _LOG, _PROG)
def quorum_index(s, d):
    return consensus.majority_index(a.progress(s, d), ["leader_term"], 5)


@_q("commit_index", "select m.leader_term, majority_index, case when l.term = m.leader_term and majority_index > 500 then majority_index end as commit_index from (select leader_term, case when count(*) >= 3 then list_sort(list(match_index), 'DESC')[3] else 0 end as majority_index from progress group by leader_term) m left join log l on l.log_index = majority_index", _LOG, _PROG)
def commit_index(s, d):
    return consensus.commit_index(a.progress(s, d), a.events_log(s, d), 5, commit_before=500)


@_q("joint_quorum_index", """, sides as (select 'old' as side, unnest([0, 1, 2]) as peer_id union all select 'new', unnest([0, 3, 4])),
 each as (select leader_term, side, list_sort(list(coalesce(match_index, 0)), 'DESC')[2] as m from (select distinct leader_term from progress) t cross join sides left join progress using (leader_term, peer_id) group by all)
 select leader_term, min(m) as majority_index from each group by leader_term""", _LOG, _PROG)
def joint_quorum_index(s, d):
    members = s.createDataFrame([("old", 0), ("old", 1), ("old", 2), ("new", 0), ("new", 3), ("new", 4)], "side string, peer_id int")
    return consensus.joint_majority_index(a.progress(s, d), members, ["leader_term"])


_ASK = """ask as (select log_index as candidate_id, k as candidate_term, cast(value * 10 as bigint) as candidate_last_index, k % 7 as candidate_last_term, 50 as current_term, case when user_id % 3 = 0 then log_index when user_id % 3 = 1 then -1 end as voted_for, 300 as last_index, 4 as last_term, user_id % 11 = 0 as spiral_guard from log)"""


@_q("vote_granted", """select candidate_id, case when candidate_term < current_term then false when spiral_guard then false else (voted_for is null or voted_for = candidate_id or candidate_term > current_term) and (candidate_last_term > last_term or (candidate_last_term = last_term and candidate_last_index >= last_index)) end as granted,
 cast(case when candidate_term >= current_term and not spiral_guard then candidate_term else current_term end as integer) as new_term from ask""", _LOG, _ASK)
def vote_granted(s, d):
    u = F.col("user_id") % 3
    ask = a.events_log(s, d).select(F.col("log_index").alias("candidate_id"), F.col("k").alias("candidate_term"), F.round(F.col("value") * 10).cast("bigint").alias("candidate_last_index"), (F.col("k") % 7).alias("candidate_last_term"), F.lit(50).alias("current_term"), F.when(u == 0, F.col("log_index")).when(u == 1, F.lit(-1)).alias("voted_for"), F.lit(300).cast("bigint").alias("last_index"), F.lit(4).alias("last_term"), (F.col("user_id") % 11 == 0).alias("spiral_guard"))
    return consensus.vote_granted(ask).select("candidate_id", "granted", "new_term")


@_q("leader_init", "select s_suppkey as peer_id, cast(5001 as bigint) as next_index, cast(0 as bigint) as match_index, cast(0 as bigint) as match_term from supplier")
def leader_init(s, d):
    return consensus.leader_init(s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("peer_id")), 5000)


@_q("append_responses", """select log_index as peer_id, cast(case when k % 2 = 0 then log_index + k % 5 + 1 when log_index + k - 50 < log_index - 1 then case when log_index + k - 50 < 200 then 199 else log_index + k - 50 end else log_index - 1 end as bigint) as next_index,
 case when k % 2 = 0 then log_index + k % 5 end as match_index, case when k % 2 = 0 then term end as match_term from log""", _LOG)
def append_responses(s, d):
    k, i = F.col("k"), F.col("log_index")
    r = a.events_log(s, d).select(i.alias("peer_id"), (k % 2 == 0).alias("success"), (i - 1).alias("sent_prev_index"), (i + k % 5).alias("sent_last_index"), F.col("term").alias("sent_last_term"), (i + k - 50).alias("conflict_index"))
    return consensus.on_append_response(r, 200)


@_q("replication_step", "select log_index as peer_id, case when log_index < 200 then 'snapshot' when log_index > 5000 then 'heartbeat' when k % 2 = 0 then 'entries' else 'entry' end as kind from log", _LOG)
def replication_step(s, d):
    peers = a.events_log(s, d).select(F.col("log_index").alias("peer_id"), F.col("log_index").alias("next_index"), (F.col("k") % 2 == 0).alias("last_success"))
    return consensus.what_to_send(peers, 200, 5000).select("peer_id", "kind")


@_q("append_decision", """select c.log_index as call, case when c.k < 20 then 'stale' when c.log_index < 300 then 'fatal' when l.term = c.pt then 'append' else 'mismatch' end as outcome,
 case when not (c.k < 20 or c.log_index < 300) and l.term is null and c.prev > 4000 then cast(4001 as bigint) end as conflict_index,
 cast(case when c.k >= 20 and c.log_index >= 300 and l.term = c.pt and c.log_index + 7 > 300 then least(c.log_index + 7, c.prev + 5) else 300 end as bigint) as new_commit
 from (select log_index, k, log_index as prev, case when k % 3 = 0 then term - 1 else term end as pt from log) c left join (select log_index, term from log where log_index <= 4000) l on l.log_index = c.prev""", _LOG)
def append_decision(s, d):
    log = a.events_log(s, d)
    i, k = F.col("log_index"), F.col("k")
    calls = log.select(i.alias("call"), k.alias("leader_term"), i.alias("prev_index"), F.when(k % 3 == 0, F.col("term") - 1).otherwise(F.col("term")).alias("prev_term"), (i + 7).alias("leader_commit"), F.lit(5).alias("n"), F.lit(20).alias("current_term"), F.lit(300).cast("bigint").alias("commit_index"))
    out = consensus.append_decision(calls, log.filter("log_index <= 4000"), 4000)
    return out.select("call", "outcome", "conflict_index", "new_commit")


@_q("checkpoint_needed", "select log_index, k % 4 <> 0 and user_id % 50 < 25 as needed from log", _LOG)
def checkpoint_needed(s, d):
    c = F.col
    return a.events_log(s, d).select("log_index", consensus.needs_checkpoint(c("k") % 4, F.lit(0), c("user_id") % 50, F.lit(25)).alias("needed"))


@_q("config_after_commit", "select log_index, case when k % 5 = 0 then 'step_down' when k % 2 = 0 and log_index >= 2000 then 'append_new' else 'none' end as action from log", _LOG)
def config_after_commit(s, d):
    c = F.col
    return a.events_log(s, d).select("log_index", consensus.config_after_commit(c("k") % 5 != 0, c("k") % 2 == 0, F.lit(2000), c("log_index")).alias("action"))


@_q("vote_responses", "select log_index, case when k > 30 and user_id % 2 = 0 then 'step_down' when user_id % 5 = 0 or k % 3 = 0 then 'ignore' when user_id % 7 = 0 then 'lead' else 'wait' end as action from log", _LOG)
def vote_responses(s, d):
    u, k = F.col("user_id"), F.col("k")
    state = F.when(u % 5 == 0, consensus.FOLLOWER).otherwise(consensus.CANDIDATE)
    return a.events_log(s, d).select("log_index", consensus.on_vote_response(state, F.lit(30), F.when(k % 3 == 0, 29).otherwise(30), k, u % 7 == 0, u % 2 == 0).alias("action"))


@_q("election_start", "select term, term + 1 as new_term, term % 3 = 1 as won from (select distinct term from log)", _LOG)
def election_start(s, d):
    t = a.events_log(s, d).select("term").distinct()
    st = consensus.election_start(F.col("term"), F.col("term") % 3)
    return t.select("term", st["term"].alias("new_term"), st["won"].alias("won"))


_STATES = "states as (select user_id as peer_id, log_index as seq, ['Client', 'Follower', 'Candidate', 'Leader'][1 + k % 4] as state from log)"


def _states(s, d):
    names = F.array(*[F.lit(x) for x in ("Client", "Follower", "Candidate", "Leader")])
    return a.events_log(s, d).select(F.col("user_id").alias("peer_id"), F.col("log_index").alias("seq"), F.element_at(names, 1 + F.col("k") % 4).alias("state"))


@_q("bad_transitions", """select peer_id, seq, before, state from (select *, lag(state) over (partition by peer_id order by seq) as before from states) where before <> state
 and (before, state) not in (('Client', 'Follower'), ('Client', 'Leader'), ('Follower', 'Candidate'), ('Candidate', 'Follower'), ('Candidate', 'Leader'), ('Leader', 'Follower'), ('Follower', 'Client'), ('Candidate', 'Client'), ('Leader', 'Client'))""", _LOG, _STATES)
def bad_transitions(s, d):
    return consensus.bad_transitions(_states(s, d)).select("peer_id", "seq", "before", "state")


@_q("state_changes", "select peer_id, seq, before, state from (select *, lag(state) over (partition by peer_id order by seq) as before from states) where before is null or before <> state", _LOG, _STATES)
def state_changes(s, d):
    return consensus.state_changes(_states(s, d)).select("peer_id", "seq", "before", "state")


_START = "start as (select log_index as peer_id, k % 3 = 0 as is_transitional, case when k % 4 = 0 then rid end as peers_update_request, case when k % 8 = 0 then cast(k * 10 as bigint) end as peers_index, cast(500 as bigint) as last_index, cast(k * 6 as bigint) as last_applied, cast(1 + k as bigint) as first_index, term as last_term, cast(15 as bigint) as current_term, cast(k as bigint) as snapshot_index, cast(k % 2 as bigint) as snapshot_term from log)"


def _start(s, d):
    k = F.col("k").cast("bigint")
    return a.events_log(s, d).select(F.col("log_index").alias("peer_id"), (k % 3 == 0).alias("is_transitional"), F.when(k % 4 == 0, F.col("request_id")).alias("peers_update_request"), F.when(k % 8 == 0, k * 10).alias("peers_index"), F.lit(500).cast("bigint").alias("last_index"), (k * 6).alias("last_applied"), (k + 1).alias("first_index"), F.col("term").alias("last_term"), F.lit(15).cast("bigint").alias("current_term"), k.alias("snapshot_index"), (k % 2).alias("snapshot_term"))


@_q("startup_errors", """select peer_id, rule from (select peer_id, unnest([
 case when is_transitional and peers_update_request is null then 'transitional config without request key' end, case when peers_update_request is not null and peers_index is null then 'config in the log not confirmed' end,
 case when peers_index > last_index then 'config not appended to the log' end, case when last_applied > last_index then 'last applied above the last index' end, case when first_index > last_applied + 1 then 'state machine not up to the first entry' end,
 case when last_term > current_term then 'current term below the last entry''s' end, case when snapshot_index = 0 and snapshot_term <> 0 then 'snapshot with index 0 has a term' end, case when snapshot_index <> first_index - 1 then 'snapshot does not precede the first index' end]) as rule from start) where rule is not null""", _LOG, _START)
def startup_errors(s, d):
    return consensus.startup_errors(_start(s, d))


@_q("startup_repair", "select s.peer_id, greatest(current_term, last_term) as current_term, coalesce(peers_index, l.log_index) as peers_index, case when first_index > last_applied + 1 then snapshot_index end as feed_to from start s left join (select rid, log_index from log where entry_type = 1) l on l.rid = s.peers_update_request", _LOG, _START)
def startup_repair(s, d):
    index = a.events_log(s, d).filter("entry_type = 1").select("request_id", "log_index")
    return consensus.startup_repair(_start(s, d), index)


@_q("peer_changes", """select coalesce(o.config, n.config) as config, coalesce(o.peer_id, n.peer_id) as peer_id, o.peer_url as old_url, n.peer_url as new_url, case when o.peer_id is null then 'added' when n.peer_id is null then 'removed' when o.peer_url <> n.peer_url then 'conflict' else 'kept' end as change
 from (select * from peers where side = 'old') o full join (select * from peers where side = 'new') n on o.config = n.config and o.peer_id = n.peer_id""", _PEERS)
def peer_changes(s, d):
    return membership.diff(a.peers(s, d), ["config"])


@_q("merged_peers", "select config, peer_id, arg_max(peer_url, case when side = 'new' then 1 else 0 end) as peer_url from peers group by config, peer_id", _PEERS)
def merged_peers(s, d):
    return membership.merged(a.peers(s, d), ["config"])


@_q("other_peers", "select config, peer_id from peers where side = 'old' and peer_id <> config + 1", _PEERS)
def other_peers(s, d):
    return membership.others(a.peers(s, d).filter("side = 'old'"), F.col("config") + 1).select("config", "peer_id")


@_q("equal_configs", """select config, count(*) filter (where change) = 0 as same from (select coalesce(o.config, n.config) as config, o.peer_id is null or n.peer_id is null or o.peer_url <> n.peer_url as change
 from (select * from peers where side = 'old') o full join (select * from peers where side = 'new') n on o.config = n.config and o.peer_id = n.peer_id) group by config""", _PEERS)
def equal_configs(s, d):
    return membership.equal_configs(a.peers(s, d), ["config"])


@_q("same_ids_in_order", ", o as (select *, row_number() over (partition by config, side order by peer_id % 10, peer_id) as ordinal from peers) select config, list(peer_id order by ordinal) filter (where side = 'old') is not distinct from list(peer_id order by ordinal) filter (where side = 'new') as same from o group by config", _PEERS)
def same_ids_in_order(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("config", "side").orderBy(F.col("peer_id") % 10, "peer_id")
    return membership.same_in_order(a.peers(s, d).withColumn("ordinal", F.row_number().over(w)), ["config"])


@_q("reset_peer_map", "select p.config, p.peer_id, coalesce(m.match_index, 0) as value from (select * from peers where side = 'old') p left join (select user_id as peer_id, max(log_index) as match_index from log group by user_id) m using (peer_id)", _LOG, _PEERS)
def reset_peer_map(s, d):
    log = a.events_log(s, d)
    values = log.groupBy(F.col("user_id").alias("peer_id")).agg(F.max("log_index").alias("value"))
    members = a.peers(s, d).filter("side = 'old'").select("config", "peer_id")
    return membership.reset_map(values, members, 0)


@_q("peer_membership", "select log_index, user_id % 200 in (select s_suppkey from supplier) as member from log", _LOG)
def peer_membership(s, d):
    own = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("peer_id"))
    log = a.events_log(s, d).withColumn("_p", F.col("user_id") % 200)
    return log.join(own, log._p == own.peer_id, "left").select("log_index", F.col("peer_id").isNotNull().alias("member"))


@_q("changed_peers", "select peer_id, peer_url, false as conflict from peers where side = 'old' and peer_id % 7 <> 0 union all select n.peer_id, n.peer_url, false from peers n where side = 'new' and peer_id not in (select peer_id from peers where side = 'old') union all select n.peer_id, n.peer_url, true from peers n join peers o using (peer_id) where n.side = 'new' and o.side = 'old' and n.peer_url <> o.peer_url", _PEERS)
def changed_peers(s, d):
    p = a.peers(s, d)
    old = p.filter("side = 'old'").select("peer_id", "peer_url")
    add = p.filter("side = 'new'").select("peer_id", "peer_url")
    return membership.change_peers(old, add, old.filter("peer_id % 7 = 0").select("peer_id"))


@_q("latest_leader", "select user_id % 20 as cluster, max_by(k, log_index) as leader_id, max_by('tcp://10.0.0.' || cast(k as varchar) || ':8047', log_index) as peer_url from log where k % 3 <> 0 group by 1", _LOG)
def latest_leader(s, d):
    log = a.events_log(s, d)
    status = log.select((F.col("user_id") % 20).alias("cluster"), F.col("log_index").alias("polled_at"), F.when(F.col("k") % 3 != 0, F.col("k")).alias("leader_id"), F.concat(F.lit("tcp://10.0.0."), F.col("k").cast("string"), F.lit(":8047")).alias("peer_url"))
    return membership.latest_leader(status, ["cluster"])


@_q("peer_status", "select user_id as peer_id, max(log_index) as polled_at, max_by(term, log_index) as current_term, max_by(k, log_index) as prune_index from log group by user_id", _LOG)
def peer_status(s, d):
    info = a.events_log(s, d).select(F.col("user_id").alias("peer_id"), F.col("log_index").alias("polled_at"), F.col("term").alias("current_term"), F.col("k").alias("prune_index"))
    return membership.latest_status(info)


#: Shapes of urls around an address and a port, and whether each is a peer's.
URLS = [("tcp://{a}:{p}", True), ("tcp://{a}:0{p}", True), ("tcp://{a}:7{p}", False), ("tcp://::::1:5", False), ("tcp://0.0.0.0:{p}", False), ("tcp://[::]:{p}", False), ("tcp://[::1]:{p}", True), ("http://{a}:{p}", False), ("tcp://{a}:{p}/x", False)]
URLS += [("tcp://me@{a}:{p}", False), ("tcp://{a}:0", False), ("tcp://{a}", False), ("tcp://256.{a}:{p}", False), ("tcp://localhost:{p}", False), ("tcp://[fe80::1:{p}]:1", True), ("tcp://[1:2:3:4:5:6:7:8:9]:1", False), ("tcp://[::ffff:{a}]:65535", True), ("tcp://{a}:65536", False), ("tcp://{a}:{p}#x", False)]
_SHAPES = ", ".join(f"('{u}', {str(ok).lower()})" for u, ok in URLS)


@_q("peer_url_check", f", shapes(shape, valid) as (values {_SHAPES}) select peer_id, replace(replace(shape, '{{a}}', '10.0.0.' || cast(peer_id % 250 as varchar)), '{{p}}', '8047') as peer_url, valid from peers, shapes where side = 'new'", _PEERS)
def peer_url_check(s, d):
    """Every customer's address in good and bad urls."""
    host = F.concat(F.lit("10.0.0."), (F.col("peer_id") % 250).cast("string"))
    shapes = F.explode(F.array(*(F.lit(u) for u, _ in URLS)))
    p = a.peers(s, d).filter("side = 'new'").select("peer_id", host.alias("host"), shapes.alias("shape"))
    url = F.replace(F.replace("shape", F.lit("{a}"), F.col("host")), F.lit("{p}"), F.lit("8047"))
    return p.select("peer_id", url.alias("peer_url")).withColumn("valid", membership.url_valid(F.col("peer_url")))


@_q("peer_text_round_trip", "select peer_id, 'node ' || cast(peer_id as varchar) || '/ü+%' as name, peer_url, peer_url || '/node%20' || cast(peer_id as varchar) || '%2F%C3%BC%2B%25' as said, true as same from peers", _PEERS)
def peer_text_round_trip(s, d):
    named = a.peers(s, d).withColumn("name", F.concat(F.lit("node "), F.col("peer_id").cast("string"), F.lit("/ü+%")))
    said = named.withColumn("said", membership.peer_text(F.col("name"), F.col("peer_url")))
    back = membership.peer_of_text(F.col("said"))
    return said.select("peer_id", "name", "peer_url", "said", (back == F.struct(F.col("name").alias("peer_id"), F.col("peer_url"))).alias("same"))


_HAVE = "coalesce(max(last_index) over (order by arrival rows between unbounded preceding and 1 preceding), 0)"


@_q("feed_gaps", f"select arrival, last_index, n, cast(greatest(0, last_index - n - have) as bigint) as missing, cast(greatest(0, least(n, last_index - have)) as bigint) as fresh_entries from (select *, {_HAVE} as have from broadcast)", _LOG, _CAST)
def feed_gaps(s, d):
    f = a.broadcast(s, d).withColumn("feed", F.lit("one"))
    return feed.gap_report(f, ["feed"]).select("arrival", "last_index", "n", "missing", "fresh_entries")


@_q("feed_strict", f"select arrival, last_index, case when last_index - n = have then 'take' when last_index <= have then 'drop' else 'refetch' end as outcome from (select *, {_HAVE} as have from broadcast)", _LOG, _CAST)
def feed_strict(s, d):
    f = a.broadcast(s, d).withColumn("feed", F.lit("one"))
    return feed.strict_report(f, ["feed"]).select("arrival", "last_index", "outcome")


@_q("feed_repaired", "select log_index, term, not exists (select 1 from broadcast b where l.log_index > b.last_index - b.n and l.log_index <= b.last_index) as fetched from log l where log_index <= (select max(last_index) from broadcast)", _LOG, _CAST)
def feed_repaired(s, d):
    return feed.repaired(a.broadcast(s, d), a.events_log(s, d))


@_q("feed_silences", "select user_id, ms as received_ms, quiet_ms from (select user_id, epoch_us(ts) // 1000 as ms, lead(epoch_us(ts) // 1000) over (partition by user_id order by ts, log_index) - epoch_us(ts) // 1000 as quiet_ms from log) where quiet_ms > 1000", _LOG)
def feed_silences(s, d):
    pulses = a.events_log(s, d).select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("received_ms"))
    return feed.silences(pulses, ["user_id"])


@_q("accepted_messages", "select log_index, k from log where k % 10 = 3", _LOG)
def accepted_messages(s, d):
    m = a.events_log(s, d).select("log_index", "k", F.concat(F.lit("secret"), (F.col("k") % 10).cast("string")).cast("binary").alias("secret"))
    return feed.accepted_secret(m, b"secret3").select("log_index", "k")


@_q("apply_order_errors", "select seq, next_index, expected from (select log_index as seq, next_index, coalesce(lag(next_index + n - 1) over (order by log_index), 0) + 1 as expected from (select log_index, log_index * 2 - 1 + case when k = 7 then 1 else 0 end as next_index, 2 as n from log)) where next_index <> expected", _LOG)
def apply_order_errors(s, d):
    b = a.events_log(s, d).select(F.col("log_index").alias("seq"), (F.col("log_index") * 2 - 1 + F.when(F.col("k") == 7, 1).otherwise(0)).alias("next_index"), F.lit(2).alias("n"), F.lit(None).cast("bigint").alias("snapshot_index"))
    return feed.next_apply_ok(b).select("seq", "next_index", "expected")


@_q("monitor_messages", "select user_id as peer_id, 'event: raft' || chr(10) || 'data: {\"current_term\":' || cast(max(term) as varchar) || ',\"last_index\":' || cast(max(log_index) as varchar) || '}' || chr(10) || chr(10) as message from log group by user_id", _LOG)
def monitor_messages(s, d):
    info = a.events_log(s, d).groupBy(F.col("user_id").alias("peer_id")).agg(F.max("term").alias("current_term"), F.max("log_index").alias("last_index"))
    return reports.monitor_message(info, ["current_term", "last_index"])


@_q("cluster_status", "select peer_id, last_index, (select max(last_index) from (select user_id % 50 as peer_id, max(log_index) as last_index from log group by 1) where peer_id % 10 = 0) - last_index as behind from (select user_id % 50 as peer_id, max(log_index) as last_index from log group by 1)", _LOG)
def cluster_status(s, d):
    info = a.events_log(s, d).groupBy((F.col("user_id") % 50).alias("peer_id")).agg(F.max("log_index").alias("last_index"))
    info = info.withColumn("is_leader", F.col("peer_id") % 10 == 0).withColumn("commit_index", F.col("last_index"))
    return reports.cluster_status(info).select("peer_id", "last_index", "behind")


@_q("final_config", "select min(log_index) as log_index from log where entry_type = 1 and log_index > 600", _LOG)
def final_config(s, d):
    return reports.final_config(a.events_log(s, d), 600)


@_q("snapshot_transfer", """select log_index as peer_id, cast(case when k % 5 = 0 then 0 when k % 3 = 0 then greatest(0, least(k * 30 - 500, 1500)) else least(k * 16 + 100, 1500) end as bigint) as next_position,
 k % 5 <> 0 and case when k % 3 = 0 then greatest(0, least(k * 30 - 500, 1500)) else least(k * 16 + 100, 1500) end >= 1500 as done from log""", _LOG)
def snapshot_transfer(s, d):
    k = F.col("k")
    steps = a.events_log(s, d).select(F.col("log_index").alias("peer_id"), (k * 16).alias("position"), F.lit(1500).alias("size"), F.lit(100).alias("chunk"), (k % 5 != 0).alias("same_snapshot"), F.when(k % 3 == 0, k * 30 - 500).alias("wanted"))
    return reports.snapshot_transfer(steps)


@_q("quiet_peers", "select peer_id, received_ms, quiet_ms from (select user_id % 300 as peer_id, epoch_us(ts) // 1000 as received_ms, lead(epoch_us(ts) // 1000) over (partition by user_id % 300 order by ts, log_index) - epoch_us(ts) // 1000 as quiet_ms from log) where quiet_ms > 1500", _LOG)
def quiet_peers(s, d):
    pulses = a.events_log(s, d).select((F.col("user_id") % 300).alias("peer_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("received_ms"))
    return reports.quiet_peers(pulses)


_LOST = "log_index % 1000 <> 500"


@_q("flood_verified", f"select moved as log_index, iteration, before from (select row_number() over (order by log_index) as moved, log_index as iteration, lag(log_index) over (order by log_index) as before from log where {_LOST}) where iteration <> before + 1", _LOG)
def flood_verified(s, d):
    """A made-up load as long as the log, of which every thousandth entry has been lost and its successors moved up."""
    n = a.events_log(s, d).agg(F.max("log_index").alias("n")).first().n
    i = F.col("log_index")
    moved = reports.flood(s, n).filter(_LOST).withColumn("log_index", i - F.floor((i + 499) / 1000).cast("bigint"))
    return reports.verify_flood(moved).select("log_index", "iteration", F.col("_before").alias("before"))


@_q("feed_signals", f"""select arrival, last_index, unnest(case when missing > 0 then ['stale', 'fresh'] when arrival = first then ['fresh'] else [] end) as signal,
 unnest(case when missing > 0 then [missing, null] when arrival = first then [null] else [] end) as missing
 from (select arrival, last_index, cast(greatest(0, last_index - n - have) as bigint) as missing, min(arrival) over () as first from (select *, {_HAVE} as have from broadcast))""", _LOG, _CAST)
def feed_signals(s, d):
    f = a.broadcast(s, d)
    at = feed.signals(f.withColumn("feed", F.lit("one")), ["feed"])
    return at.join(f.select("arrival", "last_index"), "arrival").select("arrival", "last_index", "signal", "missing")


_BEAT = 6 * 3600 * 1000


@_q("feed_heartbeats", f"""select user_id, sent_ms + k * {_BEAT} as sent_ms, term, last_index, cast(0 as bigint) as n
 from (select *, unnest(range(1, 1 + greatest(0, (until - sent_ms - 1) // {_BEAT}))) as k
  from (select *, coalesce(lead(sent_ms) over (partition by user_id order by sent_ms, last_index), {a.NOW_MS}) as until
   from (select user_id, epoch_us(ts) // 1000 as sent_ms, term, log_index as last_index from log)))""", _LOG)
def feed_heartbeats(s, d):
    sent = a.events_log(s, d).select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("sent_ms"), "term", F.col("log_index").alias("last_index"))
    return feed.heartbeats(sent, ["user_id"], a.NOW_MS, _BEAT)


@_q("config_in_force", "select log_index, cast(coalesce(max(log_index) filter (where entry_type = 1) over (order by log_index), 0) as bigint) as peers_index from log", _LOG)
def config_in_force(s, d):
    return feed.config_in_force(a.events_log(s, d))


@_q("caught_up_reader", "select max(log_index) as last_index, greatest(3, max_by(term, log_index)) as current_term, greatest(40, coalesce(max(log_index) filter (where entry_type = 1), 40)) as peers_index from log where log_index > 200", _LOG)
def caught_up_reader(s, d):
    return feed.caught_up(a.events_log(s, d), 200, 3, 40)


@_q("reconciled_peers", """, v as (select config, peer_id, peer_url as value from peers where side = 'old'), m as (select config, peer_id from peers where side = 'new')
 select config, peer_id, coalesce(v.value, 'none') as value, case when v.value is null then 'added' when m.peer_id is null then 'removed' else 'kept' end as action
 from v full join m using (config, peer_id)""", _PEERS)
def reconciled_peers(s, d):
    p = a.peers(s, d)
    values = p.filter("side = 'old'").select("config", "peer_id", F.col("peer_url").alias("value"))
    return membership.reconcile(values, p.filter("side = 'new'"), ["config"], "none")
