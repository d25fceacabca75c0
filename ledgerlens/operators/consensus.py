"""Consensus decisions as functions of recorded state: votes, commits, replication, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.codec import majority_of

FOLLOWER, CANDIDATE, LEADER, CLIENT = "Follower", "Candidate", "Leader", "Client"
#: The transitions that a peer can make.
TRANSITIONS = ((CLIENT, FOLLOWER), (CLIENT, LEADER), (FOLLOWER, CANDIDATE), (CANDIDATE, FOLLOWER), (CANDIDATE, LEADER), (LEADER, FOLLOWER), (FOLLOWER, CLIENT), (CANDIDATE, CLIENT), (LEADER, CLIENT))


def first_votes(votes: DataFrame, by: list[str]) -> DataFrame:
    """A peer's first vote of an election counts."""
    return votes.groupBy(*by, "peer_id").agg(F.min_by("granted", "seq").alias("granted"))


def tally(votes: DataFrame, by: list[str], peers: int) -> DataFrame:
    """Votes and voters of a configuration of ``peers`` members, and what follows from them."""
    need = peers // 2 + 1
    t = first_votes(votes, by).groupBy(*by).agg(F.count_if("granted").alias("votes"), F.count(F.lit(1)).alias("voters"))
    return t.select(*by, "votes", "voters", (F.col("voters") >= need).alias("majority_voted"), (F.col("votes") >= need).alias("won"))


def joint_tally(votes: DataFrame, by: list[str], members: DataFrame) -> DataFrame:
    """members(side, peer_id): both sides need their own majority; a peer may be of both."""
    sizes = members.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    each = first_votes(votes, by).join(F.broadcast(members), "peer_id").groupBy(*by, "side").agg(F.count_if("granted").alias("votes"), F.count(F.lit(1)).alias("voters"))
    met = votes.select(*by).distinct().crossJoin(F.broadcast(sizes)).join(each, [*by, "side"], "left")
    need = majority_of(F.col("n"))
    have = lambda c: F.min(F.coalesce(F.col(c), F.lit(0)) >= need)
    return met.groupBy(*by).agg(have("voters").alias("majority_voted"), have("votes").alias("won"))


def majority_index(progress: DataFrame, by: list[str], peers: int | None = None) -> DataFrame:
    """The highest index that a majority of each group has: the k-th largest match_index.

    Peers that acknowledged nothing count with 0 where the number of peers is given.
    """
    n = F.lit(peers) if peers else F.count(F.lit(1))
    k = (F.floor(n / 2) + 1).cast("int")
    ranked = F.sort_array(F.collect_list("match_index"), asc=False)  # one entry a peer
    picked = F.when(F.size(ranked) >= k, F.element_at(ranked, k)).otherwise(F.lit(0).cast("bigint"))
    return progress.groupBy(*by).agg(picked.alias("majority_index"))


def commit_index(progress: DataFrame, log: DataFrame, peers: int | None = None, commit_before: int = 0) -> DataFrame:
    """By leader term: the majority's index if its entry is of that term and above the last commit.

    Terms never fall, so if the k-th largest index is of an older term nothing commits.
    """
    top = majority_index(progress, ["leader_term"], peers)
    terms = log.select(F.col("log_index").alias("_i"), F.col("term").alias("_t"))
    met = top.join(terms, top.majority_index == F.col("_i"), "left")
    ok = (F.col("_t") == F.col("leader_term")) & (F.col("majority_index") > commit_before)
    return met.select("leader_term", "majority_index", F.when(ok, F.col("majority_index")).alias("commit_index"))


def joint_majority_index(progress: DataFrame, members: DataFrame, by: list[str], own: str | None = None) -> DataFrame:
    """Least of both sides' majority index; the leader's own log counts wherever it is a member."""
    met = members.join(progress, "peer_id", "left") if not by else progress.select(*by).distinct().crossJoin(F.broadcast(members)).join(progress, [*by, "peer_id"], "left")
    far = F.lit((1 << 53) - 1).cast("bigint")
    at = F.when(F.col("peer_id") == F.lit(own), far).otherwise(F.coalesce("match_index", F.lit(0).cast("bigint"))) if own is not None else F.coalesce("match_index", F.lit(0).cast("bigint"))
    sides = majority_index(met.withColumn("match_index", at), [*by, "side"])
    return sides.groupBy(*by).agg(F.min("majority_index").alias("majority_index"))


def log_up_to_date(c_term: Column, c_index: Column, term: Column, index: Column) -> Column:
    return F.struct(c_term, c_index) >= F.struct(term, index)


def vote_granted(ask: DataFrame) -> DataFrame:
    """ask(candidate_id, candidate_term, candidate_last_index, candidate_last_term, current_term,
    voted_for, last_index, last_term, spiral_guard) + (granted, new_term)."""
    c = F.col
    free = c("voted_for").isNull() | (c("voted_for") == c("candidate_id")) | (c("candidate_term") > c("current_term"))
    fresh = log_up_to_date(c("candidate_last_term"), c("candidate_last_index"), c("last_term"), c("last_index"))
    granted = F.when(c("candidate_term") < c("current_term"), False).when(c("spiral_guard"), False).otherwise(free & fresh)
    moved = (granted | (c("candidate_term") > c("current_term"))) & ~c("spiral_guard") & (c("candidate_term") >= c("current_term"))
    return ask.select(*ask.columns, granted.alias("granted"), F.when(moved, c("candidate_term")).otherwise(c("current_term")).alias("new_term"))


def election_start(current_term: Column, peers: Column) -> Column:
    """A new term with one's own vote; a sole member wins at once."""
    return F.struct((current_term + 1).alias("term"), F.lit(1).alias("votes"), (peers == 1).alias("won"))


def on_vote_response(state: Column, current_term: Column, sent_term: Column, term: Column, won: Column, majority_voted: Column) -> Column:
    """What a candidate does: step down for a higher term (once a majority has answered), lead, or wait."""
    return F.when((term > current_term) & majority_voted, "step_down").when((state != CANDIDATE) | (sent_term != current_term), "ignore").when(won, "lead").otherwise("wait")


def leader_init(peers: DataFrame, last_index: int) -> DataFrame:
    return peers.select("peer_id", F.lit(last_index + 1).cast("bigint").alias("next_index"), F.lit(0).cast("bigint").alias("match_index"), F.lit(0).cast("bigint").alias("match_term"))


def needs_checkpoint(last_term: Column, current_term: Column, commit: Column, last_index: Column) -> Column:
    """A new leader writes a checkpoint where older terms' entries are not committed."""
    return (last_term != current_term) & (commit < last_index)


def on_append_response(r: DataFrame, first_index: int) -> DataFrame:
    """r(peer_id, success, sent_prev_index, sent_last_index, sent_last_term, conflict_index) + next and match."""
    c = F.col
    back = F.when(c("conflict_index") < c("sent_prev_index"), F.when(c("conflict_index") < first_index, F.lit(first_index - 1)).otherwise(c("conflict_index"))).otherwise(c("sent_prev_index"))
    return r.select("peer_id", F.when(c("success"), c("sent_last_index") + 1).otherwise(back).cast("bigint").alias("next_index"), F.when(c("success"), c("sent_last_index")).alias("match_index"), F.when(c("success"), c("sent_last_term")).alias("match_term"))


def what_to_send(peers: DataFrame, first_index: int, last_index: int) -> DataFrame:
    """peers(peer_id, next_index, last_success) + kind: snapshot, entry, entries or heartbeat."""
    c = F.col
    kind = F.when(c("next_index") < first_index, "snapshot").when(c("next_index") > last_index, "heartbeat").when(c("last_success"), "entries").otherwise("entry")
    return peers.withColumn("kind", kind)


def append_decision(calls: DataFrame, log: DataFrame, last_index: int, snapshot_index: int = 0, snapshot_term: int = 0) -> DataFrame:
    """calls(leader_term, prev_index, prev_term, leader_commit, n, current_term, commit_index) +
    (outcome, conflict_index, new_commit): what a follower answers to appended entries."""
    c = F.col
    terms = log.select(F.col("log_index").alias("_i"), F.col("term").alias("_t"))
    met = calls.join(terms, c("prev_index") == c("_i"), "left")
    term = F.coalesce("_t", F.when(c("prev_index") == snapshot_index, F.lit(snapshot_term).cast("bigint")))
    outcome = F.when(c("leader_term") < c("current_term"), "stale").when(c("prev_index") < c("commit_index"), "fatal").when(F.coalesce(term == c("prev_term"), F.lit(False)), "append").otherwise("mismatch")
    short = (outcome == "mismatch") & (c("prev_index") > last_index)
    commit = F.when((outcome == "append") & (c("leader_commit") > c("commit_index")), F.least(c("leader_commit"), c("prev_index") + c("n"))).otherwise(c("commit_index"))
    return met.select(*calls.columns, outcome.alias("outcome"), F.when(short, F.lit(last_index + 1).cast("bigint")).alias("conflict_index"), commit.alias("new_commit"))


def config_after_commit(is_member: Column, transitional: Column, peers_index: Column, commit: Column) -> Column:
    """step_down where the leader is no longer a member, append_new where the joint one is committed."""
    return F.when(~is_member, "step_down").when(transitional & (commit >= peers_index), "append_new").otherwise("none")


def next_state(wanted: Column, is_member: Column) -> Column:
    return F.when((wanted == FOLLOWER) & ~is_member, CLIENT).otherwise(wanted)


def bad_transitions(states: DataFrame) -> DataFrame:
    """states(peer_id, seq, state): changes that no peer makes."""
    w = Window.partitionBy("peer_id").orderBy("seq")
    before = F.lag("state").over(w)
    known = F.lit(False)
    for a, b in TRANSITIONS:
        known = known | ((F.col("before") == a) & (F.col("state") == b))
    return states.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col("state")) & ~known)


def state_changes(states: DataFrame) -> DataFrame:
    w = Window.partitionBy("peer_id").orderBy("seq")
    return states.withColumn("before", F.lag("state").over(w)).filter(F.col("before").isNull() | (F.col("before") != F.col("state")))


def startup_errors(s: DataFrame) -> DataFrame:
    """One row per violated rule of a peer's recorded state at its start."""
    c = F.col
    rules = {
        "transitional config without request key": c("is_transitional") & c("peers_update_request").isNull(),
        "config in the log not confirmed": c("peers_update_request").isNotNull() & c("peers_index").isNull(),
        "config not appended to the log": c("peers_index") > c("last_index"),
        "last applied above the last index": c("last_applied") > c("last_index"),
        "state machine not up to the first entry": c("first_index") > c("last_applied") + 1,
        "current term below the last entry's": c("last_term") > c("current_term"),
        "snapshot with index 0 has a term": (c("snapshot_index") == 0) & (c("snapshot_term") != 0),
        "snapshot does not precede the first index": c("snapshot_index") != c("first_index") - 1,
    }
    named = F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()])
    return s.select("peer_id", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("rule"))


def startup_repair(s: DataFrame, index: DataFrame) -> DataFrame:
    """The state as a start repairs it: term, index of the configuration, how far to feed a snapshot."""
    c = F.col
    known = index.select(F.col("request_id").alias("_known"), F.col("log_index").alias("_at"))
    met = s.join(known, c("peers_update_request") == c("_known"), "left")
    return met.select("peer_id", F.greatest("current_term", "last_term").alias("current_term"), F.coalesce("peers_index", "_at").alias("peers_index"), F.when(c("first_index") > c("last_applied") + 1, c("snapshot_index")).alias("feed_to"))
