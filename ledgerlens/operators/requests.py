"""Idempotent requests: the index of ids, their expiry, and the classes of updates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import codec


def first_wins(log: DataFrame, key: str = "request_key") -> DataFrame:
    return log.groupBy(key).agg(F.min("log_index").alias("log_index"), F.count(F.lit(1)).alias("n"))


def request_index(log: DataFrame, key: str = "request_key") -> DataFrame:
    """key -> the last index written under it, in the order of the first."""
    return log.groupBy(key).agg(F.max("log_index").alias("log_index"), F.min("log_index").alias("first_index"))


def fresh_index(log: DataFrame, now_ms: int, ttl_ms: int | None, most: int | None = None) -> DataFrame:
    """(log_index, request_id): ids that are set and not expired, the newest ``most`` of them."""
    seconds = codec.id_seconds(F.col("request_id"))
    kept = log.filter(codec.id_is_set(F.col("request_id")) & ~codec.request_expired(seconds, now_ms, ttl_ms)).select("log_index", "request_id")
    return kept.orderBy(F.desc("log_index")).limit(most) if most is not None else kept


def prune_index(log: DataFrame, now_ms: int, ttl_ms: int | None) -> DataFrame:
    """One row: the index before the oldest fresh id, or the last index."""
    seconds = codec.id_seconds(F.col("request_id"))
    fresh = codec.id_is_set(F.col("request_id")) & ~codec.request_expired(seconds, now_ms, ttl_ms)
    return log.agg(F.coalesce(F.min(F.when(fresh, F.col("log_index"))) - 1, F.max("log_index")).alias("prune_index"))


def compaction_index(log: DataFrame, commit_index: int, now_ms: int, ttl_ms: int | None) -> DataFrame:
    return prune_index(log, now_ms, ttl_ms).select(F.least(F.lit(commit_index).cast("bigint"), "prune_index").alias("compaction_index"))


def cache_after_cleanup(index: DataFrame, now_ms: int, ttl_ms: int | None, most: int | None) -> DataFrame:
    """index(request_id, first_index): what is left when ids are dropped from the oldest on while
    they are expired or too many, stopping at the first keeper. The keeper is found as the least
    first_index that is fresh and within the cap, so ids are never put in one order."""
    expired = codec.request_expired(codec.id_seconds(F.col("request_id")), now_ms, ttl_ms)
    kept = index.filter(~expired)
    stop = kept.agg(F.min("first_index").alias("_stop"))
    if most is not None:
        newest = index.select("first_index").orderBy(F.desc("first_index")).limit(most).agg(F.min("first_index").alias("_cap"))
        within = index.join(F.broadcast(newest), F.col("first_index") >= F.col("_cap")).filter(~expired)
        stop = within.agg(F.min("first_index").alias("_stop"))
    return index.join(F.broadcast(stop), F.col("first_index") >= F.col("_stop")).select(*index.columns)


def payload_ok(data: Column, most: int) -> Column:
    return F.coalesce(F.length(data).between(1, most), F.lit(False))


def classify_updates(requests: DataFrame, index: DataFrame, pending: DataFrame, *, is_leader: bool, leader_id: str | None, last_applied: int, now_ms: int, ttl_ms: int | None, max_bytes: int, past_ms: int = 0, future_ms: int = 0) -> DataFrame:
    """requests(request_id, data) + (status, log_index).

    ignored: id or size is wrong; redirect: no leader here; pending: already waited for;
    expired: unknown and too old or from the future; append: unknown and acceptable;
    applied: known and applied; wait: known and not yet applied.
    """
    known = index.select(F.col("request_id").alias("_known"), F.col("log_index").alias("_at"))
    waiting = pending.select(F.col("request_id").alias("_waits")).distinct()
    met = requests.join(known, F.col("request_id") == F.col("_known"), "left").join(waiting, F.col("request_id") == F.col("_waits"), "left")
    sane = codec.request_sanity(codec.id_seconds(F.col("request_id")), now_ms, ttl_ms, past_ms, future_ms) == 0
    fine = codec.is_ident(F.col("request_id")) & payload_ok(F.col("data"), max_bytes)
    status = (
        F.when(~fine, "ignored")
        .when(F.lit(not is_leader), "redirect")
        .when(F.col("_waits").isNotNull(), "pending")
        .when(F.col("_at").isNull() & ~sane, "expired")
        .when(F.col("_at").isNull(), "append")
        .when(F.col("_at") <= last_applied, "applied")
        .otherwise("wait")
    )
    return met.select(*requests.columns, status.alias("status"), F.when(status == "applied", F.col("_at")).alias("log_index"), F.when(status == "redirect", F.lit(leader_id)).alias("leader"))


def classify_config_updates(requests: DataFrame, index: DataFrame, *, is_leader: bool, in_transition: bool, reply_waiting: bool, update_id: bytes | None, commit_index: int, now_ms: int, ttl_ms: int | None) -> DataFrame:
    """requests(request_id, peers_ok) + (status, log_index).

    0 not the leader; 1 accepted, with the index if it is committed; 2 the peers, or the entry
    that the id stands for, are not a configuration to take; 3 another change is under way;
    4 the id is expired or from the future. Ids of a wrong length are ignored (null).
    """
    known = index.select(F.col("request_id").alias("_known"), F.col("log_index").alias("_at"))
    met = requests.join(known, F.col("request_id") == F.col("_known"), "left")
    sane = codec.request_sanity(codec.id_seconds(F.col("request_id")), now_ms, ttl_ms) == 0
    own = F.coalesce(F.col("request_id") == F.lit(update_id), F.lit(False)) if update_id is not None else F.lit(False)
    new = F.when(~sane, 4).when(~F.col("peers_ok"), 2).when(F.lit(in_transition), 3).otherwise(1)
    seen = F.when((F.col("_at") <= commit_index) | own, 1).otherwise(2)
    status = (
        F.when(~codec.is_ident(F.col("request_id")), F.lit(None).cast("int"))
        .when(F.lit(not is_leader), 0)
        .when(F.lit(reply_waiting), F.when(own, 1).otherwise(3))
        .when(F.col("_at").isNull(), new)
        .otherwise(seen)
    )
    index_out = F.when((status == 1) & F.lit(not reply_waiting) & (F.col("_at") <= commit_index), F.col("_at"))
    return met.select(*requests.columns, status.alias("status"), index_out.alias("log_index"))


def resolved(pending: DataFrame, last_applied: int) -> DataFrame:
    """Pending requests whose entry has been applied."""
    return pending.filter(F.col("log_index") <= last_applied)


def bounced_duplicates(calls: DataFrame) -> DataFrame:
    """calls(seq, peer_id, message_id) that repeat their peer's last message id."""
    w = Window.partitionBy("peer_id").orderBy("seq")
    return calls.withColumn("bounced", F.coalesce(F.lag("message_id").over(w) == F.col("message_id"), F.lit(False)))


def replayed_replies(calls: DataFrame) -> DataFrame:
    """calls(seq, peer_id, message_id, reply) + (bounced, answer): a repeated call isn't handled again,
    it gets what the call that it repeats was answered, null where that has no reply yet."""
    at = bounced_duplicates(calls)
    so_far = Window.partitionBy("peer_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(~F.col("bounced"), F.struct("reply"))
    return at.withColumn("answer", F.last(own, ignorenulls=True).over(so_far)["reply"])


# The types of messages, those of peers first.
PEER_MESSAGES = {"+": "append_entries", "?": "request_vote", "$": "install_snapshot"}
CLIENT_MESSAGES = {"=": "request_update", "&": "config_update", "<": "request_entries", "^": "request_config", "%": "request_log_info"}


def message_route(kind: Column, secret: Column, message_id: Column, own_secret: bytes) -> Column:
    """What handles a message: 'refused' (another secret), a known type's name, 'ignored' (a peer's message
    whose id has not 1 to 12 bytes), 'custom' (any other type, for the state machine) or 'dropped' (none)."""
    text = kind.cast("string")
    has_id = F.coalesce(F.length(message_id).between(1, codec.REQUEST_ID_BYTES), F.lit(False))
    route = F.when(~F.coalesce(secret == F.lit(own_secret), F.lit(False)), "refused")
    for code, name in PEER_MESSAGES.items():
        route = route.when(text == code, F.when(has_id, name).otherwise("ignored"))
    for code, name in CLIENT_MESSAGES.items():
        route = route.when(text == code, name)
    return route.when(F.length(kind) > 0, "custom").otherwise("dropped")


def serve(messages: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(message_id, reply): what the handlers of custom types answer to messages(message_id, message_type, args).

    Each handler turns the messages of its type into replies, as many as it wants; types without one get none.
    """
    replies = [handle(messages.filter(F.col("message_type") == kind)).select("message_id", "reply") for kind, handle in handlers.items()]
    return reduce(DataFrame.unionByName, replies) if replies else messages.select("message_id", F.lit(None).cast("string").alias("reply")).limit(0)


def table_function(spark: SparkSession, name: str, handler: type, schema: str) -> None:
    """Makes a class with eval(...) that yields rows a table function of SQL, for custom requests on arguments."""
    spark.udtf.register(name, F.udtf(handler, returnType=schema))


def correlate(responses: DataFrame, handlers: DataFrame, on: str = "message_id") -> DataFrame:
    """Responses with a waiting handler; others are dropped."""
    return responses.join(handlers, on)


def fresh_view(last_applied: Column, last_update: Column) -> Column:
    """Whether what has been applied holds the reader's own last update."""
    return F.coalesce(last_applied >= last_update, F.lit(True))
