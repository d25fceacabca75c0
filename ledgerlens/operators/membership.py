"""Peer lists: parsing, difference, merging, reconciling and joining configurations."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Characters besides letters, digits and ~ that an id keeps in a url.
_PLAIN = "-_.!*'()"


class PeerError(ValueError):
    """A peer list that can't be taken."""


def _url_pattern() -> str:
    """Peers are reached at tcp:// an address that is not the unspecified one, and a port from 1 to 65535."""
    byte = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = rf"(?:{byte}\.){{3}}{byte}"
    h = "[0-9A-Fa-f]{1,4}"
    tails = lambda left: [f"(?:{h}(?::{h}){{0,{6 - left}}})?" if left < 7 else "", *([f"(?:{h}:){{0,{5 - left}}}{v4}"] if left < 6 else [])]
    heads = lambda left: f"{h}(?::{h}){{{left - 1}}}" if left else ""
    v6 = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{v4}", *(f"{heads(left)}::{tail}" for left in range(8) for tail in tails(left))]
    port = "0*(?:6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[1-9][0-9]{0,3})"
    return rf"^tcp://(?:(?!0\.0\.0\.0:){v4}|\[(?!::\])(?:{'|'.join(v6)})\]):{port}$"


#: The one rule for urls, in Python and in Spark.
PEER_URL = _url_pattern()


def parse_peer(peer) -> tuple[str, str]:
    """(id, url) of a url, an (id, url) pair or a mapping with id and url; one that is missing is as the other."""
    if isinstance(peer, str):
        pid, url = peer, peer
    elif isinstance(peer, dict):
        url = peer.get("url", peer.get("id"))
        pid = peer.get("id", url)
    else:
        pid, url = peer if len(peer) > 1 else (peer[0], peer[0])
    if not isinstance(pid, str) or not pid or not isinstance(url, str):
        raise PeerError(f"no peer: {peer!r}")
    if not re.match(PEER_URL, url):
        raise PeerError(f"no url of a peer: {url!r}")
    return pid, url


def parse_peer_text(text: str) -> tuple[str, str]:
    """(id, url) of a url that may be followed by a slash and the id, percent-encoded: what ``format_peer`` gives."""
    scheme, mark, rest = text.partition("://")
    host, slash, tail = rest.partition("/")
    url = scheme + mark + host
    if slash and not tail:
        raise PeerError(f"an empty id: {text!r}")
    return parse_peer((unquote(tail) if slash else url, url))


def parse_peer_list(text: str, old: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Peers of a comma-separated list."""
    return parse_peers([parse_peer_text(x) for x in re.split(r"\s*,\s*", text.strip())], old)


def parse_peers(peers, old: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Peers with unique ids and urls that do not contradict the old ones."""
    out = [parse_peer(p) for p in peers]
    if not out:
        raise PeerError("no peers")
    if len({i for i, _ in out}) < len(out) or len({u for _, u in out}) < len(out):
        raise PeerError("peers have an id or url in common")
    by_id, by_url = dict(old or ()), {u: i for i, u in old or ()}
    for i, u in out:
        if by_id.get(i, u) != u or by_url.get(u, i) != i:
            raise PeerError(f"peer {i} contradicts the present configuration")
    return out


def url_valid(url: Column) -> Column:
    return F.coalesce(url.rlike(PEER_URL), F.lit(False))


def join_configuration(present: list[tuple[str, str]], wanted, in_transition: bool = False) -> dict | None:
    """{old, new} of a change; None during one; an error where ids are the same in the same order."""
    if in_transition:
        return None
    new = parse_peers(wanted, present)
    if [i for i, _ in new] == [i for i, _ in present]:
        raise PeerError("the configuration has the same peers")
    return {"old": present, "new": new}


def format_peer(pid: str, url: str) -> str:
    return url if pid == url else f"{url}/{quote(pid, safe=_PLAIN)}"


def peer_text(pid: Column, url: Column) -> Column:
    """``format_peer`` as an expression."""
    encoded = F.regexp_replace(F.url_encode(pid), r"\+", "%20")
    for c in _PLAIN.replace("-_.*", "") + "~":
        encoded = F.regexp_replace(encoded, f"%{ord(c):02X}", c)
    return F.when(pid == url, url).otherwise(F.concat(url, F.lit("/"), encoded))


def peer_of_text(text: Column) -> Column:
    """struct(peer_id, peer_url) of ``peer_text``, null where the id is empty or the url is none of a peer."""
    url = F.regexp_extract(text, r"^([^/]*//[^/]*)", 1)
    tail = F.regexp_extract(text, r"^[^/]*//[^/]*/(.*)$", 1)
    named = text.rlike(r"^[^/]*//[^/]*/")
    pid = F.when(named, F.url_decode(F.regexp_replace(tail, r"\+", "%2B"))).otherwise(url)
    return F.when(url_valid(url) & (pid != ""), F.struct(pid.alias("peer_id"), url.alias("peer_url")))


def diff(peers: DataFrame, by: list[str]) -> DataFrame:
    """peers(side, peer_id, peer_url): what happens to each peer between old and new."""
    old = peers.filter("side = 'old'").select(*by, "peer_id", F.col("peer_url").alias("old_url"))
    new = peers.filter("side = 'new'").select(*by, "peer_id", F.col("peer_url").alias("new_url"))
    met = old.join(new, [*by, "peer_id"], "full")
    change = F.when(F.col("old_url").isNull(), "added").when(F.col("new_url").isNull(), "removed").when(F.col("old_url") != F.col("new_url"), "conflict").otherwise("kept")
    return met.withColumn("change", change)


def merged(peers: DataFrame, by: list[str]) -> DataFrame:
    """Union of both sides by peer; the new side's url overrides."""
    return peers.groupBy(*by, "peer_id").agg(F.max_by("peer_url", F.when(F.col("side") == "new", 1).otherwise(0)).alias("peer_url"))


def others(peers: DataFrame, own: Column) -> DataFrame:
    return peers.filter(F.col("peer_id") != own)


def reset_map(values: DataFrame, members: DataFrame, default) -> DataFrame:
    """A value for each member: the one it had, or the default."""
    return members.join(values, "peer_id", "left").select(*members.columns, F.coalesce("value", F.lit(default)).alias("value"))


def reconcile(values: DataFrame, members: DataFrame, by: list[str], default=None, create: bool = True) -> DataFrame:
    """(by, peer_id, value, action): values of members 'kept', those of others 'removed', and, where
    ``create``, the default 'added' for members without one."""
    v = values.select(*by, "peer_id", "value", F.lit(True).alias("_had"))
    m = members.select(*by, "peer_id", F.lit(True).alias("_is"))
    action = F.when(F.col("_is").isNull(), "removed").when(F.col("_had").isNull(), "added").otherwise("kept")
    met = v.join(m, [*by, "peer_id"], "full" if create else "left").withColumn("action", action)
    return met.select(*by, "peer_id", F.when(F.col("action") == "added", F.lit(default)).otherwise(F.col("value")).alias("value"), "action")


def equal_configs(peers: DataFrame, by: list[str]) -> DataFrame:
    """For each configuration, whether both sides have the same peers at the same urls."""
    d = diff(peers, by)
    return d.groupBy(*by).agg((F.count_if(F.col("change") != "kept") == 0).alias("same"))


def same_in_order(peers: DataFrame, by: list[str]) -> DataFrame:
    """Whether both sides list the same ids in the same order (their ordinals' order)."""
    lists = peers.groupBy(*by).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("ordinal", "peer_id")))), lambda x: x["peer_id"]).alias(s) for s in ("old", "new")])
    return lists.select(*by, (F.col("old") == F.col("new")).alias("same"))


def change_peers(peers: DataFrame, add: DataFrame, delete: DataFrame) -> DataFrame:
    """peers without delete and with add; an added id that is there under another url is an error row."""
    clash = add.join(peers.select("peer_id", F.col("peer_url").alias("_url")), "peer_id", "left")
    fine = clash.filter(F.col("_url").isNull()).select("peer_id", "peer_url", F.lit(False).alias("conflict"))
    bad = clash.filter(F.col("_url") != F.col("peer_url")).select("peer_id", "peer_url", F.lit(True).alias("conflict"))
    return peers.join(delete, "peer_id", "left_anti").select("peer_id", "peer_url", F.lit(False).alias("conflict")).unionByName(fine).unionByName(bad)


def latest_leader(status: DataFrame, by: list[str]) -> DataFrame:
    """status(polled_at, leader_id, peer_url): the last known leader and its url."""
    return status.filter("leader_id is not null").groupBy(*by).agg(F.max_by(F.struct("leader_id", "peer_url"), "polled_at").alias("s")).select(*by, "s.leader_id", "s.peer_url")


def latest_status(info: DataFrame, at: str = "polled_at") -> DataFrame:
    """The last info or error of each peer."""
    rest = [c for c in info.columns if c not in ("peer_id", at)]
    return info.groupBy("peer_id").agg(F.max_by(F.struct(*rest), at).alias("s"), F.max(at).alias(at)).select("peer_id", at, "s.*")
