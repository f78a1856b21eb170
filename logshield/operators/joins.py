"""Enrichment joins: addresses in ranges, lists, bans and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logshield.functions.ip import cidr_bounds, ip_key, ip_v4, is_cidr, is_ip, range_cidrs, target_kind
from logshield.sources.shared import cut

#: Characters of the pieces by which tokens are looked up.
GRAM = 3


def enrich_geo(requests: DataFrame, ranges: DataFrame, bits: int = 16) -> DataFrame:
    """requests with asn, country and as_org of the range that holds client_ip; null if none, and
    for IPv6. Ranges are cut at blocks of 2^bits addresses and joined by block; of overlapping
    ranges the one with the greatest start counts. Spark broadcasts the cut ranges if they are
    small; only distinct addresses are joined, so a busy address is looked up once."""
    pieces = ranges.select("*", F.explode(F.sequence(F.shiftright("start_ip", bits), F.shiftright("end_ip", bits))).alias("block"))
    seen = requests.select("client_ip").distinct().withColumn("v4", ip_v4(F.col("client_ip"))).where("v4 IS NOT NULL").withColumn("block", F.shiftright("v4", bits))
    hit = seen.join(pieces, (seen["block"] == pieces["block"]) & F.col("v4").between(F.col("start_ip"), F.col("end_ip")))
    best = hit.groupBy("client_ip").agg(F.max_by(F.struct("asn", "country", "as_org"), F.struct("start_ip", "asn")).alias("g"))
    return requests.join(best, "client_ip", "left").select(*requests.columns, "g.asn", "g.country", "g.as_org")


def cidrs_for_asns(ranges: DataFrame, asns: DataFrame) -> DataFrame:
    """(asn, start, prefix): the aligned cover of all ranges of the listed networks."""
    got = ranges.join(asns.select("asn").distinct(), "asn")
    return got.select("asn", F.inline(range_cidrs(F.col("start_ip"), F.col("end_ip"))))


def _networks(rows: DataFrame, column: str) -> DataFrame:
    """CIDR rows with lo, hi and family. Cut, as the keys are long expressions that joins would
    otherwise copy into their null tests."""
    return cut(rows.where(is_cidr(F.col(column))).select("*", F.inline(F.array(cidr_bounds(F.col(column))))))


def _points(rows: DataFrame, column: str) -> DataFrame:
    """Distinct addresses with their keys, cut."""
    rows = rows.select(column).distinct().where(is_ip(F.col(column)))
    return cut(rows.withColumn("key", ip_key(F.col(column))))


def _around(points: DataFrame, networks: DataFrame) -> DataFrame:
    """Pairs of points(key) and distinct networks(lo, hi) that hold them: an equi-join per number of
    hex digits that both bounds share. A key of the join has 15 networks at most."""
    shared = F.length(F.regexp_extract(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.when(F.substring(F.col("lo"), i, F.lit(1)) == F.substring(F.col("hi"), i, F.lit(1)), "0").otherwise("1"))), "^(0*)", 1))
    nets = networks.withColumn("same", shared).withColumn("head", F.substring(F.col("lo"), F.lit(1), F.col("same")))
    lengths = sorted(r["same"] for r in nets.select("same").distinct().collect())  # 33 at most
    if not lengths:
        return points.join(nets.drop("same", "head"), points["key"] == nets["lo"])
    heads = points.withColumn("same", F.explode(F.array(*map(F.lit, lengths)))).withColumn("head", F.substring(F.col("key"), F.lit(1), F.col("same")))
    return heads.join(nets, ["same", "head"]).where("key BETWEEN lo AND hi").drop("same", "head")


def flattened(networks: DataFrame, value: str) -> DataFrame:
    """(key, side, value): where networks(lo, hi, value) begin (side 0, before the address) or end (side 2,
    after it), and the least value that holds from there on, null if none. Networks lie within each
    other or apart, so that these are the bounds of disjoint ranges."""
    nets = cut(networks.groupBy("lo", "hi").agg(F.min(value).alias("value")))
    edges = nets.select(F.col("lo").alias("key"), F.lit(0).alias("side")).unionByName(nets.select(F.col("hi").alias("key"), F.lit(2).alias("side"))).distinct()
    over = _around(edges, nets).where("side = 0 OR hi > key").groupBy("key", "side").agg(F.min("value").alias("value"))
    return edges.join(over, ["key", "side"], "left")


def _within(points: DataFrame, networks: DataFrame, value: str) -> DataFrame:
    """points(key, ...) with the least value of the networks that hold them, if any: the last bound at or
    before a point tells. Points and bounds are dealt out by ranges of addresses, so that neither a
    wide network nor a busy prefix is one group; what a range begins with, a row each, comes
    from the ranges before."""
    bounds = flattened(networks, value)
    names = points.columns
    kind = bounds.schema["value"].dataType
    here = points.select("key", F.lit(1).alias("side"), F.struct(*names).alias("point"), F.lit(None).cast(kind).alias("value"))
    both = here.unionByName(bounds.select("key", "side", F.lit(None).cast(here.schema["point"].dataType).alias("point"), "value"))
    dealt = cut(both.repartitionByRange("key", "side").select("*", F.spark_partition_id().alias("part")))
    order = F.struct("key", "side")
    told = F.when(F.col("side") != 1, F.struct("value"))
    ends = dealt.where("side <> 1").groupBy("part").agg(F.max_by(F.struct("value"), order).alias("end"))
    parts = dealt.select("part").distinct().join(ends, "part", "left")
    parts = parts.withColumn("begin", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "begin")
    last = F.last(told, ignorenulls=True).over(Window.partitionBy("part").orderBy("key", "side"))
    got = dealt.withColumn("last", last).where("side = 1").join(F.broadcast(parts), "part")
    return got.select("point.*", F.coalesce("last", "begin")["value"].alias("value"))


def whitelist_match(addresses: DataFrame, whitelist: DataFrame) -> DataFrame:
    """addresses(client_ip) with `listed`: equal to an entry or inside one; bad entries are ignored."""
    points = _points(addresses, "client_ip")
    single = _points(whitelist, "entry").select("key").distinct()
    exact = points.join(single, "key", "left_semi").select("client_ip")
    nets = _networks(whitelist.select("entry"), "entry").withColumn("one", F.lit(True))
    inside = _within(points, nets, "one").where("value").select("client_ip")
    hit = exact.unionByName(inside).distinct().withColumn("_hit", F.lit(True))
    return addresses.join(hit, "client_ip", "left").select(*addresses.columns, F.coalesce("_hit", F.lit(False)).alias("listed"))


def check_targets(targets: DataFrame, bans: DataFrame, as_of: int) -> DataFrame:
    """(target, kind, match, ban_target, reason, expired) of targets(target): a ban of the same text,
    expired or not, else the first active network ban, in target order, that holds the address."""
    live = F.col("expires_at").isNull() | (F.col("expires_at") > as_of)
    asked = targets.select("target").distinct()
    direct = asked.join(bans.select("target", "reason", (~live).alias("expired")), "target")
    direct = direct.select("target", F.lit("Direct").alias("match"), F.col("target").alias("ban_target"), "reason", "expired")
    points = _points(asked, "target")
    nets = _networks(bans.where(live).select(F.col("target").alias("ban_target"), "reason"), "ban_target")
    inside = _within(points, nets.withColumn("ban", F.struct("ban_target", "reason")), "ban").where("value IS NOT NULL")
    inside = inside.join(direct.select("target"), "target", "left_anti").select("target", F.lit("Subnet").alias("match"), "value.ban_target", "value.reason", F.lit(False).alias("expired"))
    found = direct.unionByName(inside)
    return asked.join(found, "target", "left").select("target", target_kind(F.col("target")).alias("kind"), "match", "ban_target", "reason", "expired")


def lookup(rows: DataFrame, side: DataFrame, key: str, value: str, default) -> DataFrame:
    """rows with `value` of side(key, value), or the default."""
    got = rows.join(side.select(key, F.col(value).alias("_v")), key, "left")
    return got.withColumn(value, F.coalesce("_v", F.lit(default))).drop("_v")


def _joined(rows: DataFrame, side: DataFrame, keys, small: int, how: str = "inner") -> DataFrame:
    """A join whose side is sent to all tasks only where it is counted to be small. What is read from a
    cut is compressed, so that Spark, by the size of its files, would send sides far too large for a driver."""
    return rows.join(F.broadcast(side) if side.count() <= small else side.hint("merge"), keys, how)


def blocklist_match(requests: DataFrame, tokens: DataFrame, column: str = "user_agent", small: int = 500_000) -> DataFrame:
    """requests with `token`: the first listed token, in order, that the column holds in any case.

    Texts repeat, so distinct ones are matched. Where a text has the first three characters of tokens (or
    a whole token of one or two), its pieces of the lengths of these tokens are looked up among all
    tokens. So a text is looked up as often as tokens of different lengths may begin in it, at any number
    of tokens, however many of them share their pieces. Tables of at most `small` rows are sent to all tasks."""
    texts = cut(requests.select(column).where(F.col(column).isNotNull()).distinct().withColumn("low", F.lower(column)))
    listed = cut(tokens.select(F.lower("token").alias("token")).where("token <> ''").distinct())
    size = F.char_length("token")
    heads = cut(listed.select(F.substring("token", 1, GRAM).alias("head"), size.alias("size")).distinct())
    sizes = [r[0] for r in heads.select(F.char_length("head")).distinct().collect()]  # GRAM at most
    if not sizes:
        return requests.withColumn("token", F.lit(None).cast("string"))
    last = F.char_length("low")
    at = lambda n: F.when(last >= n, F.transform(F.sequence(F.lit(1), F.greatest(last - n + 1, F.lit(1))), lambda i: F.struct(i.alias("at"), F.substring("low", i, F.lit(n)).alias("head"))))
    places = texts.select(column, "low", F.inline(F.flatten(F.array_compact(F.array(*map(at, sizes))))))
    pieces = _joined(places, heads, "head", small).select(column, F.substring("low", F.col("at"), F.col("size")).alias("token"))
    hits = cut(_joined(pieces, listed, "token", small).groupBy(column).agg(F.min("token").alias("token")))
    return _joined(requests, hits, column, small, "left").select(*requests.columns, "token")
