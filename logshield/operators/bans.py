"""The ban table as a ledger, its views, and what is reported from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logshield.functions.classify import datetime_text, duration_text
from logshield.functions.ip import is_private
from logshield.operators.joins import check_targets, whitelist_match
from logshield.sources.policies import latest

BAN_SECONDS = 3600
COLUMNS = ("target", "tier_level", "banned_at", "expires_at", "reason")


def build_bans(verdicts: DataFrame, seconds: int = BAN_SECONDS) -> DataFrame:
    """The ban table of verdicts: of each address its last ban, an hour long unless permanent. Verdicts
    with tier and duration_s, as escalation gives them, keep these."""
    b = verdicts.where("action = 'ban'")
    tier = F.col("tier") if "tier" in b.columns else F.lit(0)
    length = F.coalesce("duration_s", F.lit(seconds)) if "duration_s" in b.columns else F.lit(seconds)
    expires = F.when(F.col("permanent"), F.lit(None).cast("long")).otherwise(F.col("ts_sec") + length)
    last = b.groupBy("client_ip").agg(F.max_by(F.struct("ts_sec", expires.alias("expires_at"), "reason", tier.alias("tier_level")), F.struct("ts_sec", "row_id")).alias("s"))
    return last.select(F.col("client_ip").alias("target"), "s.tier_level", F.col("s.ts_sec").alias("banned_at"), "s.expires_at", "s.reason")


def manual_bans(targets: DataFrame) -> DataFrame:
    """Ban rows of targets(target, reason, banned_at): for good; private addresses are refused."""
    got = targets.where(~is_private(F.col("target")))
    return got.select("target", F.lit(0).alias("tier_level"), "banned_at", F.lit(None).cast("long").alias("expires_at"), F.coalesce("reason", F.lit("manual_cli_ban")).alias("reason"))


def upsert_bans(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The table after new bans: by target the last write counts."""
    ledger = existing.select(*COLUMNS, F.lit(0).alias("seq")).unionByName(new.select(*COLUMNS, F.lit(1).alias("seq")))
    return latest(ledger, "target", ("seq", "banned_at")).select(*COLUMNS)


def remove_bans(existing: DataFrame, targets: DataFrame) -> DataFrame:
    return existing.join(targets.select("target"), "target", "left_anti").select(existing.columns)


def active_bans(bans: DataFrame, as_of: int) -> DataFrame:
    return bans.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def purged_count(bans: DataFrame, as_of: int) -> DataFrame:
    """(kept, removed) if ended bans are purged."""
    live = F.col("expires_at").isNull() | (F.col("expires_at") > as_of)
    return bans.agg(F.count(F.when(live, 1)).alias("kept"), F.count(F.when(~live, 1)).alias("removed"))


def restore_set(bans: DataFrame, as_of: int, chunk: int = 1000) -> DataFrame:
    """What a restart puts back in force: the export of active bans, with the time that is left."""
    return export_enforcement(active_bans(bans, as_of), as_of, chunk)


def export_enforcement(bans: DataFrame, as_of: int, chunk: int = 1000) -> DataFrame:
    """(family, part, elements): set elements with a timeout where the ban ends, `chunk` a row."""
    left = F.col("expires_at") - as_of
    element = F.when(left.isNotNull(), F.concat("target", F.lit(" timeout "), left.cast("string"), F.lit("s"))).otherwise(F.col("target"))
    got = active_bans(bans, as_of).select(F.when(F.col("target").contains(":"), "v6").otherwise("v4").alias("family"), "target", element.alias("element"))
    # Parts by hash, as many as chunks are needed: no group grows with the table.
    n = got.groupBy("family").count().withColumn("parts", F.ceil(F.col("count") / chunk))
    got = got.join(n.select("family", "parts"), "family").withColumn("part", F.pmod(F.crc32(F.col("target").cast("binary")), F.col("parts")))
    return got.groupBy("family", "part").agg(F.array_join(F.sort_array(F.collect_list("element")), ", ").alias("elements"))


def threat_summary(verdicts: DataFrame) -> DataFrame:
    """Threats by reason family and action, with subtotals (null: all); by stream too, where
    verdicts tell it."""
    family = F.substring_index("reason", ":", 2)
    if "stream" in verdicts.columns:
        return verdicts.where("action <> 'allow'").select("stream", "action", family.alias("family")).rollup("stream", "action", "family").agg(F.count("*").alias("threats"))
    return verdicts.where("action <> 'allow'").select("action", family.alias("family")).rollup("action", "family").agg(F.count("*").alias("threats"))


def threat_report(verdicts: DataFrame) -> DataFrame:
    """One row per ban, as written by the report sink."""
    return verdicts.where("action = 'ban'").select("row_id", "client_ip", "permanent", "reason", "uri")


def write_threat_report(verdicts: DataFrame, path: str) -> int:
    rows = threat_report(verdicts)
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def ban_list(bans: DataFrame, as_of: int, filter_text: str | None = None, limit: int | None = 50) -> DataFrame:
    """Active bans in target order, the first 50 unless all are asked for."""
    got = active_bans(bans, as_of)
    if filter_text:
        low = filter_text.lower()
        got = got.where(F.lower("target").contains(low) | F.lower("reason").contains(low))
    left = F.when(F.col("expires_at").isNull(), "permanent").otherwise(duration_text(F.col("expires_at") - as_of))
    got = got.select("target", "reason", datetime_text(F.col("banned_at")).alias("banned"), left.alias("left")).orderBy("target")
    return got.limit(limit) if limit else got


def status_report(bans: DataFrame, policies: dict[str, DataFrame], as_of: int, first: int = 15) -> DataFrame:
    """(section, key, value): counts and first entries of bans and policies."""
    live = active_bans(bans, as_of)
    rows = live.agg(F.count("*").cast("string").alias("value")).select(F.lit("active_bans").alias("section"), F.lit("count").alias("key"), "value")
    rows = rows.unionByName(live.orderBy("target").limit(first).select(F.lit("ban").alias("section"), F.col("target").alias("key"), F.col("reason").alias("value")))
    for name, table in policies.items():
        key = table.columns[0]
        rows = rows.unionByName(table.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.lit("on").alias("value")))
    return rows


def check_report(targets: DataFrame, bans: DataFrame, whitelist: DataFrame, offenses: DataFrame, as_of: int) -> DataFrame:
    """Ban, whitelist state and offense history of many targets at once."""
    got = check_targets(targets, bans, as_of)
    listed = whitelist_match(got.select(F.col("target").alias("client_ip")).distinct(), whitelist)
    got = got.join(listed.withColumnRenamed("client_ip", "target"), "target", "left")
    state = F.when(is_private(F.col("target")), "private").when(F.col("listed"), "listed").otherwise("no")
    past = offenses.select(F.col("client_ip").alias("target"), F.col("count").alias("offenses"), "first_seen", "last_seen")
    return got.join(past, "target", "left").select("target", "kind", "match", "ban_target", "reason", "expired", state.alias("whitelist"), F.coalesce("offenses", F.lit(0)).alias("offenses"), "first_seen", "last_seen")
