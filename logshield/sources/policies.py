"""Policy tables: small DataFrames, seeded from configuration and edited as ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("whitelist", "categories", "blocked_asns", "restricted_asns", "allowed_regions", "waf_state")


def load_policies(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}


def merge_absent(stored: DataFrame, config: DataFrame, key: str) -> DataFrame:
    """Configured rows enter only where the key is not stored: a stored false survives."""
    return stored.unionByName(config.join(stored.select(key), key, "left_anti").select(stored.columns))


def merge_union(stored: DataFrame, config: DataFrame) -> DataFrame:
    return stored.unionByName(config).distinct()


def latest(ledger: DataFrame, key: str, order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """The last row of each key of an append-only ledger."""
    rest = [c for c in ledger.columns if c != key]
    return ledger.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def upsert_policy(ledger: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Keys that are on after the changes(key, on, at, seq)."""
    return latest(ledger.unionByName(changes), key).where("on").select(key)
