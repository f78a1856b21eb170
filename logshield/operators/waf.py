"""A firewall expression under a size limit, packed from policies and active bans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logshield.functions.ip import ip_v4

MAX_CHARS = 3950


def _packed(items: DataFrame, column: str, order, budget: int) -> DataFrame:
    """The longest prefix, in order, whose items with a space each fit the budget. No more than
    budget / 2 items can fit, so the sort is a top-k and the window runs over few rows."""
    top = items.orderBy(*order).limit(max(budget // 2, 1))
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("used", F.sum(F.length(column) + 1).over(w)).where(F.col("used") <= budget)


def waf_expression(bans: DataFrame, blocked_asns: DataFrame, restricted_asns: DataFrame, regions: DataFrame, as_of: int, max_chars: int = MAX_CHARS, recent_first: bool = False) -> DataFrame:
    """(expression, n_asns, n_addresses, chars): up to three clauses joined by ` or `: restricted
    networks outside the allowed regions, if it fits as a whole; blocked networks, the last ones
    that fit in their order; banned IPv4 addresses, the first ones that fit, by descending target
    or by recency."""
    def joined(rows: DataFrame, c: str, quoted: bool) -> str:
        # What is longer than the limit cannot fit, so no more than that is read.
        got = [r[c] for r in rows.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(max_chars + 1).collect()]
        return " ".join(f'"{x}"' if quoted else str(x) for x in got)

    r, c = joined(restricted_asns, "asn", False), joined(regions, "country", True)
    clauses, left = [], max_chars
    if r and c:
        clause = f"(ip.src.asnum in {{{r}}} and not ip.src.country in {{{c}}})"
        if len(clause) + 4 <= left:
            clauses, left = [clause], left - len(clause) - 4
    frame = len("(ip.src.asnum in {})") + 4
    asns = blocked_asns.select(F.col("asn").cast("string").alias("asn"), F.col("asn").alias("n")).distinct()
    kept = sorted((x["n"] for x in _packed(asns, "asn", [F.desc("n")], left - frame).collect()))
    if kept:
        clause = f"(ip.src.asnum in {{{' '.join(map(str, kept))}}})"
        clauses, left = [*clauses, clause], left - len(clause) - 4
    frame = len("(ip.src in {})")
    live = bans.where((F.col("expires_at").isNull() | (F.col("expires_at") > as_of)) & ip_v4(F.col("target")).isNotNull())
    order = [F.desc("banned_at"), F.desc("target")] if recent_first else [F.desc("target")]
    fit = [x["target"] for x in _packed(live.select("target", "banned_at"), "target", order, left - frame).orderBy("used").collect()] if left > frame else []
    if fit:
        clauses.append(f"(ip.src in {{{' '.join(fit)}}})")
    text = " or ".join(clauses)
    return bans.sparkSession.createDataFrame([(text, len(kept), len(fit), len(text))], "expression string, n_asns int, n_addresses int, chars int")


def waf_budget(expression: DataFrame, bans: DataFrame, as_of: int, max_chars: int = MAX_CHARS) -> DataFrame:
    live = bans.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of)).agg(F.count("*").alias("active_bans"))
    used = F.round(F.col("chars") * 100.0 / max_chars, 1)
    return expression.join(live, F.lit(True)).select("chars", F.lit(max_chars).alias("max_chars"), used.alias("percent"), F.substring("expression", 1, 120).alias("preview"), "active_bans")
