"""The rule cascade: a verdict for every request and ssh event of a table.

A stateless stage settles every row, or makes it a strike of one pool; counters then run over
the strike rows alone and come back by row_id. Requests need row_id, ts_sec, client_ip, method,
uri, status, referer and user_agent, and may have asn and country."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logshield.functions import classify as C
from logshield.functions import signatures as S
from logshield.functions.ip import is_private
from logshield.operators.counters import strike_counts
from logshield.sources.shared import cut

TOOL_THRESHOLD, TOOL_WINDOW = 10, 10
AUTH_THRESHOLD, AUTH_WINDOW = 5, 300


@dataclass(frozen=True)
class Policies:
    """Allowed endpoints (regexes), blocked agent categories, and small tables: whitelist and
    banned (client_ip), blocked and restricted (asn), allowed (country). None: empty."""

    allowed_endpoints: tuple[str, ...] = ()
    blocked_categories: tuple[str, ...] = S.BLOCKED_BY_DEFAULT
    whitelist: DataFrame | None = None
    banned: DataFrame | None = None
    blocked_asns: DataFrame | None = None
    restricted_asns: DataFrame | None = None
    allowed_regions: DataFrame | None = field(default=None)


def _flag(rows: DataFrame, side: DataFrame | None, key: str, name: str) -> DataFrame:
    """A boolean column: is the key listed? Spark broadcasts the list if its size allows."""
    if side is None or key not in rows.columns:
        return rows.withColumn(name, F.lit(False))
    listed = side.select(F.col(key).alias(f"_{name}")).where(F.col(f"_{name}").isNotNull()).distinct()
    return rows.join(listed, F.col(key) == F.col(f"_{name}"), "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")


def flagged(rows: DataFrame, p: Policies) -> DataFrame:
    rows = _flag(rows, p.whitelist, "client_ip", "listed")
    rows = _flag(rows, p.banned, "client_ip", "banned")
    rows = _flag(rows, p.blocked_asns, "asn", "asn_blocked")
    rows = _flag(rows, p.restricted_asns, "asn", "asn_restricted")
    return _flag(rows, p.allowed_regions, "country", "region_allowed")


def candidates(requests: DataFrame, p: Policies) -> DataFrame:
    """requests with `act`, the settled action and reason (`allow`, `drop_banned`, `ban|reason`,
    `perm|reason`) or the strike that the row makes (`strike|pool|told|category|threshold|window`)."""
    rows = flagged(requests, p)
    for name, kind in (("asn", "long"), ("country", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    # Lower case once a row, not once a mark.
    rows = rows.withColumns({"path": C.normalized_path(F.col("uri")), "_agent": F.lower("user_agent"), "_referer": F.lower("referer")})
    rows = C.seam(rows.withColumns({"agent": C.agent_category(F.col("user_agent")), "private": is_private(F.col("client_ip"))}))
    rows = C.seam(rows.withColumns({
        "exploit": C.header_exploit(F.col("user_agent"), F.col("_agent")), "refx": C.referer_exploit(F.col("referer"), F.col("_referer")),
        "evil": C.malicious_uri(F.col("uri")), "endpoint": C.allowed_endpoint(F.col("uri"), p.allowed_endpoints),
    }))
    rows = C.with_probe_rule(rows.drop("rule"))
    rows = rows.withColumn("d", C.probe_decision(F.col("method"), F.col("status"), F.col("rule")))
    rows = C.seam(rows.withColumn("kind", C.decision_part(F.col("d"), "kind")).withColumn("category", C.decision_part(F.col("d"), "category")))
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    agent, kind, category, evil = F.col("agent"), F.col("kind"), F.col("category"), F.lit("ban|probe:common:immediate_malicious")
    blocked = agent.isin(*p.blocked_categories) if p.blocked_categories else F.lit(False)
    tool = blocked & agent.isin("generic_tools", "empty")
    act = (
        F.when(F.col("private") | F.col("listed"), "allow")
        .when(F.col("banned"), "drop_banned")
        .when(F.col("asn_blocked"), text("ban|blocked_asn:", F.col("asn").cast("string")))
        .when(F.col("asn_restricted") & ~F.col("region_allowed"), text("ban|restricted_asn_region:", F.col("asn").cast("string"), ":", F.coalesce("country", F.lit("??"))))
        .when(F.col("exploit").isNotNull(), text("perm|header_exploit:", F.col("exploit")))
        .when(tool & F.col("evil"), evil)
        .when(tool & ~F.col("endpoint") & (kind != "pass"), text("ban|probe:", agent, ":tool_probe"))
        .when(tool & F.col("status").between(400, 599), text("strike|tool|tool_error_burst:", agent, f"||{TOOL_THRESHOLD}|{TOOL_WINDOW}"))
        .when(tool, "allow")
        .when(blocked, text("ban|blocked_bot_category:", agent))
        .when(C.scanner_method(F.col("method")), text("ban|scanner_method:", F.upper("method")))
        .when(F.col("refx").isNotNull(), text("perm|harmful_referer:", F.col("refx")))
        .when(F.col("endpoint"), "allow")
        .when(F.col("evil"), evil)
        .when(kind == "pass", "allow")
        .when(kind == "instant", text("ban|probe:", category, ":instant"))
        .otherwise(text("strike|", kind, "|probe:", category, ":", kind, "_threshold|", F.substring_index("d", "|", -3)))
    )
    return rows.withColumn("act", C.held(act)).drop("_agent", "_referer")


def settled(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The narrow table of rows with `act`, cut: the cascade, a long expression, is planned and
    run once, whatever reads it."""
    return cut(rows.select(*keep, "row_id", "ts_sec", "client_ip", "act"))


def strike_rows(flat: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The strikes of a settled table: pool, told, category, threshold and window_s."""
    part = F.split("act", "\\|")
    return flat.where(F.col("act").startswith("strike|")).select(
        *keep, "row_id", "ts_sec", "client_ip", part[1].alias("pool"), part[2].alias("told"), F.nullif(part[3], F.lit("")).alias("category"), part[4].cast("int").alias("threshold"), part[5].cast("int").alias("window_s"),
    )


def done_rows(flat: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Verdicts of the rows that are settled without counting."""
    head = F.substring_index("act", "|", 1)
    return flat.where(~F.col("act").startswith("strike|")).select(
        *keep, "row_id", "ts_sec", "client_ip", F.when(head == "perm", "ban").otherwise(head).alias("action"),
        F.when(F.col("act").contains("|"), F.substring(F.col("act"), F.length(head) + 2, F.length("act"))).alias("reason"),
        F.when(head.isin("ban", "perm"), head == "perm").alias("permanent"), F.lit(None).cast("int").alias("strikes"),
    )


def judged_strikes(hits: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Verdicts of counted strikes. Only tool bursts do not tell the count."""
    over = F.col("strikes") >= F.col("threshold")
    told = F.when(F.col("pool") == "tool", F.col("told")).otherwise(F.concat_ws(":", "told", F.col("strikes").cast("string")))
    return hits.select(*keep, "row_id", "ts_sec", "client_ip", F.when(over, "ban").otherwise("allow").alias("action"), F.when(over, told).alias("reason"), F.when(over, False).alias("permanent"), "strikes")


def counted(rows: DataFrame, keep: tuple[str, ...], clock: str) -> DataFrame:
    """Verdicts of rows with `act`; strike rows pass their counters, the others go straight
    through, so that only strikes are shuffled."""
    flat = settled(rows, keep)
    return done_rows(flat, keep).unionByName(judged_strikes(strike_counts(strike_rows(flat, keep), clock), keep))


def evaluate_requests(requests: DataFrame, p: Policies = Policies(), clock: str = "event") -> DataFrame:  # noqa: B008
    """(row_id, ts_sec, client_ip, uri, action, reason, permanent, strikes) of every request."""
    return counted(candidates(requests, p), ("uri",), clock)


def evaluate_minimal(requests: DataFrame, p: Policies = Policies()) -> DataFrame:  # noqa: B008
    """The cascade for requests without status and referer: 200 and none."""
    return evaluate_requests(requests.withColumn("status", F.lit(200)).withColumn("referer", F.lit("")), p)


def ssh_candidates(events: DataFrame, p: Policies) -> DataFrame:
    """events(row_id, ts_sec, client_ip, kind, reason) with `act`."""
    rows = _flag(_flag(events, p.whitelist, "client_ip", "listed"), p.banned, "client_ip", "banned")
    act = (
        F.when((F.col("kind") == "ignore") | F.col("client_ip").isNull(), "allow")
        .when(is_private(F.col("client_ip")) | F.col("listed"), "allow")
        .when(F.col("banned"), "drop_banned")
        .when(F.col("kind") == "scanner_probe", F.concat(F.lit("ban|probe:ssh:"), F.col("reason")))
        .otherwise(f"strike|isolated|probe:ssh:auth_failures|common|{AUTH_THRESHOLD}|{AUTH_WINDOW}")
    )
    return rows.withColumn("act", C.held(act))


def evaluate_ssh(events: DataFrame, p: Policies = Policies(), clock: str = "event") -> DataFrame:  # noqa: B008
    return counted(ssh_candidates(events, p), (), clock)


def evaluate_all(requests: DataFrame, events: DataFrame, p: Policies = Policies(), clock: str = "event") -> DataFrame:  # noqa: B008
    """Web and ssh rows together: they share each address's isolated counter."""
    web = candidates(requests, p).select(F.lit("web").alias("stream"), "row_id", "ts_sec", "client_ip", "uri", "act")
    ssh = ssh_candidates(events, p).select(F.lit("ssh").alias("stream"), "row_id", "ts_sec", "client_ip", F.lit(None).cast("string").alias("uri"), "act")
    return counted(web.unionByName(ssh), ("stream", "uri"), clock)
