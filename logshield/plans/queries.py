"""Queries over the views: a table-level result for every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logshield.functions import classify as C
from logshield.functions import ip as IP
from logshield.operators import bans as B
from logshield.operators import counters as K
from logshield.operators import joins as J
from logshield.operators import verdicts as VD
from logshield.operators import waf as W
from logshield.plans import oracles as O
from logshield.plans import views as V
from logshield.plans.registry import DEFAULT, ORACLES, query  # noqa: F401
from logshield.sources import logs as L
from logshield.sources import policies as P

_COLS = "row_id, client_ip, method, uri, status, referer, user_agent"
_LOG = ("row_id", "client_ip", "method", "uri", "status", "referer", "user_agent")


@query(O.over(O.judged() + "," + O.verdicts(), "SELECT * FROM verdict"))
def f1_evaluate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VD.evaluate_requests(V.access_log(spark, sf_dir), DEFAULT)


@query(O.over("", f"SELECT {_COLS}, true AS parse_ok FROM access_log"))
def a2_parse_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_combined(V.access_lines(spark, sf_dir)).select(*_LOG, "parse_ok")


@query(O.over("", f"SELECT {_COLS} FROM access_log"))
def a3_parse_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_format(V.access_lines(spark, sf_dir), L.COMBINED).select(*_LOG)


_JSON_SQL = """SELECT row_id, client_ip, method, {uri} AS uri, CASE WHEN row_id % 3 = 2 THEN 200 ELSE status END AS status,
  CASE WHEN row_id % 3 = 0 THEN referer ELSE '' END AS referer, user_agent FROM access_log"""


@query(O.over("", _JSON_SQL.format(uri="uri")))
def a4_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_json(V.json_lines(spark, sf_dir)).select(*_LOG)


@query(O.over("", _JSON_SQL.format(uri="CASE WHEN row_id % 3 = 1 THEN method || ' ' || uri || ' HTTP/1.1' ELSE uri END").replace("client_ip, method,", "client_ip, CASE WHEN row_id % 3 = 1 THEN 'GET' ELSE method END AS method,")))
def a5_parse_json_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_json(V.json_lines(spark, sf_dir), replay=True).select(*_LOG)


@query(O.over("", "SELECT row_id, client_ip, 'open() \"' || uri || '\" failed (2: No such file or directory)' AS reason FROM access_log WHERE status >= 400"))
def a6_parse_error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_error_log(V.error_lines(spark, sf_dir)).select("row_id", "client_ip", "reason")


_STEP = "CAST(floor(row_id / 3) AS BIGINT) % 5"


@query(O.over("", f"""SELECT row_id, CASE WHEN {_STEP} IN (0, 1) THEN 'auth_failure' WHEN {_STEP} = 2 AND NOT contains(client_ip, ':') THEN 'scanner_probe' ELSE 'ignore' END AS kind,
  CASE WHEN {_STEP} IN (0, 1) OR ({_STEP} = 2 AND NOT contains(client_ip, ':')) THEN client_ip END AS client_ip,
  CASE {_STEP} WHEN 0 THEN 'root' WHEN 1 THEN 'bob' END AS "user", CASE WHEN {_STEP} = 2 AND NOT contains(client_ip, ':') THEN 'no_identification_string' END AS reason FROM access_log"""))
def a7_parse_auth_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_auth_log(V.auth_lines(spark, sf_dir)).select("row_id", "kind", "client_ip", "user", "reason")


_AUTH8 = f"""
au AS MATERIALIZED (SELECT row_id, ts_sec, user_id AS pid, client_ip, {_STEP} AS s, contains(client_ip, ':') AS v6 FROM access_log),
st AS MATERIALIZED (SELECT *, CASE WHEN s = 3 THEN 1 WHEN NOT v6 AND s <> 3 THEN 0 END AS mark FROM au),
pe AS MATERIALIZED (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY pid ORDER BY ts_sec, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pending FROM st),
au8 AS MATERIALIZED (SELECT row_id, ts_sec, client_ip AS ip, CASE WHEN s = 3 THEN 'ignore' WHEN pending = 1 AND NOT v6 THEN 'scanner_probe' WHEN s IN (0, 1) THEN 'auth_failure' WHEN s = 2 AND NOT v6 THEN 'scanner_probe' ELSE 'ignore' END AS kind,
  CASE WHEN s = 3 THEN NULL WHEN pending = 1 AND NOT v6 THEN 'invalid_protocol_identifier' WHEN s = 2 AND NOT v6 THEN 'no_identification_string' END AS reason FROM pe)"""


@query(O.over(_AUTH8, "SELECT row_id, kind, reason, CASE WHEN kind <> 'ignore' THEN ip END AS client_ip FROM au8"))
def a8_parse_auth_log_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_auth_log_stateful(V.auth_lines(spark, sf_dir)).select("row_id", "kind", "reason", "client_ip")


@query(O.over(_AUTH8, """SELECT 'combined' AS format, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS reason, count(*) AS n, count(DISTINCT client_ip) AS addresses FROM access_log UNION ALL
SELECT 'json', NULL, NULL, count(*), count(DISTINCT client_ip) FROM access_log UNION ALL
SELECT 'ssh', kind, reason, count(*), count(DISTINCT ip) FROM au8 WHERE kind <> 'ignore' GROUP BY kind, reason"""))
def a9_scan_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("row_id", "ts_sec", "line")
    lines = V.access_lines(spark, sf_dir).select(*cols).unionByName(V.json_lines(spark, sf_dir).select(*cols)).unionByName(V.auth_lines(spark, sf_dir).select(*cols))
    return L.scan_mixed(lines).where("format IS NOT NULL").groupBy("format", "kind", "reason").agg(F.count("*").alias("n"), F.countDistinct("client_ip").alias("addresses"))


_CLASS = "CASE WHEN contains(client_ip, ':') THEN 'v6' WHEN starts_with(client_ip, '10.') THEN 'private' ELSE 'public' END"


@query(O.over("", f"SELECT {_CLASS} AS class, method, count(*) AS requests, count(DISTINCT client_ip) AS addresses FROM access_log GROUP BY ALL"))
def c1_address_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.access_log(spark, sf_dir)
    ip = C.resolved_ip(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("client_ip"))
    kind = F.when(F.col("ip").isNull(), "unresolved").when(F.col("ip").contains(":"), "v6").when(IP.is_private(F.col("ip")), "private").otherwise("public")
    return log.withColumn("ip", ip).groupBy(kind.alias("class"), "method").agg(F.count("*").alias("requests"), F.countDistinct("ip").alias("addresses"))


@query(O.over(O.judged(), "SELECT path, count(*) AS hits, count(DISTINCT uri) AS spellings, count(*) FILTER (WHERE evil) AS malicious FROM facts GROUP BY path"))
def c4_uri_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.access_log(spark, sf_dir).select("uri", C.normalized_path(F.col("uri")).alias("path"), C.malicious_uri(F.col("uri")).alias("evil"))
    return log.groupBy("path").agg(F.count("*").alias("hits"), F.countDistinct("uri").alias("spellings"), F.count(F.when(F.col("evil"), 1)).alias("malicious"))


@query(O.over(O.judged(), "SELECT agent, count(*) AS requests, count(DISTINCT client_ip) AS addresses, count(*) FILTER (WHERE status >= 400) * 1.0 / count(*) AS error_share FROM facts GROUP BY agent"))
def c5_agent_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.access_log(spark, sf_dir).select("client_ip", "status", C.agent_category(F.col("user_agent")).alias("agent"))
    return log.groupBy("agent").agg(F.count("*").alias("requests"), F.countDistinct("client_ip").alias("addresses"), (F.count(F.when(F.col("status") >= 400, 1)) / F.count("*")).alias("error_share"))


@query(O.over(O.judged(), """SELECT 'user_agent' AS header, exploit AS kind, count(*) AS hits, count(DISTINCT client_ip) AS addresses FROM facts WHERE exploit IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'referer', refx, count(*), count(DISTINCT client_ip) FROM facts WHERE refx IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'method', upper(method), count(*), count(DISTINCT client_ip) FROM facts WHERE upper(method) IN ('PROPFIND', 'DEBUG', 'SEARCH', 'TRACK', 'TRACE') GROUP BY ALL"""))
def c7_exploit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.access_log(spark, sf_dir)
    found = F.array(
        F.struct(F.lit("user_agent").alias("header"), C.header_exploit(F.col("user_agent")).alias("kind")),
        F.struct(F.lit("referer").alias("header"), C.referer_exploit(F.col("referer")).alias("kind")),
        F.struct(F.lit("method").alias("header"), F.when(C.scanner_method(F.col("method")), F.upper("method")).alias("kind")),
    )
    return log.select("client_ip", F.inline(found)).where("kind IS NOT NULL").groupBy("header", "kind").agg(F.count("*").alias("hits"), F.countDistinct("client_ip").alias("addresses"))


@query(O.over(O.judged(), "SELECT rule, kind, category, count(*) AS hits, count(DISTINCT client_ip) AS addresses FROM facts GROUP BY ALL"))
def c11_probe_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = C.with_probe_rule(V.access_log(spark, sf_dir).withColumn("path", C.normalized_path(F.col("uri"))))
    log = log.withColumn("d", C.probe_decision(F.col("method"), F.col("status"), F.col("rule")))
    return log.groupBy("rule", C.decision_part(F.col("d"), "kind").alias("kind"), C.decision_part(F.col("d"), "category").alias("category")).agg(F.count("*").alias("hits"), F.countDistinct("client_ip").alias("addresses"))


_GEO = f"r AS ({V.IP2ASN}), geo AS MATERIALIZED (SELECT l.*, asn, country, as_org FROM (SELECT *, {O.IP_V4.format('client_ip')} AS v4 FROM access_log) l LEFT JOIN r ON l.v4 BETWEEN r.start_ip AND r.end_ip)"


@query(O.over(_GEO, "SELECT row_id, client_ip, asn, country, as_org FROM geo"))
def d1_enrich_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.enrich_geo(V.access_log(spark, sf_dir).select("row_id", "client_ip"), V.ip2asn(spark, sf_dir))


_PRE = "CASE WHEN asn % 7 = 0 THEN 'blocked_asn:' || asn WHEN asn % 7 = 1 AND country NOT IN ('AA', 'BH', 'CO') THEN 'restricted_asn_region:' || asn || ':' || country END"


def _asn_policies(spark: SparkSession, sf_dir: str) -> VD.Policies:
    ranges = V.ip2asn(spark, sf_dir)
    return VD.Policies(
        allowed_endpoints=("^/api/.*",), blocked_asns=ranges.where("asn % 7 = 0").select("asn"), restricted_asns=ranges.where("asn % 7 = 1").select("asn"),
        allowed_regions=ranges.where("country IN ('AA', 'BH', 'CO')").select("country"),
    )


@query(O.over(_GEO + "," + O.judged(source="geo", extra=_PRE) + "," + O.verdicts(), """SELECT asn, country, count(*) AS requests, count(*) FILTER (WHERE action = 'ban') AS bans, count(*) FILTER (WHERE reason LIKE '%asn%') AS asn_bans
FROM verdict JOIN geo USING (row_id) GROUP BY asn, country"""))
def c13_asn_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = J.enrich_geo(V.access_log(spark, sf_dir), V.ip2asn(spark, sf_dir))
    # Network and country go along with the verdicts, so that rows are not joined to themselves.
    got = VD.counted(VD.candidates(log, _asn_policies(spark, sf_dir)), ("asn", "country"), "event")
    ban = F.col("action") == "ban"
    return got.groupBy("asn", "country").agg(F.count("*").alias("requests"), F.count(F.when(ban, 1)).alias("bans"), F.count(F.when(F.col("reason").contains("asn"), 1)).alias("asn_bans"))


@query("SELECT CAST(64500 + n_nationkey AS BIGINT) AS asn, CAST(1 AS BIGINT) AS cidrs, CAST(8388608 AS BIGINT) AS addresses FROM nation WHERE n_nationkey % 2 = 0")
def d2_range_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = V.ip2asn(spark, sf_dir)
    got = J.cidrs_for_asns(ranges, ranges.where("asn % 2 = 0").select("asn"))
    return got.groupBy("asn").agg(F.count("*").alias("cidrs"), F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), 32 - F.col("prefix"))).alias("addresses"))


_BANS = f"b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY target ORDER BY banned_at DESC) AS k FROM ({V.BANS})), bans AS MATERIALIZED (SELECT target, tier_level, banned_at, expires_at, reason FROM b WHERE k = 1)"
_LIVE = f"(expires_at IS NULL OR expires_at > {V.AS_OF})"


def _bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ban table after an upsert: bans of even seconds are stored first, then all of them
    come, of each target the last."""
    rows = V.bans(spark, sf_dir)
    stored = B.upsert_bans(rows.where("false"), rows.where("banned_at % 2 = 0"))
    return B.upsert_bans(stored, rows)


@query(O.over(_BANS, "SELECT * FROM bans"))
def b1_upsert_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bans(spark, sf_dir)


@query(O.over(_BANS, "SELECT * FROM bans WHERE NOT starts_with(target, '30.')"))
def b2_remove_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _bans(spark, sf_dir)
    return B.remove_bans(got, got.where(F.col("target").startswith("30.")))


@query(O.over(_BANS, f"SELECT * FROM bans WHERE {_LIVE}"))
def e11_active_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.active_bans(_bans(spark, sf_dir), V.AS_OF)


_LEFT = "target, reason, CASE WHEN expires_at IS NULL THEN 'permanent' ELSE '1m 40s' END AS \"left\""


@query(O.over(_BANS, f"SELECT {_LEFT} FROM bans WHERE {_LIVE} ORDER BY target LIMIT 50"))
def g1_ban_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ban_list(_bans(spark, sf_dir), V.AS_OF).select("target", "reason", "left")


_TWO = "lpad(CAST({} AS VARCHAR), 2, '0')"
_BANNED = "CASE WHEN banned_at < 1704067200 THEN '31 Dec 2023 ' ELSE '1 Jan 2024 ' END || " + " || ':' || ".join(_TWO.format(x) for x in ("banned_at % 86400 // 3600", "banned_at % 3600 // 60", "banned_at % 60")) + " || ' UTC'"


@query(O.over(_BANS, f"SELECT {_LEFT}, {_BANNED} AS banned FROM bans WHERE {_LIVE} AND (contains(lower(target), 'building') OR contains(lower(reason), 'building'))"))
def g1_ban_list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ban_list(_bans(spark, sf_dir), V.AS_OF, "BUILDing", limit=None)


@query(O.over(_BANS, f"SELECT 'v4' AS family, target || CASE WHEN expires_at IS NULL THEN '' ELSE ' timeout 100s' END AS element FROM bans WHERE {_LIVE}"))
def b4_export_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.export_enforcement(_bans(spark, sf_dir), V.AS_OF).select("family", F.explode(F.split("elements", ", ")).alias("element"))


_CHECK = _BANS + f""",
asked AS MATERIALIZED (SELECT DISTINCT client_ip AS target FROM access_log UNION SELECT target FROM bans),
di AS MATERIALIZED (SELECT a.target, 'Direct' AS match, b.target AS ban_target, b.reason, NOT {_LIVE.replace("expires_at", "b.expires_at")} AS expired FROM asked a JOIN bans b ON a.target = b.target),
nets AS (SELECT target, reason, split_part(target, '/', 1) AS base FROM bans WHERE contains(target, '/') AND {_LIVE}),
sub AS (SELECT a.target, min(n.target) AS ban_target FROM asked a JOIN nets n ON NOT contains(a.target, ':') AND NOT contains(a.target, '/') AND regexp_extract(a.target, '^(.*)\\.[0-9]+$', 1) = regexp_extract(n.base, '^(.*)\\.[0-9]+$', 1) GROUP BY a.target)"""


@query(O.over(_CHECK, """SELECT a.target, CASE WHEN contains(a.target, '/') THEN 'CIDR' ELSE 'IP' END AS kind, coalesce(di.match, CASE WHEN sub.ban_target IS NOT NULL THEN 'Subnet' END) AS match,
  coalesce(di.ban_target, sub.ban_target) AS ban_target, coalesce(di.reason, nets.reason) AS reason, CASE WHEN di.match IS NOT NULL THEN di.expired WHEN sub.ban_target IS NOT NULL THEN false END AS expired
FROM asked a LEFT JOIN di ON a.target = di.target LEFT JOIN sub ON a.target = sub.target LEFT JOIN nets ON nets.target = sub.ban_target"""))
def d5_check_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bans = _bans(spark, sf_dir)
    asked = V.access_log(spark, sf_dir).select(F.col("client_ip").alias("target")).unionByName(bans.select("target"))
    return J.check_targets(asked, bans, V.AS_OF)


_HITS = O.over(O.judged() + "," + O.verdicts(), "SELECT row_id, client_ip, CAST(strikes AS INT) AS strikes FROM hits WHERE pool = '@POOL'")


def _strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.strike_counts(VD.strike_rows(VD.settled(VD.candidates(V.access_log(spark, sf_dir), DEFAULT))))


@query(_HITS.replace("@POOL", "shared"))
def e1_shared_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strikes(spark, sf_dir).where("pool = 'shared'").select("row_id", "client_ip", "strikes")


@query(_HITS.replace("@POOL", "isolated"))
def e2_isolated_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strikes(spark, sf_dir).where("pool = 'isolated'").select("row_id", "client_ip", "strikes")


@query(_HITS.replace("@POOL", "tool"))
def e3_tool_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strikes(spark, sf_dir).where("pool = 'tool'").select("row_id", "client_ip", "strikes")


_MID = V.AS_OF + 60


@query(O.over(O.judged() + "," + O.verdicts(), f"SELECT client_ip, pool, CAST(arg_max(strikes, (ts_sec, row_id)) AS INT) AS strikes, max(ts_sec) AS last_seen FROM hits WHERE ts_sec <= {_MID} GROUP BY client_ip, pool"))
def e5_strike_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.strike_snapshot(_strikes(spark, sf_dir), _MID).drop("category")


@query(O.over(O.judged() + "," + O.verdicts() + f", snap AS (SELECT client_ip, pool, max(ts_sec) AS last_seen FROM hits WHERE ts_sec <= {_MID} GROUP BY client_ip, pool)", f"SELECT * FROM snap WHERE client_ip IN (SELECT client_ip FROM snap WHERE {_MID} - last_seen <= 10)"))
def e6_evict_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.evict_strikes(K.strike_snapshot(_strikes(spark, sf_dir), _MID), _MID, 10).select("client_ip", "pool", "last_seen")


_OFF = """of0 AS (SELECT client_ip, ts_sec, row_id, CASE WHEN ts_sec - lag(ts_sec) OVER (PARTITION BY client_ip ORDER BY ts_sec, row_id) > 5 THEN 1 ELSE 0 END AS c FROM access_log WHERE status >= 400),
of1 AS (SELECT *, sum(c) OVER (PARTITION BY client_ip ORDER BY ts_sec, row_id) AS run FROM of0),
of2 AS (SELECT client_ip, run, count(*) AS "count", min(ts_sec) AS first_seen, max(ts_sec) AS last_seen FROM of1 GROUP BY client_ip, run),
offenses AS (SELECT client_ip, "count", first_seen, last_seen FROM of2 QUALIFY row_number() OVER (PARTITION BY client_ip ORDER BY run DESC) = 1)"""


@query(O.over(_OFF, "SELECT * FROM offenses"))
def e8_offense_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.offense_counter(V.access_log(spark, sf_dir).where("status >= 400").select("client_ip", "ts_sec"), 5)


@query(O.over(_OFF, f"SELECT * FROM offenses WHERE {V.AS_OF + 130} - last_seen <= 20"))
def e9_prune_offenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.prune_offenses(e8_offense_counter(spark, sf_dir), V.AS_OF + 130, 20)


_ESC = """
ev2 AS MATERIALIZED (SELECT client_ip, ts_sec, row_id, row_id % 29 = 0 AS perm, row_number() OVER (PARTITION BY client_ip ORDER BY ts_sec, row_id) AS k FROM access_log WHERE status >= 400),
fold AS (
  SELECT client_ip, 0 AS k, 0 AS n, CAST(NULL AS BIGINT) AS anchor, 0 AS nxt, CAST(NULL AS INT) AS tier, false AS perm, CAST(NULL AS BIGINT) AS ts_sec, CAST(NULL AS BIGINT) AS row_id FROM ev2 WHERE k = 1
  UNION ALL
  SELECT e.client_ip, CAST(e.k AS INT), CASE WHEN e.perm OR m >= 3 THEN 0 ELSE m END, CASE WHEN e.perm OR m >= 3 THEN NULL WHEN fresh THEN e.ts_sec ELSE anchor END,
    CASE WHEN NOT e.perm AND m >= 3 THEN least(nxt + 1, 2) ELSE nxt END, CASE WHEN e.perm THEN 2 WHEN m >= 3 THEN nxt END, e.perm, e.ts_sec, e.row_id
  FROM (SELECT f.nxt, f.anchor, f.n, e.*, (f.anchor IS NULL OR e.ts_sec - f.anchor > 10) AS fresh, CASE WHEN f.anchor IS NULL OR e.ts_sec - f.anchor > 10 THEN 1 ELSE f.n + 1 END AS m
        FROM fold f JOIN ev2 e ON e.client_ip = f.client_ip AND e.k = f.k + 1) e)"""


@query(O.over(_ESC, "SELECT client_ip, ts_sec, row_id, tier, CASE WHEN perm THEN NULL WHEN tier = 0 THEN CAST(3600 AS BIGINT) WHEN tier = 1 THEN CAST(86400 AS BIGINT) END AS duration_s, perm OR tier = 2 AS permanent FROM fold WHERE tier IS NOT NULL").replace("WITH ev AS", "WITH RECURSIVE ev AS", 1))
def e10_escalate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.access_log(spark, sf_dir).where("status >= 400").select("client_ip", "ts_sec", "row_id", (F.col("row_id") % 29 == 0).alias("instant_permanent"))
    return K.escalate(rows, find_time=10, max_retry=3, tiers=(3600, 86400, None))


@query(O.over(O.judged() + "," + O.verdicts(), "SELECT client_ip AS target, CAST(0 AS INT) AS tier_level, max(ts_sec) AS banned_at, arg_max(reason, (ts_sec, row_id)) AS reason, arg_max(permanent, (ts_sec, row_id)) AS permanent FROM verdict WHERE action = 'ban' GROUP BY client_ip"))
def e12_build_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = B.build_bans(VD.evaluate_requests(V.access_log(spark, sf_dir), DEFAULT))
    return got.select("target", "tier_level", "banned_at", "reason", F.col("expires_at").isNull().alias("permanent"))


@query(O.over(O.judged() + "," + O.verdicts() + ", t AS (SELECT action, array_to_string(string_split(reason, ':')[1:2], ':') AS family FROM verdict WHERE action <> 'allow')", "SELECT action, family, count(*) AS threats FROM t GROUP BY ROLLUP (action, family)"))
def e13_threat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.threat_summary(VD.evaluate_requests(V.access_log(spark, sf_dir), DEFAULT))


@query(O.over(O.judged() + "," + O.verdicts(), "SELECT row_id, client_ip, permanent, reason, uri FROM verdict WHERE action = 'ban'"))
def b3_threat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.threat_report(VD.evaluate_requests(V.access_log(spark, sf_dir), DEFAULT))


@query(O.over(O.judged(source="(SELECT * REPLACE (200 AS status, '' AS referer) FROM access_log)") + "," + O.verdicts(), "SELECT row_id, action, reason FROM verdict"))
def f1b_evaluate_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VD.evaluate_minimal(V.access_log(spark, sf_dir), DEFAULT).select("row_id", "action", "reason")


def _ssh_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_auth_log_stateful(V.auth_lines(spark, sf_dir)).select("row_id", "ts_sec", "client_ip", "kind", "reason")


_SSH = _AUTH8 + """,
sh0 AS MATERIALIZED (SELECT *, CASE WHEN kind = 'ignore' OR starts_with(ip, '10.') THEN 'allow' WHEN kind = 'scanner_probe' THEN 'probe' ELSE 'strike' END AS act FROM au8),
sh1 AS MATERIALIZED (SELECT *, CASE WHEN ts_sec - lag(ts_sec) OVER (PARTITION BY ip ORDER BY ts_sec, row_id) > 300 THEN 1 ELSE 0 END AS c FROM sh0 WHERE act = 'strike'),
sh2 AS MATERIALIZED (SELECT *, sum(c) OVER (PARTITION BY ip ORDER BY ts_sec, row_id) AS run FROM sh1),
sh3 AS MATERIALIZED (SELECT *, least(row_number() OVER (PARTITION BY ip, run ORDER BY ts_sec, row_id), 255) AS n FROM sh2)"""


@query(O.over(_SSH, """SELECT row_id, CASE act WHEN 'probe' THEN 'ban' ELSE 'allow' END AS action, CASE act WHEN 'probe' THEN 'probe:ssh:' || reason END AS reason FROM sh0 WHERE act <> 'strike'
UNION ALL SELECT row_id, CASE WHEN n >= 5 THEN 'ban' ELSE 'allow' END, CASE WHEN n >= 5 THEN 'probe:ssh:auth_failures:' || n END FROM sh3"""))
def f5_evaluate_ssh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VD.evaluate_ssh(_ssh_events(spark, sf_dir)).select("row_id", "action", "reason")


_REPLAY = VD.Policies(blocked_categories=("security_testing", "ai_crawler", "bad_scraper", "generic_tools", "empty"))


@query(O.over(O.judged(_REPLAY.blocked_categories, None) + "," + O.verdicts("none"), "SELECT row_id, action, reason FROM verdict"))
def f6_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.scan_mixed(V.access_lines(spark, sf_dir)).where("format <> 'ssh'")
    return VD.evaluate_requests(rows, _REPLAY, clock="none").select("row_id", "action", "reason")


@query(O.over(_GEO + "," + _BANS + f""",
asn_text AS (SELECT '(ip.src.asnum in {{' || string_agg(CAST(asn AS VARCHAR), ' ' ORDER BY asn) || '}})' AS a, count(*) AS n_asns FROM r WHERE asn % 2 = 0),
v4 AS (SELECT target, sum(length(target) + 1) OVER (ORDER BY target DESC) AS used FROM bans WHERE {_LIVE} AND NOT contains(target, '/')),
fit AS (SELECT target FROM v4, asn_text WHERE used <= 3950 - length(a) - 4 - 14)""", "SELECT a || ' or (ip.src in {' || string_agg(target, ' ' ORDER BY target DESC) || '})' AS expression, CAST(any_value(n_asns) AS INT) AS n_asns, CAST(count(*) AS INT) AS n_addresses FROM fit, asn_text GROUP BY a"))
def f4_waf_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = V.ip2asn(spark, sf_dir)
    return W.waf_expression(_bans(spark, sf_dir), ranges.where("asn % 2 = 0"), ranges.limit(0), ranges.limit(0), V.AS_OF).drop("chars")


@query(O.over(_BANS + "," + _OFF + ", asked AS (SELECT DISTINCT client_ip AS target FROM access_log)", """SELECT a.target, coalesce(o."count", 0) AS offenses, CASE WHEN starts_with(a.target, '10.') THEN 'private' WHEN starts_with(a.target, '21.') OR a.target = '22.26.14.3' THEN 'listed' ELSE 'no' END AS whitelist FROM asked a LEFT JOIN offenses o ON o.client_ip = a.target"""))
def g3_check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = V.access_log(spark, sf_dir).select(F.col("client_ip").alias("target"))
    listed = spark.createDataFrame([("21.0.0.0/8",), ("22.26.14.3",), ("nonsense",), ("1.2.3/4",)], "entry string")
    return B.check_report(asked, _bans(spark, sf_dir), listed, e8_offense_counter(spark, sf_dir), V.AS_OF).select("target", "offenses", "whitelist")


@query(O.over("", "SELECT client_ip, starts_with(client_ip, '21.') OR starts_with(client_ip, '2001:db8:') AS listed, count(*) AS n FROM access_log GROUP BY ALL"))
def d3_whitelist_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([("21.0.0.0/8",), ("2001:db8::/32",), ("bad",)], "entry string")
    got = J.whitelist_match(V.access_log(spark, sf_dir).select("client_ip"), listed)
    return got.groupBy("client_ip", "listed").agg(F.count("*").alias("n"))


@query(O.over("", "SELECT token, count(*) AS n FROM (SELECT CASE WHEN contains(lower(user_agent), 'curl') THEN 'curl' WHEN contains(lower(user_agent), 'gptbot') THEN 'gptbot' END AS token FROM access_log) GROUP BY token"))
def d7_blocklist_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = spark.createDataFrame([("GPTBot",), ("curl",)], "token string")
    return J.blocklist_match(V.access_log(spark, sf_dir).select("user_agent"), tokens).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT CAST(64500 + n_nationkey AS BIGINT) AS asn FROM nation")
def a16_merge_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    asns = V.ip2asn(spark, sf_dir).select("asn")
    return P.merge_union(asns.where("asn % 2 = 0"), asns)


@query("SELECT c_custkey AS key FROM customer WHERE CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 ELSE c_custkey % 5 > 1 END")
def b5_upsert_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    stored = keys.select("key", (F.col("key") % 5 > 1).alias("on"), F.lit(0).alias("at"), F.lit(0).alias("seq"))
    changes = keys.where("key % 3 = 0").select("key", (F.col("key") % 2 == 0).alias("on"), F.lit(1).alias("at"), F.lit(0).alias("seq"))
    return P.upsert_policy(stored, changes, "key")


@query(O.over(O.judged() + "," + O.verdicts(), f"SELECT pool, count(*) AS n FROM hits WHERE NOT (starts_with(client_ip, '2') AND ts_sec <= {_MID}) GROUP BY pool"))
def e7_clear_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _strikes(spark, sf_dir)
    forgotten = rows.where(F.col("client_ip").startswith("2")).select("client_ip", F.lit(_MID).alias("cleared_at")).distinct()
    return K.clear_strikes(rows, forgotten).groupBy("pool").agg(F.count("*").alias("n"))


_LABEL = " ".join(f"WHEN contains(uri, {O.q(m)}) THEN {O.q(m)}" for m in (".env", "/wp-", ".sql", "../", "%2e%2e", "/%00", "/adminer", "phpunit", "/actuator"))


@query(O.over(f"u AS MATERIALIZED (SELECT DISTINCT uri FROM access_log), v AS MATERIALIZED (SELECT uri, {O.probe_rule('uri', '404')} AS rule FROM u), k AS MATERIALIZED (SELECT uri, {O.decision('kind', method=O.q('GET'), status='404')} AS kind, {O.decision('category', method=O.q('GET'), status='404')} AS category FROM v)",
    f"SELECT uri, CASE WHEN regexp_matches(uri, '^/api/.*') THEN 'AllowedEndpoint' {_LABEL} WHEN kind = 'pass' THEN 'Clean' ELSE category END AS label FROM k"))
def c12_probe_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.access_log(spark, sf_dir).select("uri").distinct().select("uri", C.probe_label(F.col("uri"), ("^/api/.*",)).alias("label"))


@query(O.over("", """SELECT DISTINCT '/log/a' || (row_id % 3) || '.log' AS src_file, 'access' AS kind, 'combined' AS format FROM access_log UNION ALL
SELECT DISTINCT '/log/j' || (row_id % 3), 'json', 'json' FROM access_log UNION ALL SELECT DISTINCT '/log/e' || (row_id % 3), 'error', 'error' FROM access_log WHERE status >= 400"""))
def a10_classify_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda rows, head, tail: rows.select(F.concat(F.lit(head), (F.col("row_id") % 3).cast("string"), F.lit(tail)).alias("src_file"), F.col("row_id").alias("line_key"), "line")
    lines = named(V.access_lines(spark, sf_dir), "/log/a", ".log").unionByName(named(V.json_lines(spark, sf_dir), "/log/j", "")).unionByName(named(V.error_lines(spark, sf_dir), "/log/e", ""))
    return L.classify_log_files(lines)
