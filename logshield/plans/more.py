"""Queries of sources that read files, of policy tables, reports and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logshield.functions import classify as C
from logshield.functions import patterns as PT
from logshield.functions import signatures as S
from logshield.operators import bans as B
from logshield.operators import counters as K
from logshield.operators import joins as J
from logshield.operators import verdicts as VD
from logshield.operators import waf as W
from logshield.plans import landing
from logshield.plans import oracles as O
from logshield.plans import queries as Q
from logshield.plans import views as V
from logshield.plans.registry import DEFAULT, query
from logshield.sources import logs as L
from logshield.sources import policies as P
from logshield.sources.shared import folder
from logshield.streaming import escalation, live

_LINES = f"lines AS ({V.ACCESS_LINES})"


@query(O.over(_LINES, "SELECT line, count(*) AS n, CAST(1 AS BIGINT) AS keyed FROM lines GROUP BY line"))
def a1_scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.scan_lines(spark, landing.landed_text(V.access_lines(spark, sf_dir)))
    keys = F.countDistinct("src_file", "line_key") == F.count("*")
    return got.groupBy("line").agg(F.count("*").alias("n"), keys.cast("long").alias("keyed"))


_PATHS = "SELECT concat('/var/log/', CAST(c_custkey % 100 AS STRING), '.log') AS path, concat('f', CAST(c_custkey % 7 AS STRING)) AS format_name, c_custkey AS seq FROM customer"
_FORMATS = "SELECT concat('f', CAST(n_nationkey AS STRING)) AS format_name, concat('$remote_addr ', n_name) AS body FROM nation WHERE n_nationkey < 5"


@query(f"""WITH p AS ({_PATHS}), f AS ({_FORMATS}), one AS (SELECT path, arg_min(format_name, seq) AS format_name FROM p GROUP BY path)
SELECT path, coalesce(body, {O.q(L.COMBINED)}) AS format FROM one LEFT JOIN f USING (format_name)""")
def a11_resolve_log_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = V._over("customer", V.table(spark, sf_dir, "customer"), _PATHS)
    return L.resolve_log_catalog(paths, V._over("nation", V.table(spark, sf_dir, "nation"), _FORMATS))


_TSV = """SELECT concat(CAST(20 + n_nationkey AS STRING), '.0.0.0', chr(9), CAST(20 + n_nationkey AS STRING), CASE WHEN n_nationkey % 6 = 5 THEN '.x' ELSE '.127.255.255' END, chr(9), CAST(64500 + n_nationkey AS STRING), chr(9),
  CASE WHEN n_nationkey % 5 = 0 THEN '?' ELSE 'ABC' END, CASE WHEN n_nationkey % 11 = 3 THEN '' ELSE concat(chr(9), n_name) END) AS line FROM nation
UNION ALL SELECT concat('# ', n_name) FROM nation"""


@query("""SELECT CAST((20 + n_nationkey) * 16777216 AS BIGINT) AS start_ip, CAST((20 + n_nationkey) * 16777216 + 8388607 AS BIGINT) AS end_ip, CAST(64500 + n_nationkey AS BIGINT) AS asn,
  CASE WHEN n_nationkey % 5 = 0 THEN '??' ELSE 'AB' END AS country, n_name AS as_org FROM nation WHERE n_nationkey % 6 <> 5 AND n_nationkey % 11 <> 3""")
def a12_read_ip2asn(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V._over("nation", V.table(spark, sf_dir, "nation"), _TSV)
    return L.read_ip2asn(spark, landing.landed_text(lines))


@query("""WITH h AS (SELECT c_custkey, last_value(CASE c_custkey % 4 WHEN 0 THEN 'agent' WHEN 1 THEN 'referer' WHEN 2 THEN '' END IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS kind FROM customer)
SELECT DISTINCT kind, 'bot' || (c_custkey % 50) || '.x' AS token FROM h WHERE kind <> '' AND c_custkey % 10 <> 9""")
def a13_read_blocklist_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "customer").selectExpr("concat('f', c_nationkey) AS src_file", "c_custkey", "c_custkey % 4 AS k")
    head = F.when(F.col("k") == 0, "map $http_user_agent $bad {").when(F.col("k") == 1, "map $http_referer $bad {").when(F.col("k") == 2, "}").otherwise("")
    token = F.concat(F.lit('  "~*(?:\\b)bot'), (F.col("c_custkey") % 50).cast("string"), F.lit('\\.x(?:\\b)" '), F.when(F.col("c_custkey") % 10 == 9, "0;").otherwise("3;"))
    lines = F.array(*(F.struct((3 * F.col("c_custkey") + i).alias("line_key"), x.alias("line")) for i, x in enumerate((head, token, F.lit("  default 0;")))))
    return L.read_blocklist_maps(rows.select("src_file", F.inline(lines)))


@query("""SELECT t AS name, count(*) AS n FROM (SELECT unnest(['whitelist', 'blocked_asns', 'restricted_asns', 'allowed_regions', 'categories', 'waf_state']) AS t, n_nationkey FROM nation) GROUP BY t""")
def a15_load_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, nation = folder(spark), V.table(spark, sf_dir, "nation")
    for t in P.TABLES:
        nation.select(F.col("n_nationkey").alias("key"), F.lit(True).alias("on")).write.parquet(f"{path}/{t}")
    got = None
    for name, rows in P.load_policies(spark, path).items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        got = one if got is None else got.unionByName(one)
    return got


@query("SELECT c_custkey AS key, c_custkey % 2 = 0 AS \"on\" FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, true FROM customer WHERE c_custkey % 3 <> 0")
def a16_merge_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is configured enters where it is not stored: a stored false survives."""
    keys = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    stored = keys.where("key % 3 = 0").withColumn("on", F.col("key") % 2 == 0)
    return P.merge_absent(stored, keys.withColumn("on", F.lit(True)), "key")


_AGENT = O.over(O.judged(), "SELECT agent, count(*) AS n FROM facts GROUP BY agent")


@query(_AGENT)
def c6_category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in any case, and as aliases where a category has one, lead back to the category."""
    alias = {c: a for a, c in S.ALIASES.items()}
    got = V.access_log(spark, sf_dir).select("row_id", C.agent_category(F.col("user_agent")).alias("c"))
    said = F.col("c")
    for c, a in alias.items():
        said = F.when((F.col("c") == c) & (F.col("row_id") % 2 == 0), a).otherwise(said)
    return got.select(C.category_from_name(F.upper(said)).alias("agent")).groupBy("agent").agg(F.count("*").alias("n"))


@query(O.over(O.judged(), "SELECT category, CASE category " + " ".join(f"WHEN {O.q(c)} THEN {n}" for c, n in S.CATEGORY_CODES.items()) + " END AS code, count(*) AS n FROM facts GROUP BY category"))
def c14_threat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.access_log(spark, sf_dir).withColumn("rule", C.probe_rule(C.normalized_path(F.col("uri")), F.col("status")))
    category = C.decision_part(C.probe_decision(F.col("method"), F.col("status"), F.col("rule")), "category")
    return log.select(category.alias("category")).groupBy("category").agg(F.count("*").alias("n")).withColumn("code", C.threat_code(F.col("category")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 < 4 THEN (c_custkey % 100) * CASE c_custkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END END AS seconds,
  CASE c_custkey % 6 WHEN 5 THEN 'unknown unit' END AS error FROM customer""")
def c15_parse_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    unit = F.element_at(F.array(*map(F.lit, ("s", "m", "h", "d", "", "y"))), (k % 6 + 1).cast("int"))
    text = F.when(k % 6 == 4, "Permanent").otherwise(F.concat((k % 100).cast("string"), unit))
    return V.table(spark, sf_dir, "customer").select("c_custkey", C.parsed_duration(text).alias("d")).select("c_custkey", "d.seconds", "d.error")


@query(O.over("", """SELECT row_id, CASE WHEN row_id % 4 = 0 THEN '9.9.9.' || (row_id % 200) WHEN row_id % 4 = 1 THEN '8.8.4.' || (row_id % 200) WHEN row_id % 4 = 2 THEN client_ip ELSE '10.1.1.1' END AS ip FROM access_log"""))
def c1_resolve_client_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the edge header, the first public hop, the peer, and a private hop at last."""
    k = F.col("row_id") % 4
    n = (F.col("row_id") % 200).cast("string")
    edge = F.when(k == 0, F.concat(F.lit(" 9.9.9."), n, F.lit(", 1.1.1.1"))).when(k == 1, "unknown")
    hops = F.when(k == 1, F.concat(F.lit("10.2.2.2, nonsense, 8.8.4."), n, F.lit(", 7.7.7.7"))).when(k == 2, "192.168.1.1, bad").when(k == 3, "x, 10.1.1.1")
    peer = F.when(k == 3, "-").otherwise(F.col("client_ip"))
    return V.access_log(spark, sf_dir).select("row_id", C.resolved_ip(edge, hops, peer).alias("ip"))


_LISTED = "starts_with(client_ip, '21.') OR starts_with(client_ip, '22.')"


@query(O.over(O.judged() + "," + O.verdicts(), f"""SELECT row_id, client_ip, CASE WHEN starts_with(client_ip, '21.') THEN 'allow' WHEN starts_with(client_ip, '22.') THEN 'drop_banned' ELSE action END AS action, CASE WHEN NOT ({_LISTED}) THEN reason END AS reason FROM verdict"""))
def d4_listed_and_banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitelist comes before the ban table, and both before every rule."""
    log = V.access_log(spark, sf_dir)
    ips = log.select("client_ip").distinct()
    p = VD.Policies(allowed_endpoints=("^/api/.*",), whitelist=ips.where("client_ip LIKE '21.%'"), banned=ips.where("client_ip LIKE '21.%' OR client_ip LIKE '22.%'"))
    return VD.evaluate_requests(log, p).select("row_id", "client_ip", "action", "reason")


_SLOT = f"""
i0 AS MATERIALIZED (SELECT 'web' AS stream, row_id, ts_sec, client_ip, category, window_s AS win FROM cand WHERE act = 'strike|isolated'
  UNION ALL SELECT 'ssh', row_id, ts_sec, ip, 'common', 300 FROM sh0 WHERE act = 'strike'),
i1 AS MATERIALIZED (SELECT *, CASE WHEN coalesce(ts_sec - lag(ts_sec) OVER w > win, false) OR coalesce(category <> lag(category) OVER w, false) THEN 1 ELSE 0 END AS fresh FROM i0 WINDOW w AS (PARTITION BY client_ip ORDER BY ts_sec, row_id, stream)),
i2 AS MATERIALIZED (SELECT *, sum(fresh) OVER (PARTITION BY client_ip ORDER BY ts_sec, row_id, stream) AS run FROM i1)"""


@query(O.over(Q._SSH + "," + O.judged() + "," + _SLOT, "SELECT stream, row_id, CAST(least(row_number() OVER (PARTITION BY client_ip, run ORDER BY ts_sec, row_id, stream), 255) AS INT) AS strikes FROM i2"))
def e4_shared_isolated_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web and ssh strikes of an address share its isolated counter."""
    web = V.access_log(spark, sf_dir)
    ssh = Q._ssh_events(spark, sf_dir)
    # Both logs use the same numbers of rows; ssh lines come first within a second.
    ssh = ssh.withColumn("row_id", 2 * F.col("row_id"))
    got = VD.evaluate_all(web.withColumn("row_id", 2 * F.col("row_id") + 1), ssh, DEFAULT)
    slot = F.col("strikes").isNotNull() & ((F.col("stream") == "ssh") | F.col("isolated"))
    web_pool = VD.strike_rows(VD.candidates(web, DEFAULT)).where("pool = 'isolated'").select(F.lit("web").alias("stream"), (2 * F.col("row_id") + 1).alias("row_id"), F.lit(True).alias("isolated"))
    got = got.join(web_pool, ["stream", "row_id"], "left").withColumn("isolated", F.coalesce("isolated", F.lit(False)))
    return got.where(slot).select("stream", F.floor(F.col("row_id") / 2).alias("row_id"), "strikes")


@query(O.over(Q._BANS, f"SELECT count(*) FILTER (WHERE {Q._LIVE}) AS kept, count(*) FILTER (WHERE NOT {Q._LIVE}) AS removed FROM bans"))
def e11_purge_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.purged_count(Q._bans(spark, sf_dir), V.AS_OF)


@query(O.over(Q._OFF, f"SELECT count(*) FILTER (WHERE {V.AS_OF + 130} - last_seen <= 20) AS kept, count(*) FILTER (WHERE {V.AS_OF + 130} - last_seen > 20) AS removed FROM offenses"))
def e9_prune_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.pruned_count(Q.e8_offense_counter(spark, sf_dir), V.AS_OF + 130, 20)


@query(O.over(Q._BANS, f"SELECT 'v4' AS family, target || CASE WHEN expires_at IS NULL THEN '' ELSE ' timeout 100s' END AS element FROM bans WHERE {Q._LIVE}"))
def g4_restore_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.restore_set(Q._bans(spark, sf_dir), V.AS_OF).select("family", F.explode(F.split("elements", ", ")).alias("element"))


@query(O.over(Q._BANS + f", live AS (SELECT target, reason FROM bans WHERE {Q._LIVE})", """SELECT 'active_bans' AS section, 'count' AS key, CAST(count(*) AS VARCHAR) AS value FROM live
UNION ALL SELECT 'ban', target, reason FROM (SELECT * FROM live ORDER BY target LIMIT 15) UNION ALL SELECT 'blocked_asns', CAST(64500 + n_nationkey AS VARCHAR), 'on' FROM nation UNION ALL SELECT 'allowed_regions', r_name, 'on' FROM region"""))
def g2_status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = {"blocked_asns": V.ip2asn(spark, sf_dir).select("asn"), "allowed_regions": V.table(spark, sf_dir, "region").select("r_name")}
    return B.status_report(Q._bans(spark, sf_dir), policies, V.AS_OF)


_CLAUSE = """reg AS (SELECT '(ip.src.asnum in {' || string_agg(CAST(asn AS VARCHAR), ' ' ORDER BY asn) || '} and not ip.src.country in {"AA" "BH" "CO"})' AS a FROM r WHERE asn % 7 = 1)"""
_RECENT = f"""v4 AS (SELECT target, banned_at, sum(length(target) + 1) OVER (ORDER BY banned_at DESC, target DESC) AS used FROM bans WHERE {Q._LIVE} AND NOT contains(target, '/')),
fit AS (SELECT v4.* FROM v4, reg WHERE used <= 600 - length(a) - 4 - 14)"""


@query(O.over(Q._GEO + "," + Q._BANS + "," + _CLAUSE + "," + _RECENT, "SELECT a || ' or (ip.src in {' || string_agg(target, ' ' ORDER BY banned_at DESC, target DESC) || '})' AS expression, CAST(count(*) AS INT) AS n_addresses FROM fit, reg GROUP BY a"))
def f4_waf_regions_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clause of restricted networks, and addresses by recency, under a small limit."""
    ranges = V.ip2asn(spark, sf_dir)
    regions = ranges.where("country IN ('AA', 'BH', 'CO')")
    return W.waf_expression(Q._bans(spark, sf_dir), ranges.where("false"), ranges.where("asn % 7 = 1"), regions, V.AS_OF, 600, recent_first=True).select("expression", "n_addresses")


@query(O.over(Q._GEO + "," + Q._BANS + "," + _CLAUSE + "," + _RECENT + ", e AS (SELECT a || ' or (ip.src in {' || string_agg(target, ' ' ORDER BY banned_at DESC, target DESC) || '})' AS expression FROM fit, reg GROUP BY a)",
    f"SELECT CAST(length(expression) AS INT) AS chars, CAST(600 AS INT) AS max_chars, round(length(expression) * 100.0 / 600, 1) AS percent, substr(expression, 1, 120) AS preview, (SELECT count(*) FROM bans WHERE {Q._LIVE}) AS active_bans FROM e"))
def f7_waf_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = V.ip2asn(spark, sf_dir)
    bans = Q._bans(spark, sf_dir)
    made = W.waf_expression(bans, ranges.where("false"), ranges.where("asn % 7 = 1"), ranges.where("country IN ('AA', 'BH', 'CO')"), V.AS_OF, 600, recent_first=True)
    return W.waf_budget(made, bans, V.AS_OF, 600).withColumn("percent", F.col("percent").cast("double"))


_DAYS = O.over(f"days AS MATERIALIZED ({V.DAYS})," + O.judged(source="days") + "," + O.verdicts().replace("ORDER BY ts_sec, row_id", "ORDER BY ts_sec NULLS FIRST, row_id"), "SELECT row_id, client_ip, pool, CAST(strikes AS INT) AS strikes FROM hits")


@query(_DAYS)
def e1_strikes_over_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pools over a month of requests, some without a time: counters go on from span to span."""
    rows = VD.settled(VD.candidates(V.access_days(spark, sf_dir), DEFAULT))
    return K.strike_counts(VD.strike_rows(rows)).select("row_id", "client_ip", "pool", "strikes")


@query(_DAYS.replace("SELECT row_id, client_ip, pool, CAST(strikes AS INT) AS strikes FROM hits", "SELECT * FROM verdict"))
def f1_evaluate_over_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VD.evaluate_requests(V.access_days(spark, sf_dir), DEFAULT)


_FLUSH = 1704067200 + 10**6


def _streamed(rows: DataFrame, judged, flush: list[tuple], files: int = 4) -> DataFrame:
    """What `judged` makes of rows as a stream of landed files. The rows of `flush`, each in a run of
    its own that goes on from the checkpoint, let the watermark pass what came before."""
    spark = rows.sparkSession
    path, out, mark = landing.landed_parts(rows, "ts_sec", files), folder(spark), folder(spark)
    for last in flush:
        spark.createDataFrame([last], rows.schema).coalesce(1).write.mode("append").parquet(path)
        stream = live.timed(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(path), "1 hour")
        live.to_parquet(judged(stream), out, mark).awaitTermination()
    return spark.read.parquet(out).where("row_id >= 0")


@query(O.over(O.judged() + "," + O.verdicts(), "SELECT * FROM verdict"))
def h1_stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access log landed in files and judged live; the result is that of the batch."""
    log = V.access_log(spark, sf_dir).select("row_id", "ts_sec", "client_ip", "method", "uri", "status", "referer", "user_agent")
    return _streamed(log, lambda stream: live.stream_verdicts(stream, DEFAULT), [(-1, _FLUSH, "10.0.0.1", "GET", "/", 200, "-", "-")])


@query(Q.ORACLES["f5_evaluate_ssh"])
def h2_stream_ssh(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.auth_lines(spark, sf_dir).select("row_id", "ts_sec", "line")
    # Two operators with state: what the first releases waits in the second for the next watermark.
    got = _streamed(lines, lambda stream: live.stream_ssh(stream, key=()), [(-1, _FLUSH, ""), (-2, _FLUSH + 10**6, "")])
    return got.select("row_id", "action", "reason")


@query(O.over(O.judged() + "," + O.verdicts(), "SELECT client_ip AS target, max(ts_sec) AS banned_at FROM verdict WHERE action = 'ban' GROUP BY client_ip"))
def h3_stream_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts landed in files, saved as a ledger batch by batch: of each address its last ban."""
    rows = VD.evaluate_requests(V.access_log(spark, sf_dir), DEFAULT)
    path, ledger = landing.landed_parts(rows, "ts_sec", 8), folder(spark)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(path)
    live.stream_bans(stream, ledger, folder(spark)).awaitTermination()
    return live.ledger_bans(spark, ledger).select("target", "banned_at")


def _offense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.access_log(spark, sf_dir).where("status >= 400")
    return rows.select("row_id", "ts_sec", "client_ip", (F.col("row_id") % 29 == 0).alias("instant_permanent"), F.lit("offense").alias("reason"))


@query(Q.ORACLES["e8_offense_counter"])
def h5_stream_offenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offense history of every address after the last of its offenses, as a stream told it."""
    rows = _offense_rows(spark, sf_dir)
    got = _streamed(rows, lambda stream: escalation.stream_offenses(stream, 5), [(-1, _FLUSH, "10.0.0.1", False, "")])
    last = F.max_by(F.struct("count", "first_seen", "last_seen"), F.struct("ts_sec", "row_id")).alias("s")
    return got.where("NOT pruned").groupBy("client_ip").agg(last).select("client_ip", "s.count", "s.first_seen", "s.last_seen")


@query(Q.ORACLES["e10_escalate"])
def h5_stream_escalate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiered bans of e10 as a stream gave them."""
    got = _streamed(_offense_rows(spark, sf_dir), lambda stream: escalation.stream_escalate(stream, 10, 3, (3600, 86400, None)), [(-1, _FLUSH, "10.0.0.1", False, "")])
    return got.select("client_ip", "ts_sec", "row_id", "tier", "duration_s", "permanent")


_TIERED = Q.ORACLES["e10_escalate"]


@query(_TIERED.replace("SELECT client_ip, ts_sec, row_id, tier, ", "SELECT client_ip AS target, CAST(tier AS INT) AS tier_level, ts_sec AS banned_at, ts_sec + ").replace(" AS duration_s, perm OR tier = 2 AS permanent FROM fold WHERE tier IS NOT NULL", " AS expires_at FROM fold WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_ip ORDER BY ts_sec DESC, row_id DESC) = 1"))
def h3_stream_tiered_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalation as a stream, its bans saved as a ledger batch by batch: of each address the last, with
    its tier and end."""
    rows = _offense_rows(spark, sf_dir)
    path, ledger, mark = landing.landed_parts(rows, "ts_sec", 4), folder(spark), folder(spark)
    spark.createDataFrame([(-1, _FLUSH, "10.0.0.1", False, "")], rows.schema).coalesce(1).write.mode("append").parquet(path)
    stream = live.timed(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(path), "1 hour")
    live.stream_bans(escalation.stream_escalate(stream, 10, 3, (3600, 86400, None)), ledger, mark).awaitTermination()
    return live.ledger_bans(spark, ledger).select("target", "tier_level", "banned_at", "expires_at")


@query(Q.ORACLES["e11_active_bans"])
def h5_stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bans landed in files; those that ended are lifted by the timers of their state. What stands is
    what the batch calls active."""
    rows = V.bans(spark, sf_dir).withColumn("row_id", F.monotonically_increasing_id()).withColumn("ts_sec", F.col("banned_at"))
    # The watermark passes every ban; what ended after the moment of the question stood then.
    end = max(V.AS_OF, rows.agg(F.max("banned_at")).first()[0] or 0) + 3600
    path, out, mark = landing.landed_parts(rows, "banned_at", 4), folder(spark), folder(spark)
    for last in (None, (end, -1)):
        if last:
            flush = spark.range(1).select(F.lit("10.0.0.1").alias("target"), F.lit(0).alias("tier_level"), F.lit(last[0]).alias("banned_at"), F.lit(last[0]).alias("expires_at"), F.lit("").alias("reason"), F.lit(last[1]).alias("row_id"), F.lit(last[0]).alias("ts_sec"))
            flush.select(*(F.col(f.name).cast(f.dataType) for f in rows.schema)).coalesce(1).write.mode("append").parquet(path)
        stream = live.timed(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(path), "1 hour")
        live.to_parquet(escalation.stream_expiry(stream), out, mark).awaitTermination()
    return escalation.standing(spark.read.parquet(out), V.AS_OF).where("target <> '10.0.0.1'")


_NESTED = """SELECT concat(CAST(20 + k % 70 AS STRING), '.', CAST((k * 13) % 256 AS STRING), '.', CAST((k * 7) % 256 AS STRING), '.', CAST(k % 250 AS STRING), '/', CAST(1 + k % 32 AS STRING)) AS target,
  concat('r', CAST(k % 5 AS STRING)) AS reason, CASE WHEN k % 3 = 0 THEN CAST(NULL AS BIGINT) WHEN k % 3 = 1 THEN CAST(1704067100 AS BIGINT) ELSE CAST(1704067300 AS BIGINT) END AS expires_at FROM numbers"""


@query(O.over(f"""numbers AS (SELECT c_custkey AS k FROM customer UNION SELECT 7 * c_custkey + 3 FROM customer), nested AS MATERIALIZED ({_NESTED}),
n AS (SELECT *, {O.IP_V4.format("split_part(target, '/', 1)")} AS base, CAST(power(2, 32 - CAST(split_part(target, '/', 2) AS INT)) AS BIGINT) AS wide FROM nested WHERE expires_at IS NULL OR expires_at > {V.AS_OF}),
asked AS (SELECT DISTINCT client_ip AS target, {O.IP_V4.format('client_ip')} AS v4 FROM access_log),
hit AS (SELECT a.target, min(struct_pack(ban_target := n.target, reason := n.reason)) AS b FROM asked a JOIN n ON v4 // wide = base // wide GROUP BY a.target)""",
    "SELECT target, CASE WHEN b IS NOT NULL THEN 'Subnet' END AS match, b.ban_target AS ban_target, b.reason AS reason FROM asked LEFT JOIN hit USING (target)"))
def d5_nested_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of every length, within each other: of those that hold an address, the first in order."""
    k = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    nets = V._over("numbers", k.union(k.selectExpr("7 * k + 3")).distinct(), _NESTED)
    asked = V.access_log(spark, sf_dir).select(F.col("client_ip").alias("target"))
    return J.check_targets(asked, nets, V.AS_OF).select("target", "match", "ban_target", "reason")


_TOKENS = """SELECT concat('REF', CAST(3 * c_custkey AS STRING)) AS token FROM customer UNION ALL SELECT concat('nt', CAST(c_custkey AS STRING)) FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT lower(c_name) FROM customer UNION ALL SELECT CASE c_nationkey % 3 WHEN 0 THEN '4x' WHEN 1 THEN '~' ELSE 'QZ' END FROM customer UNION ALL SELECT '' FROM customer"""
_AGENTS = "SELECT concat('Mozilla/5.0 Agent', CAST(o_orderkey % 997 AS STRING), ' ref', CAST(o_custkey % 400 AS STRING), CASE WHEN o_custkey % 11 = 0 THEN ' 4X' ELSE '' END) AS user_agent FROM orders"


@query(f"""WITH t AS MATERIALIZED (SELECT DISTINCT lower(token) AS token FROM ({_TOKENS}) WHERE token <> ''), a AS MATERIALIZED (SELECT user_agent, count(*) AS n FROM ({_AGENTS}) GROUP BY user_agent),
m AS (SELECT user_agent, min(token) AS token FROM a JOIN t ON contains(lower(user_agent), token) GROUP BY user_agent) SELECT token, CAST(sum(n) AS BIGINT) AS n FROM a LEFT JOIN m USING (user_agent) GROUP BY token""")
def d7_blocklist_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as there are customers and more, of one character to many."""
    tokens = V._over("customer", V.table(spark, sf_dir, "customer"), _TOKENS)
    agents = V._over("orders", V.table(spark, sf_dir, "orders"), _AGENTS)
    return J.blocklist_match(agents, tokens).groupBy("token").agg(F.count("*").alias("n"))


@query(Q.ORACLES["f4_waf_regions_recent"])
def h4_stream_waf_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expression after the last of several batches of bans, each of which read its own rows only."""
    bans, ranges = V.bans(spark, sf_dir), V.ip2asn(spark, sf_dir)
    regions, none = ranges.where("country IN ('AA', 'BH', 'CO')"), ranges.where("false")
    made = lambda rows: W.waf_expression(rows, none, ranges.where("asn % 7 = 1"), regions, V.AS_OF, 600, recent_first=True)
    path, out = landing.landed_parts(bans, "banned_at", 6), folder(spark)
    stream = spark.readStream.schema(bans.schema).option("maxFilesPerTrigger", 2).parquet(path)
    live.stream_recent_waf(stream, folder(spark), folder(spark), out, folder(spark), made, lambda: V.AS_OF, 80).awaitTermination()
    got = spark.read.parquet(out)
    return got.join(got.agg(F.max("batch").alias("batch")), "batch", "left_semi").select("expression", "n_addresses")


@query(O.over(O.judged() + "," + O.verdicts(), "SELECT row_id, client_ip, action, reason, strikes FROM verdict WHERE strikes IS NOT NULL"))
def h6_stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request comes again when the watermark has passed it: late strikes count nowhere."""
    log = V.access_log(spark, sf_dir).select("row_id", "ts_sec", "client_ip", "method", "uri", "status", "referer", "user_agent")
    path, out, mark = landing.landed_parts(log, "ts_sec", 4), folder(spark), folder(spark)
    flush = spark.createDataFrame([(-1, _FLUSH, "10.0.0.1", "GET", "/", 200, "-", "-")], log.schema).coalesce(1)
    for more in (flush, log.withColumn("row_id", F.col("row_id") + 10**9)):
        more.write.mode("append").parquet(path)
        stream = live.timed(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 3).parquet(path), "1 hour")
        live.to_parquet(live.stream_verdicts(stream, DEFAULT), out, mark).awaitTermination()
    return spark.read.parquet(out).where("strikes IS NOT NULL").select("row_id", "client_ip", "action", "reason", "strikes")


@query(Q.ORACLES["f1_evaluate_requests"])
def h7_stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are sent twice: each row is judged once."""
    log = V.access_log(spark, sf_dir).select("row_id", "ts_sec", "client_ip", "method", "uri", "status", "referer", "user_agent")
    path, out, mark = landing.landed_parts(log, "ts_sec", 4), folder(spark), folder(spark)
    log.coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(-1, _FLUSH, "10.0.0.1", "GET", "/", 200, "-", "-")], log.schema).coalesce(1).write.mode("append").parquet(path)
    stream = live.timed(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 3).parquet(path), "1 hour", ("row_id",))
    live.to_parquet(live.stream_verdicts(stream, DEFAULT), out, mark).awaitTermination()
    return spark.read.parquet(out).where("row_id >= 0")


@query(O.over("", "SELECT client_ip, method, uri, status, referer, user_agent, CAST(1704067200 AS BIGINT) AS ts_sec, count(*) AS n FROM access_log GROUP BY ALL"))
def a14_stream_access_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines landed as text files, parsed as they come."""
    path, out = landing.landed_text(V.access_lines(spark, sf_dir).repartition(3)), folder(spark)
    rows = live.stream_access_logs(spark, path, files=2).select("client_ip", "method", "uri", "status", "referer", "user_agent", "ts_sec")
    live.to_parquet(rows, out, folder(spark)).awaitTermination()
    return spark.read.parquet(out).groupBy(*rows.columns).agg(F.count("*").alias("n"))


#: Four kinds of files and the formats of their folders.
_KINDS = {"combined": L.COMBINED, "edge": L.EDGE, "own": '${host}|$status|$request_method $request_uri|$remote_addr|$$|$http_user_agent', "json": '{"client":"$remote_addr","request":"$request"}'}


@query(O.over("", """SELECT CASE row_id % 4 WHEN 0 THEN 'combined' WHEN 1 THEN 'edge' WHEN 2 THEN 'own' ELSE 'json' END AS kind, client_ip, method, uri, status, CASE WHEN row_id % 4 = 2 THEN '' ELSE referer END AS referer, user_agent,
  CASE WHEN row_id % 4 = 2 THEN 'www' ELSE '' END AS host, count(*) AS n FROM access_log GROUP BY ALL"""))
def a3_formats_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four formats read at once, each by its own, found by the catalog of paths and formats."""
    lines = V.access_lines(spark, sf_dir).select("row_id", "line").join(V.access_log(spark, sf_dir), "row_id")
    ip, plain = F.col("client_ip"), F.col("line")
    own = F.concat_ws("|", F.lit("www"), F.col("status").cast("string"), F.concat_ws(" ", "method", "uri"), ip, F.lit("$"), "user_agent")
    edge = F.concat(F.lit("10.9.9.9"), F.expr("substr(line, length(client_ip) + 1)"), F.lit(' "'), ip, F.lit('"'))
    asked = F.concat(F.lit('{"client":"'), ip, F.lit('","request":"'), F.concat_ws(" ", "method", "uri"), F.lit(' HTTP/1.1","status":'), F.col("status").cast("string"), F.lit(',"ua":"'), F.col("user_agent"), F.lit('","referer":"'), F.col("referer"), F.lit('"}'))
    k = F.col("row_id") % 4
    kind = F.when(k == 0, "combined").when(k == 1, "edge").when(k == 2, "own").otherwise("json")
    path = folder(spark)
    rows = lines.select(kind.alias("kind"), F.when(k == 0, plain).when(k == 1, edge).when(k == 2, own).otherwise(asked).alias("line"))
    rows.write.partitionBy("kind").text(path)
    read = L.scan_lines(spark, path)
    of = F.regexp_extract("src_file", "/kind=([a-z]+)/", 1)
    paths = read.select(F.col("src_file").alias("path"), of.alias("format_name"), F.lit(1).alias("seq")).distinct()
    catalog = L.resolve_log_catalog(paths, spark.createDataFrame(list(_KINDS.items()), "format_name string, body string"))
    got = L.parse_by_file(read, catalog).where("parse_ok").withColumn("kind", of)
    return got.groupBy("kind", "client_ip", "method", "uri", "status", "referer", "user_agent", "host").agg(F.count("*").alias("n"))


_WRITTEN = r"""SELECT c_custkey AS k, concat(CASE c_custkey % 8 WHEN 0 THEN '^/page/[0-9]+' WHEN 1 THEN '(?i)/PAGE/' WHEN 2 THEN 'a(?=b)' WHEN 3 THEN '(x)\\1' WHEN 4 THEN '[[:digit:]_]{2,3}' WHEN 5 THEN '(?P<n>y)+?' WHEN 6 THEN '*' ELSE '[z-a]' END, CAST(c_custkey AS STRING)) AS pattern FROM customer"""


@query(f"""SELECT pattern, CASE k % 8 WHEN 2 THEN 'look-around or unknown group' WHEN 3 THEN 'backreference' WHEN 6 THEN 'nothing to repeat' WHEN 7 THEN 'bad range' END AS reason,
  CASE k % 8 WHEN 0 THEN '(?Ud)^/page/[0-9]+' || k WHEN 1 THEN '(?Ud)(?i)/PAGE/' || k WHEN 4 THEN '(?Ud)[\\p{{Digit}}_]{{2,3}}' || k WHEN 5 THEN '(?Ud)(y)+?' || k END AS java FROM ({_WRITTEN.replace(chr(92) * 2, chr(92))})""")
def c10_pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns as data: each with its form for Java or the reason why there is none."""
    return PT.translated(V._over("customer", V.table(spark, sf_dir, "customer"), _WRITTEN))
