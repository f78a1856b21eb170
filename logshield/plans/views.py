"""Views of the given tables as log data: the inputs of the registered queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One request per event; both engines run this text. `ev` adds `us`, microseconds of ts.
ACCESS_LOG = """
SELECT event_id AS row_id, event_id, user_id,
  1704067200 + CAST(floor((us - 1704067200000000) / 20000000000.0) AS BIGINT) AS ts_sec,
  CASE WHEN user_id % 15 = 14 THEN concat('10.0.0.', CAST(1 + user_id % 250 AS STRING))
       WHEN user_id % 50 = 7 THEN concat('2001:db8::', CAST(user_id % 10000 AS STRING))
       ELSE concat(CAST(20 + user_id % 70 AS STRING), '.', CAST((user_id * 13) % 256 AS STRING), '.',
                   CAST((user_id * 7) % 256 AS STRING), '.', CAST(1 + user_id % 250 AS STRING)) END AS client_ip,
  CASE WHEN event_id % 11 = 3 THEN 'POST' WHEN event_id % 97 = 5 THEN 'TRACE'
       WHEN event_id % 13 = 4 THEN 'HEAD' ELSE 'GET' END AS method,
  CASE (event_id * 7 + user_id * 3) % 32
    WHEN 0 THEN '/wp-login.php' WHEN 1 THEN '/.env' WHEN 2 THEN '/.git/config'
    WHEN 3 THEN '/static/../../etc/passwd' WHEN 4 THEN '/images%2f%2e%2e%2fsecret'
    WHEN 5 THEN '/login%0d%0aSet-Cookie:a' WHEN 6 THEN '/wp-admin/setup.php'
    WHEN 7 THEN '/actuator/env' WHEN 8 THEN '/phpmyadmin/index.php' WHEN 9 THEN '/backup.sql'
    WHEN 10 THEN '/id_rsa' WHEN 11 THEN '/vendor/phpunit/phpunit/src/Util/PHP/eval-stdin.php'
    WHEN 12 THEN '/x.php' WHEN 13 THEN '/tool.py' WHEN 14 THEN '/.aws/credentials'
    WHEN 15 THEN '/webmail/' WHEN 16 THEN '/api/v1/users/.env' WHEN 17 THEN '/.well-known/acme'
    WHEN 18 THEN '/telescope/requests' WHEN 19 THEN '/cgi-bin/luci'
    ELSE concat('/page/', CAST(event_id % 50 AS STRING)) END AS uri,
  CASE event_type WHEN 'error' THEN 404 WHEN 'signup' THEN 403 WHEN 'purchase' THEN 404
       WHEN 'click' THEN 200 ELSE 302 END AS status,
  CASE WHEN event_id % 101 = 9 THEN '${jndi:ldap://x/a}' WHEN event_id % 103 = 9 THEN 'http://x/../y' ELSE '-' END AS referer,
  CASE user_id % 12 WHEN 0 THEN 'curl/8.5.0' WHEN 1 THEN '-' WHEN 2 THEN 'Mozilla/5.0 (compatible; GPTBot/1.2)'
    WHEN 3 THEN 'sqlmap/1.7' WHEN 4 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)'
    ELSE CASE WHEN event_id % 89 = 1 THEN '() { :; }; echo' ELSE 'Mozilla/5.0 (X11; Linux x86_64) Firefox/115.0' END END AS user_agent
FROM ev
"""
#: The same requests over a month, in bursts, and every 41st without a time.
DAYS = """
SELECT row_id, client_ip, method, uri, status, referer, user_agent,
  CASE WHEN row_id % 41 = 7 THEN CAST(NULL AS BIGINT)
       ELSE 1704067200 + (row_id % 30) * 86400 + (row_id % 7) * 599 + CAST(floor(row_id / 1000) AS BIGINT) * 3 + row_id % 5 END AS ts_sec
FROM access_log
"""
ACCESS_LINES = """
SELECT row_id, ts_sec, concat(client_ip, ' - - [01/Jan/2024:00:00:00 +0000] "', method, ' ', uri, ' HTTP/1.1" ', CAST(status AS STRING), ' 100 "', referer, '" "', user_agent, '"') AS line
FROM access_log
"""
JSON_LINES = """
SELECT row_id, ts_sec, CASE row_id % 3
  WHEN 0 THEN concat('{"client_ip":"', client_ip, '","method":"', method, '","uri":"', uri, '","status":', CAST(status AS STRING), ',"ua":"', user_agent, '","referer":"', referer, '"}')
  WHEN 1 THEN concat('{"remote_addr":"', client_ip, '","request":"', method, ' ', uri, ' HTTP/1.1","status":"', CAST(status AS STRING), '","http_user_agent":"', user_agent, '"}')
  ELSE concat('{"ip":"', client_ip, '","request_method":"', method, '","path":"', uri, '","user_agent":"', user_agent, '"}') END AS line
FROM access_log
"""
ERROR_LINES = """
SELECT row_id, concat('2024/01/01 00:00:00 [error] 1234#0: *', CAST(row_id AS STRING), ' open() "', uri, '" failed (2: No such file or directory), client: ', client_ip, ', server: x, request: "', method, ' ', uri, ' HTTP/1.1"') AS line
FROM access_log WHERE status >= 400
"""
AUTH_LINES = """
SELECT row_id, ts_sec, user_id AS pid, client_ip AS ip, concat('Jan  1 00:00:00 host sshd[', CAST(user_id AS STRING), ']: ',
  CASE CAST(floor(row_id / 3) AS BIGINT) % 5
    WHEN 0 THEN concat('Failed password for root from ', client_ip, ' port 22 ssh2')
    WHEN 1 THEN concat('Failed password for invalid user bob from ', client_ip, ' port 22 ssh2')
    WHEN 2 THEN concat('Did not receive identification string from ', client_ip, ' port 22')
    WHEN 3 THEN 'error: kex: client sent invalid protocol identifier "GET / HTTP/1.1"'
    ELSE concat('Connection closed: Connection from ', client_ip, ' port 22') END) AS line
FROM access_log
"""
IP2ASN = """
SELECT CAST((20 + n_nationkey) * 16777216 AS BIGINT) AS start_ip, CAST((20 + n_nationkey) * 16777216 + 8388607 AS BIGINT) AS end_ip,
  CAST(64500 + n_nationkey AS BIGINT) AS asn, concat(chr(65 + n_nationkey % 26), chr(65 + (n_nationkey * 7) % 26)) AS country, n_name AS as_org
FROM nation
"""
BANS = """
SELECT CASE WHEN c_custkey % 10 = 0 THEN concat('30.', CAST(c_custkey % 256 AS STRING), '.', CAST((c_custkey * 7) % 256 AS STRING), '.0/24')
       ELSE concat(CAST(20 + c_custkey % 70 AS STRING), '.', CAST((c_custkey * 13) % 256 AS STRING), '.', CAST((c_custkey * 7) % 256 AS STRING), '.', CAST(1 + c_custkey % 250 AS STRING)) END AS target,
  CAST(0 AS INT) AS tier_level, CAST(1704000000 + c_custkey AS BIGINT) AS banned_at,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(NULL AS BIGINT) WHEN c_custkey % 3 = 1 THEN CAST(1704067100 AS BIGINT) ELSE CAST(1704067300 AS BIGINT) END AS expires_at,
  concat('reason:', c_mktsegment) AS reason
FROM customer
"""
#: Moment at which bans are judged.
AS_OF = 1704067200


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.selectExpr("*", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) AS us")


def _over(name: str, rows: DataFrame, text: str) -> DataFrame:
    """The text run over rows in place of the table `name`. The view that stands for it has a name of its
    own, so that no view of the session is touched; the plan is made at once, so it can go again."""
    spark, own = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(own)
    out = spark.sql(re.sub(rf"\bFROM {name}\b", f"FROM {own}", text))
    spark.catalog.dropTempView(own)
    return out


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over("ev", events_view(spark, sf_dir), ACCESS_LOG)


def access_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over("access_log", access_log(spark, sf_dir), DAYS)


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over("access_log", access_log(spark, sf_dir), ACCESS_LINES)


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over("access_log", access_log(spark, sf_dir), JSON_LINES)


def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over("access_log", access_log(spark, sf_dir), ERROR_LINES)


def auth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over("access_log", access_log(spark, sf_dir), AUTH_LINES)


def ip2asn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over("nation", table(spark, sf_dir, "nation"), IP2ASN)


def bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over("customer", table(spark, sf_dir, "customer"), BANS)


#: The same views for the SQL oracle.
WITH = f"WITH ev AS (SELECT *, epoch_us(ts) AS us FROM events), access_log AS ({ACCESS_LOG})"
