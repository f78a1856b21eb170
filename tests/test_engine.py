"""Scalars, parsers and counters on small examples; the cascade against a row-at-a-time model."""

import ipaddress
import random
import time

import pytest
from pyspark.sql import functions as F

from logshield.functions import classify as C
from logshield.functions import ip as IP
from logshield.functions import patterns as PT
from logshield.operators import counters as K
from logshield.operators import joins as J
from logshield.operators import verdicts as VD
from logshield.sources import logs as L


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_addresses(spark):
    texts = ["1.2.3.4", "01.2.3.4", "::1", "2001:db8::7", "1::2::3", "::ffff:10.0.0.1", "fe80::1%e", None, ""]
    assert column(spark, texts, IP.is_ip) == [True, False, True, True, False, True, False, False, False]
    assert column(spark, ["1.2.3.4", "::1", "2001:db8::7"], IP.ip_key) == ["0" * 20 + "ffff01020304", "0" * 31 + "1", "20010db8" + "0" * 23 + "7"]
    private = ["127.0.0.1", "10.9.8.7", "172.31.0.1", "172.32.0.1", "192.168.1.1", "100.64.0.1", "169.254.0.1", "8.8.8.8", "::1", "fd00::1", "fe90::1", "2001:db8::1", "::ffff:10.0.0.1"]
    assert column(spark, private, IP.is_private) == [True, True, True, False, True, True, True, False, True, True, True, False, False]


def test_uri_and_agents(spark):
    assert column(spark, ["/a%2f%2fb", "/%2e%2e/x", "/a//b\\c", "/%252e", "/plain"], C.normalized_path) == ["/a/b", "/../x", "/a/b/c", "/%252e", "/plain"]
    assert column(spark, ["/a%00", "/a%0D", "/a"], C.malicious_uri) == [True, True, False]
    agents = ["curl/8", "", "-", "Mozilla GPTBot", "sqlmap", "javascript", "Firefox", None]
    assert column(spark, agents, C.agent_category) == ["generic_tools", "empty", "empty", "ai_crawler", "security_testing", "generic_tools", "browser_or_unknown", "empty"]
    assert column(spark, ["x${JNDI:y", "() { :", "<?PHP", "ok"], C.header_exploit) == ["jndi", "shellshock", "php_tag", None]


@pytest.mark.parametrize(("method", "path", "status", "rule", "decision"), [
    ("GET", "/.git/config", 404, "R10", "shared|vcs|3|10"), ("POST", "/.git/config", 404, "R10", "instant|vcs||"), ("GET", "/x/bin/sh", 200, "R02", "pass|common||"),
    ("POST", "/x/bin/sh", 200, "R02", "instant|common||"), ("GET", "/wp-admin/x", 404, "R37", "isolated|wordpress|7|10"), ("PUT", "/wp-admin/x", 404, "R37", "isolated|wordpress|5|10"),
    ("GET", "/index", 200, "R29", "pass|||"), ("GET", "/.well-known/x", 200, "R00", "pass|||"), ("GET", "/q.php", 404, "R55", "isolated|php|15|10"), ("GET", "/", 404, "R99", "pass|||"),
])
def test_probe_rules(spark, method, path, status, rule, decision):
    rows = spark.createDataFrame([(method, path, status)], "m string, p string, s int")
    r = rows.withColumn("r", C.probe_rule(F.col("p"), F.col("s"))).select("r", C.probe_decision(F.col("m"), F.col("s"), F.col("r")).alias("d")).first()
    assert (r["r"], r["d"]) == (rule, decision)


def test_parsers_reject_without_failing(spark):
    lines = ['1.2.3.4 - - [x] "GET /a HTTP/1.1" 404 1 "-" "curl"', "garbage", "", '1.2.3.4 - - [x] "GET /a HTTP/1.1" 99999999 1 "-" "c"', None]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [bool(r["parse_ok"]) for r in L.parse_combined(rows).collect()] == [True, False, False, False, False]
    assert L.parse_json(spark.createDataFrame([('{"ip":"1.1.1.1","status":"x"}',), ("{",), ("no",)], "line string")).where("parse_ok").count() == 1
    assert L.parse_format(rows).where("parse_ok").first()["uri"] == "/a"


def test_cidr_cover_and_bounds(spark):
    rng = random.Random(3)
    pairs = [tuple(sorted((rng.randrange(1 << 20), rng.randrange(1 << 20)))) for _ in range(60)] + [(0, (1 << 32) - 1), (5, 5)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long")
    for r in rows.select("a", "b", IP.range_cidrs(F.col("a"), F.col("b")).alias("c")).collect():
        at = r["a"]
        for start, prefix in r["c"]:
            assert start == at and start % (1 << (32 - prefix)) == 0
            at += 1 << (32 - prefix)
        assert at == r["b"] + 1
    got = spark.createDataFrame([("10.1.2.3/9",)], "t string").select(IP.cidr_bounds(F.col("t")).alias("b")).first()["b"]
    assert (got["lo"][-8:], got["hi"][-8:]) == ("0a000000", "0a7fffff")


def escalated(rows, find_time, max_retry, tiers):
    """The fold, row by row: (address, row, tier, seconds)."""
    out, state, last = set(), {}, max(len(tiers) - 1, 0)
    for ip, ts, rid, perm in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        n, anchor, tier = state.get(ip, (0, None, 0))
        if perm:
            out.add((ip, rid, last, None))
            state[ip] = (0, None, tier)
            continue
        n, anchor = (1, ts) if anchor is None or ts - anchor > find_time else (n + 1, anchor)
        if n >= max_retry:
            out.add((ip, rid, tier, tiers[tier] if tiers else None))
            n, anchor, tier = 0, None, min(tier + 1, last)
        state[ip] = (n, anchor, tier)
    return out


OFFENSE = "client_ip string, ts_sec long, row_id long, instant_permanent boolean"


@pytest.mark.parametrize(("block", "max_retry", "tiers"), [(1 << 14, 3, (60, None)), (4, 3, (60, 120, None)), (1, 1, (60, 70)), (7, 5, ()), (3, 2, (None, 9))])
def test_escalation_equals_fold(spark, block, max_retry, tiers):
    rng = random.Random(5)
    rows = [(f"1.1.1.{rng.randrange(4)}", rng.randrange(300), i, rng.random() < 0.05) for i in range(400)]
    rows += [("2.2.2.2", 5, 1000 + i, None) for i in range(30)] + [(None, i, 2000 + i, False) for i in range(9)] + [("", i, 3000 + i, False) for i in range(9)] + [("3.3.3.3", None, 4000 + i, i == 2) for i in range(6)]
    got = K.escalate(spark.createDataFrame(rows, OFFENSE), 20, max_retry, tiers, block).collect()
    assert {(r["client_ip"], r["row_id"], r["tier"], r["duration_s"]) for r in got} == escalated(rows, 20, max_retry, tiers)
    assert all(r["permanent"] == (r["duration_s"] is None) for r in got) and len(got) == len({r["row_id"] for r in got})


def test_escalation_of_one_busy_address(spark):
    # No stretch without offenses: every window depends on the one before. Small blocks, many rounds.
    rng = random.Random(6)
    rows, ts = [], 0
    for i in range(6000):
        ts += rng.choice([0, 1, 1, 2, 9])
        rows.append(("1.1.1.1", ts, i, rng.random() < 0.001))
    got = K.escalate(spark.createDataFrame(rows, OFFENSE), 10, 4, (60, 120, None), 50).collect()
    assert {(r["client_ip"], r["row_id"], r["tier"], r["duration_s"]) for r in got} == escalated(rows, 10, 4, (60, 120, None))
    assert K.escalate(spark.createDataFrame([], OFFENSE), 10, 4, (60,)).count() == 0


@pytest.mark.parametrize("bucket", [600, 10, 1])
def test_offense_runs_equal_sequential_model(spark, bucket):
    rng = random.Random(8)
    rows = [(f"1.1.1.{rng.randrange(5)}", rng.choice([None, *range(60)] if i % 9 == 0 else range(150))) for i in range(300)]
    want = {}
    for ip, ts in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        n, first, last = want.get(ip, (0, None, None))
        n, first = (1, ts) if ts is not None and last is not None and ts - last > 4 else (n + 1, ts if first is None else first)
        want[ip] = (n, first, ts)
    got = K.offense_counter(spark.createDataFrame(rows, "client_ip string, ts_sec long"), 4, bucket).collect()
    assert {r["client_ip"]: (r["count"], r["first_seen"], r["last_seen"]) for r in got} == want


@pytest.mark.parametrize(("clock", "bucket"), [("event", 600), ("event", 7), ("event", 1), ("none", 7)])
def test_counters_equal_sequential_model(spark, clock, bucket):
    rng = random.Random(7)
    rows = [(i, rng.randrange(120), f"9.9.9.{rng.randrange(3)}", rng.choice(["shared", "isolated"]), rng.choice(["a", "b"]), rng.choice([1, 5, 10])) for i in range(600)]
    rows += [(1000 + i, 1000 + i // 3, None, "shared", "a", 5) for i in range(900)]
    # Without a time no window expires; such rows come first, by number.
    rows += [(3000 + i * 40_000, None, f"9.9.9.{i % 2}", "isolated", rng.choice(["a", "a", "a", "b"]), 5) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, ts_sec long, client_ip string, pool string, category string, window_s int")
    got = {r["row_id"]: r["strikes"] for r in K.strike_counts(df, clock, bucket).collect()}
    state = {}
    for rid, ts, ip, pool, cat, win in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        last, was, n = state.get((ip, pool), (None, None, 0))
        n = 1 if last is None or (clock == "event" and last[0] is not None and ts - last[0] > win) or (pool == "isolated" and was != cat) else min(n + 1, 255)
        state[(ip, pool)] = ((ts,), cat, n)
        assert got[rid] == n


def test_mixed_lines(spark):
    web = '1.2.3.4 - - [x] "GET /a HTTP/1.1" 404 1 "-" "cu\x01rl"'
    lines = [web, '{"client":"1.1.1.1","uri":"/j","status":404}', '{"client":5,"client_ip":"1.1.1.1","uri":"/j"}', '{"ip":"1.1.1.1","uri":7,"path":"/p"}', 'h sshd[7]: client sent invalid protocol identifier "x"', "h sshd[7]: Connection from 9.9.9.9 port 1", "h sshd[8]: Failed password for root from 8.8.8.8 port 1", "noise", None]
    rows = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "row_id long, ts_sec long, line string")
    got = {r["row_id"]: (r["format"], r["client_ip"], r["uri"], r["user_agent"], r["kind"], r["reason"]) for r in L.scan_mixed(rows).collect()}
    none = (None,) * 6
    assert got == {
        0: ("combined", "1.2.3.4", "/a", "cu rl", None, None), 1: ("json", "1.1.1.1", "/j", "", None, None), 2: none, 3: ("json", "1.1.1.1", "/", "", None, None),
        4: none, 5: ("ssh", "9.9.9.9", None, None, "scanner_probe", "invalid_protocol_identifier"), 6: ("ssh", "8.8.8.8", None, None, "auth_failure", None), 7: none, 8: none,
    }


def test_lines_are_read_once(spark):
    # A status that runs into a quote is none; many quotes without a blank are no search; lines of a process go to the pairing, but not if they are requests.
    ask = '1.2.3.4 - - [x] "GET /a HTTP/1.1" 404{}"-" "{}"'
    lines = [ask.format("", "x"), ask.format(" ", "sshd[7]: from 9.9.9.9"), "1.2.3.4" + '"a"' * 20_000, "h: Invalid user bob from 5.5.5.5", "h sshd[7]: banner line contains invalid characters", "h sshd[7]: from 6.6.6.6 x"]
    rows = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "row_id long, ts_sec long, line string")
    begun = time.monotonic()
    got = {r["row_id"]: (r["format"], r["client_ip"], r["status"], r["kind"], r["reason"]) for r in L.scan_mixed(rows).collect()}
    assert time.monotonic() - begun < 60
    none = (None,) * 5
    assert got == {0: none, 1: ("combined", "1.2.3.4", 404, None, None), 2: none, 3: ("ssh", "5.5.5.5", None, "auth_failure", None), 4: none, 5: ("ssh", "6.6.6.6", None, "scanner_probe", "banner_invalid_format")}
    alone = {r["row_id"]: r["kind"] for r in L.scan_mixed(rows.drop("ts_sec")).collect()}
    assert alone == {0: None, 1: None, 2: None, 3: "auth_failure", 4: None, 5: None}


def test_durations_and_formats(spark):
    texts = ["15m", "24h", " 7d ", "PERMANENT", "", "5x", "m", "+3s", "-3s", "99999999999999999999d", "1.5h"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(C.parsed_duration(F.col("t"))).collect()]
    assert got == [(900, None), (86400, None), (604800, None), (None, None), (None, "empty"), (None, "unknown unit"), (None, "bad number"), (3, None), (None, "bad number"), (None, "bad number"), (None, "bad number")]
    bodies = [L.COMBINED, L.EDGE, '{"a":"$host"}', "$remote_addr $status", L.COMBINED + " $host", '$http_cf_connecting_ip $remote_user "$request" $status']
    assert column(spark, bodies, L.format_kind) == ["combined", "edge", "json", "custom", "custom", "edge"]
    assert column(spark, ["Mozilla SemrushBot", "python-requests/2", "masscan-ng", "curly", "xJAVA/1"], C.agent_category) == column(spark, ["semrush", "python", "masscan", "curl", "java"], C.agent_category)


def test_lists_and_shared_slot(spark):
    schema = "row_id long, ts_sec long, client_ip string, method string, uri string, status int, referer string, user_agent string"
    web = [(i, i, ip, "GET", "/x.sql", 404, "-", "Mozilla Firefox") for i, ip in enumerate(["1.1.1.1", "2.2.2.2", "3.3.3.3", "10.0.0.1"] * 5)]
    lists = VD.Policies(whitelist=spark.createDataFrame([("1.1.1.1",)], "client_ip string"), banned=spark.createDataFrame([("2.2.2.2",), ("1.1.1.1",), ("10.0.0.1",)], "client_ip string"))
    got = VD.evaluate_requests(spark.createDataFrame(web, schema), lists).collect()
    assert {(r["client_ip"], r["action"]) for r in got} == {("1.1.1.1", "allow"), ("2.2.2.2", "drop_banned"), ("3.3.3.3", "allow"), ("3.3.3.3", "ban"), ("10.0.0.1", "allow")}
    # One isolated slot an address: an ssh failure between two web strikes of another category restarts both.
    ssh = spark.createDataFrame([(100 + i, ts, "3.3.3.3", "auth_failure", None) for i, ts in enumerate([3, 30, 31, 32, 33, 34])], "row_id long, ts_sec long, client_ip string, kind string, reason string")
    both = VD.evaluate_all(spark.createDataFrame([w for w in web if w[2] == "3.3.3.3"], schema), ssh).collect()
    state, was = 0, None
    for r in sorted(both, key=lambda r: (r["ts_sec"], r["row_id"])):
        state = state + 1 if was == r["stream"] else 1
        was = r["stream"]
        assert r["strikes"] == state and r["action"] == ("ban" if state >= 5 else "allow")


def test_empty_table(spark):
    rows = spark.createDataFrame([], "row_id long, ts_sec long, client_ip string, method string, uri string, status int, referer string, user_agent string")
    assert VD.evaluate_requests(rows).count() == 0


def test_tokens_by_pieces_and_nested_networks(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcA é") for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(300)] + [None, "", "İx"]
    tokens = ["".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 2, 3, 4, 6]))) for _ in range(40)] + ["zz", None]
    tokens = [t for t in tokens if t not in ("a", "b", "c")]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, user_agent string")
    for some in (tokens, ["b"], ["zzz"], []):
        got = J.blocklist_match(rows, spark.createDataFrame([(t,) for t in some], "token string"))
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
        want = {i: min((k for k in some if k and t is not None and k in t.lower()), default=None) for i, t in enumerate(texts)}
        assert {r["i"]: r["token"] for r in got.collect()} == want
    # Networks of both families, nested, equal, touching, one holding everything.
    bans = [("0.0.0.0/1", "a"), ("128.0.0.0/1", "b"), ("9.0.0.0/8", "c"), ("9.1.0.0/16", "A"), ("9.1.2.3/32", "d"), ("9.1.2.0/24", "e"), ("9.1.2.255/25", "f"), ("2001:db8::/32", "g"), ("2001:db8::/32", "h"), ("2001:db8:0:1::/64", "B"), ("4000::/2", "i"), ("bad", "z")]
    asked = ["9.1.2.3", "9.1.2.127", "9.1.2.128", "9.1.2.255", "9.1.3.0", "9.255.255.255", "10.0.0.0", "127.255.255.255", "128.0.0.0", "255.255.255.255", "0.0.0.0", "2001:db8::1", "2001:db8:0:1:ffff:ffff:ffff:ffff", "2001:db8:0:2::", "2001:db9::", "7fff::1", "8000::", "nonsense", None]
    frame = spark.createDataFrame([(*b, None) for b in bans], "target string, reason string, expires_at long")
    got = {r["target"]: (r["match"], r["ban_target"], r["reason"]) for r in J.check_targets(spark.createDataFrame([(a,) for a in asked], "target string"), frame, 0).collect()}
    nets = [(ipaddress.ip_network(t, strict=False), t, r) for t, r in bans if "/" in t]
    for a in asked:
        try:
            over = sorted((t, r) for n, t, r in nets if ipaddress.ip_address(a) in n)
        except ValueError:
            over = []
        assert got[a] == (("Subnet", *over[0]) if over else (None, None, None))


def test_many_tokens_of_the_same_pieces_are_not_sent_to_all_tasks(spark):
    texts = [f"Agent{i % 97} REF{i % 40}" for i in range(400)]
    tokens = [f"ref{i}" for i in range(3000)] + [f"nt{i}" for i in range(0, 90, 7)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, user_agent string")
    got = J.blocklist_match(rows, spark.createDataFrame([(t,) for t in tokens], "token string"), small=0)
    want = {i: min((k for k in tokens if k in t.lower()), default=None) for i, t in enumerate(texts)}
    assert {r["i"]: r["token"] for r in got.collect()} == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_json_lines_are_whole_and_typed(spark):
    lines = [
        '{"ip":"1.1.1.1","uri":"/a"}', '{"ip":"1.1.1.1"} trailing', '{"ip":"1.1.1.1"},{"a":1}', '{"ip":"1.1.1.1","ip":"2.2.2.2"}', '{"client":7,"ip":"1.1.1.1"}', '{"client":null,"ip":"1.1.1.1","status":70000}',
        '{"ip":"1.1.1.1","uri":"\\u002fa"}', '{"ip":"1.1.1.1","uri":"/a","x":"q\\n"}', '{"ip":"1.1.1.1","status":"+404","note":{"client":5}}', '\t{"ip":"1.1.1.1","status":-3,"host":"\\"client\\": 5"} ', '{"ip":"1.1.1.1","status":"70000"}', "{", None, "[1]",
    ]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r["i"]: (r["parse_ok"], r["uri"], r["status"]) for r in L.parse_json(rows).collect()}
    assert [i for i in got if got[i][0]] == [0, 5, 7, 8, 10] and got[0][1] == "/a" and [got[i][2] for i in (5, 8, 10)] == [4464, 404, 200]
    got = {r["i"]: (r["parse_ok"], r["uri"], r["status"]) for r in L.parse_json(rows, replay=True).collect()}
    assert [i for i in got if got[i][0]] == [0, 6, 7, 8, 9, 10] and got[6][1] == "/a" and got[9][2] == 200


def test_error_reasons_of_every_level(spark):
    tail = ", client: 1.2.3.4, server: x"
    lines = {
        "t [error] 1#0: *5 open() failed (2: No such file)" + tail: "open() failed (2: No such file)", "t [crit] 1#0: *5 SSL failed" + tail: "SSL failed", "t [warn] 1#0: no marker" + tail: "t [warn] 1#0: no marker",
        "plain text" + tail: "plain text", "[error] no colon" + tail: "[error] no colon", "x, client: 1.2.3.4 [error] a: b": "x", "x, client: nobody, y": None, "no client": None,
    }
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r["line"]: r["reason"] for r in L.parse_error_log(rows).collect()} == lines


def test_each_file_by_its_format(spark):
    lines = [
        ("a", '1.1.1.1 - - [t] "GET /a HTTP/1.1" 404 1 "r" "u"'), ("b", 'h 2.2.2.2 $ "POST /b HTTP/1.1" 500'), ("c", '{"ip":"3.3.3.3","path":"/c"}'), ("d", '9.9.9.9 - - [t] "GET /d HTTP/1.1" 200 1 "-" "u" "4.4.4.4"'),
        ("e", '5.5.5.5 - - [t] "GET /e HTTP/1.1" 200 1 "-" "u"'), ("b", "does not fit"), ("f", "GET/f 6.6.6.6"),
    ]
    catalog = [("a", L.COMBINED), ("b", '${host} $remote_addr $$ "$request" $status'), ("c", '{"ip":"$remote_addr","path":"$uri"}'), ("d", L.EDGE), ("f", "$request_method/$uri $remote_addr"), ("unused", "$x")]
    rows = spark.createDataFrame([(i, f, x) for i, (f, x) in enumerate(lines)], "i int, src_file string, line string")
    got = L.parse_by_file(rows, spark.createDataFrame(catalog, "path string, format string")).orderBy("i").collect()
    assert [(r["parse_ok"], r["client_ip"], r["method"], r["uri"], r["status"]) for r in got] == [
        (True, "1.1.1.1", "GET", "/a", 404), (True, "2.2.2.2", "POST", "/b", 500), (True, "3.3.3.3", "GET", "/c", 200), (True, "4.4.4.4", "GET", "/d", 200), (True, "5.5.5.5", "GET", "/e", 200),
        (False, None, "GET", "/", 200), (True, "6.6.6.6", "GET", "f", 200),
    ]
    assert got[1]["host"] == "h"


KNOWN = {
    "^/api/.*": "/api/x", r"\d+": "a٣", r"^/v\d{1,2}/(?P<name>\w+)$": "/v12/é", "(?i)ADMIN": "/admin", r"a.b": "a\rb", "[[:alpha:]_-]+$": "12x-", "[]a]+$": "]a", r"[^\]]$": "x", r"\x{2f}q\u{71}": "/qq", "a|": "zz",
    r"\p{Greek}\p{Lu}": "αΒ", "(?:x|y){2,3}?z": "xyz", "(?m)^b$": "a\nb\nc", "x{2}": "xx", r"\v": "\x0b", "a&b": "a&b", r"[\d.]+\.php": "1.2.php",
}
WRONG = {
    "a(?=b)": "look-around or unknown group", "(?<!a)b": "look-around or unknown group", r"(a)\1": "backreference", r"\Qa\E": "unknown escape", "a++": "repeated repetition", "*a": "nothing to repeat", "(a": "unclosed group", "a)": "unopened group",
    "[a": "unclosed class", "[z-a]": "bad range", "a{3,2}": "bad repetition", "a{": "bad repetition", "(?x) a": "flag", r"\p{Nope}": "unknown property", "[[:nope:]]": "unknown class", r"\Z": "unknown escape", "\\": "unknown escape", "[a&&b]": "set operation", "(?>a)": "look-around or unknown group",
}


def test_patterns_are_translated_or_refused(spark):
    for p, text in KNOWN.items():
        if text is not None:
            assert spark.createDataFrame([(text,)], "u string").select(C.allowed_endpoint(F.col("u"), ("never", p))).first()[0], p
    texts = spark.createDataFrame([("ab\n",)], "u string")
    assert not texts.select(C.allowed_endpoint(F.col("u"), ("b$",))).first()[0]
    got = {r["pattern"]: r["reason"] for r in PT.translated(spark.createDataFrame([(p,) for p in WRONG], "pattern string")).collect()}
    assert got == WRONG
    with pytest.raises(ValueError, match="look-around"):
        C.allowed_endpoint(F.col("u"), ("ok", "a(?=b)"))


def test_networks_go_along_with_verdicts(spark):
    from logshield.plans.queries import c13_asn_exposure

    plan = c13_asn_exposure(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "event_id" not in plan and "user_id" not in plan
