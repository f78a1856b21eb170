"""Streams against the batch operators over the same rows."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from logshield.operators import bans as B
from logshield.operators import verdicts as VD
from logshield.sources import logs as L
from logshield.operators import counters as K
from logshield.streaming import escalation as E
from logshield.streaming import live as S

P = VD.Policies(allowed_endpoints=("^/api/.*",))
REQUEST = "row_id long, ts_sec long, client_ip string, method string, uri string, status int, referer string, user_agent string"


def requests(n=600, seed=1):
    rng = random.Random(seed)
    paths = ["/wp-login.php", "/.git/config", "/x.php", "/page/1", "/tool.py", "/backup.sql", "/api/x", "/.env", "/wp-admin/a"]
    agents = ["Mozilla/5.0 Firefox/115.0", "curl/8.5.0", "sqlmap/1.7"]
    ips = ["21.3.4.5"] * 4 + [f"22.1.1.{i}" for i in range(6)] + ["10.0.0.1"]
    return [(i, 1704067200 + i // 4, rng.choice(ips), "GET", rng.choice(paths), rng.choice([200, 404, 404, 403]), "-", rng.choice(agents + agents[:1] * 6)) for i in range(n)]


def key(rows):
    return sorted((r["row_id"], r["client_ip"], r["action"], r["reason"], r["permanent"], r["strikes"]) for r in rows)


@pytest.fixture()
def folder(tmp_path):
    def made(name):
        path = tmp_path / f"{name}-{uuid.uuid4().hex[:6]}"
        if name == "in":
            path.mkdir()
        return str(path)

    return made


def land(spark, rows, schema, to, parts):
    """Files in an order of their own; the last row lets the watermark pass all others."""
    for part in parts:
        spark.createDataFrame([r for r in rows if part(r[0])], schema).coalesce(1).write.mode("append").parquet(to)


FLUSH = (10**6, 1704067200 + 10**5, "10.0.0.1", "GET", "/", 200, "-", "x")


def test_verdicts_equal_batch_and_go_on_after_a_restart(spark, folder):
    rows = requests()
    src, out, mark = folder("in"), folder("out"), folder("mark")
    stream = S.timed(spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(src), "60 seconds")
    got = S.stream_verdicts(stream, P)
    # Within a file rows come in any order, and files overlap by half a minute.
    random.Random(2).shuffle(rows)
    land(spark, rows, REQUEST, src, [lambda i: i < 150 or 200 <= i < 250, lambda i: 150 <= i < 200 or 250 <= i < 350])
    S.to_parquet(got, out, mark).awaitTermination()
    land(spark, [*rows, FLUSH], REQUEST, src, [lambda i: 350 <= i < 600, lambda i: i == FLUSH[0]])
    q = S.to_parquet(got, out, mark)
    q.awaitTermination()
    assert S.late_rows(q) == 0
    want = VD.evaluate_requests(spark.createDataFrame([*rows, FLUSH], REQUEST), P)
    have = spark.read.parquet(out)
    assert sorted(have.columns) == sorted(want.columns)
    assert key(have.collect()) == key(want.collect())
    assert any(r["strikes"] and r["strikes"] > 1 for r in have.collect())


def test_late_strikes_are_counted_and_equal_rows_taken_once(spark, folder):
    rows = requests(200, 3)
    src, out, mark = folder("in"), folder("out"), folder("mark")
    late = (9000, 1704067200, "21.3.4.5", "GET", "/x.php", 404, "-", "Mozilla/5.0 Firefox/115.0")
    land(spark, [*rows, FLUSH], REQUEST, src, [lambda i: i < 200])
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(src)
    S.to_parquet(S.stream_verdicts(S.timed(stream, "10 seconds"), P), out, mark).awaitTermination()
    spark.createDataFrame([late], REQUEST).coalesce(1).write.mode("append").parquet(src)
    q = S.to_parquet(S.stream_verdicts(S.timed(stream, "10 seconds"), P), out, mark)
    q.awaitTermination()
    assert S.late_rows(q) == 1
    assert 9000 not in {r["row_id"] for r in spark.read.parquet(out).collect()}
    again, out2 = folder("in"), folder("out")
    land(spark, [*rows, FLUSH], REQUEST, again, [lambda i: i < 200, lambda i: i < 200, lambda i: i == FLUSH[0]])
    stream = spark.readStream.schema(REQUEST).parquet(again)
    S.to_parquet(S.stream_verdicts(S.timed(stream, "1 hour", ("row_id",)), P), out2, folder("mark")).awaitTermination()
    assert spark.read.parquet(out2).groupBy("row_id").count().where("count > 1").count() == 0


def test_ssh_equals_batch(spark, folder):
    rng = random.Random(4)
    said = ["Failed password for root from {} port 22 ssh2", "Did not receive identification string from {} port 22", 'error: kex: client sent invalid protocol identifier "GET"', "Connection closed: Connection from {} port 22"]
    rows = [(i, 1704067200 + i // 3, f"h{i % 2}", f"host {'sshd[%d]: ' % rng.randrange(5) if i % 7 else ''}" + rng.choice(said).format(f"23.1.1.{rng.randrange(3)}")) for i in range(300)]
    schema = "row_id long, ts_sec long, src_file string, line string"
    src, out = folder("in"), folder("out")
    flush = [(10**6 + k, 1704067200 + 10**5 * (k + 1), "h", "quiet") for k in range(2)]
    mark = folder("mark")
    for parts in ([lambda i: i < 120, lambda i: 120 <= i < 300, lambda i: i == 10**6], [lambda i: i == 10**6 + 1]):
        land(spark, [*rows, *flush], schema, src, parts)
        stream = S.timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "5 seconds")
        # What the pairing releases is counted when the watermark moves again.
        S.to_parquet(S.stream_ssh(stream), out, mark).awaitTermination()
    table = spark.createDataFrame(rows, schema)
    want = VD.evaluate_ssh(L.parse_auth_log_stateful(table).select("row_id", "ts_sec", "client_ip", "kind", "reason"))
    have = spark.read.parquet(out).where("row_id < 1000000")
    assert key(have.collect()) == key(want.collect())
    assert {"probe:ssh:invalid_protocol_identifier"} <= {r["reason"] for r in have.collect()}


def test_ledger_sync_and_sweep(spark, folder):
    src, ledger, out, told = folder("in"), folder("ledger"), folder("waf"), []
    schema = "row_id long, ts_sec long, client_ip string, action string, reason string, permanent boolean"
    rows = [(1, 100, "1.1.1.1", "ban", "a", False), (2, 200, "1.1.1.1", "ban", "b", False), (3, 150, "2.2.2.2", "ban", "c", True), (4, 160, "3.3.3.3", "allow", None, None), (5, 90, "1.1.1.1", "ban", "old", False)]
    land(spark, rows, schema, src, [lambda i: i < 4, lambda i: i >= 4])
    verdicts = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    S.stream_bans(verdicts, ledger, folder("mark"), 50, told=lambda b: told.append(b.count())).awaitTermination()
    bans = S.ledger_bans(spark, ledger)
    assert sorted(tuple(r) for r in bans.select("target", "banned_at", "expires_at", "reason").collect()) == [("1.1.1.1", 200, 250, "b"), ("2.2.2.2", 150, None, "c")]
    assert sorted(told) == [1, 2]
    S.stream_waf_sync(verdicts, ledger, out, folder("mark"), lambda b: b.agg(F.count("*").alias("n")), once=True).awaitTermination()
    assert {r["n"] for r in spark.read.parquet(out).collect()} == {2}
    new = folder("ledger")
    assert tuple(S.sweep(spark, ledger, new, 300).first()) == (1, 1)
    assert [r["target"] for r in S.ledger_bans(spark, new).collect()] == ["2.2.2.2"]
    assert B.active_bans(bans, 240).count() == 2


def test_landed_lines(spark, folder):
    src, out = folder("in"), folder("out")
    lines = [f'21.0.0.1 - - [01/Jan/2024:00:00:0{i} +0000] "GET /.env HTTP/1.1" 404 1 "-" "x"' for i in range(5)] + ["garbage"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(src)
    S.to_parquet(S.stream_access_logs(spark, src).select("client_ip", "uri", "ts_sec"), out, folder("mark")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("21.0.0.1", "/.env", 1704067200 + i) for i in range(5)]
    assert S.stream_auth_logs(spark, src).isStreaming


def ran(spark, rows, schema, src, out, judged, folder, parts, delay="60 seconds"):
    """Rows landed part by part, each part in a run of its own; what came out."""
    mark = folder("mark")
    for part in parts:
        random.Random(3).shuffle(part)
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(src)
        stream = S.timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), delay)
        S.to_parquet(judged(stream), out, mark).awaitTermination()
    return spark.read.parquet(out)


def test_busy_address_and_rows_without_a_time(spark, folder):
    rng = random.Random(5)
    paths = ["/x.php", "/tool.py", "/wp-admin/a", "/backup.sql"]
    # Half of the strikes are of one address: hundreds a span, so that counters end at 255.
    rows = [(i, 1704067200 + i // 90, "21.3.4.5" if i % 2 else f"22.1.1.{i % 9}", "GET", paths[0] if i % 2 and i < 3500 else rng.choice(paths), 404, "-", "Mozilla/5.0 Firefox/115.0") for i in range(4000)]
    lost = [(9000 + i, None, "21.3.4.5", "GET", "/x.php", 404, "-", "Mozilla/5.0 Firefox/115.0") for i in range(3)]
    got = ran(spark, rows, REQUEST, folder("in"), folder("out"), lambda s: S.stream_verdicts(s, P), folder, [rows[:1900], rows[1900:] + lost, [FLUSH]]).collect()
    want = VD.evaluate_requests(spark.createDataFrame([*rows, FLUSH], REQUEST), P)
    assert key(r for r in got if not 9000 <= r["row_id"] < 9003) == key(want.collect())
    assert max(r["strikes"] or 0 for r in got) == 255
    assert [r["strikes"] for r in got if 9000 <= r["row_id"] < 9003] == [1, 1, 1]


def test_offenses_and_escalation_equal_batch(spark, folder):
    rng = random.Random(6)
    schema = "row_id long, ts_sec long, client_ip string, instant_permanent boolean"
    rows = [(i, 1704067200 + i // 7, rng.choice(["1.1.1.1"] * 4 + [f"2.2.2.{i % 5}"]), rng.random() < 0.02) for i in range(900)]
    end = [(10**6, 1704067200 + 10**5, "9.9.9.9", False)]
    parts = lambda: [rows[:400], rows[400:], list(end)]
    frame = spark.createDataFrame(rows, schema)
    got = ran(spark, rows, schema, folder("in"), folder("out"), lambda s: E.stream_escalate(s, 10, 3, (60, 120, None)), folder, parts())
    told = lambda df: sorted((r["client_ip"], r["row_id"], r["tier"], r["duration_s"], r["permanent"]) for r in df.collect())
    assert told(got) == told(K.escalate(frame, 10, 3, (60, 120, None)))
    got = ran(spark, rows, schema, folder("in"), folder("out"), lambda s: E.stream_offenses(s, 2, max_age=1000), folder, parts())
    pruned = {r["client_ip"]: (r["count"], r["first_seen"], r["last_seen"]) for r in got.where("pruned").collect()}
    assert pruned == {r["client_ip"]: (r["count"], r["first_seen"], r["last_seen"]) for r in K.offense_counter(frame, 2).collect()}


def test_bans_end_by_themselves(spark, folder):
    schema = "target string, tier_level int, banned_at long, expires_at long, reason string, row_id long, ts_sec long"
    ban = lambda t, at, end, r: (t, 1, at, end, r, at, at)
    rows = [ban("e", 10, 5, "over before"), ban("a", 100, 200, "first"), ban("a", 150, 400, "longer"), ban("b", 100, 180, "x"), ban("b", 300, None, "for good"), ban("c", 120, 500, "y"), ban("d", 130, 390, "z")]
    out = folder("out")
    got = ran(spark, rows, schema, folder("in"), out, E.stream_expiry, folder, [rows[:4], rows[4:], [ban("q", 460, 470, "last")]], "60 seconds")
    events = sorted((r["target"], r["event"], r["at"]) for r in got.where("target <> 'q'").collect())
    assert events == [("a", "banned", 100), ("a", "banned", 150), ("a", "lifted", 400), ("b", "banned", 100), ("b", "banned", 300), ("b", "lifted", 180), ("c", "banned", 120), ("d", "banned", 130), ("d", "lifted", 390), ("e", "banned", 10), ("e", "lifted", 5)]
    assert {(r["target"], r["reason"]) for r in E.standing(got).where("target <> 'q'").collect()} >= {("b", "for good"), ("c", "y")}


def test_what_stood_at_a_moment(spark):
    schema = "target string, event string, at long, tier_level int, banned_at long, expires_at long, reason string, row_id long"
    ban = lambda t, at, end, i: [(t, "banned", at, 0, at, end, "r", i), *([(t, "lifted", end, 0, at, end, "r", i)] if end else [])]
    # Lifted since the moment; over before it began; replaced within its second.
    rows = ban("a", 100, 400, 1) + ban("b", 300, 50, 2) + ban("c", 100, 50, 3) + ban("c", 100, None, 4) + ban("d", 100, 150, 5)
    events = spark.createDataFrame(rows, schema)
    assert {r["target"] for r in E.standing(events, 200).collect()} == {"a", "c"}
    assert {r["target"] for r in E.standing(events).collect()} == {"c"}


def test_recent_bans_equal_the_whole_ledger(spark, folder):
    schema = "target string, tier_level int, banned_at long, expires_at long, reason string"
    rng, src, ledger, tops, out = random.Random(7), folder("in"), folder("ledger"), folder("tops"), folder("waf")
    moments, ledgers = iter([100, 200, 300, 10_000]), []
    for k in range(4):
        rows = [(f"1.1.{rng.randrange(3)}.{rng.randrange(40)}", 0, 100 * k + rng.randrange(90), rng.choice([None, 100 * k + rng.randrange(400)]) if k < 3 else 9000, "r") for _ in range(60)]
        spark.createDataFrame([*rows, ("::1", 0, 1, None, "six")], schema).coalesce(1).write.mode("append").parquet(src)
        now = next(moments)
        told = lambda bans: bans.orderBy(F.desc("banned_at"), F.desc("target")).limit(5).select("target", "banned_at")
        stream = spark.readStream.schema(schema).parquet(src)
        S.stream_recent_waf(stream, ledger, tops, out, folder_once(folder), told, lambda now=now: now, 5).awaitTermination()
        whole = B.active_bans(S.ledger_bans(spark, ledger), now).where("target LIKE '%.%'")
        want = [tuple(r) for r in whole.orderBy(F.desc("banned_at"), F.desc("target")).limit(5).select("target", "banned_at").collect()]
        got = [tuple(r) for r in spark.read.parquet(f"{out}/batch={k}").orderBy(F.desc("banned_at"), F.desc("target")).collect()]
        assert got == want and want
        ledgers.append(spark.read.parquet(f"{tops}/batch={k}").count())
    assert max(ledgers) <= 21


_MARK = {}


def folder_once(folder):
    """One checkpoint for all runs of a test."""
    return _MARK.setdefault("mark", folder("mark"))
