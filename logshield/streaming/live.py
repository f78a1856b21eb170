"""The cascade over streams, in event time.

A file source takes rolled files that land in a folder; it does not follow one that grows. Rows
are settled by the same columns as in batch. Strikes wait until the watermark passes them, and are
counted in the order of (ts_sec, row_id), whatever the order in which files arrive: the result is
that of the batch operators over the same rows. Strikes that come after the watermark are dropped and
counted by Spark (see late_rows). The state of an address goes when none of its pools was hit for
IDLE seconds.

Addresses are dealt to KEYS keys by hash, and the rows of a key are handled as one table, so that the
costs of a key in Python are not those of an address. What arrives waits in parts as it came, one
value a part. Strikes wait for each span of SPAN seconds of a key, which is read once, when the
watermark has passed the span: a busy address is many keys, and no list of it is read or written again
and again. A span counts its strikes by itself; what depends on the spans before (254 rows of a pool
at most, as counters end at 255) and a summary go on to the state that follows the addresses.

Streams need ts_sec (seconds since 1970) and row_id, the order within a second. A strike without a
time stands alone: it is counted as the first of its pool."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from logshield.functions.ip import ip_v4
from logshield.operators import verdicts as VD
from logshield.operators.bans import BAN_SECONDS, COLUMNS, active_bans, build_bans
from logshield.sources import logs as L
from logshield.sources.policies import latest

#: Seconds without a strike after which an address is forgotten; seconds of a span; how late a row may come.
IDLE, SPAN, DELAY = 600, 10, "10 seconds"
#: Largest count of a counter; keys of a state, to which addresses are dealt by hash.
MOST, KEYS = 255, 32
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STRIKE = "client_ip string, row_id long, ts_sec long, event_ts timestamp, uri string, pool string, told string, category string, threshold int, window_s int"
_WAITING = "client_ip string, row_id long, ts_sec long, uri string, pool string, told string, category string, threshold int, window_s int"
_COUNTED = "client_ip string, part int, kind string, row_id long, ts_sec long, event_ts timestamp, uri string, pool string, told string, category string, threshold int, window_s int, n int"
_NAMES = lambda schema: [c.split()[0] for c in schema.split(", ")]


def stream_lines(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """(line, src_file) of text files as they land; the checkpoint remembers which were read."""
    rows = spark.readStream.format("text").option("maxFilesPerTrigger", files).option("latestFirst", "false").load(folder)
    return rows.where("is_valid_utf8(value)").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("src_file"))


def time_local(line: Column) -> Column:
    """Seconds of the `[01/Jan/2024:00:00:00 +0000]` of an access line; null without one."""
    stamp = F.regexp_extract(line, r"\[(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\]", 1)
    return F.try_to_timestamp(stamp, F.lit("dd/MMM/yyyy:HH:mm:ss Z")).cast("long")


def stream_access_logs(spark: SparkSession, folder: str, log_format: str = L.COMBINED, files: int = 1000) -> DataFrame:
    """Parsed access lines as they land, malformed ones left out; ts_sec from the line, null if its
    stamp does not parse."""
    rows = stream_lines(spark, folder, files)
    got = L.parse_combined(rows) if log_format == L.COMBINED else L.parse_format(rows, log_format)
    return got.where("parse_ok").withColumn("ts_sec", time_local(F.col("line")))


def stream_auth_logs(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    return stream_lines(spark, folder, files)


def timed(rows: DataFrame, delay: str = DELAY, once_by: tuple[str, ...] = ()) -> DataFrame:
    """rows with event_ts and its watermark; of rows equal in `once_by` within the delay one stays,
    for sources that send files twice."""
    rows = rows.withColumn("event_ts", F.timestamp_seconds("ts_sec")).withWatermark("event_ts", delay)
    return rows.dropDuplicatesWithinWatermark(list(once_by)) if once_by else rows


def dealt(*columns: str, keys: int = KEYS) -> Column:
    """The key of a state that these values belong to."""
    return F.pmod(F.xxhash64(*columns), F.lit(keys)).cast("int")


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    """A table as one value of a state."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as to:
        to.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return (sink.getvalue().to_pybytes(),)


def _unpacked(parts, schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(p[0]).read_all() for p in parts]
    return pa.concat_tables(tables or [schema.empty_table()]).to_pandas(types_mapper=_KINDS.get)


#: Whole numbers and flags that may be null stay what they are.
_KINDS = {pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype()}


def arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


class Gate(StatefulProcessor):
    """Rows of a span of seconds, the last part of the key, wait until the watermark has passed the
    span; then `released` gets them, once, as one table in the order of (ts_sec, row_id)."""

    waiting: str

    def __init__(self, span: int):
        self.span = span

    def init(self, handle) -> None:
        self.handle, self.schema = handle, arrow(self.waiting)
        self.parts = handle.getListState("parts", "rows binary")

    def released(self, key: tuple, rows: pd.DataFrame, at: pd.Timestamp) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for pdf in rows:
            self.parts.appendValue(_packed(pdf[self.schema.names], self.schema))
        self.handle.registerTimer((int(key[-1]) + 1) * self.span * 1000 - 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        rows = _unpacked(self.parts.get(), self.schema).sort_values(["ts_sec", "row_id"], ignore_index=True)
        self.parts.clear()
        # Spark wants the event time of what is released to be after the watermark; ts_sec keeps the order.
        out = self.released(key, rows, pd.Timestamp(timerValues.getCurrentWatermarkInMs() + 1, unit="ms"))
        if len(out):
            yield out

    def close(self) -> None:
        pass


class Ordered(StatefulProcessor):
    """Rows wait until the watermark has come to them; then `step` gets those of a key as one table in
    the order of (ts_sec, row_id), with the table that is kept of the key, and returns what is to be kept
    and what is let out. `ends` tells the next second at which `step` is asked again without rows."""

    waiting: str
    kept: str

    def init(self, handle) -> None:
        self.handle, self.schema, self.kind = handle, arrow(self.waiting), arrow(self.kept)
        self.parts = handle.getListState("parts", "rows binary")
        self.state = handle.getValueState("state", "rows binary")

    def step(self, kept: pd.DataFrame, rows: pd.DataFrame, mark: int) -> tuple[pd.DataFrame, pd.DataFrame | None]:
        raise NotImplementedError

    def ends(self, kept: pd.DataFrame) -> float | None:
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        first = []
        for pdf in rows:
            self.parts.appendValue(_packed(pdf[self.schema.names], self.schema))
            first.append(int(pdf["ts_sec"].min()))
        if first:
            # A timer fires when the watermark is past it; a row is due when the watermark has come to it.
            ms, timers = min(first) * 1000 - 1, list(self.handle.listTimers())
            if not timers or ms < min(timers):
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs()
        rows = _unpacked(self.parts.get(), self.schema)
        late = rows["ts_sec"] * 1000 > mark
        rest, due = rows[late], rows[~late].sort_values(["ts_sec", "row_id"], ignore_index=True)
        if len(due):
            if len(rest):
                self.parts.put([_packed(rest, self.schema)])
            else:
                self.parts.clear()
        kept = _unpacked([self.state.get()] if self.state.exists() else [], self.kind)
        kept, out = self.step(kept, due, mark)
        if len(kept):
            self.state.update(_packed(kept, self.kind))
        else:
            self.state.clear()
        end = self.ends(kept) if len(kept) else None
        again = [*([rest["ts_sec"].min()] if len(rest) else []), *([] if end is None or pd.isna(end) else [end])]
        if again:
            self.handle.registerTimer(int(min(again)) * 1000 - 1)
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


def runs(rows: pd.DataFrame, by: list[str], fresh) -> pd.Series:
    """For rows in order, the number of their run in its group; a `fresh` row begins the next."""
    return fresh.astype("int64").groupby([rows[c] for c in by], sort=False, dropna=False).cumsum()


class SpanStrikes(Gate):
    """The strikes of a span, counted from its beginning. `done` rows have their count; `lead` rows
    are of the first run of their pool, so that what came before the span adds to them; a `span` row a
    pool tells where the span ends (n of its last run), `cut` if that run began within it."""

    waiting = _WAITING

    def __init__(self, span: int, never: bool = False):
        super().__init__(span)
        self.never = never

    def released(self, key, rows, at) -> pd.DataFrame:
        by = ["client_ip", "pool"]
        before = rows.groupby(by, sort=False, dropna=False)[["ts_sec", "category"]].shift()
        other = (rows["pool"] == "isolated") & before["ts_sec"].notna() & (rows["category"].fillna("\0") != before["category"].fillna("\0"))
        gone = False if self.never else (rows["ts_sec"] - before["ts_sec"] > rows["window_s"]).fillna(False).astype(bool)
        run = runs(rows, by, other | gone)
        n = (rows.groupby([rows["client_ip"], rows["pool"], run], sort=False, dropna=False).cumcount() + 1).clip(upper=MOST)
        rows = rows.assign(n=n, event_ts=at)
        lead = (run == 0) & (n < MOST)
        last = rows.assign(kind=(run > 0).map({True: "cut", False: "span"})).drop_duplicates(by, keep="last")
        rows = rows.assign(kind=lead.map({True: "lead", False: "done"}), part=(KEYS + rows["row_id"] % KEYS).mask(lead, key[0]))
        last = last.assign(part=key[0], row_id=pd.NA, uri=None, told=None, threshold=pd.NA, window_s=pd.NA)
        return pd.concat([rows, last])[_NAMES(_COUNTED)]
class StrikeChain(StatefulProcessor):
    """What spans leave to the addresses of a key: per pool the last strike's second, its category and the
    count. All spans that the watermark has passed come in one batch, so that those of a batch, in
    their order, follow those of the batches before."""

    kept = arrow("client_ip string, pool string, last long, category string, n long")

    def __init__(self, every: int, never: bool = False, idle: int = IDLE):
        self.every, self.never, self.idle = every, never, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "rows binary")

    def read(self) -> pd.DataFrame:
        return _unpacked([self.state.get()] if self.state.exists() else [], self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        names, chained = ["client_ip", "row_id", "ts_sec", "uri", "pool", "told", "threshold", "strikes"], []
        for pdf in rows:
            done = pdf["kind"] == "done"
            if done.any():
                yield pdf[done].rename(columns={"n": "strikes"})[names]
            if not done.all():
                chained.append(pdf[~done])
        if not chained:
            return
        # A span's rows in order, its summaries behind them.
        some = pd.concat(chained)
        some = some.assign(last=some["kind"] != "lead", place=some["ts_sec"] // self.every).sort_values(["place", "last", "ts_sec", "row_id"], ignore_index=True)
        some["category"] = some["category"].astype(object).where(some["category"].notna(), None)
        kept = self.read()
        state = {(ip, pool): (last, was, n) for ip, pool, last, was, n in zip(*(kept[c] for c in kept.columns))}
        strikes, carry = [0] * len(some), {}
        for i, (ip, pool, kind, ts, category, window, n) in enumerate(zip(*(some[c] for c in ("client_ip", "pool", "kind", "ts_sec", "category", "window_s", "n")))):
            of = (ip, pool)
            if kind == "lead":
                if of not in carry:
                    last, was, before = state.get(of, (None, None, 0))
                    fresh = last is None or (not self.never and ts - last > window) or (pool == "isolated" and category != was)
                    carry[of] = 0 if fresh else before
                strikes[i] = min(n + carry[of], MOST)
            else:
                state[of] = (ts, category, n if kind == "cut" else min(n + carry.get(of, 0), MOST))
                carry.pop(of, None)
        self._keep(pd.DataFrame([(*of, *value) for of, value in state.items()], columns=kept.columns), timerValues)
        lead = some["kind"] == "lead"
        if lead.any():
            yield some.assign(strikes=strikes)[lead][names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self._keep(self.read(), timerValues)
        yield from ()

    def _keep(self, state: pd.DataFrame, timerValues) -> None:  # noqa: N803
        """What was idle goes; a timer is set for when the next may."""
        if not self.never:
            ends = (state["last"] + self.idle) * 1000
            state = state[ends >= timerValues.getCurrentWatermarkInMs()]
        if not len(state):
            self.state.clear()
            return
        self.state.update(_packed(state, self.kept))
        if not self.never:
            self.handle.registerTimer(int(state["last"].min() + self.idle) * 1000)

    def close(self) -> None:
        pass


class SshPairing(Ordered):
    """Lines of sshd processes: a marker line makes its process's next line with an address a probe."""

    waiting = "proc string, row_id long, ts_sec long, client_ip string, kind string, reason string, mark string, addr string"
    kept = "proc string, mark string"

    def step(self, kept, rows, mark):
        marks, takes = rows["mark"].notna(), rows["addr"].notna()
        # Of the lines before, the last with a marker or an address tells what is pending.
        told = pd.concat([kept, rows[["proc"]].assign(mark=rows["mark"].where(marks, takes.map({True: "", False: None})))], ignore_index=True)
        told["mark"] = told["mark"].astype(object).where(told["mark"].notna(), None)
        pending = told.groupby("proc", sort=False)["mark"].ffill().groupby(told["proc"], sort=False).shift()[len(kept) :].set_axis(rows.index)
        fires = ~marks & takes & pending.notna() & (pending != "")
        last = told[told["mark"].notna()].drop_duplicates("proc", keep="last")
        if not len(rows):
            return kept, None
        # Spark wants the event time of what is released to be after the watermark; ts_sec keeps the order.
        out = rows.assign(
            event_ts=pd.Timestamp(mark + 1, unit="ms"), client_ip=rows["client_ip"].mask(marks, None).mask(fires, rows["addr"]),
            kind=rows["kind"].mask(marks, "ignore").mask(fires, "scanner_probe"), reason=rows["reason"].mask(marks, None).mask(fires, pending),
        )
        return last[last["mark"] != ""], out[["row_id", "ts_sec", "event_ts", "client_ip", "kind", "reason"]]


def _counted(flat: DataFrame, keep: tuple[str, ...], clock: str, span: int = SPAN) -> DataFrame:
    """Verdicts of a stream with `act` and event_ts; only strikes pass through state."""
    done = VD.done_rows(flat, keep)
    strikes = VD.strike_rows(flat, ("event_ts", *keep))
    if "uri" not in keep:
        strikes = strikes.withColumn("uri", F.lit(None).cast("string"))
    strikes = strikes.select(*_NAMES(_STRIKE))
    timed_rows = strikes.where("event_ts IS NOT NULL").withColumn("of", dealt("client_ip")).withColumn("span", F.floor(F.col("ts_sec") / span))
    spans = timed_rows.groupBy("of", "span").transformWithStateInPandas(
        SpanStrikes(span, clock == "none"), _COUNTED, "Append", "EventTime", eventTimeColumnName="event_ts"
    )
    hits = spans.groupBy("part").transformWithStateInPandas(
        StrikeChain(span, clock == "none"), "client_ip string, row_id long, ts_sec long, uri string, pool string, told string, threshold int, strikes int", "Append", "EventTime"
    )
    alone = strikes.where("event_ts IS NULL").withColumn("strikes", F.lit(1)).select(*hits.columns)
    return done.unionByName(VD.judged_strikes(hits.unionByName(alone), keep))


def stream_verdicts(requests: DataFrame, p: VD.Policies = VD.Policies(), clock: str = "event") -> DataFrame:  # noqa: B008
    """The columns of evaluate_requests for a stream with event_ts (see timed)."""
    rows = VD.candidates(requests, p).select("row_id", "ts_sec", "event_ts", "client_ip", "uri", "act")
    return _counted(rows, ("uri",), clock)


def stream_ssh(lines: DataFrame, p: VD.Policies = VD.Policies(), key: tuple[str, ...] = ("src_file",)) -> DataFrame:  # noqa: B008
    """Verdicts of a stream of ssh lines(line, row_id, ts_sec, event_ts): pairing by process of
    each source, then the counters of each address. Lines without a process are paired with none."""
    rows = L.with_marks(L.parse_auth_log(lines))
    proc = F.concat_ws("|", *key, F.coalesce(F.col("pid").cast("string"), F.concat(F.lit("row "), F.col("row_id").cast("string"))))
    rows = rows.withColumn("proc", proc).withColumn("mark", F.when(F.col("pid").isNotNull(), F.col("_mark"))).withColumn("addr", F.when(F.col("pid").isNotNull() & F.col("_mark").isNull(), F.col("_ip")))
    paired = rows.select("proc", "row_id", "ts_sec", "event_ts", "client_ip", "kind", "reason", "mark", "addr").withColumn("of", dealt("proc")).groupBy("of").transformWithStateInPandas(
        SshPairing(), "row_id long, ts_sec long, event_ts timestamp, client_ip string, kind string, reason string", "Append", "EventTime", eventTimeColumnName="event_ts"
    )
    return _counted(VD.ssh_candidates(paired, p).select("row_id", "ts_sec", "event_ts", "client_ip", "act"), (), "event")


def started(rows: DataFrame, checkpoint: str, each, trigger: dict | None = None) -> StreamingQuery:
    """Run `each(batch, batch_id)` over a stream. A batch that is run again after a failure has the
    same id, so that what `each` writes by id is written once."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def to_parquet(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Rows to a folder, each once."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def late_rows(q: StreamingQuery) -> int:
    """Rows that came after the watermark, of the progress that the query still remembers."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in q.recentProgress for s in p["stateOperators"])


def stream_bans(verdicts: DataFrame, ledger: str, checkpoint: str, seconds: int = BAN_SECONDS, trigger: dict | None = None, told=None) -> StreamingQuery:
    """Each batch's bans as one part of the ledger, by its id; then `told(bans)`, if given."""
    def save(batch: DataFrame, batch_id: int) -> None:
        path = f"{ledger}/part={batch_id}"
        build_bans(batch, seconds).write.mode("overwrite").parquet(path)
        if told is not None:
            told(batch.sparkSession.read.parquet(path))

    return started(verdicts, checkpoint, save, trigger)


def ledger_bans(spark: SparkSession, ledger: str) -> DataFrame:
    """The ban table of a ledger: by target the last ban, of the last part in a tie."""
    return latest(spark.read.parquet(ledger), "target", ("banned_at", "part")).drop("part")


def stream_waf_sync(changes: DataFrame, ledger: str, out: str, checkpoint: str, expression, seconds: int = 5, once: bool = False) -> StreamingQuery:
    """After changes, at most once in `seconds`: `expression(bans)` of the whole ledger, to a
    folder by batch id. Changes between two runs are taken together."""
    def sync(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            expression(ledger_bans(batch.sparkSession, ledger)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return started(changes, checkpoint, sync, {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"})


def _recent(bans: DataFrame, as_of: int, rows: int) -> DataFrame:
    return active_bans(bans, as_of).where(ip_v4(F.col("target")).isNotNull()).orderBy(F.desc("banned_at"), F.desc("target")).limit(rows)


def stream_recent_waf(bans: DataFrame, ledger: str, tops: str, out: str, checkpoint: str, expression, as_of, fit: int, trigger: dict | None = None) -> StreamingQuery:
    """After each batch of ban rows: `expression(bans)` to a folder by batch id, as if of the whole ledger,
    where it takes addresses by recency and `fit` of them at most.

    A batch becomes a part of the ledger. Of the ledger, only the 4 * fit most recent active addresses
    are kept beside it, one small table a batch, so that a batch reads the last of these and its own rows.
    What was left out is older than all of them; only when so many have ended that fewer than
    `fit` remain is the ledger read again. `as_of()` tells the moment."""
    def sync(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, as_of()
        path, kept = f"{ledger}/part={batch_id}", f"{tops}/batch={batch_id}"
        batch.select(*COLUMNS).write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path).withColumn("seq", F.lit(1))
        whole = True
        if batch_id:
            old = spark.read.parquet(f"{tops}/batch={batch_id - 1}")
            # The row without a target tells whether nothing was left out so far.
            whole = old.where("target IS NULL").first()["tier_level"] == 1
            rows = old.where("target IS NOT NULL").select(*COLUMNS, F.lit(0).alias("seq")).unionByName(rows)
        merged = latest(rows, "target", ("banned_at", "seq")).select(*COLUMNS)
        live = active_bans(merged, now).where(ip_v4(F.col("target")).isNotNull()).count()
        if not whole and live < fit:
            merged, whole = ledger_bans(spark, ledger).select(*COLUMNS), True
            live = active_bans(merged, now).where(ip_v4(F.col("target")).isNotNull()).count()
        whole = whole and live <= 4 * fit
        mark = spark.range(1).select(F.lit(None).cast("string").alias("target"), F.lit(int(whole)).alias("tier_level"), *(F.lit(None).cast(t).alias(c) for c, t in (("banned_at", "long"), ("expires_at", "long"), ("reason", "string"))))
        _recent(merged, now, 4 * fit).unionByName(mark).write.mode("overwrite").parquet(kept)
        expression(spark.read.parquet(kept).where("target IS NOT NULL")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return started(bans, checkpoint, sync, trigger)


def sweep(spark: SparkSession, ledger: str, to: str, as_of: int) -> DataFrame:
    """A compacted ledger without ended bans at `to`, and (kept, removed). Idle strikes leave by the
    timers of their state, old offenses by prune_offenses."""
    bans = ledger_bans(spark, ledger)
    live = F.col("expires_at").isNull() | (F.col("expires_at") > as_of)
    bans.where(live).write.mode("overwrite").parquet(f"{to}/part=0")
    return bans.agg(F.count(F.when(live, 1)).alias("kept"), F.count(F.when(~live, 1)).alias("removed"))
