"""Offense history and tiered bans over streams, and bans that end by themselves.

Offenses wait until the watermark has come to them, and change what is kept of their addresses in their
order; that is a handful of numbers an address. Addresses are dealt to keys by hash (see live). Bans that
come out are rows of the ban ledger, as bans of verdicts are. All results are those of the batch
operators over the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logshield.streaming.live import Ordered, dealt

#: Seconds after its last offense at which an address's history ends.
MAX_AGE = 30 * 86400


def _columns(rows: pd.DataFrame, *names: str):
    """The rows as tuples, null as None."""
    return zip(*(rows[n].astype(object).where(rows[n].notna(), None) for n in names))


class OffenseHistory(Ordered):
    """count, first_seen and last_seen after each offense; a row with `pruned` when the history ends."""

    waiting = "client_ip string, row_id long, ts_sec long"
    kept = "client_ip string, count long, first_seen long, last_seen long"
    columns = ["client_ip", "row_id", "ts_sec", "count", "first_seen", "last_seen", "pruned"]

    def __init__(self, window: int, max_age: int):
        self.window, self.max_age = window, max_age

    def step(self, kept, rows, mark):
        state, out = {ip: told for ip, *told in _columns(kept, *kept.columns)}, []
        for ip, row_id, ts in _columns(rows, "client_ip", "row_id", "ts_sec"):
            count, first, last = state.get(ip) or (0, ts, ts)
            count, first = (1, ts) if ts - last > self.window else (count + 1, first)
            state[ip] = (count, first, ts)
            out.append((ip, row_id, ts, count, first, ts, False))
        now = mark // 1000
        for ip, (count, first, last) in list(state.items()):
            if now > last + self.max_age:
                out.append((ip, None, last + self.max_age, count, first, last, True))
                del state[ip]
        made = pd.DataFrame(out, columns=self.columns).astype({"row_id": "Int64"})
        return pd.DataFrame([(ip, *told) for ip, told in state.items()], columns=kept.columns), made

    def ends(self, kept):
        return kept["last_seen"].min() + self.max_age + 1


class Escalation(Ordered):
    """The window's count and anchor, and the next tier; a row for each ban."""

    waiting = "client_ip string, row_id long, ts_sec long, perm boolean, reason string"
    kept = "client_ip string, n long, anchor long, tier long"
    columns = ["client_ip", "row_id", "ts_sec", "tier", "perm", "reason"]

    def __init__(self, find_time: int, max_retry: int, last: int):
        self.find_time, self.max_retry, self.last = find_time, max_retry, last

    def step(self, kept, rows, mark):
        state, out = {ip: told for ip, *told in _columns(kept, *kept.columns)}, []
        for ip, row_id, ts, perm, reason in _columns(rows, "client_ip", "row_id", "ts_sec", "perm", "reason"):
            n, anchor, tier = state.get(ip) or (0, None, 0)
            if perm:
                state[ip] = (0, None, tier)
                out.append((ip, row_id, ts, self.last, True, reason))
                continue
            n, anchor = (1, ts) if anchor is None or ts - anchor > self.find_time else (n + 1, anchor)
            state[ip] = (n, anchor, tier)
            if n >= self.max_retry:
                state[ip] = (0, None, min(tier + 1, self.last))
                out.append((ip, row_id, ts, tier, False, reason))
        # Without a tier, an address is forgotten with its window.
        left = [(ip, n, anchor, tier) for ip, (n, anchor, tier) in state.items() if tier or (anchor is not None and mark // 1000 <= anchor + self.find_time)]
        return pd.DataFrame(left, columns=kept.columns).astype({"anchor": "Int64"}), pd.DataFrame(out, columns=self.columns)

    def ends(self, kept):
        return kept.loc[kept["tier"] == 0, "anchor"].min() + self.find_time + 1


def _dealt(offenses: DataFrame):
    names = offenses.columns
    reason = F.col("reason") if "reason" in names else F.lit(None).cast("string")
    perm = F.coalesce("instant_permanent", F.lit(False)) if "instant_permanent" in names else F.lit(False)
    rows = offenses.where("event_ts IS NOT NULL").select("client_ip", "row_id", "ts_sec", "event_ts", perm.alias("perm"), reason.alias("reason"), dealt("client_ip").alias("of"))
    return rows.groupBy("of")


def stream_offenses(offenses: DataFrame, window: int, max_age: int = MAX_AGE) -> DataFrame:
    """(client_ip, row_id, ts_sec, count, first_seen, last_seen, pruned): the history of an address after
    each of a stream's offenses(client_ip, row_id, ts_sec, event_ts), see timed; the last row of an
    address is what offense_counter tells. When it has been quiet for max_age seconds, its history ends
    with a row that has `pruned`. Offenses without a time are left out."""
    kind = "client_ip string, row_id long, ts_sec long, count long, first_seen long, last_seen long, pruned boolean"
    return _dealt(offenses).transformWithStateInPandas(OffenseHistory(window, max_age), kind, "Append", "EventTime")


def stream_escalate(offenses: DataFrame, find_time: int, max_retry: int, tiers: tuple[int | None, ...]) -> DataFrame:
    """The bans of escalate for a stream of offenses, as verdicts: client_ip, row_id, ts_sec, action,
    reason, permanent, tier and duration_s, which stream_bans saves in its ledger with their tiers.
    Offenses without a time are left out."""
    fold = Escalation(find_time, max(max_retry, 1), max(len(tiers) - 1, 0))
    got = _dealt(offenses).transformWithStateInPandas(fold, "client_ip string, row_id long, ts_sec long, tier int, perm boolean, reason string", "Append", "EventTime")
    length = F.element_at(F.array(*[F.lit(t).cast("long") for t in tiers]), F.col("tier") + 1) if tiers else F.lit(None).cast("long")
    length = F.when(F.col("perm"), F.lit(None).cast("long")).otherwise(length)
    return got.select("client_ip", "row_id", "ts_sec", F.lit("ban").alias("action"), "reason", length.isNull().alias("permanent"), "tier", length.alias("duration_s"))


class BanClock(Ordered):
    """The bans of targets: begun by a row, ended by the next one or by their own time."""

    waiting = "target string, row_id long, ts_sec long, tier_level long, expires_at long, reason string"
    kept = "target string, banned_at long, tier_level long, expires_at long, reason string, row_id long"
    columns = ["target", "event", "at", "tier_level", "banned_at", "expires_at", "reason", "row_id"]

    def step(self, kept, rows, mark):
        state, out, now = {target: told for target, *told in _columns(kept, *kept.columns)}, [], mark // 1000
        event = lambda target, what, at, ban: out.append((target, what, at, ban[1], ban[0], *ban[2:]))
        for target, row_id, at, tier, expires, reason in _columns(rows, "target", "row_id", "ts_sec", "tier_level", "expires_at", "reason"):
            ban = state.get(target)
            if ban is not None and ban[2] is not None and ban[2] <= at:
                event(target, "lifted", ban[2], ban)
            state[target] = (at, tier, expires, reason, row_id)
            event(target, "banned", at, state[target])
        for target, ban in list(state.items()):
            if ban[2] is not None and ban[2] <= now:
                event(target, "lifted", ban[2], ban)
                del state[target]
        left = pd.DataFrame([(target, *ban) for target, ban in state.items()], columns=kept.columns).astype({"expires_at": "Int64"})
        return left, pd.DataFrame(out, columns=self.columns).astype({"expires_at": "Int64"})

    def ends(self, kept):
        return kept["expires_at"].min()


def stream_expiry(bans: DataFrame) -> DataFrame:
    """(target, event, at, tier_level, banned_at, expires_at, reason, row_id): `banned` and `lifted` as they come
    about, of a stream of bans(target, tier_level, banned_at, expires_at, reason, row_id, event_ts), with
    the watermark on event_ts, the time of banned_at. Of a target the last ban counts (row_id breaks
    ties); one that is replaced before its end is not lifted. A ban is lifted when the watermark comes
    to its end, and its state goes with it; permanent ones stay."""
    kind = "target string, event string, at long, tier_level int, banned_at long, expires_at long, reason string, row_id long"
    rows = bans.where("event_ts IS NOT NULL").select("target", F.col("banned_at").alias("ts_sec"), "tier_level", "expires_at", "reason", "row_id", "event_ts", dealt("target").alias("of"))
    return rows.groupBy("of").transformWithStateInPandas(BanClock(), kind, "Append", "EventTime")


def standing(events: DataFrame, as_of: int | None = None) -> DataFrame:
    """The ban table of the events of stream_expiry so far: targets whose last ban was not lifted, or, with
    `as_of`, not until then."""
    # A ban and its end are told by the row that began it; an end may lie before its ban.
    known = events if as_of is None else events.where((F.col("event") == "banned") | (F.col("at") <= as_of))
    order = F.struct("banned_at", "row_id", (F.col("event") == "lifted").cast("int"))
    last = known.groupBy("target").agg(F.max_by(F.struct("event", "tier_level", "banned_at", "expires_at", "reason"), order).alias("s"))
    return last.where("s.event = 'banned'").select("target", "s.tier_level", "s.banned_at", "s.expires_at", "s.reason")
