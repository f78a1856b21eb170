"""Per-address strike counters and offense history as window expressions.

A counter restarts when the gap to the previous strike of the pool exceeds the current row's
window (or, in the isolated pool, the category changed); it saturates at 255 and keeps firing.
Rows are ordered by (ts_sec, row_id), those without a time first: for them no window expires. Only
strike rows are shuffled, by address and pool. No address is worked on as a whole: it is cut in spans of
time, or of rows, that are summed up in a row or a few each, and only these are chained."""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logshield.sources.shared import cut

#: Seconds of a span of an address, and numbers of rows of a span of those without a time.
SPAN, ROW_SPAN = 600, 1 << 16
#: Rows of a block of offenses that escalation follows at once.
BLOCK = 1 << 14


def _span(bucket: int) -> Column:
    """(seconds, rows): the span of a row; spans are in the order of the rows."""
    no_time = F.col("ts_sec").isNull()
    seconds = F.when(no_time, F.lit(-(1 << 62))).otherwise(F.floor(F.col("ts_sec") / bucket))
    return F.struct(seconds.alias("seconds"), F.when(no_time, F.floor(F.col("row_id") / ROW_SPAN)).otherwise(F.lit(0).cast("long")).alias("rows"))


def strike_counts(strikes: DataFrame, clock: str = "event", bucket: int = SPAN) -> DataFrame:
    """Adds strikes to (row_id, client_ip, pool, category, window_s, ts_sec, ...).

    clock: `event` uses ts_sec; `none` never lets a window expire (a replay in no time). An
    address is counted in spans of `bucket` seconds, each by itself; one row a span then tells
    what the next begins with. So a busy address is many groups, not one."""
    spans = ["_who", "pool", "_span"]
    order = Window.partitionBy(*spans).orderBy("ts_sec", "row_id")
    rows = strikes.withColumn("_who", F.coalesce("client_ip", F.lit(""))).withColumn("_span", _span(bucket))
    expired = F.lit(False) if clock == "none" else F.col("ts_sec") - F.lag("ts_sec").over(order) > F.col("window_s")
    other = (F.col("pool") == "isolated") & (F.col("category") != F.lag("category").over(order))
    rows = rows.withColumn("_cut", F.coalesce(expired, F.lit(False)) | F.coalesce(other, F.lit(False))).withColumn("_at", F.row_number().over(order))
    rows = rows.withColumn("_from", F.last(F.when(F.col("_cut"), F.col("_at")), ignorenulls=True).over(order)).withColumn("_n", F.col("_at") - F.coalesce(F.col("_from"), F.lit(1)) + 1)

    last = F.max(F.struct("ts_sec", "row_id", "category", "_n", F.col("_from").isNotNull().alias("cut")))
    ends = rows.groupBy(*spans).agg(F.min(F.struct("ts_sec", "row_id", "category", "window_s")).alias("a"), last.alias("z"))
    chain = Window.partitionBy("_who", "pool").orderBy("_span")
    was = F.lag("z").over(chain)
    gone = F.lit(False) if clock == "none" else F.col("a.ts_sec") - F.col("was.ts_sec") > F.col("a.window_s")
    changed = F.coalesce((F.col("pool") == "isolated") & (F.col("a.category") != F.col("was.category")), F.lit(False))
    ends = ends.withColumn("was", was).withColumn("cut", F.col("was").isNull() | gone | changed)
    ends = ends.withColumn("run", F.sum((F.col("cut") | F.col("z.cut")).cast("int")).over(chain))
    whole = Window.partitionBy("_who", "pool", "run").orderBy("_span")
    ends = ends.withColumn("sum", F.sum("z._n").over(whole)).withColumn("_carry", F.when(F.col("cut"), F.lit(0)).otherwise(F.lag("sum").over(chain)))
    got = rows.join(ends.select(*spans, "_carry"), spans)
    n = F.col("_n") + F.when(F.col("_from").isNull(), F.col("_carry")).otherwise(F.lit(0))
    return got.select(*strikes.columns, F.least(n, F.lit(255)).cast("int").alias("strikes"))


def strike_snapshot(counted: DataFrame, as_of: int) -> DataFrame:
    """Last state of each address and pool at a moment: strikes, category, last_seen."""
    state = F.max_by(F.struct("strikes", "category", "ts_sec"), F.struct("ts_sec", "row_id"))
    got = counted.where(F.col("ts_sec") <= as_of).groupBy("client_ip", "pool").agg(state.alias("s"))
    return got.select("client_ip", "pool", F.col("s.strikes").alias("strikes"), F.col("s.category").alias("category"), F.col("s.ts_sec").alias("last_seen"))


def evict_strikes(snapshot: DataFrame, as_of: int, max_idle: int = 600) -> DataFrame:
    """Addresses with any pool idle no longer than max_idle keep all their pools."""
    live = F.max(F.lit(as_of) - F.col("last_seen") <= max_idle).over(Window.partitionBy("client_ip"))
    return snapshot.withColumn("live", live).where("live").drop("live")


def clear_strikes(counted: DataFrame, addresses: DataFrame) -> DataFrame:
    """Without the strikes of addresses(client_ip, cleared_at) up to that moment."""
    gone = addresses.select(F.col("client_ip").alias("c"), "cleared_at")
    return counted.join(gone, (F.col("client_ip") == F.col("c")) & (F.col("ts_sec") <= F.col("cleared_at")), "left_anti")


def offense_counter(offenses: DataFrame, window: int, bucket: int = SPAN) -> DataFrame:
    """(client_ip, count, first_seen, last_seen) of the last run of offenses(client_ip, ts_sec)
    without a gap over `window`. An address is summed up in spans of `bucket` seconds, by their first and
    last runs; one row a span then tells what belongs to the address's last run. Offenses without a
    time count with those of the first run."""
    gap = lambda at, before: F.coalesce(at - before > window, F.lit(False))
    spans = ["client_ip", "span"]
    rows = offenses.select("client_ip", "ts_sec", F.coalesce(F.floor(F.col("ts_sec") / bucket), F.lit(-(1 << 62))).alias("span"))
    order = Window.partitionBy(*spans).orderBy("ts_sec")
    runs = rows.withColumn("run", F.sum(gap(F.col("ts_sec"), F.lag("ts_sec").over(order)).cast("int")).over(order))
    runs = runs.groupBy(*spans, "run").agg(F.count("*").alias("count"), F.min("ts_sec").alias("first_seen"), F.max("ts_sec").alias("last_seen"))
    ends = runs.groupBy(*spans).agg(F.max_by(F.struct("count", "first_seen", "last_seen"), "run").alias("z"), F.min("first_seen").alias("a"), F.max("run").alias("inner"))
    chain = Window.partitionBy("client_ip").orderBy("span")
    fresh = gap(F.col("a"), F.lag("z.last_seen").over(chain)) | (F.col("inner") > 0)
    ends = ends.withColumn("whole", F.sum(fresh.cast("int")).over(chain))
    whole = ends.groupBy("client_ip", "whole").agg(F.sum("z.count").alias("count"), F.min("z.first_seen").alias("first_seen"), F.max("z.last_seen").alias("last_seen"))
    last = whole.groupBy("client_ip").agg(F.max_by(F.struct("count", "first_seen", "last_seen"), "whole").alias("s"))
    return last.select("client_ip", "s.count", "s.first_seen", "s.last_seen")


def prune_offenses(history: DataFrame, as_of: int, max_age: int = 30 * 86400) -> DataFrame:
    return history.where(F.lit(as_of) - F.col("last_seen") <= max_age)


def pruned_count(history: DataFrame, as_of: int, max_age: int = 30 * 86400) -> DataFrame:
    """(kept, removed) of prune_offenses."""
    old = F.lit(as_of) - F.col("last_seen") > max_age
    return history.agg(F.count(F.when(~old, 1)).alias("kept"), F.count(F.when(old, 1)).alias("removed"))


def _numbered(offenses: DataFrame) -> DataFrame:
    """offenses with `at`, their place in the order of (client_ip, ts_sec, row_id) over the whole table.
    Ranges of that order are dealt out, so that a busy address is in many of them; the sizes of the
    ranges, a number a partition, tell where each begins."""
    order = ("client_ip", "ts_sec", "row_id")
    dealt = offenses.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_n")))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size")).withColumn("_begin", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size"))
    got = dealt.join(F.broadcast(sizes.select("_part", "_begin")), "_part")
    return got.withColumn("at", F.col("_begin") + F.col("_n")).drop("_part", "_n", "_begin")


def _following(rows: pa.Table, find_time: int, max_retry: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of consecutive ones, taken as the first offense of a window: the first row after
    the window, and whether the window ends in a ban. A row of the next address and a permanent
    offense end a window as well."""
    n = len(rows)
    ip, ts = rows["client_ip"].combine_chunks(), rows["ts_sec"].combine_chunks()
    perm = rows["perm"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
    key = pc.fill_null(ip, "").dictionary_encode().indices.to_numpy() * 2 + ip.is_null().to_numpy(zero_copy_only=False)
    bar = np.ones(n, bool)
    bar[1:] = (key[1:] != key[:-1]) | perm[1:] | perm[:-1]
    # The first row of another stretch after each row.
    starts = np.flatnonzero(bar)
    ends = np.append(starts, n)[np.searchsorted(starts, np.arange(n), "right")]
    timed = ts.is_valid().to_numpy(zero_copy_only=False)
    at = ts.fill_null(0).to_numpy()
    # Within a stretch times rise: one search over all, with stretches far apart.
    stretch = np.cumsum(bar) - 1
    late = np.full(n, n)
    known = np.flatnonzero(timed)
    if len(known):
        base = at[known].min()
        width = int(at[known].max() - base) + find_time + 2
        line = stretch[known] * width + (at[known] - base)
        late[known] = np.append(known, n)[np.searchsorted(line, line + find_time, "right")]
    # A window without a time holds its own row alone.
    late[~timed] = np.flatnonzero(~timed) + 1
    after = np.minimum(ends, late)
    bans = (after - np.arange(n) >= max_retry) & ~perm
    after = np.where(bans, np.arange(n) + max_retry, np.where(perm, np.arange(n) + 1, after))
    return after, bans


def escalate(offenses: DataFrame, find_time: int, max_retry: int, tiers: tuple[int | None, ...], block: int = BLOCK) -> DataFrame:
    """Bans (client_ip, ts_sec, row_id, tier, duration_s, permanent) of offenses(client_ip, ts_sec,
    row_id, instant_permanent).

    The window is anchored at its first offense; the max_retry-th offense within it bans and
    clears the counter; each ban of an address takes the next tier, the last one for good. A null
    tier, or none at all, is permanent. An instant permanent offense bans at the last tier, clears the
    counter and leaves the tier history. An offense without a time is a window of its own.

    The fold is not followed row by row. Any offense, taken as the first of a window, tells the one
    that begins the next window, at most max_retry rows on. So a block of rows is a table from the
    few rows at which a window may enter it to those at which one enters the next block. These
    tables are chained by pointer jumping, in rounds that double the reach; then every block knows where
    it is entered, and tells its bans. The tiers before the last need the first bans of an address only."""
    max_retry, block = max(max_retry, 1), max(block, max_retry)
    kept = offenses.select("client_ip", F.col("ts_sec").cast("long").alias("ts_sec"), F.col("row_id").cast("long").alias("row_id"), F.col("instant_permanent").alias("perm"))
    kept = kept.withColumn("client_ip", F.col("client_ip").cast("string"))
    rows = cut(_numbered(kept))
    blocks = ceil(rows.count() / block)
    # A block holds the first rows of the next one too, to see windows end.
    home = F.floor(F.col("at") / block)
    rows = rows.withColumn("block", F.explode(F.when(F.col("at") % block < max_retry, F.array(home - 1, home)).otherwise(F.array(home)))).where("block >= 0")

    def tables(group: pa.Table) -> pa.Table:
        """(id, to): entries of a block and of the next one, numbered through."""
        group = group.sort_by("at")
        number = group["block"][0].as_py()
        size = min(block, len(group))
        after, _ = _following(group, find_time, max_retry)
        leaves = np.minimum(after, len(group)).tolist()
        for i in range(size - 1, -1, -1):
            if leaves[i] < size:
                leaves[i] = leaves[leaves[i]]
        entries = np.arange(min(max_retry, size))
        to = np.array(leaves[: len(entries)], np.int64) - size
        return pa.table({"id": number * max_retry + entries, "to": (number + 1) * max_retry + np.minimum(to, max_retry - 1)})

    entered = _entered(rows.groupBy("block").applyInArrow(tables, "id long, to long"), blocks, max_retry)

    def bans(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        size = min(block, len(group))
        after, banned = _following(group, find_time, max_retry)
        perm = group["perm"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
        hit, after, i = [], after.tolist(), group["entry"][0].as_py()
        while i < size:
            if banned[i]:
                hit.append(i + max_retry - 1)
            i = after[i]
        own = np.flatnonzero(perm[:size])
        some = group.take(np.concatenate([np.array(hit, np.int64), own]))
        return some.select(["client_ip", "ts_sec", "row_id", "at"]).append_column("perm", pa.array([False] * len(hit) + [True] * len(own), pa.bool_()))

    placed = rows.join(entered, "block")
    kind = "client_ip string, ts_sec long, row_id long, at long, perm boolean"
    found = cut(placed.groupBy("block").applyInArrow(bans, kind))
    last = max(len(tiers) - 1, 0)
    early = found.where("NOT perm").withColumn("tier", F.row_number().over(Window.partitionBy("client_ip").orderBy("at")) - 1).where(F.col("tier") < last).select("at", "tier")
    got = found.join(early, "at", "left").withColumn("tier", F.coalesce("tier", F.lit(last)))
    length = F.element_at(F.array(*[F.lit(t).cast("long") for t in tiers]), F.col("tier") + 1) if tiers else F.lit(None).cast("long")
    length = F.when(F.col("perm"), F.lit(None).cast("long")).otherwise(length)
    return got.select(F.col("client_ip").cast(offenses.schema["client_ip"].dataType).alias("client_ip"), "ts_sec", "row_id", F.col("tier").cast("int").alias("tier"), length.alias("duration_s"), length.isNull().alias("permanent"))


def _entered(jumps: DataFrame, blocks: int, max_retry: int) -> DataFrame:
    """(block, entry): where each block is entered, from jumps(id, to) between numbered entries. The
    first block is entered at its first row; a block that all entries leave alike tells the next one's
    entry by itself, so that rounds of doubling are needed only between such blocks."""
    jumps = cut(jumps)
    sure = jumps.groupBy(F.floor(F.col("id") / max_retry).alias("b")).agg(F.min("to").alias("id"), F.max("to").alias("z")).where("id = z").select("id")
    reached = cut(sure.unionByName(jumps.sparkSession.range(1)).distinct())
    for _ in range(ceil(log2(max(blocks, 1))) + 1):
        if reached.where(F.col("id") < blocks * max_retry).count() >= blocks:
            break
        reached = cut(reached.unionByName(reached.join(jumps, "id").select(F.col("to").alias("id"))).distinct())
        on = jumps.select(F.col("id").alias("to"), F.col("to").alias("further"))
        jumps = cut(jumps.join(on, "to").select("id", F.col("further").alias("to")))
    return reached.select(F.floor(F.col("id") / max_retry).alias("block"), (F.col("id") % max_retry).alias("entry"))
