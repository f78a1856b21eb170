"""Mixing sources to target weights by pivotal dependent rounding.

Every document's fractional copy count is its source's rate. Pairs of documents of a source
then exchange words at random, keeping the pair's words and each document's expectation, until
one of the two has a whole number of copies. Chunks of a source do so independently and leave
one fractional document each; those meet in a tree of fan-in FAN until one is left per source,
so that a source's words differ from its target by less than a short document's size: the last
fraction is drawn by lot. A document that is too long for the rest of its chunk to balance may leave its
own, but for one that has a chance of SLIGHT at most of another copy (or of one less): it goes without,
if that can be balanced, since its source would else miss the target by its length.

The partner of a long document, and of the last ones of a chunk, is all that follows it, taken as one: it gains what they
lose in proportion to their fractions, or loses what they gain in proportion to what is left to
whole copies. Each such step keeps the words of the two sides and, by the odds down : up, every
expectation, as a step of two documents does; it is pivoting with a composite partner, needed since
no single short document could give or take what makes a long one whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logshield.llm.common import cut, maybe_broadcast, mix

#: Documents of a chunk, residuals that meet in one node of the tree.
CHUNK, FAN = 4096, 64
#: The shortest documents of a chunk, so many at least and with so many times the words of its longest,
#: are settled last, each against all that are shorter still.
TAIL, LONG = 64, 8
#: Up to this chance of a copy more (or less) a document that is too long to be balanced goes without it.
SLIGHT = 0.1


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space. Null: 0."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, source_size, docs, target) from (source, source_size, docs), a row per source.

    Sources in code point order, null last, take the weights in turn. Targets are the level of
    water poured by weight: each stops at `most` times its size and the rest rises. The windows
    run over a row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    got = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    got = got.withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    place = F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last()))
    got = got.withColumn("level", level).withColumn("place", place)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(whole)["level"]
    target = F.when(fits.isNull(), F.col("cap")).otherwise(F.least("cap", fits * F.col("weight")))
    return got.select("source", "source_size", "docs", target.alias("target"))


def _settled(p: np.ndarray, s: np.ndarray, u: np.ndarray, k: int, rest: np.ndarray) -> np.ndarray:
    """One step of k against all of rest, taken as one. Where the rest balances k becoming whole one way
    only, and the other way is a slight chance, k goes that way."""
    have, room = float(p[rest] @ s[rest]), float((1 - p[rest]) @ s[rest])
    if not have or not room:
        return p
    up, down = min((1 - p[k]) * s[k], have), min(p[k] * s[k], room)
    short, tight = up < (1 - p[k]) * s[k], down < p[k] * s[k]
    sided = short != tight and min(p[k], 1 - p[k]) <= SLIGHT
    gains = tight if sided else u[k] * (up + down) < down
    if gains:
        p[k], p[rest] = p[k] + up / s[k], p[rest] * (1 - up / have)
    else:
        p[k], p[rest] = p[k] - down / s[k], p[rest] + (1 - p[rest]) * (down / room)
    near = np.round(p)
    return np.where(np.abs(p - near) < 1e-12, near, p)


def _pivot(group: pa.Table, seed: int, level: int, last: bool) -> pa.Table:
    """Rounds p of all rows of a group but one; with `last`, of that one too, by lot. Documents meet in
    pairs, long ones first; what is left of them, and then each of the shortest ones, meets all that are
    shorter, so that the one left over is short."""
    group = group.sort_by([("size", "descending"), ("h", "ascending"), ("p", "ascending")])
    p, s = group["p"].to_numpy().copy(), group["size"].to_numpy().astype(np.float64)
    random = mix(group["h"].to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64((seed * 1_000_003 + level * 7919) % (1 << 63)))
    unit = lambda x: (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    u = unit(random)
    fractions = lambda: np.flatnonzero((p > 0) & (p < 1))
    i, open_ = None, fractions()
    # From the shortest on, as many as hold several times the words of the longest.
    words = np.cumsum(s[open_][::-1])
    tail = max(TAIL, int(np.searchsorted(words, LONG * s[open_[0]])) + 1) if len(open_) else 0
    for j in open_[: max(len(open_) - tail, 0)].tolist():
        if i is None:
            i = j
            continue
        up, down = min((1 - p[i]) * s[i], p[j] * s[j]), min(p[i] * s[i], (1 - p[j]) * s[j])
        if u[j] * (up + down) < down:  # i gains, with the chance that keeps expectations
            full = (1 - p[i]) * s[i] <= p[j] * s[j]
            p[i], p[j] = (1.0, p[j] - up / s[j]) if full else (p[i] + up / s[i], 0.0)
        else:
            full = p[i] * s[i] <= (1 - p[j]) * s[j]
            p[i], p[j] = (0.0, p[j] + down / s[j]) if full else (p[i] - down / s[i], 1.0)
        i = j if full else i
        if not 1e-12 < p[i] < 1 - 1e-12:  # both became whole at once
            p[i], i = round(p[i]), None
    u = unit(mix(random))
    open_ = fractions()
    for at, k in enumerate(open_.tolist()):
        if 0 < p[k] < 1:
            p = _settled(p, s, u, k, open_[at + 1 :])
    for k in fractions()[:1].tolist() if last else ():
        p[k] = float(unit(mix(mix(random)))[k] < p[k])
    return group.set_column(group.column_names.index("p"), "p", pa.array(p))


def _rounder(seed: int, level: int, last: bool):
    def rounded(group):
        return _pivot(group, seed, level, last)

    return rounded


def mixture(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, tie (and the columns named in `keep`) of every
    row of docs(doc_id, text, source, ...).

    Defined cases: a null or empty text has size 0 and takes 0; rows without source are a source
    of their own, last in order; rows without doc_id and rows that repeat a doc_id are documents
    like others; sources of size 0 have target 0; very long texts are counted whole. Reruns agree:
    the random numbers are hashes of doc_id, size, seed and a number among rows that are equal
    here (column `tie`, from 0; such rows are interchangeable), and chunks are dealt by them. An
    empty table gives an empty result."""
    units = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep)
    # Equal rows are one row with their number until they are dealt out again, in runs of CHUNK.
    units = cut(units.groupBy(units.columns).agg(F.count("*").alias("equal")))
    most_equal = units.agg(F.max("equal")).first()[0] or 0
    ones = units.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("equal") - 1) / CHUNK))))
    if most_equal > CHUNK:
        ones = ones.repartition("doc_id", "size", "run")
    start = F.col("run") * CHUNK
    ones = ones.withColumn("tie", F.explode(F.sequence(start, F.least(start + CHUNK, F.col("equal")) - 1))).drop("run", "equal")
    sources = cut(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("source_size"), F.sum("equal").alias("docs")), share, most, weights))
    most_docs = sources.agg(F.max("docs")).first()[0] or 0
    kinds = {f: t for f, t in ones.dtypes}
    rate = F.when(F.col("source_size") > 0, F.when(F.col("target") >= F.col("source_size") * F.lit(float(most)), F.lit(float(most))).otherwise(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    of = maybe_broadcast(sources.withColumnRenamed("source", "s"))
    h = F.xxhash64("doc_id", "size", F.lit(seed), *keep, "tie")
    rows = ones.join(of, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate).withColumn("h", h)
    rows = rows.withColumn("base", F.when(F.col("size") > 0, F.floor("rate").cast("long")).otherwise(F.lit(0).cast("long"))).withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.col("base")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("chunk", F.pmod(F.col("h"), F.ceil(F.col("docs") / CHUNK)))
    names = ["doc_id", "source", "size", *keep, "tie", "source_size", "target", "base", "h", "chunk", "p"]
    kinds |= {"source_size": "long", "target": "double", "base": "long", "h": "long", "chunk": "long", "p": "double"}
    schema = ", ".join(f"`{x}` {kinds[x]}" for x in names)
    rows, done, level, chunks = rows.select(names), [], 0, -(-most_docs // CHUNK)
    while True:
        last = chunks <= 1
        rows = cut(rows.groupBy("source", "chunk").applyInArrow(_rounder(seed, level, last), schema))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        if last:
            done.append(rows)
            break
        done.append(rows.where(~open_))
        rows = rows.where(open_).withColumn("chunk", F.floor(F.col("chunk") / FAN))
        level, chunks = level + 1, -(-chunks // FAN)
    got = done[0]
    for x in done[1:]:
        got = got.unionByName(x)
    copies = F.col("base") + F.round("p").cast("long")
    return got.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "tie", *keep)
