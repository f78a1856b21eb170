"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is `size` consecutive words of an item (a shorter item is one window). Its tokens are
its shingles of `shingle` consecutive words; since a window must be contained as a whole, one
necessary token suffices as its prefix: its rarest in the corpus.

1. The corpus is read once. Positions whose shingle occurs in the benchmark at all (a semi-join
   on 64-bit hashes) are kept, each with the few words around it that a window can cover.
2. Their counts order the shingles by rarity; each window is represented by its rarest one.
3. Kept positions join the prefixes; the shingle's offset in the window gives the start, which
   must lie within the text (positional bound) with the whole window (length bound); the words
   are then compared exactly.

Only step 1 touches texts and it does not shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logshield.llm.common import cut, maybe_broadcast

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def plain_words(text: Column) -> Column:
    """Words of a text: runs of ASCII letters and digits and of all other non-ASCII characters,
    A-Z lower-cased and nothing else. Null: none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _GAP), "")


def _key(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get(words, at + j) for j in range(n)))


def _keys(n: int) -> Column:
    """The key of every position; those of the last ones hold fewer words and meet no window."""
    return F.transform("words", lambda _, i: _key(F.col("words"), i, n))


def windows(items: DataFrame, size: int, shingle: int) -> DataFrame:
    """(item_id, words, w, n): the windows of each item, w words long, indexed by shingles of n."""
    got = items.select("item_id", plain_words(F.col("text")).alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.size("all") - size, F.lit(0))
    got = got.select("item_id", "all", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    got = got.select("item_id", F.slice("all", F.col("i") + 1, F.lit(size)).alias("words"))
    return got.withColumn("w", F.size("words")).withColumn("n", F.least(F.col("w"), F.lit(shingle)))


def hit_windows(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, items): every document row as (doc_id, th, n_words), th being a hash of its
    text; the occurrences (doc_id, th, wid, start, w) of windows in it; and (wid, item_id)."""
    win = cut(windows(items, size, shingle).withColumn("wid", F.xxhash64("words")))
    of_items = win.select("wid", "item_id").distinct()
    distinct = win.groupBy("wid").agg(F.first("words").alias("words"), F.max("w").alias("w"), F.max("n").alias("n"))
    lengths = sorted(r.n for r in win.select("n").distinct().collect())
    at = distinct.select("wid", "words", "w", "n", F.explode(F.sequence(F.lit(0), F.col("w") - F.col("n"))).alias("o"))
    key = F.coalesce(*(F.when(F.col("n") == n, _key(F.col("words"), F.col("o"), n)) for n in lengths)) if lengths else F.lit(None).cast("long")
    at = cut(at.withColumn("key", key))

    # The first entry of each array stands for the row itself, so that one pass yields both. No
    # array is empty; the outer form keeps Spark from testing that by computing it once more.
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), plain_words(F.col("text")).alias("words"))
    keys = [_keys(n) for n in lengths]
    texts = texts.withColumn("keys", F.concat(F.array(F.lit(0).cast("long")), *keys))
    found = texts.select("doc_id", "th", "words", F.posexplode_outer("keys").alias("pos", "key"))
    known = cut(at.select("key").union(at.sparkSession.createDataFrame([(0,)], "key long")).distinct())
    found = found.join(maybe_broadcast(known), "key", "left_semi")
    n = F.size("words")
    p = F.when(F.col("pos") > 0, (F.col("pos") - 1) % n)
    first = F.greatest(F.coalesce(p, F.lit(0)) - (size - 1), F.lit(0))
    around = F.when(F.col("pos") > 0, F.slice("words", first + 1, F.lit(2 * size - 1)))
    found = cut(found.select("doc_id", "th", n.cast("long").alias("n_words"), "key", p.alias("p"), first.alias("first"), around.alias("around")))
    rows, kept = found.where("p IS NULL"), found.where("p IS NOT NULL")

    count = kept.groupBy("key").agg(F.count("*").alias("k"))
    rarest = at.join(count, "key").groupBy("wid").agg(
        F.min_by(F.struct("key", "o", "words", "w"), F.struct("k", "key", "o")).alias("s"), F.countDistinct("o").alias("seen"), F.max(F.col("w") - F.col("n") + 1).alias("all")
    )
    # A window with a shingle that occurs nowhere cannot occur.
    prefix = cut(rarest.where("seen = all").select("wid", "s.key", "s.o", F.col("s.words").alias("want"), "s.w"))
    hits = kept.join(maybe_broadcast(prefix), "key").withColumn("start", F.col("p") - F.col("o"))
    hits = hits.where("start >= 0 AND start + w <= n_words")
    hits = hits.where(F.slice("around", F.col("start") - F.col("first") + 1, F.col("w")) == F.col("want"))
    return rows, hits.select("doc_id", "th", "wid", "start", "w").distinct(), of_items


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit (words inside any occurrence of a window),
    n_items, items_sha256 (of the sorted, comma-joined item_ids) and contaminated.

    Defined cases: null or empty texts have no words and no hits; items without words have no
    windows; an item without item_id counts its words but is no item; rows that repeat a doc_id
    are judged each by its own text; very long texts are read whole; other columns are ignored.
    Equal windows of several items count for each of them."""
    rows, hits, of_items = hit_windows(docs, items, size, shingle)
    hits = cut(hits)
    earlier = Window.partitionBy("doc_id", "th").orderBy("start", F.desc("w"), "wid").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("w")
    before = F.coalesce(F.max(end).over(earlier), F.lit(0))
    none = F.lit(None)
    new = hits.withColumn("gain", F.greatest(end - F.greatest("start", before), F.lit(0)))
    new = new.select("doc_id", "th", none.cast("long").alias("n_words"), F.col("gain").cast("long").alias("gain"), none.cast("string").alias("item"))
    named = hits.select("doc_id", "th", "wid").distinct().join(maybe_broadcast(cut(of_items)), "wid").where("item_id IS NOT NULL")
    named = named.select("doc_id", "th", none.cast("long").alias("n_words"), F.lit(0).cast("long").alias("gain"), F.col("item_id").cast("string").alias("item"))
    rows = rows.select("doc_id", "th", "n_words", F.lit(0).cast("long").alias("gain"), none.cast("string").alias("item"))
    got = rows.unionByName(new).unionByName(named).groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"), F.sum("gain").alias("n_hit"), F.count("n_words").alias("copies"), F.array_sort(F.collect_set("item")).alias("ids")
    )
    got = got.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return got.drop("copy")


ORACLE = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS w, array_to_string(ws[i + 1 : i + 10], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 9, 1))) AS i FROM item WHERE len(ws) > 0)),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM doc),
spot AS (
  SELECT doc_id, i, l.w, array_to_string(ws[i + 1 : i + l.w], ' ') AS s FROM pos, (SELECT DISTINCT w FROM win) l WHERE i + l.w <= len(ws)),
hit AS (SELECT doc_id, i, spot.w, item_id FROM spot JOIN win ON spot.w = win.w AND spot.s = win.s),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + w)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
