"""Ranked lexical search, term at a time, with limited accumulators.

One scan of the texts makes a forward index: each document with its length and the terms of the
queries that it holds. Posting lists are read from it rarest first, in waves: the four rarest terms of
each item, then twice as many each time. A posting adds to the accumulator of its (item,
document), or creates one. After a wave the k-th best partial score of each item is known; once
all terms that are left, at their largest possible contributions, cannot reach it, no document
without an accumulator can enter the result, and the item creates no more. Accumulators that cannot
reach the k-th partial score themselves go. The survivors are then brought up to date exactly, from
the forward index. All numbers but a term's weight are integers, so bounds are exact as well.

Frequent terms are thus never turned into accumulators where rarer ones decide; every (item,
document) pair is a key of its own, so that no posting list and no item is gathered anywhere."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logshield.llm.common import cut, discard, maybe_broadcast, slices

#: What is a term: a run of letters, digits and all that is not ASCII, A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of the queries that one scan of the texts looks for; more are looked for in several scans.
VOCABULARY = 500_000
#: Terms of each item in the first wave; every further wave takes twice as many.
FIRST = 4
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
_TERM, _GAP = re.compile(TERM.encode()), re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _pieces(text: bytes):
    """Lists of the terms of a text, a piece of it at a time, cut between terms."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, min(at + PIECE, len(text)))
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text, at, end)
        at = end + 1


def _index(known):
    """mapInArrow function: rows (doc_id, text, row) to (row, doc_id, n, terms, tfs); `known` is a broadcast of
    the wanted terms and their numbers."""

    def read(batches):
        for batch in slices(batches):
            want = known.value
            lengths, terms, tfs = [], [], []
            for text in batch.column(1):
                n, count = 0, Counter()
                for words in _pieces((text.as_py() or "").encode().lower()):
                    n += len(words)
                    count.update(map(want.get, words))
                count.pop(None, None)
                lengths.append(n)
                terms.append(list(count.keys()))
                tfs.append(list(count.values()))
            cols = [batch.column(2), batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n", "terms", "tfs"])

    return read


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, word, qtf) of items(item_id, text)."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select("item_id", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("word"))
    return words.groupBy("item_id", "word").agg(F.count("*").alias("qtf"))


def _forward(docs: DataFrame, vocabulary: DataFrame, bound: int) -> DataFrame:
    """(row, block, doc_id, n, terms, tfs), cut: a row for each document and block of the vocabulary,
    which has one block unless it is over the bound. With several, rows are numbered and written
    before the scans, so that all scans number them alike."""
    sc = docs.sparkSession.sparkContext
    blocks = max(1, -(-vocabulary.count() // bound))
    told, kind = None, docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    if blocks > 1:
        numbered = cut(numbered)
    for b in range(blocks):
        part = vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b).collect()
        known = sc.broadcast({r["word"].encode(): r["term"] for r in part})
        one = numbered.mapInArrow(_index(known), f"row long, doc_id {kind}, n long, terms array<long>, tfs array<long>")
        one = one.select("row", F.lit(b).alias("block"), "doc_id", "n", "terms", "tfs")
        told = one if told is None else told.unionByName(one)
    return cut(told)


def _posts(indexed: DataFrame, *keep: str) -> DataFrame:
    """(row, term, part) of a forward index; a part is what a term of weight 1 adds to the score."""
    got = indexed.select(*keep, "row", "m", F.inline(F.arrays_zip("terms", "tfs")))
    return got.select(*keep, "row", F.col("terms").alias("term"), F.expr("(1000000000 * tfs) div (1000 * tfs + 8 * m)").alias("part"))


def _none(docs: DataFrame, items: DataFrame) -> DataFrame:
    kinds = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    return docs.sparkSession.createDataFrame([], "item_id {}, rank int, doc_id {}, score long".format(*kinds))


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(item, theta): the k-th best score of each item that has so many."""
    best = Window.partitionBy("item").orderBy(F.desc("score"))
    return scores.withColumn("k", F.row_number().over(best)).where(f"k <= {k}").where(f"k = {k}").select("item", F.col("score").alias("theta"))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents with the highest score above 0,
    equal scores by ascending doc_id; ranks count from 1.

    docs(doc_id, text) are searched whole, items(item_id, text) are the queries. A score is the sum,
    over the item's terms with repeats, of w * ((10^9 tf) div (1000 tf + 8 m)), with
    w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 25 + (75 n N) div L; N documents have a term, L
    is all their terms, n those of the document.

    Defined cases: a null or empty text has no terms, counts nowhere and is never found; rows without
    a doc_id count in N, L and df but are not ranked; rows that repeat a doc_id are documents of their
    own and may each be ranked; rows that repeat an item_id are one item with the terms of all of
    them; an item without terms, or with none that a document holds, has no rows; very long texts
    are read whole, a megabyte of words at a time; other columns are ignored; empty tables give no
    rows."""
    wanted = cut(_item_terms(items))
    numbered = cut(wanted.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")))
    named = cut(wanted.select("item_id").distinct().select("item_id", F.monotonically_increasing_id().alias("item")))
    forward = _forward(docs, numbered, vocabulary)

    total = forward.where("block = 0 AND n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return _none(docs, items)
    m = F.expr(f"25 + (CAST(75 * n AS DECIMAL(20, 0)) * CAST({total['docs']} AS DECIMAL(18, 0))) div CAST({total['terms']} AS DECIMAL(20, 0))")
    indexed = forward.where("size(terms) > 0").select("row", "doc_id", m.alias("m"), "terms", "tfs")
    ranks = indexed.where("doc_id IS NOT NULL").drop("doc_id")

    # Each item's terms by rarity, with what all terms after a place can add at most.
    weight = F.floor(F.lit(1000) * F.log((F.lit(2.0) * total["docs"] + 2) / (F.lit(2.0) * F.col("df") + 1)))
    known = _posts(indexed).groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most")).withColumn("w", weight)
    order = Window.partitionBy("item").orderBy("df", "term")
    rest = order.rowsBetween(1, Window.unboundedFollowing)
    terms = wanted.join(numbered, "word").join(named, wanted["item_id"].eqNullSafe(named["item_id"])).join(known, "term")
    terms = terms.select("item", "term", "df", (F.col("qtf") * F.col("w")).alias("qw"), "most")
    terms = cut(terms.select("item", "term", "qw", F.row_number().over(order).alias("place"), F.coalesce(F.sum(F.col("qw") * F.col("most")).over(rest), F.lit(0)).alias("after")))
    size = terms.agg(F.max("place").alias("longest"), F.count("*").alias("n")).first()
    if not size["n"]:
        return _none(docs, items)

    added, settled, past, low, wide = None, [], [], 1, FIRST
    still = terms.select("item").distinct()
    while low <= size["longest"]:
        high, wide = low + wide - 1, 2 * wide
        wave = terms.where(f"place BETWEEN {low} AND {high}").join(still, "item", "left_semi").select("item", "term", "qw")
        hits = _posts(ranks).join(maybe_broadcast(wave, size["n"]), "term").select("item", "row", (F.col("qw") * F.col("part")).alias("score"))
        added = hits if added is None else added.unionByName(hits)
        scores = cut(added.groupBy("item", "row").agg(F.sum("score").alias("score")))
        left = terms.where(f"place <= {high}").groupBy("item").agg(F.min_by("after", -F.col("place")).alias("after")).join(still, "item", "left_semi")
        marks = cut(left.join(_kth(scores, k), "item", "left").select("item", "after", F.coalesce("theta", F.lit(0)).alias("theta")))
        # Strictly less: an equal score may still win by its doc_id.
        ended = (F.col("after") < F.col("theta")) | (F.col("after") == 0)
        kept = scores.join(maybe_broadcast(marks, size["n"]), "item").where("score + after >= theta").select("item", "row", "score", ended.alias("ended"))
        settled.append(kept.where("ended").select("item", "row", "score", F.lit(high).alias("upto")))
        added, still, low = kept.where("NOT ended").drop("ended"), marks.where(~ended).select("item"), high + 1
        past += [scores, marks]
        if still.isEmpty():
            break

    survivors = settled[0]
    for s in settled[1:]:
        survivors = survivors.unionByName(s)
    survivors = cut(survivors)
    discard(*past)
    # The terms that an item had left, brought in from the documents that survived.
    upto = survivors.groupBy("item").agg(F.min("upto").alias("upto"))
    todo = terms.where("qw > 0").join(upto, "item").where("place > upto").select("item", "term", "qw")
    late = _posts(ranks.join(maybe_broadcast(survivors.select("item", "row")), "row"), "item")
    late = late.join(maybe_broadcast(todo, size["n"]), ["item", "term"]).select("item", "row", (F.col("qw") * F.col("part")).alias("score"))
    full = survivors.select("item", "row", "score").unionByName(late).groupBy("item", "row").agg(F.sum("score").alias("score")).where("score > 0")
    full = full.join(forward.where("block = 0").select("row", "doc_id"), "row")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row")
    top = full.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    return top.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS MATERIALIZED (SELECT item_id, t, count(*) AS qtf FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
total AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
p AS MATERIALIZED (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY t, n_docs),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t), total WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(k AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0) WHERE k <= 10
"""
