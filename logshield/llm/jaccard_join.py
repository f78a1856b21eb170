"""Exact Jaccard self-join on word shingles: universe partition and pigeonhole.

Two sets of sizes p and q with Jaccard similarity of t or more differ in at most H tokens,
H = (p + q)(1 - t) / (1 + t) rounded down. Sizes are cut into bands so that partners lie in
the same or the next band. For each band the token universe is hashed into H + 1 units and a
few to spare, held by groups of three kinds; a group that forgives k differences takes k + 1 units:

* E, one unit: the segment itself is indexed (finds pairs with no difference in it);
* S, two units: the segment is cut in three and each pair of parts is indexed, a subset of
  segments (finds pairs with one difference in it at most);
* N, two units: the segment and each of its one-deletion neighbours are indexed (the same).

By the pigeonhole principle two similar sets agree on some key. The kinds of a band are chosen
by cost: index rows plus expected verifications, which grow with the square of the band's rows.

Keys of no token at all would put all sets of a band that are empty there into one bucket, so
they are left out: a set whose groups with such a key hold no more units than are to spare still
agrees with each partner on some other group. The few sets with more of them ("poor" ones) are
also partitioned by a second and a third hash; two partners are found by the first hash under which
either of them is not poor. Sets that are poor under all three index the empty keys of the last.

Groups of copies are never expanded. Equal sets are one node from the start, buckets with the same
members are one; unlike sets whose 64-bit ids agree are told apart by size and sketch and get other
ids. Nodes are verified against two hubs of their bucket, its least and its largest node, and those
still apart against a few more; only pairs of nodes of one bucket that are not connected by then, and that a 512-bit parity sketch
(a lower bound of the true difference) does not rule out, are verified after that. All verification
is by intersection of the whole sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from functools import partial, reduce
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logshield.llm.common import Words, chunks, cut, discard, lower_ascii, maybe_broadcast, mix, release, spaced
from logshield.llm.graph import components

#: Ids up to which the documents to verify are picked by a broadcast (16 MB), beyond by a shuffle.
PICK_ROWS = 2_000_000
#: Rows of one bucket that one task pairs with each other; larger buckets are dealt in blocks.
BLOCK = 1024
#: Parts in which keys are made and moved, one after the other: disk holds the keys of one part.
PARTS = 2
#: Rounds in which sets that are apart meet a further hub.
HUBS = 3
#: Hashes of the universe that poor sets are tried by.
SEEDS = 3
#: Cost model: chance that a token of a loosely related pair agrees, share of such pairs,
#: cost of a verification in index rows.
AGREE, RELATED, VERIFY = 0.66, 1e-4, 20.0


def hamming(p: int, q: int, num: int, den: int) -> int:
    """Most differing tokens of sets of sizes p and q with Jaccard >= num / den."""
    return (p + q) * (den - num) // (den + num)


def bands(largest: int, num: int, den: int) -> list[int]:
    """First size of each band, up to a band that starts above `largest`."""
    first = [1]
    while first[-1] <= largest:
        first.append(max(first[-1] + 1, first[-1] * den // num + 1))
    return first


def spare(least: int, size: int, kind: str) -> int:
    """Units beyond `least` that few sets of `size` tokens exceed by groups with an empty key:
    their expected number and one and a half deviations, for groups of one kind."""
    units, wide = least, 1 if kind == "E" else 2
    for _ in range(4):
        t = size / units
        empty = {"E": exp(-t), "S": 3 * exp(-4 * t / 3) - 2 * exp(-2 * t), "N": (1 + 2 * t) * exp(-2 * t)}[kind]
        units = least + ceil(units * empty + 1.5 * sqrt(units * empty * wide))
    return units - least


def allocate(least: int, size: int, rows: int, kinds: str = "ESN") -> tuple[int, int, int, int]:
    """(E, S, N) groups and units to spare of a band that needs `least` units, sets of `size` tokens
    or more and `rows` sets. `kinds` limits the choice (tests force each)."""
    near = RELATED * rows * rows / 2 * VERIFY
    found = []
    for kind in kinds:
        more = spare(least, size, kind)
        two, one = divmod(least + more, 2)
        t = size / (least + more)
        if kind == "E" or not two:
            cost, groups = (least + more) * (rows + near * AGREE**t), (least + more, 0, 0)
        elif kind == "S":
            cost, groups = (3 * two + one) * rows + near * (3 * two * AGREE ** (4 * t / 3) + one * AGREE**t), (one, two, 0)
        else:
            cost, groups = (two * (1 + 2 * t) + one) * rows + near * (two * 2 * t * AGREE ** (2 * t - 1) + one * AGREE**t), (one, 0, two)
        found.append((cost, (*groups, more)))
    return min(found)[1]


def plan(sizes: dict[int, int], num: int, den: int, kinds: str = "ESN") -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Bands and their groups, from the number of sets by size."""
    first = bands(max(sizes, default=1), num, den)
    groups = []
    for a, b in zip(first, first[1:] + [first[-1] * den // num + 1], strict=True):
        most = hamming(b - 1, (b - 1) * den // num, num, den)
        rows = sum(n for s, n in sizes.items() if a <= s < b)
        groups.append(allocate(most + 1, a, rows, kinds) if most else (0, 0, 0, 0))
    return first, groups


def _sets(raw: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each begins."""
    raw = lower_ascii(raw)
    w = Words(raw, off, spaced(raw))
    n = w.counts
    h = w.hash
    k = len(h)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(k - words + 1, 0), np.uint64)
        for j in range(words):
            acc += h[j : k - words + 1 + j] * mix(np.uint64([j + 1]))[0]
    acc = mix(acc)
    out, first = [], np.zeros(len(n) + 1, np.int64)
    for d, (a, c) in enumerate(zip(w.first[:-1].tolist(), n.tolist(), strict=True)):
        if c >= words:
            s = np.unique(acc[a : a + c - words + 1])
        elif c:
            x = np.uint64(c)
            with np.errstate(over="ignore"):
                for j in range(c):
                    x = x * np.uint64(0xD6E8FEB86659FD93) + h[a + j]
            s = mix(np.array([x], np.uint64))
        else:
            first[d + 1] = first[d]
            continue
        out.append(s)
        first[d + 1] = first[d] + len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), first


def _reduce(op, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    got = np.zeros(len(first) - 1, np.uint64)
    full = first[1:] > first[:-1]
    if full.any():
        got[full] = op.reduceat(values, first[:-1][full])
    return got


#: Bits of a node's id (tests take few, to see ids clash).
NODE_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)


def _nodes(s: np.ndarray, first: np.ndarray, taken: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit id of each whole set. Of each id in `taken`, which unlike sets were found to share,
    the sets have ids by another hash, as often as `taken` has grown."""
    n = np.diff(first).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = _reduce(np.add, mix(s ^ np.uint64(0x243F6A8885A308D3)), first)
        y = _reduce(np.bitwise_xor, mix(s + np.uint64(0x13198A2E03707344)), first)
        out = mix(x * np.uint64(3) + y + n) & NODE_BITS
        for _ in range(len(taken)):
            again = np.isin(out, np.array(taken, np.int64).view(np.uint64))
            if not again.any():
                break
            out[again] = mix(x[again] ^ mix(y[again] + n[again] + out[again]))
    return out


def _describe(batches, words: int, taken: tuple[int, ...] = ()):
    for batch in batches:
        for a, k, raw, off in chunks(batch.column(1)):
            s, first = _sets(raw, off, words)
            bit = np.uint64(1) << (s & np.uint64(63))
            lane = (s >> np.uint64(6)) & np.uint64(7)
            cols = [*(c.slice(a, k) for i, c in enumerate(batch.columns) if i != 1), pa.array(np.diff(first)), pa.array(_nodes(s, first, taken).view(np.int64))]
            cols += [pa.array(_reduce(np.bitwise_xor, np.where(lane == j, bit, np.uint64(0)), first).view(np.int64)) for j in range(8)]
            yield pa.RecordBatch.from_arrays(cols, [*(c for c in batch.schema.names if c != "text"), "n", "node", *(f"p{j}" for j in range(8))])


def _whole(batches, words: int, taken: tuple[int, ...] = ()):
    for batch in batches:
        for _, k, raw, off in chunks(batch.column(1)):
            s, first = _sets(raw, off, words)
            sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(s, first, taken).view(np.int64)), sets], ["node", "tokens"])


def _expand(first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of the picked sets, and the index in `pick` of each."""
    size = first[pick + 1] - first[pick]
    start = np.repeat(first[pick] - (np.cumsum(size) - size), size)
    return start + np.arange(int(size.sum())), np.repeat(np.arange(len(pick)), size)


def _segment_keys(s: np.ndarray, first: np.ndarray, pick: np.ndarray, at: np.ndarray, grp: np.ndarray, seed: int, empty: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the picked sets, each in band `at`, under one hash of the universe; the index in
    `pick` of each key; and which of the picked are poor. With `empty`, poor ones have their
    keys of no token too."""
    pos, own = _expand(first, pick)
    x = s[pos]
    e, t, n = (grp[at][:, j] for j in range(3))
    slots = e + 3 * t + n
    base = np.concatenate([[0], np.cumsum(slots)])
    third = (mix(x ^ np.uint64(0x452821E638D01377 + seed)) % (3 * e + 6 * t + 6 * n)[own].astype(np.uint64)).astype(np.int64)
    eo, to = e[own], t[own]
    y = third - 3 * eo
    slot = np.where(y < 0, third // 3, np.where(y < 6 * to, eo + y // 2, eo + 3 * to + (y - 6 * to) // 6))
    tok = mix(x + np.uint64(0xA4093822299F31D0))
    sums = np.zeros(int(base[-1]), np.uint64)
    held = np.bincount(base[own] + slot, minlength=int(base[-1]))
    of = np.repeat(np.arange(len(pick)), slots)
    j = np.arange(int(base[-1])) - base[of]
    is_e, is_n = j < e[of], j >= (e + 3 * t)[of]
    keys, owner, void = [], [], []
    with np.errstate(over="ignore"):
        np.add.at(sums, base[own] + slot, tok)
        tag = lambda i, j, kind: mix(at[i].astype(np.uint64) * np.uint64(0x9E3779B1) + j.astype(np.uint64) * np.uint64(4 * SEEDS) + np.uint64(4 * seed + kind))
        for mask, kind in ((is_e, 0), (is_n, 2)):
            keys.append(mix(sums[mask] + tag(of[mask], j[mask], kind)))
            owner.append(of[mask])
            void.append(held[mask] == 0)
        head = np.flatnonzero(~is_e & ~is_n & ((j - e[of]) % 3 == 0))
        for p, q in ((0, 1), (1, 2), (0, 2)):
            keys.append(mix(mix(sums[head + p]) + np.uint64(3) * sums[head + q] + tag(of[head], j[head] + p, 1 if q - p == 1 else 3)))
            owner.append(of[head])
            void.append(held[head + p] + held[head + q] == 0)
        one = slot >= (e + 3 * t)[own]
        if one.any():
            o, sl = own[one], slot[one]
            keys.append(mix(sums[base[o] + sl] - tok[one] + tag(o, sl, 2)))
            owner.append(o)
            void.append(held[base[o] + sl] == 1)
    parts = (held[head] == 0).astype(int) + (held[head + 1] == 0) + (held[head + 2] == 0)
    waste = np.bincount(of[is_e & (held == 0)], minlength=len(pick)) + 2 * np.bincount(of[is_n & (held <= 1)], minlength=len(pick)) + 2 * np.bincount(of[head[parts >= 2]], minlength=len(pick))
    poor = waste > grp[at][:, 3]
    keys, owner, void = np.concatenate(keys), np.concatenate(owner), np.concatenate(void)
    use = ~void | (poor[owner] if empty else False)
    return keys[use], owner[use], poor


def _keys(batches, words: int, band_first: list[int], groups: list[tuple[int, int, int, int]], taken: tuple[int, ...] = (), part: int = 0):
    """The keys that leave `part` modulo PARTS, each with its node."""
    edge, grp = np.array(band_first), np.array(groups, np.int64)
    for batch in batches:
        for _, _, raw, off in chunks(batch.column(1)):
            s, first = _sets(raw, off, words)
            size, node = np.diff(first), _nodes(s, first, taken)
            row = np.sort(np.unique(node, return_index=True)[1])
            row = row[size[row] > 0]
            band = np.searchsorted(edge, size[row], "right") - 1
            pick, at = np.concatenate([row, row[band > 0]]), np.concatenate([band, band[band > 0] - 1])
            use = grp[at][:, :3].sum(axis=1) > 0
            pick, at = pick[use], at[use]
            for seed in range(SEEDS):
                if not len(pick):
                    break
                keys, owner, poor = _segment_keys(s, first, pick, at, grp, seed, seed == SEEDS - 1)
                here = keys % np.uint64(PARTS) == np.uint64(part)
                keys, nodes = keys[here], node[pick][owner[here]]
                for i in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].view(np.int64)), pa.array(nodes[i : i + (1 << 16)].view(np.int64))], ["key", "node"])
                pick, at = pick[poor], at[poor]


def _similar(num: int, den: int, common, total):
    return F.lit(den) * common >= F.lit(num) * (total - common)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, num: int, den: int, taken: tuple[int, ...] = ()) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets are similar enough, read from the texts of
    the nodes in them."""
    some = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", "doc_id"))
    texts = docs.join(maybe_broadcast(some.select("doc_id").distinct(), some.count(), PICK_ROWS), "doc_id", "left_semi")
    sets = cut(texts.mapInArrow(partial(_whole, words=words, taken=taken), "node long, tokens array<long>"))
    # Only rows that share a doc_id bring a set twice; else sets are not moved for this.
    if not sets.groupBy("node").count().where("count > 1").isEmpty():
        sets, was = cut(sets.dropDuplicates(["node"])), sets
        discard(was)
    # One set of a pair goes to the other; both leave the place they are read at only for that.
    k = pairs.count()
    x = sets.join(maybe_broadcast(pairs, k), F.col("node") == F.col("a")).select("a", "b", F.col("tokens").alias("x"))
    y = sets.join(maybe_broadcast(pairs.select(F.col("b").alias("node")).distinct(), k), "node", "left_semi").select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    links = cut(x.join(y, "b").where(_similar(num, den, F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y"))).select("a", "b"))
    discard(some, sets)
    release(docs.sparkSession)
    return links


def _once(docs: DataFrame, told: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of docs that bring each set, without most of its copies: those whose doc_id stands for no
    set go. The shorter one of two lists of doc_ids tells them; if both are long, all rows stay."""
    reps = nodes.select("doc_id").distinct()
    ids = told.where("n > 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    n = reps.count()
    more = ids.count() - n
    if not more or min(n, more) > PICK_ROWS:
        return docs
    if n < more:
        return docs.join(F.broadcast(cut(reps)), "doc_id", "left_semi")
    return docs.join(F.broadcast(cut(ids.join(reps, "doc_id", "left_anti"))), "doc_id", "left_anti")


def _possible(num: int, den: int, x: str, y: str):
    """No proof against the pair: sizes within the bound, and the sketches within the difference."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.p{j}").bitwiseXOR(F.col(f"{y}.p{j}"))) for j in range(1, 8)), F.bit_count(F.col(f"{x}.p0").bitwiseXOR(F.col(f"{y}.p0"))))
    return (F.lit(num) * n <= F.lit(den) * m) & (F.lit(num) * m <= F.lit(den) * n) & (apart * F.lit(den + num) <= (n + m) * F.lit(den - num))


def jaccard_components(
    docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, kinds: str = "ESN", rows: bool = False
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text, ...).

    A row's set: its distinct shingles of `words` words (split at ASCII white space, A-Z
    lower-cased); with fewer words, the whole sequence as one; none without words or text.
    Rows with den * intersection >= num * union are linked; component_id is the smallest
    doc_id reachable. Defined cases: a null or empty text has no shingles and is its own
    component; a row without doc_id gets its n_shingles and a null component_id and links
    nothing; rows repeating a doc_id are joined by text as any other rows, so each carries
    the smallest doc_id reachable from its own text; a similarity on the threshold links; a very
    long text is read whole, at some fifty bytes of working memory a byte; other columns of docs
    are ignored; an empty table gives no rows.

    With `rows`: (doc_id, th, first) instead, th being the xxhash64 of the row's text and first
    the smallest (doc_id, th) of its component; null if it is alone by definition."""
    docs = docs.select("doc_id", "text")
    keyed = docs.withColumn("th", F.xxhash64("text")) if rows else docs
    lanes, taken = [f"p{j}" for j in range(8)], ()
    while True:
        told = cut(keyed.mapInArrow(partial(_describe, words=words, taken=taken), "doc_id long, " + "th long, " * rows + "n long, node long, " + ", ".join(f"{c} long" for c in lanes)))
        # Rows of one id are one set: as large, and alike in all 512 bits of the sketch.
        differ = " OR ".join(f"min({c}) <> max({c})" for c in ("n", *lanes))
        nodes = told.where("n > 0 AND doc_id IS NOT NULL").groupBy("node")
        least = F.min(F.struct("doc_id", "th") if rows else F.col("doc_id")).alias("rep")
        nodes = cut(nodes.agg(least, *(F.max(c).alias(c) for c in ("n", *lanes)), F.expr(differ).alias("differ")).withColumn("doc_id", F.col("rep.doc_id" if rows else "rep")))
        clash = [r["node"] for r in nodes.where("differ").select("node").collect()]
        if not clash:
            break
        # Ids of 64 bits: some one in 10^10 texts.
        discard(told, nodes)
        taken = (*taken, *clash)
    nodes = nodes.drop("differ")
    told = told.select("doc_id", *["th"] * rows, "n", "node")

    # Sets by power-of-1.02 size class are few rows, whatever the number of documents.
    counted = nodes.groupBy(F.floor(F.log(1.02, F.col("n").cast("double"))).alias("c")).agg(F.max("n").alias("n"), F.count("*").alias("k")).collect()
    first, groups = plan({r["n"]: r["k"] for r in counted}, num, den, kinds)
    # Keys of two sets or more are a small part of all keys. Keys are moved once, and their files go
    # before the next are made.
    once, of_key, found = _once(docs.where("doc_id IS NOT NULL"), told, nodes), Window.partitionBy("key"), []
    for part in range(PARTS):
        entries = once.mapInArrow(partial(_keys, words=words, band_first=first, groups=groups, taken=taken, part=part), "key long, node long")
        entries = entries.select("key", "node", F.min("node").over(of_key).alias("b"), F.max("node").over(of_key).alias("a"))
        found.append(cut(entries.where("b < a").select("key", "node").distinct()))
        release(docs.sparkSession)
    members = reduce(DataFrame.union, found)
    # Buckets with the same members (their number, least, largest and 128 bits of all) are one.
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"s{i}") for i in range(2)]
    buckets = cut(members.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("a"), F.count("*").alias("k"), *same).where("b < a"))
    large = buckets.where("k > 2").groupBy("k", "a", "b", "s0", "s1").agg(F.min("key").alias("key")).select("key", "a", "b")
    large = cut(members.join(maybe_broadcast(cut(large)), "key"))
    to_hub = lambda hub: large.where(f"node <> {hub}").select(F.greatest("node", hub).alias("a"), F.least("node", hub).alias("b"))
    pairs = buckets.where("k = 2").select("a", "b").union(to_hub("a")).union(to_hub("b")).distinct()
    pairs = pairs.join(nodes.alias("x"), F.col("a") == F.col("x.node")).join(nodes.alias("y"), F.col("b") == F.col("y.node"))
    pairs = cut(pairs.where(_possible(num, den, "x", "y")).select("a", "b"))
    discard(*found, buckets)
    if pairs.isEmpty():
        return _labelled(told, nodes, None, rows)
    # A set is in many buckets and meets many hubs of one group: the least one first, others only if that
    # has not joined them.
    near = cut(pairs.groupBy("a").agg(F.min("b").alias("b")))
    links = _verified(near, docs, nodes, words, num, den, taken)
    known = components(links)
    root = lambda x: known.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    some = pairs.join(near, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    some = cut(some.where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b"))
    if not some.isEmpty():
        more = _verified(some, docs, nodes, words, num, den, taken)
        if not more.isEmpty():
            known = components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    discard(near, some)

    # Loose groups: sets that are still apart from others of their bucket meet more hubs, another one in
    # every bucket and round, before pairs are looked at.
    tried = pairs.select("a", "b")
    for k in range(HUBS):
        left = large.join(known, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
        hub = F.min_by(F.struct("node", "comp"), F.xxhash64("node", "key", F.lit(k))).alias("hub")
        mixed = left.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), hub).where("c0 < c1")
        some = left.join(mixed.select("key", "hub"), "key").where("comp <> hub.comp").select(F.greatest("node", "hub.node").alias("a"), F.least("node", "hub.node").alias("b")).distinct()
        some = some.join(tried, ["a", "b"], "left_anti").join(nodes.alias("x"), F.col("a") == F.col("x.node")).join(nodes.alias("y"), F.col("b") == F.col("y.node"))
        some = cut(some.where(_possible(num, den, "x", "y")).select("a", "b"))
        if some.isEmpty():
            continue
        tried = tried.union(some)
        more = _verified(some, docs, nodes, words, num, den, taken)
        if not more.isEmpty():
            known = components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    # What is left of the exact work: pairs of one bucket that are still apart.
    left = large.join(known, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    mixed = left.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("k")).where("c0 < c1")
    left = cut(left.join(mixed.select("key", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "key").join(nodes.drop("rep", "doc_id"), "node"))
    x = left.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).alias("x")
    y = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & apart & _possible(num, den, "x", "y"))
    # Pairs with a hub are settled.
    rest = cut(rest.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    more = None if rest.isEmpty() else _verified(rest, docs, nodes, words, num, den, taken)
    if more is not None and not more.isEmpty():
        known = components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    discard(links, large, pairs, left, rest)
    return _labelled(told, nodes, known, rows)


def _labelled(told: DataFrame, nodes: DataFrame, roots: DataFrame | None, rows: bool = False) -> DataFrame:
    if roots is None:
        named = nodes.select("node", F.col("rep").alias("component_id"))
    else:
        of = nodes.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
        of = cut(of)
        least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = of.join(least, "root").select("node", "component_id")
    got = told.select("doc_id", "n", "node", *["th"] * rows).join(named, "node", "left")
    if rows:
        return got.select("doc_id", "th", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component_id")).alias("first"))
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
spot AS (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 3], ' ') AS s FROM spot),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS MATERIALIZED (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
edge AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM edge UNION SELECT r.x, b.y FROM reach r JOIN edge b ON r.y = b.x),
lowest AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN lowest l ON l.x = d.doc_id
"""
