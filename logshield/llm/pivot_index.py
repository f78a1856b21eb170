"""Near-duplicate vectors through a pivot-permutation index.

A bounded sample of the vectors gives reference points (pivots) that lie apart from each other. Every
vector is described by its ORDER nearest pivots, nearest first. It is entered into the inverted lists
of the first few of them, one list for each label and pivot. Two vectors of a list are candidates
if their descriptions share enough pivots; candidates are verified by their cosine. How many pivots
list a vector, and how many candidates must share, is fitted on the sample: pairs at the very threshold,
the hardest ones, must be found with a chance of RECALL or more. Nearer pairs are found more surely.

Equal vectors under one label are one node with a weight, so that copies are never compared. A list
is cut into blocks of BLOCK vectors and every two blocks are one group, so that no task holds more
than two of them. A group answers with numbers of links and a spanning forest of them, never with all
pairs. A pair that meets in several lists is counted in the first of them alone."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logshield.llm.common import cut, discard, maybe_broadcast, slices
from logshield.llm.graph import components
from logshield.llm.vectors import matrix, usual_length

#: Pivots that describe a vector, most of them that candidates must share, and the chance with which a
#: pair at the threshold is to share them and one list.
ORDER, SHARED, RECALL = 16, 6, 0.98
#: Vectors that the pivots are chosen from, and bounds of their number.
SAMPLE, LEAST, MOST = 8192, 64, 4096
#: Vectors of a block; rows and columns of candidates looked at together.
BLOCK, TILE = 2048, 256


def pivot_count(vectors: int) -> int:
    """Pivots for so many vectors: lists grow with the root of their number, up to MOST pivots."""
    return int(min(max(2 ** round(np.log2(max(vectors, 1)) / 2), LEAST), MOST))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """`count` unit vectors: those of the sample, in its order, that are no nearer to the ones before than
    a cosine that is raised until there are enough; random directions for what is missing. Pivots stay
    farther apart than vectors that link, so that near copies see them in about one order."""
    taken: list[int] = []
    near = np.full(len(sample), -1.0)
    for limit in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85):
        for i in range(len(sample)):
            if len(taken) < count and near[i] < limit:
                taken.append(i)
                near = np.maximum(near, sample @ sample[i])
                near[i] = 2
    more = np.random.default_rng(0).standard_normal((max(count - len(taken), 0), sample.shape[1]))
    return np.concatenate([sample[taken], more / np.linalg.norm(more, axis=1, keepdims=True)])


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the nearest pivots of unit vectors, nearest first."""
    far = -(x @ pivots.T)
    some = np.argpartition(far, ORDER - 1, axis=1)[:, :ORDER]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1).astype(np.int16)


def fitted(sample: np.ndarray, pivots: np.ndarray, least: float) -> tuple[int, int]:
    """(posted, shared) for vectors like those of the sample: each gets a partner at the threshold, in a
    random direction, and the pairs are looked for."""
    x = sample[:2048]
    off = np.random.default_rng(1).standard_normal(x.shape)
    off -= np.einsum("ij,ij->i", off, x)[:, None] * x
    length = np.linalg.norm(off, axis=1, keepdims=True)
    y = least * x + np.sqrt(1 - least * least) * off / np.where(length > 0, length, 1)
    a, b = nearest(x, pivots), nearest(y, pivots)
    same = a[:, :, None] == b[:, None, :]
    common = same.any(axis=2).sum(axis=1)
    shared = next((t for t in range(SHARED, 1, -1) if (common >= t).mean() >= (1 + RECALL) / 2), 1)
    posted = next((r for r in range(2, ORDER) if (same[:, :r, :r].any(axis=(1, 2)) & (common >= shared)).mean() >= RECALL), ORDER)
    return posted, shared


def _unit(batches, dim: int):
    """(vec_id, embedding, label) to the same and whether a direction can be told."""
    for batch in slices(batches, 1024):
        good, c = matrix(batch.column(1), dim)
        good[good] = (c != 0).any(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good & batch.column(2).is_valid().to_numpy(zero_copy_only=False))], ["vec_id", "embedding", "label", "told"])


def directions(vectors: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in doubles; scaled first, so that squares neither overflow nor vanish."""
    x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _described(batches, dim: int, pivots: np.ndarray):
    """Nodes with `near`, the numbers of their nearest pivots, nearest first."""
    for batch in slices(batches, 1024):
        some = nearest(directions(batch.column(batch.schema.names.index("embedding")), dim), pivots)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * ORDER), pa.array(some.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "near"])


def _masks(near: np.ndarray, pivots: int) -> np.ndarray:
    """Sets of pivots as bits."""
    bits = np.zeros((len(near), pivots), bool)
    np.put_along_axis(bits, near.astype(np.int64), True, axis=1)
    return np.packbits(np.pad(bits, ((0, 0), (0, -pivots % 64))), axis=1).view(np.uint64)


def _found(a: dict, b: dict | None, list_of: int, shared: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (row of a, row of b; of a alone if b is None) that are counted in this list."""
    other, out = b or a, []
    for i in range(0, len(a["x"]), TILE):
        for j in range(0 if b else i, len(other["x"]), TILE):
            p, q = slice(i, i + TILE), slice(j, j + TILE)
            common = np.bitwise_count(a["mask"][p, None] & other["mask"][None, q]).sum(axis=2, dtype=np.uint16)
            x, y = np.nonzero(common >= shared)
            x, y = x + i, y + j
            if b is None:
                x, y = x[x < y], y[x < y]
            # Counted under the smallest pivot that both are listed under.
            same = np.where((a["posted"][x][:, :, None] == other["posted"][y][:, None, :]).any(axis=2), a["posted"][x], np.int16(32767))
            mine = same.min(axis=1, initial=32767) == list_of
            x, y = x[mine], y[mine]
            near = np.einsum("ij,ij->i", a["x"][x], other["x"][y]) >= least
            out.append((x[near], y[near]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows by the pairs (x, y)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        np.minimum.at(low, root, low)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _linked(rows: pa.Table, dim: int, pivots: int, posted: int, shared: int, least: float) -> pa.Table:
    """Of one group of two blocks of a list, or of one: (node, links, root) of the nodes with links."""
    first, second = rows["first"][0].as_py(), rows["second"][0].as_py()
    near = rows["near"].combine_chunks()
    near = near.flatten().to_numpy(zero_copy_only=False).reshape(len(near), -1)
    x = directions(rows["embedding"].combine_chunks(), dim)
    mask, under = _masks(near, pivots), near[:, :posted]
    part = rows["block"].to_numpy()
    one, two = np.flatnonzero(part == first), np.flatnonzero(part == second)
    take = lambda i: {"x": x[i], "mask": mask[i], "posted": under[i]}
    p, q = _found(take(one), None if first == second else take(two), rows["pivot"][0].as_py(), shared, least) if len(one) and len(two) else (np.zeros(0, int), np.zeros(0, int))
    p, q = one[p], two[q]
    weight, links = rows["weight"].to_numpy(), np.zeros(len(rows), np.int64)
    np.add.at(links, p, weight[q])
    np.add.at(links, q, weight[p])
    node = rows["node"].to_numpy()
    hit = np.flatnonzero(links)
    return pa.table({"node": node[hit], "links": links[hit], "root": node[_forest(len(rows), p, q)][hit]})


def near_duplicates(rows: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of rows(vec_id, embedding, label).

    Rows link if their labels are equal and the cosine of their vectors, in doubles, is `least` or
    more. n_links counts the other rows linked directly, component_id is the smallest vec_id
    reachable, kept tells vec_id = component_id.

    Defined cases: rows without a label or a vec_id, and vectors that are null, empty, zero, of another
    length than most or hold null or non-finite entries link with nothing and are components of their
    own (one without vec_id has component_id null and is not kept); rows that repeat a vec_id are
    vectors of their own, each with its links; equal vectors are all linked; other columns are
    ignored; an empty table gives no rows."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    vector, label = (rows.schema[c].dataType.simpleString() for c in ("embedding", "label"))
    rows = rows.select("vec_id", "embedding", "label")
    dim = usual_length(rows, "embedding")
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not dim:
        return alone
    # -0.0 becomes 0.0, so that equal vectors hash alike.
    zero = F.lit(0).cast(rows.schema["embedding"].dataType.elementType)
    rows = rows.withColumn("embedding", F.transform("embedding", lambda c: c + zero))
    told = rows.mapInArrow(partial(_unit, dim=dim), f"vec_id {kind}, embedding {vector}, label {label}, told boolean")
    told = told.withColumn("told", F.col("told") & F.col("vec_id").isNotNull()).withColumns({f"h{i}": F.xxhash64(F.lit(i), "label", "embedding") for i in range(2)})
    nodes = told.where("told").groupBy("label", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.min("h0").alias("h0"), F.min("h1").alias("h1"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    count = nodes.count()
    if not count:
        return alone

    # The bounded sample: those of smallest hash, whatever their label.
    sample = nodes.orderBy("h0", "h1").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    sample = directions(sample, dim)
    pivots = choose_pivots(sample, pivot_count(count))
    posted, shared = fitted(sample, pivots, least)
    described = nodes.select("node", "label", "weight", "embedding").mapInArrow(partial(_described, dim=dim, pivots=pivots), f"node long, label {label}, weight long, embedding {vector}, near array<short>")
    described = cut(described)
    listed = described.withColumn("pivot", F.explode(F.slice("near", 1, posted)))
    sizes = listed.groupBy("label", "pivot").agg(F.count("*").alias("k")).where("k > 1")
    sizes = cut(sizes.select("label", "pivot", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")))
    dealt = listed.join(maybe_broadcast(sizes), ["label", "pivot"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "pivot", "node", "weight", "embedding", "near", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    many = len(pivots)

    def link(group: pa.Table) -> pa.Table:
        return _linked(group, dim, many, posted, shared, least)

    found = cut(dealt.groupBy("label", "pivot", "first", "second").applyInArrow(link, "node long, links long, root long"))

    links = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(links)
    named = nodes.select("node", "least", "weight", "h0", "h1").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(roots, "node", "left")
    named = cut(named.select("h0", "h1", "least", F.coalesce("root", "node").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "root").select("h0", "h1", "n_links", "component_id")
    got = told.select("vec_id", "told", "h0", "h1").join(named, ["h0", "h1"], "left")
    linked = F.col("told") & F.col("component_id").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("vec_id"))
    got = got.select("vec_id", F.when(linked, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"))
    discard(described, sizes)
    return got.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, e -> e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, e -> e <> 0)) > 0),
link AS MATERIALIZED (SELECT a.r AS p, b.r AS q, b.vec_id AS other FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT p, q, other FROM link UNION SELECT reach.p, link.q, link.other FROM reach JOIN link ON reach.q = link.p),
lowest AS (SELECT p, min(other) AS least FROM reach GROUP BY p),
n AS (SELECT p, count(*) AS k FROM link GROUP BY p)
SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(l.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(l.least, vec_id)) AS kept
FROM v LEFT JOIN n ON n.p = r LEFT JOIN lowest l ON l.p = r
"""
