"""Compression classifier: zstandard dictionaries of good and of bad text.

A text is cut into pieces of PIECE bytes, each compressed once with either dictionary; the
difference of the summed sizes, divided by their sum, is calibrated by a logistic curve of it alone.
The bounded labelled sample is cut in halves, each with dictionaries of its own: a text's gap is the
mean of both, and the curve is fitted on the gap that each labelled text has under the other half.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logshield.llm.common import bounded_labels, cut, discard, fold, slices, with_texts

#: Labelled documents of each class that are used at most.
PER_CLASS = 2000
#: Bytes of a dictionary and of a piece; the compression level.
DICT_BYTES, PIECE, LEVEL = 110 << 10, 2048, 3


def _pieces(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def _trained(group: pa.Table) -> pa.Table:
    import zstandard

    texts = sorted(group["text"].to_pylist())
    samples = [p for t in texts for p in _pieces(t)]
    try:
        made = zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text for a trained dictionary: the text itself
        made = b"".join(samples)[-DICT_BYTES:]
    return pa.table({"half": group["half"].slice(0, 1), "y": group["y"].slice(0, 1), "made": pa.array([made], pa.binary())})


class _Sizes:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.by = []
        for d in (good, bad):
            if d:
                z = zstandard.ZstdCompressionDict(d)
                z.precompute_compress(level=LEVEL)
                self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_checksum=False, write_content_size=False, write_dict_id=False))
            else:
                self.by.append(zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False))

    def gap(self, text: str | None) -> float:
        """(bad - good) / (bad + good) of the compressed sizes, 0 for an empty text."""
        pieces = _pieces(text) if text else []
        good, bad = (sum(len(z.compress(p)) for p in pieces) for z in self.by)
        return (bad - good) / (bad + good) if pieces else 0.0


#: Good and bad dictionary of either half.
Pairs = tuple[tuple[bytes, bytes], tuple[bytes, bytes]]


def _gaps(batches, pairs: Pairs):
    sizes = [_Sizes(*p) for p in pairs]
    for batch in slices(batches):
        gaps = [[z.gap(t.as_py()) for t in batch.column(1)] for z in sizes]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(g, pa.float64()) for g in gaps)], ["doc_id", "gap0", "gap1"])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> list[float]:
    """Slopes of the columns of x and, last, the intercept of a weighted logistic regression, by
    Newton's method with bounded steps."""
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(x))])
    w, total = np.zeros(z.shape[1]), weight.sum()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) / total + ridge * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z / total + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return [*(w[:-1] / scale).tolist(), float(w[-1])]


def fit(docs: DataFrame, labels: DataFrame, column: str, mod: int, rest: int, per_class: int = PER_CLASS) -> tuple[Pairs, list[float]]:
    """(dictionaries of both halves, slope and intercept), learned outside the held-out fold."""
    chosen = bounded_labels(labels, column, mod, rest, per_class)
    sample = cut(with_texts(docs, chosen, 2 * per_class).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")))
    made = sample.select("half", "y", "text").groupBy("half", "y").applyInArrow(_trained, "half int, y int, made binary").collect()
    by = {(r["half"], r["y"]): bytes(r["made"]) for r in made}
    pairs: Pairs = tuple((by.get((h, 1), b""), by.get((h, 0), b"")) for h in (0, 1))
    gap = sample.select("doc_id", "text").mapInArrow(partial(_gaps, pairs=pairs), "doc_id long, gap0 double, gap1 double")
    other = F.when(F.col("half") == 0, F.col("gap1")).otherwise(F.col("gap0")).alias("gap")
    rows = gap.join(sample.select("doc_id", "half", "y"), "doc_id").select("doc_id", "y", other).orderBy("doc_id").collect()
    discard(sample)
    outside = labels.where(~fold(F.col("doc_id"), mod, rest) & F.col(column).isNotNull())
    share = {r[0]: r[1] for r in outside.groupBy(F.col(column).cast("int")).count().collect()}
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return pairs, [0.0, float(np.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1)))]
    weight = np.where(y == 1, share.get(1, 1) / max(y.sum(), 1), share.get(0, 1) / max((1 - y).sum(), 1))
    return pairs, logistic(np.array([[r["gap"]] for r in rows]), y, weight)


def quality(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and gap of every row of docs(doc_id, text, ...).

    Defined cases: a null or empty text has gap 0 and the curve's score there; with labels of one
    class or none the score is the share of good labels; rows that repeat a doc_id are scored each
    (the text of least hash is learned from); equal texts get equal scores; a very long text is
    compressed piece by piece; other columns are ignored; an empty table gives no rows."""
    pairs, (slope, base) = fit(docs, labels, "quality", mod, rest)
    got = docs.select("doc_id", "text").mapInArrow(partial(_gaps, pairs=pairs), "doc_id long, gap0 double, gap1 double")
    got = got.select("doc_id", ((F.col("gap0") + F.col("gap1")) / 2).alias("gap"))
    score = 1 / (1 + F.exp(-(F.col("gap") * F.lit(slope) + F.lit(base))))
    return got.select("doc_id", fold(F.col("doc_id"), mod, rest).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "gap")
