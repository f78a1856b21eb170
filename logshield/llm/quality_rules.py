"""Quality rules: counts of bad layout, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into BUCKETS buckets. Two multinomials over the buckets are
counted, one over the trusted target (all documents labelled good) and one over all rows of the
corpus; a document's mean log ratio of its n-grams is compared with a fixed threshold. The model is
two vectors of a fixed length, whatever the size of the corpus.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logshield.llm.common import Words, chunks, mix, spaced, sums_by

BUCKETS = 1 << 14
#: Mean log ratio (nats per n-gram) from which a document is kept.
THRESHOLD = -0.08
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _ngrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, and of the pairs that start at each word (the last of a row: none)."""
    one = (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
    two = np.full(len(one), -1, np.int64)
    if len(one) > 1:
        with np.errstate(over="ignore"):
            pair = mix(w.hash[:-1] * np.uint64(3) + w.hash[1:])
        two[:-1] = (pair & np.uint64(BUCKETS - 1)).astype(np.int64)
        ends = w.first[1:-1]
        two[ends[ends > 0] - 1] = -1
    return one, two


def _counted(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, raw, off in chunks(batch.column(0)):
            one, two = _ngrams(Words(raw, off, spaced(raw)))
            total += np.bincount(one, minlength=BUCKETS) + np.bincount(two[two >= 0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def ngram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all n-grams by bucket: BUCKETS numbers."""
    rows = texts.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p = (target + alpha) / (target.sum() + alpha * BUCKETS)
    q = (raw + alpha) / (raw.sum() + alpha * BUCKETS)
    return np.log(p / q)


def _repeated(w: Words, size: int) -> np.ndarray:
    """Words of each row inside windows of `size` words that occur twice or more in the row."""
    h, n = w.hash, w.counts
    acc = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            acc += h[j : len(h) - size + 1 + j] * mix(np.uint64([j + 1]))[0]
    acc = mix(acc)
    out = np.zeros(len(n), np.int64)
    for d in np.flatnonzero(n > size).tolist():
        v = acc[w.first[d] : w.first[d] + n[d] - size + 1]
        s = np.sort(v)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            seen = np.zeros(n[d] + 1, np.int64)
            seen[1 : len(v) + 1] = np.isin(v, twice)
            c = np.cumsum(seen)
            out[d] = np.count_nonzero(c[1:] - np.concatenate([np.zeros(min(size - 1, n[d]), np.int64), c[: max(n[d] - size + 1, 0)]]))
    return out


def _ruled(batches, ratio: np.ndarray):
    for batch in batches:
        for a, k, raw, off in chunks(batch.column(1)):
            inside = spaced(raw)
            w = Words(raw, off, inside)
            n = w.counts
            dup = []
            for i in range(k):
                lines = [x for x in raw[off[i] : off[i + 1]].tobytes().split(b"\n") if x.strip()]
                dup.append(len(lines) - len(set(lines)))
            one, two = _ngrams(w)
            score = np.zeros(len(one) + 1)
            np.cumsum(ratio[one] + np.where(two >= 0, ratio[two], 0.0), out=score[1:])
            grams = np.maximum(2 * n - 1, 1)
            mean = (score[w.first[1:]] - score[w.first[:-1]]) / grams
            arrays = [batch.column(0).slice(a, k), *map(pa.array, (n, sums_by(inside & ((raw & 0xC0) != 0x80), off), sums_by(_SYMBOLS[raw], off), np.array(dup, np.int64), _repeated(w, 8), mean))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"])


def quality_rules(docs: DataFrame, target: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): the counts, base_failed, llr and kept.

    `target` holds the texts of the trusted target. Defined cases: a null or empty text has no
    words, fails the base rules and has an llr of 0; with an empty target all ratios are those of
    the corpus to the uniform distribution; rows that repeat a doc_id are judged each; a document on
    the threshold is kept; a very long text is read whole, at some fifty bytes of working memory a
    byte; other columns are ignored; an empty table gives no rows."""
    docs = docs.select("doc_id", "text")
    ratio = log_ratio(ngram_counts(target), ngram_counts(docs))
    got = docs.mapInArrow(partial(_ruled, ratio=ratio), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return got.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
