"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the words in it,
a document's the noisy-or of its sentences' scores; the weights are trained on document labels
alone, and the sentence scores then locate what makes a document toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logshield.llm.common import bounded_labels, cut, fold, slices, with_texts

#: Labelled documents of each class that are learned from at most; words that have a weight.
PER_CLASS, VOCABULARY = 10_000, 4096
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]+")
_BREAKS = frozenset(".!?;\n")
#: Known words, the sentence of each, the document of each sentence, other sentences per document.
Bags = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _word_docs(batches):
    """Per task: (word, documents labelled 1, documents labelled 0) with it."""
    by = (Counter(), Counter())
    for batch in slices(batches):
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by[1 - y].update({t for t in _TOKEN.findall(text.lower()) if t[0] not in _BREAKS})
    words = list(by[0] | by[1])
    for i in range(0, len(words), 10_000):
        part = words[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([by[0][w] for w in part], pa.int64()), pa.array([by[1][w] for w in part], pa.int64())], ["word", "pos", "neg"])


def bag(text: str | None, index: dict[str, int]) -> list[list[int]]:
    """Distinct known words of each sentence that has a word."""
    out, now, full = [], set(), False
    get = index.get
    for t in _TOKEN.findall((text or "").lower()):
        if t[0] in _BREAKS:
            if full:
                out.append(sorted(now))
                now, full = set(), False
        else:
            full = True
            k = get(t)
            if k is not None:
                now.add(k)
    if full:
        out.append(sorted(now))
    return out


def train(bags: Bags, y: np.ndarray, weight: np.ndarray, size: int, rounds: int = 400, ridge: float = 2e-5) -> np.ndarray:
    """Weights of the words and, last, the intercept: noisy-or likelihood, gradient steps (Adam)."""
    feat, of_sent, of_doc, quiet = bags
    w = np.zeros(size + 1)
    w[size] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = weight / weight.sum()
    for step in range(1, rounds + 1):
        z = np.bincount(of_sent, w[feat], len(of_doc)) + w[size]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        still = 1 / (1 + np.exp(-np.clip(w[size], -30, 30)))
        none = np.bincount(of_doc, np.log1p(-np.minimum(s, 1 - 1e-9)), len(y)) + quiet * np.log1p(-min(still, 1 - 1e-9))
        q = np.exp(none)  # no sentence offends
        d_none = np.where(y == 1, q / np.maximum(1 - q, 1e-6), -1.0) * weight
        d_z = -d_none[of_doc] * s
        g = np.concatenate([np.bincount(feat, d_z[of_sent], size), [d_z.sum() - (d_none * quiet).sum() * still]])
        g[:size] += ridge * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def _bagged(batches, words: list[str]):
    """Per document: known words, how many of them in each sentence that has one, other sentences."""
    index = {w: i for i, w in enumerate(words)}
    for batch in slices(batches):
        bags = [bag(t, index) for t in batch.column(3).to_pylist()]
        known = [[s for s in b if s] for b in bags]
        kind = pa.list_(pa.int32())
        arrays = [pa.array([[k for s in b for k in s] for b in known], kind), pa.array([[len(s) for s in b] for b in known], kind), pa.array([len(b) - len(k) for b, k in zip(bags, known, strict=True)], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *arrays], ["doc_id", "y", "weight", "feats", "sizes", "quiet"])


def _train_task(group: pa.Table, size: int) -> pa.Table:
    group = group.sort_by("doc_id").combine_chunks()
    sizes, feats = group["sizes"].combine_chunks(), group["feats"].combine_chunks()
    flat = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    of_doc = np.repeat(np.arange(len(sizes)), pc.list_value_length(sizes).to_numpy(zero_copy_only=False).astype(np.int64))
    bags = (feats.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(flat)), flat), of_doc, group["quiet"].to_numpy().astype(float))
    w = train(bags, group["y"].to_numpy().astype(float), group["weight"].to_numpy(), size)
    return pa.table({"i": pa.array(np.arange(len(w))), "w": pa.array(w)})


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, per_class: int = PER_CLASS) -> tuple[list[str], list[float]]:
    """(words, weights and intercept) learned outside the held-out fold from a bounded sample."""
    chosen = bounded_labels(labels, "toxic", mod, rest, per_class)
    sample = cut(with_texts(docs, chosen, 2 * per_class))
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(n) < 2:
        return [], [-30.0 if n.get(0, 0) or not n else 30.0]
    words = sample.select("text", "y").mapInArrow(_word_docs, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # How much better two rates explain the word than one: the likelihood ratio.
    p, q = (F.col("pos") + 0.5) / (n[1] + 1), (F.col("neg") + 0.5) / (n[0] + 1)
    both = (F.col("pos") + F.col("neg") + 1) / (n[1] + n[0] + 2)
    gain = F.col("pos") * F.log(p / both) + F.col("neg") * F.log(q / both)
    words = cut(words.where("pos + neg >= 2").withColumn("gain", gain))
    # A word must explain more labels than naming it among all candidates costs.
    words = [r["word"] for r in words.where(F.col("gain") > math.log(words.count() + 1)).orderBy(F.desc("gain"), "word").limit(VOCABULARY).collect()]
    outside = labels.where(~fold(F.col("doc_id"), mod, rest) & F.col("toxic").isNotNull())
    share = {r[0]: r[1] for r in outside.groupBy(F.col("toxic").cast("int")).count().collect()}
    weight = F.when(F.col("y") == 1, share[1] / n[1]).otherwise(share[0] / n[0])

    def trained(group):
        return _train_task(group, len(words))

    # The sample is bounded, and what one task trains on is a few numbers per document.
    bags = sample.select("doc_id", "y", weight.alias("weight"), "text").mapInArrow(
        partial(_bagged, words=words), "doc_id long, y int, weight double, feats array<int>, sizes array<int>, quiet long"
    )
    rows = bags.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(trained, "i long, w double").orderBy("i").collect()
    return words, [r["w"] for r in rows]


def _scored(batches, words: list[str], weights: list[float]):
    index, w, base = {x: i for i, x in enumerate(words)}, np.array(weights[:-1]), weights[-1]
    quiet = 1 / (1 + np.exp(-base))
    for batch in slices(batches):
        out = []
        for text in batch.column(1).to_pylist():
            sentences = bag(text, index)
            scores = [1 / (1 + np.exp(-min(max(base + float(w[s].sum()), -30), 30))) if s else quiet for s in sentences]
            best = max(range(len(scores)), key=scores.__getitem__, default=None)
            out.append((1 - float(np.exp(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum())) if scores else 0.0, len(scores), best, scores[best] if scores else None, [i for i, x in enumerate(scores) if x >= 0.5]))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "score", "n_sentences", "worst_sentence", "worst_score", "offending"])


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, worst_sentence, worst_score and the indexes
    of offending sentences (score 0.5 or more) of every row of docs(doc_id, text, ...).

    Defined cases: a text without words, or null, has score 0; with labels of one class or none
    every text with words gets that class; rows that repeat a doc_id are scored each (the text of
    least hash is learned from); ties for the worst sentence go to the first; a very long text is
    read whole, with some hundred bytes of working memory a word; other columns are ignored."""
    words, weights = fit(docs, labels, mod, rest)
    got = docs.select("doc_id", "text").mapInArrow(
        partial(_scored, words=words, weights=weights), "doc_id long, score double, n_sentences long, worst_sentence long, worst_score double, offending array<long>"
    )
    return got.select("doc_id", fold(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "worst_sentence", "worst_score", "offending")


def _appended(batches, at: int, words: list[str], weights: list[float], name: str):
    for batch in slices(batches):
        scored = next(_scored([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["doc_id", "text"])], words, weights))
        yield pa.RecordBatch.from_arrays([*batch.columns, scored.column(1)], [*batch.schema.names, name])


def scored_rows(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, name: str = "toxic_score") -> DataFrame:
    """docs with one more column `name`, the score, for filters that keep all columns; docs must
    not have a column of that name."""
    words, weights = fit(docs, labels, mod, rest)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{name}` double"
    return docs.mapInArrow(partial(_appended, at=docs.columns.index("text"), words=words, weights=weights, name=name), schema)
