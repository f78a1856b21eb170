"""Language identification of mixed-language text.

The script of a word narrows the candidates to languages seen in that script; each candidate
scores the word by its character n-grams; a Viterbi path over the words, with a penalty for
each switch of language, labels spans. The document's language is that of most letters.

The search is left out where it cannot find better than the single best language. Let g be the
largest gain of any run of words in any other language. A path that visits the best language
and r runs in others has r switches or more and gains at most r g, so it is no better if g is at
most one penalty. A path without the best language has r - 1 switches and r of 2 or more (one alone
is a worse single language): it is no better if g is at most half a penalty, or if the sum over all
words of the best other language's lead is at most one penalty.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logshield.llm.common import Words, chunks, fold, maybe_broadcast, mix

#: About so many documents of each language are learned from at most.
PER_LANGUAGE = 3000
#: Buckets of n-grams, their lengths in bytes, nats per switch, least share of a script.
BUCKETS, ORDERS, SWITCH, SCRIPT_SHARE = 1 << 15, (3, 4), 12.0, 0.01
# First code points of script ranges and the script each begins (fixed values of Unicode).
_RANGES = ((0, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x590, 4), (0x600, 5), (0x750, 6), (0x900, 7), (0x980, 8), (0xE00, 9), (0xE80, 10), (0x10A0, 11), (0x1100, 12), (0x1200, 10), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x2E80, 13), (0x3040, 14), (0x3100, 13), (0x3130, 12), (0x3200, 13), (0xAC00, 12), (0xD7B0, 10), (0xF900, 13), (0xFB00, 0), (0x10000, 10), (0x20000, 13))
SCRIPTS = 15


class Letters:
    """The words of a chunk (letters; rows padded by a space) with their scripts and n-grams."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        k = len(off) - 1
        self.off = off + np.arange(1, k + 2)
        raw = np.insert(np.insert(raw, off[1:], 32), 0, 32)
        self.off[0] = 1
        inside = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
        edges = np.clip(np.concatenate([[0], self.off[1:]]), 0, len(raw))
        w = Words(raw, edges, inside, hashed=False)
        self.start, self.end, self.first = w.start, w.end, w.first
        self.text = np.where(inside, raw, 32).astype(np.uint64)

    def scripts(self) -> np.ndarray:
        b = [np.where(self.start + j < self.end, self.text[np.minimum(self.start + j, len(self.text) - 1)], 0).astype(np.int64) & (0xFF if j == 0 else 0x3F) for j in range(4)]
        code = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 0x1F) << 6 | b[1], np.where(b[0] < 0xF0, (b[0] & 0xF) << 12 | b[1] << 6 | b[2], (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3])))
        return np.array([s for _, s in _RANGES])[np.searchsorted([a for a, _ in _RANGES], code, "right") - 1]

    def ngrams(self):
        """For each order: buckets of the n-grams of all words (with the spaces around them), in
        order, and the word of each."""
        size = self.end - self.start + 1  # with the space after it
        pos = np.repeat(self.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        word = np.repeat(np.arange(len(size)), size)
        depth = pos - self.start[word]
        for n in ORDERS:
            ok = depth >= n - 2
            at, of = pos[ok], word[ok]
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h = (h << np.uint64(8)) | self.text[at - j]
            yield (mix(h * np.uint64(8) + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64), of


def _lower(column) -> pa.Array:
    return pc.utf8_lower(column)


def _counted(batches, index: dict[str, int]):
    total = np.zeros((len(index), BUCKETS + SCRIPTS), np.int64)
    for batch in batches:
        lang = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
        for a, k, raw, off in chunks(_lower(batch.column(0))):
            w = Letters(raw, off)
            if not len(w.start):
                continue
            of_row = np.repeat(lang[a : a + k], np.diff(w.first))
            wide = BUCKETS + SCRIPTS
            flat = np.bincount(of_row * wide + BUCKETS + w.scripts(), minlength=total.size)
            for b, of in w.ngrams():
                flat += np.bincount(of_row[of] * wide + b, minlength=total.size)
            total += flat.reshape(total.shape)
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, mod: int = 4, rest: int = 2, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities [bucket, language], allowed [script, language]), learned from
    rows with text and lang outside the held-out fold, a hash-chosen part of each language."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~fold(F.col("doc_id"), mod, rest))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros((SCRIPTS, 0), bool)
    share = docs.sparkSession.createDataFrame([(x, int(min(1.0, per_language / counts[x]) * (1 << 20))) for x in langs], "lang string, share long")
    picked = rows.join(maybe_broadcast(share, len(langs)), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 20)) < F.col("share"))
    index = {x: i for i, x in enumerate(langs)}
    # The sample is bounded; few tasks count it, each sending its table of counts.
    got = picked.select("text", "lang").repartition(8).mapInArrow(partial(_counted, index=index), "lang long, bucket long, n long")
    total = np.zeros((len(langs), BUCKETS + SCRIPTS))
    for r in got.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["lang"], r["bucket"]] = r["n"]
    grams, scripts = total[:, :BUCKETS] + 0.5, total[:, BUCKETS:]
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)).T
    allowed = (scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= SCRIPT_SHARE).T
    allowed[~allowed.any(axis=1)] = True
    return langs, logp.astype(np.float32), allowed


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word: most summed score less `switch` for each change; ties go to
    staying, then to the first language."""
    best = scores[0].astype(np.float64)
    back = np.zeros(scores.shape, np.int64)
    stay = np.arange(scores.shape[1])
    for t in range(1, len(scores)):
        top = int(best.argmax())
        keep = best >= best[top] - switch
        back[t] = np.where(keep, stay, top)
        best = np.where(keep, best, best[top] - switch) + scores[t]
    path = np.zeros(len(scores), np.int64)
    path[-1] = int(best.argmax())
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path


def _word_scores(w: Letters, logp: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    out = np.zeros((len(w.start), logp.shape[1]))
    for b, of in w.ngrams():
        if len(b):
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            out[of[begin]] += np.add.reduceat(logp[b], begin, axis=0)
    out /= len(ORDERS)
    out[~allowed[w.scripts()]] -= 1e4
    return out


def _labelled(batches, langs: list[str], logp: np.ndarray, allowed: np.ndarray, switch: float, always: bool = False):
    """`always`: search each text (tests compare)."""
    count = len(langs)
    limit = max(1 << 16, (4 << 20) // max(count, 2))
    for batch in batches:
        texts = batch.column(1)
        for a, k, raw, off in chunks(_lower(texts), limit):
            w = Letters(raw, off)
            pred, score, spans = ["und"] * k, np.zeros(k), [[] for _ in range(k)]
            if count and len(w.start):
                s = _word_scores(w, logp, allowed)
                n = np.diff(w.first)
                total = np.zeros((len(s) + 1, count))
                np.cumsum(s, axis=0, out=total[1:])
                top = (total[w.first[1:]] - total[w.first[:-1]]).argmax(axis=1)
                own = np.repeat(np.arange(k), n)
                lead = s - s[np.arange(len(s)), top[own]][:, None]
                # Largest gain of a run of words, per language: running sum less its running least.
                run = np.cumsum(lead, axis=0)
                prior = run - lead
                shift = (np.abs(run).max() * 2 + 1) * own[:, None]
                gain = (run - (np.minimum.accumulate(prior - shift, axis=0) + shift)).max(axis=1)
                most = np.zeros(k)
                np.maximum.at(most, own, gain)
                lead[np.arange(len(s)), top[own]] = -np.inf
                away = np.bincount(own, lead.max(axis=1), k)
                settled = (most <= switch / 2) | ((most <= switch) & (away <= switch))
                size = w.end - w.start
                for d in np.flatnonzero(n).tolist():
                    p, q = w.first[d], w.first[d + 1]
                    text = None
                    if settled[d] and not always:
                        pred[d], score[d], spans[d] = langs[top[d]], 1.0, [(0, int(q - p), langs[top[d]])]
                    else:
                        path = viterbi(s[p:q], switch)
                        letters = np.bincount(path, size[p:q], count)
                        best = int(letters.argmax())
                        cut_at = np.flatnonzero(np.diff(path, prepend=-1))
                        ends = np.append(cut_at[1:], q - p)
                        pred[d], score[d] = langs[best], float(letters[best] / letters.sum())
                        spans[d] = [(int(x), int(y - x), langs[path[x]]) for x, y in zip(cut_at, ends, strict=True)]
                    # Non-ASCII characters count as word bytes above; without a letter it is und.
                    if not ((w.text[w.start[p:q]] < 128).any()):
                        text = texts[a + d].as_py()
                        if not any(c.isalpha() for c in text):
                            pred[d], score[d], spans[d] = "und", 0.0, []
            arrays = [batch.column(0).slice(a, k), pa.array(pred), pa.array(score), pa.array([[{"first_word": x, "words": y, "lang": z} for x, y, z in r] for r in spans], pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "spans"])


def languages(docs: DataFrame, mod: int = 4, rest: int = 2, switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of letters in lang_pred) and spans (first word,
    words, language) of every row of docs(doc_id, text, lang, ...).

    Defined cases: a null text, or one without letters, is und with score 0; rows with a null lang
    are predicted, not learned from; with nothing to learn from every text is und; rows that
    repeat a doc_id are predicted each; ties go to the first language in order; a very long text is
    scored whole (its words x languages numbers); other columns are ignored."""
    langs, logp, allowed = fit(docs, mod, rest)
    schema = "doc_id long, lang_pred string, score double, spans array<struct<first_word: long, words: long, lang: string>>"
    got = docs.select("doc_id", "text").mapInArrow(partial(_labelled, langs=langs, logp=logp, allowed=allowed, switch=switch), schema)
    return got.select("doc_id", fold(F.col("doc_id"), mod, rest).alias("held_out"), "lang_pred", "score", "spans")
