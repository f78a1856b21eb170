"""Shared helpers: tables, cut points, bounded broadcasts, and a vectorised word reader.

The word reader works on the UTF-8 bytes of an Arrow string column, a few MB at a time,
so that the cost per document is a handful of numpy passes and memory stays bounded.
"""

from __future__ import annotations

import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of text that the vectorised reader handles at once (one longer text: at once).
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session inside one
    process (master local, as in tests) may do without: it gets a temporary one. Elsewhere executors
    would write to disks of their own, so that is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive lost executors
    and do not run the plan above it again. What is no longer read can be discarded."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._cut = path
    return got


def discard(*tables: DataFrame) -> None:
    """Delete the files of cut tables; all that was made of them must be written by now."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._cut)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have shuffle files deleted whose tables are cut. They stay until the driver collects its garbage,
    which one with much memory rarely does by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with a number behind it if df has such a column already."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def maybe_broadcast(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if df has no more than `bound` rows, else leave the choice to Spark.
    df should be a cut table or a small aggregate: it is counted unless `rows` is given."""
    if rows is None:
        rows = df.count()
    return F.broadcast(df) if rows <= bound else df


def fold(doc_id: Column, mod: int, rest: int) -> Column:
    """True if crc32 of doc_id as text leaves `rest` modulo `mod`; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod) == F.lit(rest), F.lit(False))


def bounded_labels(labels: DataFrame, column: str, mod: int, rest: int, per_class: int) -> DataFrame:
    """(doc_id, y) of at most `per_class` labelled documents of each class outside the held-out
    fold, those with the smallest hash of doc_id: the bound of what a classifier is fitted on.
    A doc_id labelled twice counts once, with its larger label."""
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~fold(F.col("doc_id"), mod, rest))
        .groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    )
    part = lambda y: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return part(1).unionByName(part(0))


def with_texts(docs: DataFrame, chosen: DataFrame, bound: int) -> DataFrame:
    """(doc_id, text, y) of the chosen documents; `chosen` has at most `bound` rows by
    construction, so it is broadcast. Of the texts of a repeated doc_id the one with the least
    hash counts, then the least text."""
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    found = docs.join(maybe_broadcast(chosen, bound), "doc_id")
    found = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("t"))
    return found.select("doc_id", "t.text", "t.y")


def slices(batches, rows: int = 256):
    """Batches of a few rows each, without copying: what Python holds of them stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


# --- vectorised reading of words -----------------------------------------------------

#: Bytes up to which words are hashed together, eight bytes at a time; longer ones one by one.
SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64 (public domain)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of rows with about `limit` bytes of text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b - a, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word raw[start:end]. A word's length, then its bytes by eights, are mixed in
    one after the other; no two words of eight bytes or less agree. (A polynomial modulo 2^64, cheaper as
    it is, agrees on simple words such as the Thue-Morse one and its complement.)"""
    size = end - start
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    out = mix(size.astype(np.uint64))
    live = np.flatnonzero((size > 0) & (size <= SHORT))
    done = 0
    while len(live):
        left = size[live] - done
        part = eights[start[live] + done]
        cut_off = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
        out[live] = mix(out[live] ^ (part & (np.uint64(0xFFFFFFFFFFFFFFFF) >> cut_off)))
        done += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


class Words:
    """Words of a chunk: `start`, `end` (byte offsets), `first` (of each row, its first word;
    one more entry at the end) and, if asked for, `hash`."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, inside: np.ndarray, hashed: bool = True):
        n = len(raw)
        prev = np.zeros(n, bool)
        nxt = np.zeros(n, bool)
        if n:
            prev[1:] = inside[:-1]
            nxt[:-1] = inside[1:]
            edge = off[(off > 0) & (off < n)]
            prev[edge] = False
            nxt[edge - 1] = False
        self.start = np.flatnonzero(inside & ~prev)
        self.end = np.flatnonzero(inside & ~nxt) + 1
        self.first = np.searchsorted(self.start, off)
        if hashed:
            self.hash = word_hashes(raw, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def spaced(raw: np.ndarray) -> np.ndarray:
    """Which bytes are outside the space characters 0x20 and 0x09 to 0x0D."""
    return ~((raw == 32) | ((raw >= 9) & (raw <= 13)))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw)


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[k]:first[k + 1]] for each k, also where that is empty."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
