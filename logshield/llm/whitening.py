"""Whitening of integer vectors by polarisation.

For every dimension, and for the sum of every two dimensions, one number is aggregated: the exact sum
of squares over the distinct vectors, after each entry has been centred at the whole number below its
mean. With the remainder of the mean these integers give the exact sums of (n*x - S)^2, so variances
are exact fractions, and cross-covariances are half the differences
Var(x_i + x_j) - Var(x_i) - Var(x_j), exact as well. They become doubles only when the matrix is
assembled for the eigenvectors. A task holds d * (d + 1) / 2 numbers whatever its rows are, and the
driver receives as many."""

from __future__ import annotations

from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logshield.llm.common import cut, slices
from logshield.llm.vectors import matrix, usual_length

#: Entries are steps of 1/SCALE; they end at +-LARGEST steps.
SCALE, LARGEST = 256.0, 1 << 40
#: Rows handled at once, and the size of entries up to which their sums of squares fit 64 bits.
ROWS, SMALL = 4096, 1 << 23
_BIG = pa.decimal128(38, 0)


def _whole(batches, dim: int):
    """(vec_id, embedding) to (vec_id, x) of the rows that remain."""
    for batch in slices(batches, ROWS):
        good, c = matrix(batch.column(1), dim)
        x = np.clip(np.floor(c * SCALE), -LARGEST, LARGEST).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), lists], ["vec_id", "x"])


def _rows(batch: pa.RecordBatch, at: int, dim: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _told(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([Decimal(int(v)) for v in total], _BIG)], ["k", "v"])


def _totals(batches, dim: int):
    """A task's rows, and its sum of each dimension."""
    total = np.array([0] * (dim + 1), object)
    for batch in slices(batches, ROWS):
        x = _rows(batch, 0, dim)
        total[0] += len(x)
        total[1:] += x.sum(axis=0).astype(object)
    yield _told(total)


def _squares(batches, middle: list[int]):
    """A task's sums of squares, around the whole numbers `middle`: of every dimension i, each
    followed by those of i + j for the dimensions j after it."""
    dim = len(middle)
    total = np.array([0] * (dim * (dim + 1) // 2), object)
    for batch in slices(batches, ROWS):
        y = _rows(batch, 0, dim) - np.array(middle, np.int64)
        if len(y) and np.abs(y).max() > SMALL:
            y = y.astype(object)
        at = 0
        for i in range(dim):
            both = y[:, i:] + y[:, i : i + 1]
            both[:, 0] = y[:, i]
            total[at : at + dim - i] += (both * both).sum(axis=0).astype(object)
            at += dim - i
    yield _told(total)


def _summed(fit: DataFrame, task) -> list[int]:
    got = fit.mapInArrow(task, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v"))
    return [int(r["v"]) for r in sorted(got.collect(), key=lambda r: r["k"])]


def covariance(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, V) of fit(x): V has the divisor n, every entry an exact fraction before it is rounded."""
    n, *sums = _summed(fit, partial(_totals, dim=dim))
    if not n:
        return 0, [], np.zeros((0, 0))
    middle, rest = zip(*(divmod(s, n) for s in sums), strict=True)
    squares = iter(_summed(fit, partial(_squares, middle=list(middle))))
    # Sum of (n*x - S)^2 = n^2 * (sum of y^2) - n * r^2, with y centred at the middle and r = sum of y.
    spread = [[n * n * next(squares) - n * (rest[i] + (rest[j] if j > i else 0)) ** 2 for j in range(i, dim)] for i in range(dim)]
    v = np.zeros((dim, dim))
    for i in range(dim):
        v[i, i] = spread[i][0] / n**3
        for j in range(i + 1, dim):
            v[i, j] = v[j, i] = (spread[i][j - i] - spread[i][0] - spread[j][0]) / (2 * n**3)
    return n, sums, v


def _projected(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (x - mean) @ axes


def _moments(batches, mean: np.ndarray, axes: np.ndarray):
    """A task's sums of the whitened values and of their products."""
    dim, k = axes.shape
    total = np.zeros((k + 1, k))
    for batch in slices(batches, ROWS):
        w = _projected(_rows(batch, 0, dim), mean, axes)
        total[0] += w.sum(axis=0)
        total[1:] += w.T @ w
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["k", "v"])


def _identity_error(fit: DataFrame, n: int, mean: np.ndarray, axes: np.ndarray) -> float:
    got = fit.mapInArrow(partial(_moments, mean=mean, axes=axes), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    k = axes.shape[1]
    total = np.array([r["v"] for r in sorted(got, key=lambda r: r["k"])]).reshape(k + 1, k) / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n*x - S)^2; none where 64 bits do not hold one."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    kind = np.int64 if largest**2 * len(sums) < 1 << 63 else object
    gap = n * x.astype(kind) - np.array(sums, kind)
    return [v if v < 1 << 63 else None for v in map(int, (gap * gap).sum(axis=1))]


def _answers(batches, n: int, sums: list[int], axes: np.ndarray, explained: np.ndarray, error: float):
    dim, k = axes.shape
    mean = np.array([s / n for s in sums])
    for batch in slices(batches, ROWS):
        x = _rows(batch, 1, dim)
        rows = len(x)
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(rows), k)))
        far = pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
        w = _projected(x, mean, axes)
        cols = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), rows), np.full(rows * k, n, np.int64), far, w.ravel(), np.tile(explained, rows), np.full(rows * k, error)]
        yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whitened(rows: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of rows(vec_id, embedding)
    and each component up to `components`, numbered from 1 by falling eigenvalue.

    An entry c becomes x = floor(256 c). The covariance is that of the distinct x, each counted once.

    Defined cases: a row goes if its vector is null, empty, or has null or non-finite entries or another
    length than most vectors have; rows that repeat a vec_id or a vector stay, each with its values;
    a null vec_id stays null; entries beyond 2^40 in x count as +-2^40; deviation is null where it
    takes more than 63 bits; components of no variance (1e-12 of the trace or less) are left out, so
    that equal vectors, a single one or an empty table give no rows; of equal eigenvalues any basis
    serves, one for all rows; other columns are ignored."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.select("vec_id", "embedding")
    dim = usual_length(rows, "embedding")
    none = rows.sparkSession.createDataFrame([], schema)
    if not dim:
        return none
    x = rows.mapInArrow(partial(_whole, dim=dim), f"vec_id {kind}, x array<long>")
    fit = cut(x.select("x").distinct())
    n, sums, v = covariance(fit, dim)
    if not n:
        return none
    values, axes = np.linalg.eigh(v)
    order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > 1e-12 * np.trace(v)]
    if not order:
        return none
    axes, explained = axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)
    error = _identity_error(fit, n, np.array([s / n for s in sums]), axes)
    return x.mapInArrow(partial(_answers, n=n, sums=sums, axes=axes, explained=explained, error=error), schema)
