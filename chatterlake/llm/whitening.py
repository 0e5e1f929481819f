"""Embedding whitening: distributed centred covariance, leading eigenpairs by tridiagonal bisection, broadcast projection.

An entry c becomes the whole number x = floor(64 c) + 1000000, so sums over the corpus can be exact: tasks multiply
x less a whole centre near the mean, add their products up without rounding, and emit one row for each pair of
dimensions, which Spark adds as decimals. What the centre lacks to the mean is taken off in whole numbers too. So the
covariance doesn't depend on how rows are dealt out. What reaches the driver is a d x d matrix, whatever the rows.

The eigenproblem of that matrix: Householder reflections make it tridiagonal, Sturm counts bisect the leading
eigenvalues, inverse iteration gives their vectors, made orthogonal within each cluster of close eigenvalues, and the
reflections are applied again.

Defined results: rows whose vector is null, is empty, holds a null, or holds an entry that isn't finite are left out, as
are entries of 2^53 / 64 or more, which have no exact x, and vectors of another length than the most frequent one (of
equally frequent ones the shortest). Repeated rows each count and each give rows; a null id stays null. Eigenvalues
that are nought beside the largest (constant or dependent dimensions, fewer rows than dimensions) give no component,
since nothing can be divided by their root: fewer than ``components`` then follow. An empty table gives an empty
result; columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.llm.shared import saved

SCALE, OFFSET = 64, 1_000_000
EXACT = float(2**53)  # below it, doubles are whole numbers without rounding
#: An eigenvalue is nought when it is this share, times the dimensions, of the largest.
NOUGHT = 1e-13


def usable(vector: str) -> Column:
    """The vector has entries, all of them finite and with an exact x. Comparisons with NaN don't help: Spark holds it greatest."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < EXACT / SCALE, F.lit(False)))
    return F.coalesce(fits & (F.size(vector) > 0), F.lit(False))


def whole(vectors: pd.Series) -> np.ndarray:
    return np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * SCALE).astype(np.int64) + OFFSET


def pair_sums(products: np.ndarray) -> pd.DataFrame:
    """The upper half of a matrix of whole numbers, a row an entry."""
    i, j = np.triu_indices(len(products))
    return pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": [Decimal(int(x)) for x in products[i, j]]})


class ExactProducts:
    """Adds up y^T y of whole-number rows without rounding: in doubles while all sums are below 2^53, then in Python's numbers."""

    def __init__(self, d: int):
        self.part, self.bound, self.total = np.zeros((d, d)), 0.0, np.zeros((d, d), dtype=object)

    def flush(self) -> None:
        self.total += self.part.astype(np.int64).astype(object)
        self.part[:], self.bound = 0, 0.0

    def add(self, y: np.ndarray) -> None:
        most = float(np.abs(y).max(initial=0)) ** 2 * len(y)
        if most >= EXACT:
            if len(y) > 1:
                self.add(y[: len(y) // 2])
                self.add(y[len(y) // 2 :])
            else:
                row = y[0].astype(object)
                self.total += np.outer(row, row)
            return
        if self.bound + most >= EXACT:
            self.flush()
        z = y.astype(np.float64)
        self.part += z.T @ z
        self.bound += most

    def sums(self) -> np.ndarray:
        self.flush()
        return self.total


@dataclass
class Moments:
    """n vectors, the exact sums S of x by dimension, and the covariance of x with divisor n."""

    n: int
    sums: list[int]
    covariance: np.ndarray


def moments(vectors: DataFrame, d: int, vector: str = "vector") -> Moments:
    """Two passes over ``vectors`` (usable ones of d entries): sums, then products of the centred."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(d, dtype=object)
        for pdf in batches:
            if len(pdf):
                n += len(pdf)
                for x in np.array_split(whole(pdf[vector]), -(-len(pdf) // 256)):  # x is below 2^54, so 256 add up in a long
                    total += x.sum(axis=0).astype(object)
        if n:
            yield pd.DataFrame({"i": np.arange(d, dtype=np.int32), "n": n, "v": [Decimal(int(t)) for t in total]})

    by_dimension = vectors.select(vector).mapInPandas(add, "i int, n long, v decimal(38,0)").groupBy("i")
    rows = sorted(by_dimension.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect())  # d rows
    if not rows:
        return Moments(0, [0] * d, np.zeros((d, d)))
    n, sums = rows[0]["n"], [int(r["v"]) for r in rows]
    centre = [(2 * s + n) // (2 * n) for s in sums]

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        products, near, seen = ExactProducts(d), np.array(centre, dtype=np.int64), False
        for pdf in batches:
            if len(pdf):
                products.add(whole(pdf[vector]) - near)
                seen = True
        if seen:
            yield pair_sums(products.sums())

    pairs = vectors.select(vector).mapInPandas(multiply, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    covariance = np.zeros((d, d))
    lacks = [s - n * c for s, c in zip(sums, centre, strict=True)]
    for i, j, v in pairs.collect():  # d (d + 1) / 2 rows
        covariance[i, j] = covariance[j, i] = (n * int(v) - lacks[i] * lacks[j]) / (n * n)
    return Moments(n, sums, covariance)


# --- the d x d eigenproblem ---


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal, and the Householder vectors v, each for the reflection 1 - 2 v v^T of the rows from k on."""
    a, n, mirrors = a.copy(), len(a), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.abs(v[1:]).max(initial=0.0)
        if size == 0.0:
            continue
        v /= max(size, abs(v[0]))
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        sub = a[k + 1 :, k + 1 :]
        p = sub @ v
        w = p - (v @ p) * v
        sub -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2.0 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        mirrors.append((k + 1, v))
    return a.diagonal().copy(), a.diagonal(-1).copy(), mirrors


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each value."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    q, below = np.ones_like(at), np.zeros(len(at), dtype=np.int64)
    for i, d in enumerate(diagonal):
        q = d - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The greatest eigenvalues in falling order, all bisected at once until their bounds can't come closer."""
    n = len(diagonal)
    around = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low, high = np.full(most, (diagonal - around).min()), np.full(most, (diagonal + around).max())
    pad = np.finfo(float).eps * max(abs(low[0]), abs(high[0])) + np.finfo(float).tiny
    low, high = low - pad, high + pad
    wanted = n - 1 - np.arange(most)  # so many lie below
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return high
        above = counts_below(diagonal, off, middle) <= wanted
        low, high = np.where(open_ & above, middle, low), np.where(open_ & ~above, middle, high)


def solved(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - value) x = right for a tridiagonal T, by elimination with row exchanges; pivots of nought become ``least``."""
    n = len(diagonal)
    d, e, f, x = diagonal - value, np.append(off, 0.0), np.zeros(n), right.copy()
    for i in range(n - 1):
        low, after, beyond = off[i], d[i + 1], e[i + 1]
        if abs(low) > abs(d[i]):  # exchange rows i and i + 1
            factor = d[i] / low
            d[i], d[i + 1] = low, e[i] - factor * after
            e[i], e[i + 1], f[i] = after, -factor * beyond, beyond
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            d[i] = d[i] if abs(d[i]) > least else least
            factor = low / d[i]
            d[i + 1] = after - factor * e[i]
            x[i + 1] -= factor * x[i]
    d[-1] = d[-1] if abs(d[-1]) > least else least
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (e[i] * x[i + 1] if i + 1 < n else 0.0) - (f[i] * x[i + 2] if i + 2 < n else 0.0)) / d[i]
    return x


def leading_pairs(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns; each vector's largest entry is positive."""
    n, most = len(a), min(most, len(a))
    scale = np.abs(a).max(initial=0.0)
    if scale == 0.0:
        return np.zeros(most), np.eye(n)[:, :most]
    diagonal, off, mirrors = tridiagonal(a / scale)
    size = (np.abs(diagonal) + np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))).max()
    values, rng = leading_values(diagonal, off, most), np.random.default_rng(7)
    vectors, first, least = np.zeros((n, most)), 0, np.finfo(float).eps * size
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            first = k  # a new cluster
        at = value - (k - first) * least  # equal eigenvalues are taken a little apart
        x = rng.standard_normal(n)
        for _ in range(6):
            x /= np.abs(x).max()
            x = solved(diagonal, off, at, x, least)
            x /= np.abs(x).max()
            for _ in range(2):  # orthogonal to the cluster, twice for what rounding leaves
                x -= vectors[:, first:k] @ (vectors[:, first:k].T @ x)
            x /= np.linalg.norm(x)
        vectors[:, k] = x
    for start, v in reversed(mirrors):
        vectors[start:] -= 2.0 * np.outer(v, v @ vectors[start:])
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(most)])
    return values * scale, vectors


# --- projection ---


def projected(vectors: DataFrame, found: Moments, directions: np.ndarray, vector: str = "vector") -> DataFrame:
    """The columns of ``vectors`` but the vector, deviation decimal and whitened array<double>. The directions go out with the task: d x 32 numbers."""
    n, sums = found.n, np.array(found.sums, dtype=object)
    kept = [c for c in vectors.columns if c != vector]

    @F.pandas_udf("deviation decimal(38,0), whitened array<double>")
    def added(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        in_longs = all(abs(s) < 2**62 for s in found.sums)
        for series in batches:
            if not len(series):
                yield pd.DataFrame({"deviation": [], "whitened": []})
                continue
            x = whole(series)
            if in_longs and int(np.abs(x).max()) * n < 2**62:
                y = x * n - sums.astype(np.int64)
            else:
                y = x.astype(object) * n - sums
            if int(np.abs(y).max()) ** 2 * y.shape[1] >= 2**63:
                y = y.astype(object)
            deviation = [Decimal(int(t)) for t in (y * y).sum(axis=1)]
            yield pd.DataFrame({"deviation": deviation, "whitened": list((y.astype(np.float64) / n) @ directions)})

    return vectors.select(*kept, added(F.col(vector)).alias("__added")).select(*kept, "__added.deviation", "__added.whitened")


def identity_error(rows: DataFrame, components: int) -> float:
    """The largest entry, without sign, of the covariance of ``whitened`` less the identity: measured on the rows."""

    def gather(f):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, total = 0, 0.0
            for pdf in batches:
                if len(pdf):
                    n, total = n + len(pdf), total + f(np.stack(pdf["whitened"].to_numpy()))
            if n:
                i = np.indices(total.shape).reshape(total.ndim, -1)
                yield pd.DataFrame({"i": i[0].astype(np.int32), "j": i[-1].astype(np.int32), "n": n, "v": total.ravel()})

        sums = rows.select("whitened").mapInPandas(run, "i int, j int, n long, v double").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        return {(r.i, r.j): r.v / r.n for r in sums.collect()}  # components, or their pairs

    means = gather(lambda w: w.sum(axis=0))
    mean = np.array([means[k, k] for k in range(components)])
    products = gather(lambda w: (w - mean).T @ (w - mean))
    return max(abs(v - (i == j)) for (i, j), v in products.items())


def whitened_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """A row for each usable vector: (id, n long, deviation decimal(38,0), whitened array<double>, explained array<double>,
    identity_error double). ``whitened[k]`` is x - S/n on the unit eigenvector of the k-th greatest eigenvalue over its
    root, ``explained[k]`` that eigenvalue's share of the trace; deviation is the sum of (n x - S)^2 over dimensions, exact.
    """
    kind = table.schema[id_col].dataType.simpleString()
    vectors = table.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("vector")).where(usable("vector"))
    lengths = vectors.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = table.sparkSession.createDataFrame([], f"`{id_col}` {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    if lengths is None:
        return empty
    vectors = vectors.where(F.size("vector") == lengths["d"])
    found = moments(vectors, lengths["d"])
    values, axes = leading_pairs(found.covariance, components)
    live = int((values > max(values[0], 0.0) * NOUGHT * lengths["d"]).sum())
    if not live:
        return empty
    values, axes = values[:live], axes[:, :live]
    rows = saved(projected(vectors, found, axes / np.sqrt(values)), "whitened")
    error = identity_error(rows, live)
    shares = F.array(*(F.lit(float(v)) for v in values / np.trace(found.covariance)))
    return rows.select(F.col("__id").alias(id_col), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(float(error)).alias("identity_error"))
