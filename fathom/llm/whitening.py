"""Embedding whitening: streaming moments, merged over partitions, and a symmetric QR eigen-solve.

Each entry c becomes the integer x = floor(scale * c) + shift. The fit list holds each distinct vector x once.
Every task streams its part of it into (n, mean, comoments) by Welford's rank-one updates, and keeps exact sums
beside them; the tasks' states are merged by the parallel update formula, first in as many tasks as the session shuffles
to and then in one, so that the driver gets a single state however many partitions there are. Its covariance is reduced to
tridiagonal form and diagonalised by implicitly shifted QR steps. The rows are projected in one narrow pass.
`identity_error` is measured, not derived: the whitened fit list is streamed through the same moments.

Rows are left out whose vector is null or empty, or holds a null or non-finite entry, and rows of another length than
most distinct vectors have (of equally frequent lengths the longer). Components are left out whose eigenvalue is
below the rounding of the largest one, so fewer than `most` come back for fewer independent vectors, and none where all
vectors are equal. Entries beyond +-2^40 after scaling count as +-2^40. A deviation beyond a long is null.
Repeated rows each come back, null ids too. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import cut, ready

SCALE, SHIFT = 64, 1_000_000
MOST = 16
LIMIT = 1 << 40
STATE = "n long, mean binary, comoments binary, sums string"


class Moments:
    """Count, mean and comoments about the mean of the vectors so far."""

    def __init__(self, dim: int) -> None:
        self.n, self.mean, self.comoments = 0, np.zeros(dim), np.zeros((dim, dim))
        self._step = np.empty((dim, dim))

    def add(self, x: np.ndarray) -> None:
        """Welford's update: the old and the new deviation make a matrix of rank one."""
        self.n += 1
        old = x - self.mean
        self.mean += old / self.n
        np.multiply.outer(old, x - self.mean, out=self._step)
        self.comoments += self._step

    def merge(self, n: int, mean: np.ndarray, comoments: np.ndarray) -> None:
        """The parallel update: both comoments, and the distance of the means."""
        if n:
            both = self.n + n
            apart = mean - self.mean
            self.comoments += comoments + np.multiply.outer(apart, apart) * (self.n / both * n)
            self.mean += apart * (n / both)
            self.n = both

    def covariance(self) -> np.ndarray:
        c = self.comoments / self.n
        return (c + c.T) / 2


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and basis of a symmetric matrix, by Householder reflections."""
    a, n = a.copy(), len(a)
    basis = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += math.copysign(float(np.linalg.norm(v)), v[0])
        size = float(np.linalg.norm(v))
        if size > 0:
            v /= size
            a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
            basis[:, k + 1 :] -= 2 * np.outer(basis[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), basis


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as rows; each one's largest entry is positive."""
    d, e, basis = tridiagonal(a)
    eps, high = np.finfo(float).eps, len(d) - 1
    while high > 0:
        small = [abs(e[k]) <= eps * (abs(d[k]) + abs(d[k + 1])) for k in range(high)]
        if small[-1]:
            e[high - 1] = 0.0
            high -= 1
            continue
        low = next((k + 1 for k in range(high - 1, -1, -1) if small[k]), 0)
        half, last = (d[high - 1] - d[high]) / 2, e[high - 1]
        shift = d[high] - last * last / (half + math.copysign(math.hypot(half, last), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):  # the bulge that the shift makes is chased down
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            d0, d1, off = d[k], d[k + 1], e[k]
            d[k] = c * c * d0 + 2 * c * s * off + s * s * d1
            d[k + 1] = s * s * d0 - 2 * c * s * off + c * c * d1
            e[k] = c * s * (d1 - d0) + (c * c - s * s) * off
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            basis[:, [k, k + 1]] = basis[:, [k, k + 1]] @ np.array([[c, -s], [s, c]])
    order = np.argsort(-d, kind="stable")
    vectors = basis.T[order]
    heads = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1)
    return d[order], vectors * np.where(heads < 0, -1.0, 1.0)


def whole(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """The vector's entries as integers."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long") + F.lit(shift))


def kept(vectors: DataFrame, scale: int, shift: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the rows whose vector has nothing but finite entries."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & finite).select("id", whole(v, scale, shift).alias("x"))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def moments(rows: DataFrame, dim: int, out_dim: int, shift: int, view: Callable[[np.ndarray], np.ndarray]) -> tuple[Moments, list[int]]:
    """Moments of view(x) over all x of rows, with the exact sums of x. view gets and gives a matrix, a row for each vector."""

    def state(m: Moments, sums: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([m.n], pa.int64()), pa.array([m.mean.tobytes()], pa.binary()), pa.array([m.comoments.tobytes()], pa.binary()), pa.array([",".join(map(str, sums))])],
            names=["n", "mean", "comoments", "sums"],
        )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums = Moments(out_dim), [0] * dim
        for b in batches:
            x = _rows(b.column(0), dim)
            sums = [s + int(t) for s, t in zip(sums, x.sum(axis=0), strict=True)]
            for row in view(x):
                m.add(row)
        if m.n:
            yield state(m, sums)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums = Moments(out_dim), [0] * dim
        for b in batches:
            for n, mean, comoments, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m.merge(n, np.frombuffer(mean), np.frombuffer(comoments).reshape(out_dim, out_dim))
                sums = [a + int(t) for a, t in zip(sums, s.split(","), strict=True)]
        if m.n:
            yield state(m, sums)

    parts = rows.select("x").mapInArrow(stream, STATE).repartition(F.xxhash64("mean")).mapInArrow(merge, STATE)
    found = parts.repartition(1).mapInArrow(merge, STATE).collect()  # one state
    m = Moments(out_dim)
    for r in found:
        m.merge(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["comoments"]).reshape(out_dim, out_dim))
    return m, [int(t) for t in found[0]["sums"].split(",")] if found else [0] * dim


@dataclass
class Model:
    """n and sums of the fit list, and its leading components as rows, with their eigenvalues and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, from exact numerators where these fit."""
        most = self.n * max(int(np.abs(x).max(initial=0)), 1)
        if max(most, *map(abs, self.sums)) < 1 << 61:
            return (self.n * x - np.array(self.sums, dtype=np.int64)) / self.n
        return np.array([[(self.n * int(c) - s) / self.n for c, s in zip(row, self.sums, strict=True)] for row in x])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n*x - S)^2 for each row; None where it doesn't fit a long."""
        top, near = float(1 << 63), self.n * self.centred(x)
        about, made = (near * near).sum(axis=1), []
        inside = about < top * 0.999
        if inside.any():
            wrapped = np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in self.sums], dtype=np.int64)
            d = self.n * x[inside] - wrapped  # the difference fits, as its square does, even where a product wraps round
            quick = iter(np.einsum("ij,ij->i", d, d).tolist())
        for k, sure in enumerate(inside):
            if sure:
                made.append(next(quick))
            elif about[k] > top * 1.001:
                made.append(None)
            else:
                v = sum((self.n * int(c) - s) ** 2 for c, s in zip(x[k], self.sums, strict=True))
                made.append(v if v < 1 << 63 else None)
        return made


def fit(listed: DataFrame, dim: int, most: int = MOST, shift: int = SHIFT) -> Model:
    """The model of a list of distinct vectors x of dim entries."""
    m, sums = moments(listed, dim, dim, shift, lambda x: x - float(shift))  # covariances are the same about any origin; near zero they round least
    if not m.n:
        return Model(0, sums, np.zeros(0), np.zeros((0, dim)), 0.0)
    v = m.covariance()
    values, axes = symmetric_qr(v)
    used = values[:most] > max(values[0], 0.0) * dim * np.finfo(float).eps
    return Model(m.n, sums, values[:most][used], axes[:most][used], float(np.trace(v)))


def whiten(vectors: DataFrame, most: int = MOST, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each kept row and component: (id, component, n, deviation, whitened, explained, identity_error)."""
    spark = ready(vectors.sparkSession)
    schema = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = kept(vectors, scale, shift, id_col, vec_col)
    listed = cut(rows.select("x").distinct())
    common = listed.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not common:
        return spark.createDataFrame([], schema)
    dim = common[0]["dim"]
    listed = listed.where(F.size("x") == dim)
    model = fit(listed, dim, most, shift)
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], schema)
    after, _ = moments(listed, dim, k, shift, model.whiten)
    error = float(np.abs(after.covariance() - np.eye(k)).max())
    shares = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            x = _rows(b.column(1), dim)
            n = len(x)
            again = lambda a: a.take(pa.array(np.repeat(np.arange(n), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    again(b.column(0)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model.n)),
                    again(pa.array(model.deviations(x), pa.int64())),
                    pa.array(model.whiten(x).reshape(-1)),
                    pa.array(np.tile(shares, n)),
                    pa.array(np.full(n * k, error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == dim).mapInArrow(run, schema)


def query(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
