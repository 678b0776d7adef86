"""Embedding whitening with weighted multiplicities (operator 12).

Vectors become integer vectors x; equal ones are grouped, and from there on each different x is handled once, with its
number of copies as weight of the fit (or one, if ``weighted`` is off). Sums are exact integers. The covariance is a
weighted product of matrices over vectors centred before multiplying, added up over tasks entry by entry; only the sums
and the matrix, whose size follows from the dimension alone, reach the driver. Each different vector is projected on the
eigenvectors once and joined back to its rows; vectors with many copies are joined by broadcast.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry, or one of 2^43 or more, are
dropped, and so are vectors of another length than most have; a component of no variance (eigenvalue at most
the dimension times 2^-52 of the sum of all) does not exist, so one row alone, or copies of one, give no rows; a deviation beyond 64
bits is null; rows that repeat a vec_id are rows of their own, a null vec_id is kept; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import prepare, query, stored, table
from .vectors import dimension, joined_back, usable

#: Steps per unit and offset of the integer vectors.
STEPS, OFFSET = 1024, 100_000
#: Components that are returned at most.
MOST = 8
#: Entries from here on have no exact integer.
LARGEST = float(1 << 43)


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS) + OFFSET)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


@dataclass
class Fit:
    """Number of vectors of the fit list, their sums per dimension, eigenvalues (falling) with eigenvectors as columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if reach * reach * x.shape[1] < 1 << 63:
            y = self.n * x - np.array(self.sums, np.int64)
            return np.einsum("ij,ij->i", y, y).tolist()
        out = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def summed(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension of ``distinct`` (x, weight)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for batch in batches:
            x, w = matrix(batch.column(0), d), batch.column(1).to_numpy()
            if batch.num_rows and int(np.abs(x).max()) * int(w.sum()) < 1 << 62:
                got = (w @ x).tolist()
            else:
                got = [sum(int(a) * int(b) for a, b in zip(w, column)) for column in x.T]
            total = [a + b for a, b in zip(total, [*got, int(w.sum())])]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "s"])

    rows = distinct.select("x", "weight").mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = {r.i: int(r.s) for r in rows}
    return sums.get(d, 0), [sums.get(i, 0) for i in range(d)]


def covariance(distinct: DataFrame, fit: Fit) -> np.ndarray:
    """Covariance of ``distinct`` (x, weight): centred, multiplied per task, added up entry by entry."""
    d = len(fit.sums)
    upper = np.triu_indices(d)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            y = fit.centred(matrix(batch.column(0), d))
            total += y.T @ (y * batch.column(1).to_numpy()[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "v"])

    got = distinct.select("x", "weight").mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((d, d))
    out[got["i"], got["j"]] = out[got["j"], got["i"]] = got["v"] / fit.n
    return out


def fitted(distinct: DataFrame, d: int) -> Fit | None:
    """The fit of ``distinct`` (x, weight), None without rows."""
    n, sums = summed(distinct, d)
    if n == 0:
        return None
    fit = Fit(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    values, axes = np.linalg.eigh(covariance(distinct, fit))
    values, axes = values[::-1], axes[:, ::-1]
    fit.trace = float(values.clip(0).sum())
    there = values > fit.trace * d * 2.0**-52
    # Either sign will do: the largest entry of an axis is positive.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(d)])
    fit.values, fit.axes = values[there], axes[:, there]
    return fit


def projected(distinct: DataFrame, fit: Fit, most: int) -> DataFrame:
    """x, copies, weight, deviation and whitened (array, one entry per component) of each different vector."""
    d, scale = len(fit.sums), fit.axes[:, :most] / np.sqrt(fit.values[:most])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), d)
            z = fit.centred(x) @ scale
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(fit.deviations(x), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], ["x", "copies", "weight", "deviation", "whitened"]
            )

    schema = "x array<bigint>, copies bigint, weight bigint, deviation bigint, whitened array<double>"
    return distinct.select("x", "copies", "weight").mapInArrow(project, schema)


def identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``white`` (whitened, weight) minus the identity."""
    z = [F.col("whitened")[i] for i in range(k)]
    n, *sums = white.agg(F.sum("weight"), *[F.sum(F.col("weight") * c) for c in z]).first()
    y = [c - s / n for c, s in zip(z, sums)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    entries = white.agg(*[F.sum(F.col("weight") * y[i] * y[j]) / n for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(entries, pairs))


def whiten(rows: DataFrame, weighted: bool = True, most: int = MOST) -> DataFrame:
    """Per remaining row of ``rows`` (vec_id, embedding) and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    prepare(rows.sparkSession)
    fine = usable(F.col("embedding")) & ~F.exists("embedding", lambda c: F.abs(c) >= LARGEST)
    rows = rows.select("vec_id", "embedding").filter(fine)
    d = dimension(rows, "embedding")
    own = rows.filter(F.size("embedding") == d).select("vec_id", integers(F.col("embedding")).alias("x"))
    distinct = own.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    distinct = stored(distinct.select("x", "copies", (F.col("copies") if weighted else F.lit(1).cast("long")).alias("weight")), "different-vectors")
    fit = fitted(distinct, d) if d else None
    k = min(most, len(fit.values)) if fit else 0
    if not k:
        schema = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        empty = rows.sparkSession.createDataFrame([], schema)
        return own.limit(0).select("vec_id").join(empty, F.lit(False))
    white = stored(projected(distinct, fit, most), "whitened")
    error = identity_error(white, k)
    total = distinct.agg(F.sum("copies")).first()[0]
    back = joined_back(own, white.select("x", "copies", "deviation", "whitened"), "x", "copies", total)
    out = back.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(v) / fit.trace) for v in fit.values[:k]])
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
