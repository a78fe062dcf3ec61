"""Embedding whitening: a distributed centred scatter, cyclic Jacobi rotations, and a broadcast whitening matrix.

Tasks add up the vectors, then the products of their centred entries. The driver turns the covariance, a number for
each pair of dimensions, with Jacobi rotations until every off-diagonal entry is nothing beside its two diagonal
ones, which leaves small eigenvalues as accurate as large ones. Sorted and scaled axes go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import matrix, scaled, usable

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Components from here on count as not finite: their sums would not be exact.
LIMIT = 2.0**30
#: The covariance of so many dimensions takes 134 MB in the driver.
MOST_DIMENSIONS = 4096
SWEEPS = 60
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of dimensions once, in rounds of pairs that share none: one stays, the others walk around it."""
    ring = list(range(d + d % 2))
    for _ in range(len(ring) - 1):
        p, q = np.array(ring[: len(ring) // 2]), np.array(ring[: len(ring) // 2 - 1 : -1])
        there = (p < d) & (q < d)
        yield np.minimum(p, q)[there], np.maximum(p, q)[there]
        ring[1:] = [ring[-1], *ring[1:-1]]


def jacobi(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), falling; a vector's largest entry is positive."""
    a, d = np.array(symmetric, float), len(symmetric)
    v, small, pairs = np.eye(d), np.finfo(float).eps / 4, list(rounds(d))
    for _ in range(SWEEPS):
        turned = False
        for p, q in pairs:
            off = np.abs(a[p, q])
            turn = (off > small * np.sqrt(np.abs(a[p, p] * a[q, q]))) & (off > np.finfo(float).tiny)
            p, q = p[turn], q[turn]
            if not len(p):
                continue
            turned = True
            with np.errstate(over="ignore"):
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.where(theta < 0, -1, 1) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            a[p, q] = a[q, p] = 0
        if not turned:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    v = v[:, order]
    return e[order], v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1, 1)


def sums(rows: DataFrame, d: int) -> np.ndarray:
    """The sum of each dimension, as whole numbers of any size."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for b in batches:
            total += matrix(b["x"], d, SHIFT).sum(0).astype(object)
        yield pa.RecordBatch.from_pydict({"i": np.arange(d, dtype=np.int32), "s": [str(x) for x in total]})

    found = rows.select("x").mapInArrow(added, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total = np.zeros(d, object)
    for r in found.collect():  # a number for each dimension
        total[r["i"]] = int(r["s"])
    return total


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - total, exact."""
    if n * int(np.abs(x).max(initial=0)) + max((abs(t) for t in total), default=0) < 1 << 62:
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


def squares(z: np.ndarray) -> list[int | None]:
    """Each row's sum of squares, exact; null if a long can't hold it."""
    if z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * z.shape[1] < 1 << 63:
        return (z * z).sum(1).tolist()
    exact = (z.astype(object) ** 2).sum(1)
    return [int(s) if s < 1 << 63 else None for s in exact]


def scatter(rows: DataFrame, d: int, n: int, total: np.ndarray, axes: np.ndarray | None = None) -> np.ndarray:
    """The covariance, divisor n, of the centred vectors or of what they are on some axes."""
    width = d if axes is None else axes.shape[1]
    upper = np.triu_indices(width)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((width, width))
        for b in batches:
            z = centred(matrix(b["x"], d, SHIFT), n, total).astype(float) / n
            z = z if axes is None else z @ axes
            s += z.T @ z
        yield pa.RecordBatch.from_pydict({"i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), "s": s[upper]})

    found = rows.select("x").mapInArrow(added, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((width, width))
    got = found.toPandas()  # a number for each pair of dimensions
    out[got["i"], got["j"]] = got["s"]
    return (out + np.triu(out, 1).T) / n


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of rows (vec_id, embedding), a row for each vector and component.

    Rows whose vector is null or holds null, NaN, an infinity or an entry of 2**30 and more take no part; vectors
    shorter than the longest are continued with zeros. Repeated rows count and return as often as they are there,
    rows without vec_id, too. Components whose eigenvalue is zero (one vector only, equal or dependent dimensions)
    have whitened null and don't count in identity_error, which is null if there is no other. `deviation` is null where
    a long can't hold it. Of equal eigenvalues any axes of their space may come, the same for all rows. No usable
    vector, or an empty table, gives no rows. Other columns aren't read. Raises above MOST_DIMENSIONS.
    """
    rows = embeddings.where(usable("embedding", LIMIT)).select("vec_id", scaled("embedding", SCALE, SHIFT).alias("x"))
    n, d = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; the driver takes covariances of {MOST_DIMENSIONS}")
    if not n or not d:
        return rows.sparkSession.createDataFrame([], ROWS)
    total = sums(rows, d)
    v = scatter(rows, d, n, total)
    e, axes = jacobi(v)
    k = min(components, d)
    good = e[:k] > d * np.finfo(float).eps * max(e[0], 0)
    scaled_axes = np.where(good, axes[:, :k] / np.sqrt(np.where(good, e[:k], 1)), 0)
    trace = float(np.trace(v))
    explained = (np.maximum(e[:k], 0) / trace if trace > 0 else np.zeros(k)).tolist()
    error = float(np.abs(scatter(rows, d, n, total, scaled_axes[:, good]) - np.eye(int(good.sum()))).max()) if good.any() else None
    sent = rows.sparkSession.sparkContext.broadcast((total, scaled_axes))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, axes = sent.value
        for b in batches:
            z = centred(matrix(b["x"], d, SHIFT), n, total)
            m = len(z)
            yield pa.RecordBatch.from_pydict({
                "vec_id": b["vec_id"].take(pa.array(np.repeat(np.arange(m), k))), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": np.full(m * k, n),
                "deviation": pa.array(squares(z), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                "whitened": pa.array((z.astype(float) / n @ axes).ravel(), mask=np.tile(~good, m)), "explained": np.tile(explained, m),
                "identity_error": pa.array([error] * (m * k), pa.float64()),
            })

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(projected, ROWS)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
