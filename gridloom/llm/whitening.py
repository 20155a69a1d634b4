"""Whitening of embeddings: centred scatter over executors, eigenvectors by cyclic Jacobi rotations on the driver.

Each component c of a vector becomes the whole number x = floor(scale * c), so that sums are exact.  Covariances are over the fit
list, each distinct x vector once, with its size n as divisor:

1. distinct x vectors are written as bytes; how often one occurs does not matter, as copies are merged before they are moved;
2. n and the sums S of the dimensions are exact whole numbers, added up in each partition and then by dimension;
3. each partition adds up the outer products of its centred vectors x - S / n; the parts are added up by row of the matrix;
4. the driver, which sees d x d numbers, turns the covariance by Jacobi rotations over all pairs of axes, sweep by sweep, until nothing is left off the
   diagonal.  Rotations are orthogonal to the last bit or two, so small eigenvalues come out as accurately as large ones are;
5. the ``components`` largest go to the executors as a d x components whitening matrix, which projects and scales every row;
6. a pass over the fit list measures the covariance of what comes out against the identity.

Vectors that are null, empty or hold null or non-finite components are dropped.  Vectors of different lengths are different tables: each
length has its own fit list, components and results.  Copies and rows that share an id or have none are whitened row by row.  A component
whose variance is zero to working precision has whitened value 0 and does not count for the identity; its share explained is 0.
Exact values that do not fit into a long are null.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import exact, finite_rows, largest, scaled_floor

SCALE = 256
LONG = 1 << 63


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, of a symmetric matrix.

    Each sweep turns every pair of axes once.  An element is passed over once it is too small to change either diagonal element beside it;
    a sweep that passes over all of them is the last.
    """
    a = np.array(matrix, np.float64)
    d = len(a)
    v = np.eye(d)
    a = (a + a.T) / 2
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= 1e-17 * math.sqrt(abs(a[p, p] * a[q, q])) or abs(off) < 1e-300:
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = 1 / (2 * theta) if abs(theta) > 1e150 else math.copysign(1, theta) / (abs(theta) + math.sqrt(theta * theta + 1))
                c = 1 / math.sqrt(t * t + 1)
                s = t * c
                rows = a[[p, q]]
                a[p], a[q] = c * rows[0] - s * rows[1], s * rows[0] + c * rows[1]
                columns = a[:, [p, q]]
                a[:, p], a[:, q] = c * columns[:, 0] - s * columns[:, 1], s * columns[:, 0] + c * columns[:, 1]
                a[p, q] = a[q, p] = 0.0
                pair = v[:, [p, q]]
                v[:, p], v[:, q] = c * pair[:, 0] - s * pair[:, 1], s * pair[:, 0] + c * pair[:, 1]
        if not turned:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    v = v[:, order]
    v *= np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0)  # one of the two signs, the same in every run
    return e[order], v


@dataclass
class Whitening:
    """What was fitted for the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # their vectors, in columns
    components: int
    identity_error: float = 0.0

    @property
    def alive(self) -> np.ndarray:
        """Which of the components have variance."""
        return self.values[: self.components] > 1e-12 * max(self.values[0], 1e-300)

    def explained(self) -> np.ndarray:
        total = self.values.sum()
        return np.maximum(self.values[: self.components], 0) / total if total > 0 else np.zeros(self.components)

    def matrix(self) -> np.ndarray:
        e = np.where(self.alive, self.values[: self.components], 1.0)
        return self.vectors[:, : self.components] / np.sqrt(e) * self.alive

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: exact whole numbers divided once."""
        return (self.deviations(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S."""
        most = largest(x) * self.n + max(map(abs, self.sums))
        sums = np.array(self.sums, object)
        return exact(x, most) * self.n - (sums if most >= 1 << 62 else sums.astype(np.int64))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.matrix()

    def squares(self, x: np.ndarray) -> list[int | None]:
        """The exact sums of (n * x - S)^2; null where they do not fit into a long."""
        d = self.deviations(x)
        found = (exact(d, largest(d) ** 2 * d.shape[1]) ** 2).sum(1).tolist()
        return [k if k < LONG else None for k in found]


def whole_vectors(table: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, d, x): the rows with a usable vector, as the bytes of its d whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"]
            for rows, matrix in finite_rows(batch["v"]):
                x = scaled_floor(matrix, scale)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "d", "x"])

    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, d int, x binary")


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, rows, x) of a batch of :func:`whole_vectors`."""
    lengths = batch["d"].to_numpy()
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        raw = batch["x"].take(pa.array(rows)).to_pylist()
        yield d, rows, np.frombuffer(b"".join(raw), np.int64).reshape(len(rows), d)


def totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and S for each length: exact, one row for each partition and dimension merged by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for d, _, x in by_length(batch):
                sums = exact(x, largest(x) * len(x)).sum(0)
                n, before = found.get(d, (0, [0] * d))
                found[d] = [n + len(x), [a + int(b) for a, b in zip(before, sums, strict=True)]]
        rows = [(d, i, n, str(s)) for d, (n, sums) in found.items() for i, s in enumerate(sums)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["d", "i", "n", "s"])

    parts = fit.select("d", "x").mapInArrow(run, "d int, i int, n long, s string")
    merged = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d", "i").collect()  # d rows for each length
    out: dict[int, tuple[int, list[int]]] = {}
    for r in merged:
        out.setdefault(r["d"], (r["n"], []))[1].append(int(r["s"]))
    return out


def summed_rows(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sum of matrices that arrive as rows (d, i, v): added up by place, d * d numbers reach the driver."""
    flat = parts.select("d", "i", F.posexplode("v").alias("j", "v")).groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    rows = flat.groupBy("d", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r")).select("d", "i", F.col("r.v").alias("v")).orderBy("d", "i").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["d"], []).append(r["v"])
    return {d: np.array(m, np.float64) for d, m in out.items()}


def scatter(fit: DataFrame, models: dict[int, Whitening], project: bool) -> dict[int, np.ndarray]:
    """Sums of the outer products of the centred vectors, or, with ``project``, of what whitening makes of them; for each length."""
    sent = fit.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch):
                model = sent.value[d]
                y = model.apply(x) if project else model.centred(x)
                found[d] = found.get(d, 0) + y.T @ y
        for d, m in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), d, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)), pa.array(list(m), pa.list_(pa.float64()))], ["d", "i", "v"])

    return summed_rows(fit.select("d", "x").mapInArrow(run, "d int, i int, v array<double>"))


def fit_whitening(fit: DataFrame, components: int = 4) -> dict[int, Whitening]:
    """For each length of vector, what is learnt from the distinct ``fit(d, x)``."""
    models = {d: Whitening(n, sums, np.zeros(d), np.eye(d), min(components, d)) for d, (n, sums) in totals(fit).items()}
    for d, m in scatter(fit, models, False).items():
        models[d].values, models[d].vectors = jacobi(m / models[d].n)
    for d, m in scatter(fit, models, True).items():
        alive = models[d].alive
        left = np.abs(m / models[d].n - np.eye(len(m)))[np.ix_(alive, alive)]
        models[d].identity_error = float(left.max()) if left.size else 0.0
    return models


def whitened(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: for each usable row and component."""
    rows = written(whole_vectors(table, id_col, vec_col, scale), "whole")
    fit = written(rows.select("d", "x").distinct(), "fit")
    models = fit_whitening(fit, components)
    sent = table.sparkSession.sparkContext.broadcast(models)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in by_length(batch):
                m = sent.value[d]
                k = m.components
                z, squares = m.apply(x), m.squares(x)
                ids = batch["id"].take(pa.array(np.repeat(at, k)))
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, m.n, np.int64)), pa.array([s for s in squares for _ in range(k)], pa.int64()),
                    pa.array(z.ravel()), pa.array(np.tile(m.explained(), len(x))), pa.array(np.full(len(x) * k, m.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
