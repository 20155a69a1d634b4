"""Centroid clustering: plain Lloyd rounds in whole numbers.

Vectors with exactly ``d`` components, none of them null or non-finite, become x = floor(scale * c).  Distances, sums and means are
exact, so neither the number of partitions nor the order of rows changes a result.

The first centroids are the k vectors with the smallest sha256 of ``<seed>:<id>`` (a null id reads ``null``; rows that share an id: the smaller vector first,
component by component).  Each round sends the k centroids to all executors, gives every vector the nearest (ties: the smaller number), adds up
vectors and counts of each cluster in each partition, and merges those rows by cluster and dimension: k * d numbers reach the driver.
Centroids become floor(sum / count); one without vectors stays.  Rounds in which no centroid moves change nothing and are not run.

Vectors are clustered row by row, so copies and rows that share an id or have none all count.  Fewer than k usable vectors give as many
centroids as there are; none give an empty result.  Distances or sums that do not fit into a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import exact, largest
from .whitening import LONG, whole_vectors

SCALE = 1024


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance to it, exact: one centroid after the other, so memory is that of the vectors."""
    most = (largest(x) + largest(centroids)) ** 2 * x.shape[1]
    x, centroids = exact(x, most), exact(centroids, most)
    every = np.stack([((x - c) ** 2).sum(1) for c in centroids])
    best = every.argmin(0)  # the first of equals
    return best, every[best, np.arange(len(x))]


def matrix_of(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.int64).reshape(len(raw), -1)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows whose digest of the id is smallest, in that order; each task sends its first k only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple] = []
        for f in frames:
            best = sorted([*best, *((h, tuple(np.frombuffer(x, np.int64).tolist()), x) for h, x in zip(f["h"], f["x"], strict=True))])[:k]
        yield pd.DataFrame([(h, list(v), x) for h, v, x in best], columns=["h", "v", "x"])

    least = rows.select(digest.alias("h"), "x").mapInPandas(run, "h string, v array<long>, x binary").orderBy("h", "v").limit(k).collect()
    return np.stack([np.frombuffer(bytes(r["x"]), np.int64) for r in least]) if least else np.empty((0, 0), np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[int, list[int]]] = {}
        for f in frames:
            if not len(f):
                continue
            x = matrix_of(f["x"])
            best, _ = nearest(x, sent.value)
            for c in np.unique(best).tolist():
                own = x[best == c]
                n, before = found.get(c, (0, [0] * x.shape[1]))
                found[c] = (n + len(own), [a + int(b) for a, b in zip(before, exact(own, largest(own) * len(own)).sum(0), strict=True)])
        yield pd.DataFrame([(c, n, [str(s) for s in sums]) for c, (n, sums) in found.items()], columns=["cluster", "n", "sums"])

    parts = rows.select("x").mapInPandas(run, "cluster int, n long, sums array<string>")
    flat = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    total = flat.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = centroids.copy()
    for r in total.collect():  # k * d rows
        new[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    sent.unpersist()
    return new


def inertias(rows: DataFrame, centroids: np.ndarray) -> dict[int, int]:
    """The sum of squared distances in each cluster."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, int] = {}
        for f in frames:
            if len(f):
                for c, s in zip(*(a.tolist() for a in nearest(matrix_of(f["x"]), centroids)), strict=True):
                    found[c] = found.get(c, 0) + s
        yield pd.DataFrame([(c, str(s)) for c, s in found.items()], columns=["cluster", "s"])

    total = rows.select("x").mapInPandas(run, "cluster int, s string").groupBy("cluster").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return {r["cluster"]: int(r["s"]) for r in total.collect()}  # k rows


def fit_centroids(rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """The final centroids of written ``rows(id, x)``, one in each row."""
    now = first_centroids(rows, k, seed)
    for _ in range(rounds if len(now) else 0):
        was, now = now, moved(rows, now)
        if (was == now).all():
            break
    return now


def clustered(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", d: int = 64, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = SCALE) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable row."""
    rows = written(whole_vectors(table, id_col, vec_col, scale).where(F.col("d") == d).select("id", "x"), "whole")
    centroids = fit_centroids(rows, k, rounds, seed)
    within = inertias(rows, centroids) if len(centroids) else {}
    fits = lambda s: s if s < LONG else None
    every = fits(sum(within.values()))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    names = [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                best, distance = nearest(matrix_of(f["x"]), centroids)
                whole = lambda values: pd.array(values, "Int64")
                columns = (whole(f["id"]), best, whole([fits(s) for s in distance.tolist()]), whole([fits(within[c]) for c in best.tolist()]), whole([every] * len(f)), [sha[c] for c in best])
                yield pd.DataFrame(dict(zip(names, columns, strict=True)))

    return rows.mapInPandas(run, f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def op13(spark, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def round_sql(r: int) -> str:
    """Assignment to the centroids of round r and the centroids after it."""
    return f"""
a{r} AS MATERIALIZED (
  SELECT row, x, k FROM (
    SELECT v.row, v.x, c.k, row_number() OVER (PARTITION BY v.row ORDER BY list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.k) AS place FROM v CROSS JOIN c{r} c
  ) WHERE place = 1),
s{r} AS (
  SELECT k, i, sum(e) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS e, unnest(range(64)) AS i FROM a{r}) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY k) m ON m.k = c.k),"""


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS k, x FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, 'null')) AS h, x FROM v ORDER BY h, x LIMIT 8)),
{"".join(round_sql(r) for r in range(10))}
f AS (
  SELECT row, k, d FROM (
    SELECT v.row, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d, row_number() OVER (PARTITION BY v.row ORDER BY d, c.k) AS place FROM v CROSS JOIN c10 c
  ) WHERE place = 1)
SELECT v.vec_id, f.k AS cluster, f.d AS distance, (sum(f.d) OVER (PARTITION BY f.k))::BIGINT AS cluster_inertia, (sum(f.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM f JOIN v ON v.row = f.row JOIN c10 c ON c.k = f.k
"""
