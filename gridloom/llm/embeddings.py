"""Embedding near-deduplication with rotated binary codes and error bounds.

A unit vector is turned by random rotations; the signs of the first rotation are its code, and the
inner product of code and vector (the correction factor) is stored with it.  Code times rotated other vector
over factor estimates the inner product without bias, and its error is below
``confidence * sqrt((1 - f^2) / f^2 / (d - 1))`` but for a vanishing share of rotations.  The rotated other
vector is stored in one byte a component; what that leaves out is at most its residual's length over the factor,
and is added to the bound.  A pair whose estimate plus bound is under the threshold, seen from either side, is
discarded; all others are computed exactly, in double precision.

1. Pairs are looked for in buckets: bands of sign bits of all rotations.  A pair at the threshold agrees
   in a bit with probability 1 - acos(t) / pi; bands are as long as the number of vectors asks for, and so many
   that a pair at the threshold shares none of them with probability ``miss`` at most.  Only codes, factors and
   one-byte vectors go to the buckets.  Large buckets are dealt to tiles.  A pair that meets in several bands counts in the first.
2. The vectors themselves are fetched for those members of a tile that have a pair left there.
3. Tiles give counts of links and a spanning forest, not pairs; components are found from the forests.

Identical vectors are one class: they link with each other and have the same links elsewhere.  Every row counts as
a vector of its own, whatever its id: rows that share an id have the links of their own vectors.  A row without an id
links as well; a component is named by its smallest id, and has none if all its ids are null.  Vectors
that are null, empty, zero or hold null or non-finite components link with nothing.  Vectors of
different lengths do not link.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, groups, tiles, written

TILE = ["band", "v", "d", "ti", "tj"]


@lru_cache(maxsize=8)
def rotations(d: int, n: int, seed: int) -> np.ndarray:
    """n random orthogonal matrices."""
    return np.stack([np.linalg.qr(np.random.default_rng([seed, d, k]).standard_normal((d, d)))[0] for k in range(n)])


def bands_for(count: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a band, and the number of bands."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(48, max(6, math.ceil(math.log2(max(count, 1) / 16)))) if count > 16 else 6
    return bits, math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


def usable(vector) -> np.ndarray | None:
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, key, vec): a digest of the components and their bytes; null where the vector cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [usable(v) for v in batch["v"].to_pylist()]
            vec = [None if v is None else (v + 0.0).tobytes() for v in found]
            key = [None if v is None else xxhash.xxh3_128_digest(v) for v in vec]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(key, pa.binary()), pa.array(vec, pa.binary())], ["id", "key", "vec"])

    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, "id long, key binary, vec binary")


def unit_rows(vec: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    scaled = vec / np.abs(vec).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def coded(classes: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """(node, d, signs, factor, turned, scale, rest, bands) of (node, vec).

    ``d`` is the number of components, ``signs`` are the bits of all bands, ``turned`` is the first rotation's vector in bytes of ``scale`` each, ``rest`` the length of what they leave out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for raw in batch["vec"].to_pylist():
                unit = unit_rows(np.frombuffer(raw)[None])[0]
                d = len(unit)
                turned = rotations(d, -(-bits * bands // d), seed) @ unit
                flat = (turned > 0).ravel()[: max(bits * bands, d)]
                scale = np.abs(turned[0]).max() / 127
                small = np.rint(turned[0] / scale).astype(np.int8)
                values = flat[: bits * bands].reshape(bands, bits) @ powers
                for column, value in zip(out, (d, np.packbits(flat).tobytes(), np.abs(turned[0]).sum() / math.sqrt(d), small.tobytes(), scale, np.linalg.norm(turned[0] - small * scale), values), strict=True):
                    column.append(value)
            kinds = (pa.int32(), pa.binary(), pa.float64(), pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["node"], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["node", "d", "signs", "factor", "turned", "scale", "rest", "bands"])

    return classes.select("node", "vec").mapInArrow(run, "node long, d int, signs binary, factor double, turned binary, scale double, rest double, bands array<long>")


class Tile:
    """The codes of a tile's members, and the pairs of its two parts that the codes leave."""

    def __init__(self, t: pa.Table, bits: int, threshold: float, confidence: float) -> None:
        self.band, self.ti, self.tj = (t[c][0].as_py() for c in ("band", "ti", "tj"))
        n, d = len(t), t["d"][0].as_py()
        part = t["part"].to_numpy()
        self.x, self.y = np.flatnonzero(part == self.ti), np.flatnonzero(part == self.tj)
        flat = np.unpackbits(np.frombuffer(b"".join(t["signs"].to_pylist()), np.uint8).reshape(n, -1), axis=1)
        self.code = flat[:, :d].astype(np.float32) * 2 - 1
        earlier = flat[:, : bits * self.band].reshape(n, self.band, bits).astype(np.int64)
        self.earlier = earlier @ (1 << np.arange(bits))  # the values of the bands before this one
        turned = np.frombuffer(b"".join(t["turned"].to_pylist()), np.int8).reshape(n, d)
        self.turned = turned.astype(np.float32) * t["scale"].to_numpy()[:, None].astype(np.float32)
        self.factor = t["factor"].to_numpy()
        self.error = confidence * np.sqrt(np.maximum(1 - self.factor**2, 0)) / math.sqrt(max(d - 1, 1)) + 1e-5
        self.rest, self.root, self.threshold = t["rest"].to_numpy(), math.sqrt(d), threshold

    def estimates(self, rows: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The largest inner product that the codes of ``rows`` allow with each of ``other``."""
        raw = (self.code[rows] @ self.turned[other].T) / self.root
        return (raw + self.error[rows][:, None] + self.rest[other][None, :]) / self.factor[rows][:, None]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs that are not discarded and meet in no earlier band, each pair once."""
        for a in range(0, len(self.x), 256):
            rows = self.x[a : a + 256]
            alive = (self.estimates(rows, self.y) >= self.threshold) & (self.estimates(self.y, rows).T >= self.threshold)
            i, j = np.nonzero(alive)
            i, j = rows[i], self.y[j]
            if self.ti == self.tj:
                i, j = i[i < j], j[i < j]
            for b in range(0, len(i), 50_000):
                p, q = i[b : b + 50_000], j[b : b + 50_000]
                first = ~(self.earlier[p] == self.earlier[q]).any(1)
                yield p[first], q[first]


def possible_members(codes: DataFrame, bits: int, threshold: float, confidence: float, block: int) -> DataFrame:
    """The members of tiles, with their codes, that have a pair left in that tile."""
    code = ["node", "d", "signs", "factor", "turned", "scale", "rest"]
    dealt = codes.select(*code, F.posexplode("bands").alias("band", "v"))
    dealt = tiles(dealt, ["band", "v", "d"], F.xxhash64("node"), block).select(*TILE, "part", *[c for c in code if c != "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, TILE):
            if len(t) < 2:
                continue
            wanted = np.zeros(len(t), bool)
            for p, q in Tile(t, bits, threshold, confidence).pairs():
                wanted[p] = wanted[q] = True
            if wanted.any():
                yield from t.filter(pa.array(wanted)).combine_chunks().to_batches()

    return dealt.mapInArrow(run, dealt.schema)


def exact_links(members: DataFrame, bits: int, threshold: float, confidence: float) -> DataFrame:
    """(a, n, b): a node, links it has in some tile (counting copies of the other), and a smaller node that it is joined to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, TILE):
            if len(t) < 2:
                continue
            nodes, n = t["node"].to_numpy(), t["n"].to_numpy()
            vec = np.frombuffer(b"".join(t["vec"].to_pylist())).reshape(len(nodes), -1)
            scaled = vec / np.abs(vec).max(1, keepdims=True)
            norm = np.linalg.norm(scaled, axis=1)
            count = np.zeros(len(nodes))
            order = np.argsort(nodes, kind="stable")
            rank = np.empty(len(nodes), np.int64)
            rank[order] = np.arange(len(nodes))
            label = np.arange(len(nodes))
            for i, j in Tile(t, bits, threshold, confidence).pairs():
                exact = np.einsum("ij,ij->i", scaled[i], scaled[j]) / (norm[i] * norm[j]) >= threshold
                i, j = i[exact], j[exact]
                count += np.bincount(i, n[j], len(nodes)) + np.bincount(j, n[i], len(nodes))
                known = np.arange(len(nodes))
                label = forest(len(nodes), np.concatenate([known, rank[i]]), np.concatenate([label, rank[j]]))
            rows = np.flatnonzero(count > 0)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), pa.array(count[rows].astype(np.int64)), pa.array(nodes[order[label[rank[rows]]]])], ["a", "n", "b"])

    return members.mapInArrow(run, "a long, n long, b long")


def links(classes: DataFrame, threshold: float, miss: float, seed: int, confidence: float, block: int) -> DataFrame:
    """The links of ``classes(node, n, vec)``, as :func:`exact_links` gives them."""
    bits, bands = bands_for(classes.count(), threshold, miss)
    left = written(possible_members(written(coded(classes, bits, bands, seed), "codes"), bits, threshold, confidence, block), "members")
    members = left.join(classes.select("node", "n", "vec"), "node")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return exact_links(members.repartition(parts, *TILE).sortWithinPartitions(*TILE), bits, threshold, confidence)


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, miss: float = 1e-3, seed: int = 1, confidence: float = 5.0, block: int = 1024) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    rows = written(vectors(table, id_col, vec_col), "vectors")
    same = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = written(same.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = written(links(classes, threshold, miss, seed, confidence, block), "links")
    count = found.groupBy("a").agg(F.sum("n").alias("m"))
    roots = components(found.select("a", "b")).select(F.col("node").alias("_node"), "component")
    named = classes.select("node", "key", "id", "n").join(count, F.col("node") == F.col("a"), "left").join(roots, F.col("node") == F.col("_node"), "left")
    named = named.select("key", "id", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    named = written(named, "named")
    name = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = named.select("key", "n_links", "root").join(name, "root").drop("root")
    out = rows.select("id", "key").join(of_class, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))  # null where the vector cannot link
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op5(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs, for small tables: the links and the smallest id that they reach.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE NOT isnan(list_cosine_similarity(a.e, b.e)) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a AS x, least(a, b) AS c FROM p UNION SELECT p.a, r.c FROM r JOIN p ON p.b = r.x),
m AS (SELECT x, least(x, min(c)) AS c FROM r GROUP BY x), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m.c, vec_id) AS component_id, coalesce(m.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.x = vec_id
"""
