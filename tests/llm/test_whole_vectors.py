"""Whitening against numpy's own eigenvectors and exact fractions; Lloyd rounds against a plain version in Python's whole numbers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from gridloom.llm import centroids, vectors, whitening

NAN, INF = float("nan"), float("inf")


def some_vectors(n=300, d=6, seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((d, d)) * np.geomspace(1, 1e-2, d)
    return (rng.standard_normal((n, d)) @ mix + rng.standard_normal(d)).tolist()


def test_jacobi_finds_small_eigenvalues():
    rng = np.random.default_rng(2)
    for d in (1, 2, 7, 40):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        e = np.geomspace(1e6, 1e-3, d)
        found, v = whitening.jacobi(q * e @ q.T)
        assert np.allclose(found, e, rtol=1e-6) and np.allclose(v.T @ v, np.eye(d), atol=1e-13)
        assert np.allclose(q * e @ q.T @ v, v * found, atol=1e-7)
    scale = np.diag(np.geomspace(1e8, 1e-8, 6))  # a graded matrix: small eigenvalues are right to nearly all digits
    base = np.eye(6) + 0.1 * np.ones((6, 6))
    found, _ = whitening.jacobi(scale @ base @ scale)
    assert abs(np.prod(found) / np.linalg.det(base) / np.prod(np.diag(scale) ** 2) - 1) < 1e-10
    assert (whitening.jacobi(np.zeros((3, 3)))[0] == 0).all()


def test_whole_numbers():
    m = np.array([[0.5, -0.5, 1e300, -1e300, 0.1, -0.0]])
    assert vectors.scaled_floor(m, 3).tolist() == [[1, -2, (1 << 63) - 1, -(1 << 63), 0, 0]]
    assert vectors.scaled_floor(np.array([[2.0**62, 2.0**63, -(2.0**63), 2.0**62 + 2048]]), 1).tolist() == [[1 << 62, (1 << 63) - 1, -(1 << 63), (1 << 62) + 2048]]


def plain_whitening(rows, k):
    """Per usable row: n, deviation, whitened up to sign, explained."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in {len(x) for _, x in good}:
        own = [(i, x) for i, x in good if len(x) == d]
        fit = sorted({tuple(x) for _, x in own})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit])
        e, v = np.linalg.eigh(centred.T @ centred / n)
        e, v = e[::-1][:k], v[:, ::-1][:, :k]
        for i, x in own:
            z = (np.array([(n * a - b) / n for a, b in zip(x, s)]) @ v) / np.sqrt(e)
            out += [(i, c + 1, n, sum((n * a - b) ** 2 for a, b in zip(x, s)), abs(z[c]), e[c] / np.trace(centred.T @ centred / n)) for c in range(len(e))]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[1]))


def test_whitening(spark):
    base = some_vectors()
    rows = list(enumerate(base)) + [(900 + i, base[0]) for i in range(40)] + [(5, base[7]), (None, base[9]), (901, None), (902, []), (903, [1.0, None, 0.0, 0.0]), (904, [NAN] * 6), (905, [INF, 0.0, 0.0])]
    rows += [(2000 + i, v[:2]) for i, v in enumerate(some_vectors(50, 3, 4))]  # another length: a table of its own
    table = spark.createDataFrame([(i, v, 3, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id long, x string, d int").repartition(5)
    found = sorted((tuple(r) for r in whitening.whitened(table).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[1]))
    want = plain_whitening(rows, 4)
    assert [r[:4] for r in found] == [w[:4] for w in want]
    assert np.allclose([abs(r[4]) for r in found], [w[4] for w in want], rtol=1e-8, atol=1e-9) and np.allclose([r[5] for r in found], [w[5] for w in want], rtol=1e-9)
    assert all(r[6] < 1e-9 for r in found)
    assert {len([r for r in found if r[0] == i]) for i in (5, 2001)} == {8, 2}


def test_whitening_of_few_and_huge(spark):
    kind = "vec_id long, embedding array<double>"
    run = lambda rows: whitening.whitened(spark.createDataFrame(rows, kind)).collect()
    assert run([]) == [] and run([(1, None)]) == []
    one = run([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert len(one) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, 0.0, 0.0, 0.0) for r in one)
    line = run([(i, [float(i), 2.0 * i, 0.0]) for i in range(10)])  # one direction only
    assert all(r["whitened"] == 0 for r in line if r["component"] > 1) and abs(line[0]["explained"] - 1) < 1e-12
    huge = run([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])])
    assert len(huge) == 6 and all(r["deviation"] is None or r["deviation"] >= 0 for r in huge) and any(r["deviation"] is None for r in huge)


def test_whitening_query(spark):
    found = whitening.op12(spark, "/root/testdata/sf0.001").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want = plain_whitening(rows, 4)
    found = sorted(map(tuple, found), key=lambda r: (r[0], r[2], r[3], r[1]))
    assert [r[:4] for r in found] == [w[:4] for w in want] and np.allclose([abs(r[4]) for r in found], [w[4] for w in want], rtol=1e-6, atol=1e-8)
    assert max(r[6] for r in found) < 1e-9 and np.allclose([r[5] for r in found], [w[5] for w in want], rtol=1e-9)


def plain_lloyd(rows, d=64, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    digest = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    now = [x for _, x in sorted(((digest(i), x) for i, x in kept))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min(range(len(now)), key=lambda c: (far(x, now[c]), c))
    for _ in range(rounds):
        own = [near(x) for _, x in kept]
        members = [[x for (_, x), o in zip(kept, own) if o == c] for c in range(len(now))]
        now = [[sum(col) // len(m) for col in zip(*m)] if m else c for c, m in zip(now, members)]
    own = [near(x) for _, x in kept]
    within = [sum(far(x, now[c]) for (_, x), o in zip(kept, own) if o == c) for c in range(len(now))]
    fits = lambda s: s if s < 1 << 63 else None
    return sorted(repr((i, o, fits(far(x, now[o])), fits(within[o]), fits(sum(within)), hashlib.sha256(",".join(map(str, now[o])).encode()).hexdigest())) for (i, x), o in zip(kept, own))


def lloyd(spark, rows, **how):
    table = spark.createDataFrame([(i, v, 3, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id long, x string, cluster int").repartition(3)
    return sorted(repr(tuple(r)) for r in centroids.clustered(table, **how).collect())


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_lloyd(spark, rounds):
    base = some_vectors(120, 5, 8)
    rows = list(enumerate(base)) + [(1000 + i, base[0]) for i in range(60)] + [(3, base[4]), (None, base[5]), (None, base[6]), (7, None), (8, []), (9, [1.0] * 4), (10, [NAN] * 5), (11, [None] + [0.0] * 4), (12, [-INF] * 5)]
    assert lloyd(spark, rows, d=5, rounds=rounds) == plain_lloyd(rows, 5, rounds=rounds)


def test_lloyd_with_ties_few_and_huge(spark):
    ties = [(i, [float(i % 2), 0.0]) for i in range(30)]  # equal vectors start several centroids: the smaller number takes them, the rest stay empty
    assert lloyd(spark, ties, d=2) == plain_lloyd(ties, 2)
    few = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert lloyd(spark, few, d=2) == plain_lloyd(few, 2) and lloyd(spark, []) == []
    rng = random.Random(1)
    huge = [(i, [rng.choice([1e12, -1e13, 3e5]) * rng.random(), rng.random()]) for i in range(40)]
    assert lloyd(spark, huge, d=2, k=3) == plain_lloyd(huge, 2, 3)


def test_lloyd_query_against_sql_and_plain(spark):
    sf = "/root/testdata/sf0.001"
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    found = sorted(repr(tuple(r)) for r in centroids.op13(spark, sf).select(names).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert found == sorted(repr(r) for r in con.execute(f"SELECT {', '.join(names)} FROM ({centroids.ORACLE})").fetchall())
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found == plain_lloyd(rows)
