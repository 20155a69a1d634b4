"""Links of large groups against brute force, how their work grows, and recall of near copies by similarity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, links, simhash


def plain_components(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        a, b = label[a], label[b]
        if a != b:
            low, high = min(a, b), max(a, b)
            label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("kind", ["all alike", "two halves", "chain", "all apart", "stragglers"])
@pytest.mark.parametrize("rounds", [1, 2])
def test_components_of_large_groups(spark, kind, rounds):
    """Points on a line are linked when they are near; some groups are one tile, one is many."""
    rng = random.Random(len(kind))
    n = 400
    place = {
        "all alike": lambda i: rng.random(), "two halves": lambda i: rng.random() + 9 * (i % 2), "chain": lambda i: i * 0.9, "all apart": lambda i: i * 5.0, "stragglers": lambda i: rng.random() if i > 12 else 3.0 + (i // 2) * 4 + 0.5 * (i % 2),
    }[kind]
    at = [place(i) for i in range(n)] + [rng.random() * 40 for _ in range(60)]
    key = ["hot"] * n + [f"k{i % 6}" for i in range(60)]
    rows = spark.createDataFrame([(k, i, x) for i, (k, x) in enumerate(zip(key, at))], "k string, id long, x double").repartition(4)

    def near(t):
        x = t["x"].to_numpy()
        return np.nonzero(np.triu(np.abs(x[:, None] - x[None, :]) <= 1, 1))

    found = {r["node"]: r["component"] for r in links.linear_components(rows, ["k"], near, 30, rounds=rounds, centers=2).collect()}
    want = plain_components(n + 60, [(i, j) for i in range(n + 60) for j in range(i) if key[i] == key[j] and abs(at[i] - at[j]) <= 1])
    assert [found.get(i, i) for i in range(n + 60)] == want


def near_copies(n, rng, words=400, edits=4):
    page = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(page)
        for _ in range(edits):
            w[rng.randrange(words)] = f"e{rng.randrange(10**9)}"
        out.append((i, " ".join(w)))
    return out


def test_work_grows_with_a_cluster(spark, monkeypatch):
    """Rows dealt to tiles for one cluster of near copies: at most 2.2 times as many for twice the copies."""
    dealt = []
    was = links.tile_links

    def counting(tiles, key, pairs_of):
        tiles = common.written(tiles, "tiles")
        dealt[-1].append((tuple(key), tiles.count()))
        return was(tiles, key, pairs_of)

    monkeypatch.setattr(links, "tile_links", counting)
    rng = random.Random(3)
    for n in (500, 1000, 2000):
        dealt.append([])
        docs = spark.createDataFrame(near_copies(n, rng), "doc_id long, text string")
        assert simhash.keep_one(docs).count() == 1
    total = lambda run, key: sum(c for k, c in run if k == key)
    for key in (("k", "v"), ("component",)):
        counts = [total(run, key) for run in dealt]
        assert all(b <= 2.2 * a for a, b in zip(counts, counts[1:])), counts
        assert counts[2] <= 40 * 2000


def test_recall_by_similarity(spark):
    """Pairs at 0.8 and above that end in one group, by band of similarity; no group joins what no chain of such pairs joins."""
    rng = random.Random(9)
    texts, base = [], 0
    for _ in range(150):
        words = [f"v{rng.randrange(10**9)}" for _ in range(rng.randint(60, 500))]
        texts.append(words)
        for share in (0.005, 0.012, 0.02, 0.03):
            w = list(words)
            for _ in range(max(1, round(share * len(w)))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
            texts.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    pairs = []
    for base in range(0, len(texts), 5):
        for i in range(base, base + 5):
            for j in range(base, i):
                pairs.append((len(sets[i] & sets[j]) / len(sets[i] | sets[j]), i, j))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    group = {r["id"]: r["component"] for r in simhash.similar_groups(docs).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        band = [(i, j) for s, i, j in pairs if low <= s < high]
        assert len(band) > 50 and sum(group[i] == group[j] for i, j in band) >= 0.99 * len(band)
    want = plain_components(len(texts), [(i, j) for s, i, j in pairs if s >= 0.8])
    assert sum(group[i] == want[i] for i in range(len(texts))) >= 0.99 * len(texts) and all(want[group[i]] == want[i] for i in range(len(texts)))


def test_partitions_are_made_once(spark, monkeypatch):
    """Whatever reads the dealt rows again, also in large groups, reads files."""
    given = []
    monkeypatch.setattr(simhash, "linear_components", lambda rows, *_: given.append(rows) or rows)
    classes = spark.createDataFrame([(i, i, bytes(simhash.SKETCH // 2), [0] * simhash.BANDS) for i in range(5)], "id long, fp long, sketch binary, bands array<int>")
    simhash.possible_groups(classes, 28, 0.5)
    assert "Generate" not in given[0]._jdf.queryExecution().executedPlan().toString()
    assert given[0].count() == 5 * (simhash.BANDS + len(simhash.partition_keys(4, simhash.CLOSE)))
