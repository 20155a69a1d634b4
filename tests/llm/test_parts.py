import random

import numpy as np
import pytest

from gridloom.llm import anchors, common, embeddings, simhash, suffixes


def test_suffix_array_is_sorted():
    rng = random.Random(2)
    for _ in range(400):
        s = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(0, 40))]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
        depth = rng.randint(1, 5)
        c = suffixes.classes(s, depth)
        for i in range(len(s)):
            twins = [j for j in range(len(s)) if j != i and s[i : i + depth] == s[j : j + depth] and len(s[j : j + depth]) == depth and len(s[i : i + depth]) == depth]
            assert (c[i] >= 0) == bool(twins) and all(c[j] == c[i] for j in twins)


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(1)
    units = rng.integers(0, 1 << 60, 3000).astype(np.uint64) % np.uint64(40)
    ah, place, first, last = anchors.Piece.of(0, units).anchors(400, 32)
    owned = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert (owned == np.arange(len(units) - 399)).all()
    assert ((first <= place) & (place + 32 <= last + 400)).all()


def test_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 128)
    monkeypatch.setattr(anchors, "_powers", [])
    units = np.random.default_rng(2).integers(0, 1 << 60, 1000).astype(np.uint64)
    starts = [p.at + k for p in anchors.pieces(units, 20) for k in range(len(p.units) - 19)]
    assert starts == list(range(981))
    whole = {(p.at + int(s)): int(h) for p in anchors.pieces(units, 20) for s, h in enumerate(p.rolling(20))}
    assert len(whole) == 981
    monkeypatch.undo()
    anchors._powers.clear()
    assert list(whole.values()) == anchors.Piece.of(0, units).rolling(20).tolist()


def test_blocks_find_all_pairs():
    rng = random.Random(3)
    for radius in (1, 4, 6):
        for m in (radius + 1, radius + 2):
            masks = simhash.partition_keys(m, radius)
            for _ in range(300):
                a = rng.getrandbits(64)
                b = a
                for k in rng.sample(range(64), radius):
                    b ^= 1 << k
                assert any(a & x == b & x for x in masks)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5000, 5000)] + [(3000, 3000 + i) for i in range(1, 300)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and got[1001] == 1000 and {got[3000 + i] for i in range(300)} == {3000} and 5000 not in got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_bring_every_pair_together_once(spark):
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 1), ("b", 50), ("c", 7)) for i in range(n)], "k string, id long")
    dealt = common.tiles(rows, ["k"], rows["id"], 8).collect()
    met = {}
    for t in {(r["k"], r["ti"], r["tj"]) for r in dealt}:
        own = [r for r in dealt if (r["k"], r["ti"], r["tj"]) == t]
        for p in own:
            for q in own:
                if p["k"] != "a" and p["id"] < q["id"] and {p["part"], q["part"]} == {t[1], t[2]}:
                    met[t[0], p["id"], q["id"]] = met.get((t[0], p["id"], q["id"]), 0) + 1
    assert set(met.values()) == {1} and len(met) == 50 * 49 // 2 + 7 * 6 // 2


def vectors(seed, n=600, d=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    near = base[:80] + rng.standard_normal((80, d)) * rng.uniform(0.05, 0.45, (80, 1))
    crowd = base[:1] + rng.standard_normal((120, d)) * 0.1
    return np.concatenate([base, near, crowd, base[5:8], 3 * base[9:11]])


@pytest.mark.parametrize("block", [16, 1024])
def test_embeddings(spark, block):
    v = vectors(4).astype(np.float32).astype(float)
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 0.0], [1.0, 0.01]]
    data = [(i, x, "c") for i, x in enumerate([*v.tolist(), *odd])]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, id string"), block=block).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    n = len(v)
    links = near.sum(1)
    found = np.array([got[i]["n_links"] for i in range(n)])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    comp = np.arange(n)
    for _ in range(n):
        new = np.array([min(comp[i], comp[near[i]].min(initial=n)) for i in range(n)])
        if (new == comp).all():
            break
        comp = new
    assert [got[i]["component_id"] for i in range(n)] == comp.tolist()
    for i in range(n, n + 6):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[n + 6]["n_links"] == 1 and got[n + 7]["component_id"] == n + 6
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_with_null_and_repeated_ids(spark):
    """Each row is a vector of its own: three equal ones have two links each, whatever their ids."""
    a, b, c = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    near = [1.0, 0.0, 0.01, 0.1]
    data = [(1, a), (None, a), (3, a), (3, b), (None, c), (None, c), (4, near), (5, None), (None, None)]
    got = embeddings.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    want = [(1, 3, 1, True), (None, 3, 1, False), (3, 3, 1, False), (3, 0, 3, True), (None, 1, None, True), (None, 1, None, True), (4, 3, 1, False), (5, 0, 5, True), (None, 0, None, True)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_similar_texts_are_grouped_and_others_are_not(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randint(150, 400))] for _ in range(300)]
    texts = [" ".join(w) for w in base]
    want = []
    for k in range(60):
        w = list(base[k])
        for _ in range(len(w) // 60):  # a word changes five shingles; about 0.85
            w[rng.randrange(len(w))] = "changed"
        s = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
        if len(s(w) & s(base[k])) / len(s(w) | s(base[k])) >= 0.8:
            want.append((k, len(texts)))
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash.similar_groups(docs).collect()}
    assert sum(got[a] == got[b] for a, b in want) >= 0.9 * len(want) and len(want) > 30
    assert all(got[i] == i for i in range(300))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id < 300").count() == 300


def test_similarity_has_an_exact_border(spark):
    """Shares of a text at 0.8 and above are linked with it, those just below are not."""
    rng = random.Random(4)
    texts, linked = [], []
    for k in range(240):
        words = [f"v{rng.randrange(10**9)}" for _ in range(304)]  # 300 shingles
        n = 240 + k % 8 if k % 2 else 239 - k % 24
        texts += [" ".join(words), " ".join(words[: n + 4])]
        linked.append(n >= 240)
    got = {r["id"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[2 * k + 1] == 2 * k for k in range(240)] == linked


def test_repeats_do_not_make_texts_similar(spark):
    """A line that repeats outvotes the rest of a fingerprint; the documents differ all the same, and ids may be null or repeated."""
    rng = random.Random(6)
    line = " ".join(f"l{i}" for i in range(9)) + "\n"
    texts = [line * 100 + " ".join(f"b{rng.randrange(10**9)}" for _ in range(500)) for _ in range(12)]
    ids = [*range(8), 8, 8, None, None]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_one(docs).collect()) == sorted(texts)
    same = spark.createDataFrame([(None, texts[0]), (None, texts[0]), (3, texts[1]), (3, texts[1] + " more"), (None, texts[1])], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"][-5:] == " more") for r in simhash.keep_one(same).collect())[0] == (0, False)
    assert simhash.keep_one(same).count() == 2


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for shared in (0, 250, 400, 500):
        pool = rng.integers(0, 1 << 64, 1000 - shared, np.uint64)
        found = []
        for turn in range(40):
            part = np.roll(pool, 17 * turn) ^ np.uint64(turn)
            a, b = part[:500], part[500 - shared :]
            marks = [np.frombuffer(simhash.sketch(x), np.uint8)[None] for x in (a, b)]
            found.append(simhash.similarity_of(*marks)[0])
        assert abs(np.mean(found) - shared / (1000 - shared)) < 0.05
    assert len(simhash.sketch(np.empty(0, np.uint64))) == len(simhash.sketch(pool))
