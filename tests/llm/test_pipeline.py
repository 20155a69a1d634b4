"""Each stage of the pipeline against brute force on its own input, and the whole run."""

import hashlib
import random
import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from gridloom.llm import mixing, pieces

SF = "/root/testdata/sf0.001"
FOREIGN = ["Привет, как дела? Это русский текст для проверки, в нём нет ни одного слова другого языка.", "これは日本語の文章です。今日は天気がいいですね。明日も晴れるでしょう。"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before the first and after each stage."""
    extra = [(100000, None, "en", "src0", 0), (100001, "", "en", None, 0), (100002, "?? !! 123", "en", "src1", 9)]
    rng = random.Random(7)
    extra += [(k, t, None, "src0", len(t)) for k, t in enumerate(FOREIGN + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(500)) for _ in range(5)], 100003)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).unionByName(docs.where("doc_id < 20").withColumn("doc_id", docs["doc_id"] + 200000))
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    for df in stages[1:5]:
        assert [f.name for f in df.schema] == [f.name for f in stages[0].schema]


def test_language_keeps_clean_documents(stages):
    before, after = texts(stages[0]), texts(stages[1])
    gone = set(before) - set(after)
    assert set(range(100000, 100010)) <= gone and len(gone) <= 10 + 0.02 * len(before)


def test_exact(stages):
    before, after = texts(stages[1]), texts(stages[2])
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t) for i, t in before.items()}
    best = {}
    for i in sorted(before, key=lambda i: (-len(before[i]), i)):
        best.setdefault(norm[i], i)
    assert set(after) == set(best.values())


def test_near(stages):
    before, after = texts(stages[2]), texts(stages[3])
    words = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t).split() for i, t in before.items()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    ids = sorted(before)
    close = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(a, b) >= 0.8]
    linked = {x for pair in close for x in pair}
    assert set(before) - set(after) <= linked  # what goes has a near copy, at 0.8 and not below
    assert close and not any(x in after and y in after for x, y in close)


def test_mix(stages):
    found = {r["doc_id"]: r for r in mixing.mix(stages[3]).collect()}
    want = Counter({i: r["times"] for i, r in found.items() if r["times"]})
    assert Counter(r["doc_id"] for r in stages[4].collect()) == want
    total = sum(r["size"] for r in found.values())
    assert sum(found[i]["size"] * n for i, n in want.items()) == pytest.approx(1.5 * total, rel=0.1)


def test_null_and_repeated_ids(spark):
    """Rows without an id and rows of one id are documents like any other."""
    texts = [(None, "a b c d", "s"), (None, "ab cd", "s"), (None, "e f g", "s"), (5, "h i j k", "s"), (5, "h i j k", "s"), (5, "l m", "s"), (6, "hij k", "s")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in texts], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.exact_copies(spark, docs, SF)
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in once.collect()) == [(0, "a b c d"), (0, "e f g"), (5, "h i j k"), (5, "l m")]
    mixed = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mixture(spark, docs, SF).collect())
    held = Counter((i, t) for i, t, _ in texts)
    assert set(mixed) == set(held)  # the one source is taken one and a half times
    assert all(held[k] <= n <= 2 * held[k] for k, n in mixed.items())


def test_tokens(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = Counter()
    for r in stages[4].collect():
        ids = library.encode(r["text"])
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stages[5].collect()) == want


def test_run(spark, tmp_path):
    assert "pipeline" in __spark_entry__.queries()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
