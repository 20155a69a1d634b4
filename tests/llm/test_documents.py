"""Each document operator against a brute-force version, on texts with every awkward case."""

import dataclasses
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import xxhash

from gridloom.llm import exact_dedup, langid, licenses, mixing, pieces, sharding, simhash, suffix_dedup, window_index

PASSAGE = " ".join(f"word{i} of{i % 7} the" for i in range(60))
LONG = " ".join(f"w{i * i % 1009}" for i in range(9000))
TEXTS = [
    None, "", " \t\n", "a", "Hello World", "hello  world", "HelloWorld", PASSAGE, PASSAGE + " end", "start " + PASSAGE, PASSAGE, LONG, LONG + " x", "x" * 5000, "été déjà vu  中文 😀 ▁ \x00 ﬁ",
    "This is released under the MIT License. See the Apache  License, and the GNU General-Public\nLicense", "Licensed under CC BY-NC 4.0.", "mit licenses MIT LICENSE", "aaaa " * 300, "one two three four five six seven eight nine ten",
    "the quick brown fox jumps over the lazy dog " * 5, "the quick brown fox jumps over the lazy cat " * 5,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, ah string, word int, key string, label string"


def rows():
    out = [(i, t, ["en", "fr", None][i % 3], [None, "b", "a", "é"][i % 4], 0, 7, "x", 1, None, "y") for i, t in enumerate(TEXTS)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_pieces(spark, docs, none):
    import sentencepiece

    model = pieces.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    vocabulary = pieces.Vocabulary.load(model)
    found = by_id(pieces.encode_decode(docs, vocabulary))
    assert len(found) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "")
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode())), t
    assert pieces.encode_decode(none, vocabulary).count() == 0
    ids = pieces.encode_texts(docs, vocabulary)
    back = by_id(pieces.decode_ids(ids, vocabulary))
    for i, t in enumerate(TEXTS):
        assert back[i]["text"] == library.decode(library.encode(t or ""))


def test_pieces_random():
    import random

    import sentencepiece

    rng = random.Random(5)
    model = pieces.default_model()
    library, codec = sentencepiece.SentencePieceProcessor(model_file=model), pieces.Codec(pieces.Vocabulary.load(model))
    alphabet = list("abcdetrsin  \n\t▁éß12.,'-_<>xX　😀中한\x00") + ["the", "ing", "   "]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert codec.encode(text) == library.encode(text)


def test_mixing(docs, none):
    found = by_id(mixing.mix(docs))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(TEXTS)}
    src = {r[0]: r[3] for r in rows()}
    order = sorted({s for s in src.values() if s is not None}) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(size[i] for i in src if src[i] == s) for s in order}
    left, open_, target = 1.5 * sum(total.values()), set(order), {}
    while True:  # clamp and share again until nothing is above
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * total[s]]
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2 * total[s]
            left -= target[s]
            open_.remove(s)
        if not open_:
            break
    for i, r in found.items():
        assert (r["size"], r["source_size"]) == (size[i], total[src[i]])
        assert r["target"] == pytest.approx(target[src[i]])
        assert r["times"] <= 2
    for s in order:
        taken = sum(found[i]["size"] * found[i]["times"] for i in src if src[i] == s)
        assert abs(taken - target[s]) <= max(size[i] for i in src if src[i] == s) / 2 + 1
    assert found == by_id(mixing.mix(docs.repartition(5)))
    assert mixing.mix(none).count() == 0


def test_shards(docs, none, spark):
    tree = sharding.Tree.of(16)
    found = by_id(sharding.shard_rows(docs, tree))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        assert (found[i]["size"], found[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert found[i]["grown_shard"] in (found[i]["shard"], 16)
    for s in {r["shard"] for r in found.values()}:
        slots = sorted(r["slot"] for r in found.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_rows(none, tree).count() == 0
    many = spark.range(40000).withColumnRenamed("id", "doc_id")
    n = tree
    for k in range(3):  # any number of shards may be added
        more = n.grow()
        moved = many.select(n.place(many["doc_id"]).alias("a"), more.place(many["doc_id"]).alias("b"))
        assert moved.where(f"a <> b AND b <> {16 + k}").count() == 0
        share = moved.where(f"b = {16 + k}").count() / 40000
        assert share == pytest.approx(1 / (17 + k), rel=0.15)
        n = more
    counts = [r["count"] for r in many.groupBy(tree.place(many["doc_id"])).count().collect()]
    assert len(counts) == 16 and max(counts) < 1.2 * min(counts)


def brute_place(tree, key, seed=0):
    """The descent from its definition: at each level the child with the smallest ``-ln(u) / weight``."""
    left = list(tree.shards)
    for level in (lambda s: s.region, lambda s: s.rack, lambda s: f"s{s.number}"):
        weights = {}
        for s in left:
            weights[level(s)] = weights.get(level(s), 0) + s.weight
        draw = lambda name: (int(hashlib.md5(f"{seed}:{name}:{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        won = min(weights, key=lambda name: -math.log(draw(name)) / weights[name]) if len(weights) > 1 else next(iter(weights))
        left = [s for s in left if level(s) == won]
    return left[0].number


def test_shards_against_the_definition_and_weights(spark):
    """Placement by brute force; a weight that changes moves rows only into or out of its own subtrees."""
    keys = spark.range(3000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.5, 0.5, 1.0, 4.0, 1.0, 1.0, 0.25, 1.0, 3.0]
    tree = sharding.Tree(tuple(dataclasses.replace(s, weight=w) for s, w in zip(sharding.Tree.of(10).shards, weights, strict=True)))
    heavier = sharding.Tree(tuple(dataclasses.replace(s, weight=s.weight * (3 if s.number == 5 else 1)) for s in tree.shards))
    placed = [tuple(r) for r in keys.select("doc_id", tree.place(keys["doc_id"]), heavier.place(keys["doc_id"]), tree.grow(2.0).place(keys["doc_id"])).collect()]
    for i, a, b, c in placed:
        assert (a, b, c) == (brute_place(tree, i), brute_place(heavier, i), brute_place(tree.grow(2.0), i))
    of = {s.number: s for s in tree.shards}
    moved = [(of[a], of[b]) for _, a, b, _ in placed if a != b]
    assert moved and all(b.region == of[5].region for _, b in moved)  # only the region that grew takes rows
    assert all(b.rack == of[5].rack for a, b in moved if a.region == b.region) and all(b.number == 5 for a, b in moved if a.rack == b.rack)
    assert {c for _, a, _, c in placed if a != c} == {10}
    for s in tree.shards:
        assert sum(a == s.number for _, a, _, _ in placed) == pytest.approx(3000 * s.weight / sum(weights), rel=0.3, abs=20)


def test_exact(docs, none, spark):
    found = by_id(exact_dedup.exact_dedup(docs))
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in TEXTS]
    for i in range(len(TEXTS)):
        same = [j for j in range(len(TEXTS)) if norm[j] == norm[i]]
        keep = min(same, key=lambda j: (-len(TEXTS[j] or ""), j))
        assert (found[i]["keep_id"], found[i]["group_size"], found[i]["kept"]) == (keep, len(same), keep == i), TEXTS[i]
    assert exact_dedup.exact_dedup(none).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "ab"), (2, "zz")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(twice).collect()) == [(0, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True), (2, 2, 1, True)]


def test_exact_query_with_repeated_and_null_ids(spark, tmp_path):
    """One row for each row of the table, whatever its id, with the digest of its own text."""
    table = [(1, "a b"), (1, "ab"), (1, "other"), (None, "ab"), (None, None), (None, "own"), (2, ""), (3, " "), (2, "x y"), (4, "xy ")]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want = []
    for k, (i, t) in enumerate(table):
        same = [j for j in range(len(table)) if norm(table[j][1]) == norm(t)]
        lead = min(same, key=lambda j: (-len(table[j][1] or ""), table[j][0] is None, table[j][0] or 0, j))
        want.append((i or 0, table[lead][0] or 0, len(same), k == lead, sha(norm(t).encode())))
    found = exact_dedup.op6(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"], r["text_sha256"]) for r in found) == sorted(want)
    numbered = spark.createDataFrame([(k, *r) for k, r in enumerate(table)], "_row long, doc_id long, text string")
    gone = {r["row"] for r in exact_dedup.exact_groups(numbered, "_row").where("row <> keep_row").collect()}
    assert len(table) - len(gone) == sum(r[3] for r in want)


def brute_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius", [4, 20])
def test_simhash(docs, none, radius):
    found = {r["id"]: r for r in simhash.simhash_groups(docs, width=4, radius=min(radius, 7)).collect()}
    radius = min(radius, 7)
    fp = [brute_fingerprint(t, 4) for t in TEXTS]
    comp = list(range(len(TEXTS)))
    for _ in comp:
        comp = [min(comp[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= radius) for i in range(len(fp))]
    for i in range(len(TEXTS)):
        assert found[i]["fp"] % (1 << 64) == fp[i]
        assert found[i]["component"] == comp[i]
    assert simhash.simhash_groups(none).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_licenses(docs, none):
    found = by_id(licenses.scan(docs))
    for i, t in enumerate(TEXTS):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = found[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        labels = {x for _, x in places}
        for label, q, p in licenses.PARTS:  # every place, with the same tests
            at = next(k for k in range(len(p)) if p[k : k + len(q)] == q)
            for k in range(-len(p), len(words)):
                hit = [0 <= k + n < len(words) and words[k + n] == w for n, w in enumerate(p)]
                if all(hit[at : at + len(q)]) and sum(hit) >= 0.8 * len(p):
                    labels.add(label)
        assert r["labels"] == ",".join(sorted(labels)) and 0 <= r["score"] <= 1
    assert licenses.scan(none).count() == 0


def test_licenses_together(spark):
    """Every label of a document with several licences is found, whatever the other documents hold."""
    passages = {}
    for label, _, passage in licenses.TEMPLATES:
        passages[label] = passages.get(label, "") + passage + "\n\n"
    mixed = [("mit", "cc-by-4.0"), ("bsd-3-clause", "apache-2.0", "cc0-1.0"), ("mit", "isc", "gpl-3", "mpl-2.0"), tuple(passages), tuple(reversed(passages))]
    texts = [". then\n".join(passages[x] for x in labels) for labels in mixed] + ["apache license version 2 0 cc by 4 0"] * 8 + ["nothing here"] * 4
    texts += ["word " * 30 + passage + " word" * 9 for _, _, passage in licenses.TEMPLATES]
    found = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, labels in enumerate(mixed):
        assert set(labels) <= set(found[i]["labels"].split(",")), labels
    for i, (label, _, _) in enumerate(licenses.TEMPLATES, len(texts) - len(licenses.TEMPLATES)):
        assert label in found[i]["labels"].split(",") and found[i]["score"] == 1


def test_licenses_in_rows_that_share_an_id(spark):
    rows = [(1, "MIT License"), (1, "nothing"), (None, "Apache License, Version 2.0"), (None, None), (1, "released under the MIT License")]
    found = sorted((str(r["doc_id"]), r["n_words"], r["labels"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == sorted([("1", 2, "mit"), ("1", 1, ""), ("None", 5, "apache"), ("None", 0, ""), ("1", 5, "mit,mit-notice")])


@pytest.mark.parametrize("block", [20, 300])
def test_suffixes_large_anchor(spark, block):
    """A line in hundreds of contexts is dealt to parts; windows are found across parts and no context matches itself."""
    import random

    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, tail, head = noise(380), noise(300), noise(45)
    texts = [noise(500) + line + noise(500) for _ in range(300)] + [noise(500) + line + tail + noise(200) for _ in range(4)]
    texts += [noise(500) + head[-n:] + line + tail[: 45 - n] + noise(500) for n in range(1, 45) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r["doc"]: [] for r in docs.selectExpr("doc_id AS doc").collect()}
    for r in suffix_dedup.repeated_spans(docs, block=block).collect():
        found[r["doc"]] += range(r["start"], r["start"] + r["n"])
    seen = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    for i, t in enumerate(texts):
        assert set(found[i]) == {k for k in range(len(t) - 399) if seen[t[k : k + 400]] > 1}, i


def test_suffixes_grow_with_the_borders(spark, tmp_path):
    """Rows dealt for a line that many documents share: twice as many documents give twice as many."""
    import random

    from gridloom.llm import common

    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, dealt, was = noise(370), [], suffix_dedup.written

    def counting(df, what):
        out = was(df, what)
        if what == "borders":
            dealt.append(common.parts(out, ["k"], out["at"], 50).count())
        return out

    suffix_dedup.written = counting
    try:
        for n in (200, 400, 800):
            texts = [(i, noise(300) + line + noise(300)) for i in range(n)]
            assert suffix_dedup.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string")).count() == 0
    finally:
        suffix_dedup.written = was
    assert dealt[0] >= 200 and dealt[2] <= 4.4 * dealt[0]


def test_suffixes(docs, none):
    found = by_id(suffix_dedup.suffix_dedup(docs))
    raw = [(t or "").encode() for t in TEXTS]
    seen = Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        assert (found[i]["n_units"], found[i]["n_removed"], found[i]["n_spans"], found[i]["kept_sha256"]) == (len(b), sum(gone), runs, sha(kept)), i
    assert suffix_dedup.suffix_dedup(none).count() == 0


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_windows(docs, none, batches):
    found = by_id(window_index.window_dedup(docs, batches=batches))
    seen = set()
    for i, t in enumerate(TEXTS):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        assert (found[i]["n_units"], found[i]["n_removed"], found[i]["kept_sha256"]) == (len(words), sum(gone), sha(kept)), i
    assert window_index.window_dedup(none).count() == 0


def test_index_is_stored_compacted_and_extended(spark, docs, tmp_path):
    """Runs are merged as they come, an index is found again in its folder, and a second batch is held against the first."""
    index = window_index.FingerprintIndex(spark, str(tmp_path / "index"), buckets=3)
    old, new = docs.where("doc_id < 11"), docs.where("doc_id >= 11")
    window_index.window_dedup(old, batches=4, index=index).count()
    assert index.compactions >= 1 and len(index.runs) < 4
    index.save()
    again = window_index.FingerprintIndex.load(spark, str(tmp_path / "index"))
    assert again.runs == index.runs and again.buckets == 3
    found = by_id(window_index.window_dedup(new, batches=2, index=again, history=old))
    whole = by_id(window_index.window_dedup(docs))
    assert set(found) == set(range(11, len(TEXTS)))
    assert all((found[i]["n_removed"], found[i]["kept_sha256"]) == (whole[i]["n_removed"], whole[i]["kept_sha256"]) for i in found)
    plan = again.read(again.runs[0][0]).join(again.read(again.runs[-1][0]).select("ah").hint("merge"), "ah", "left_semi")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    hits = again.add(spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "ah long, n long"))
    assert [r["ah"] for r in hits.collect()] == [2]
    assert {r["ah"] for r in again.add(spark.createDataFrame([(1, 1), (5, 1)], "ah long, n long")).collect()} == {1}
    again.drop()


def test_language(docs, none, spark):
    from pyspark.sql import functions as F

    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(real, ~langid.held_out())
    got = langid.predict(real, model).join(real.select("doc_id", "lang"), "doc_id").where(langid.held_out()).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
    assert got["rejected"].mean() < 0.02
    found = by_id(langid.predict(docs, model))
    for i, t in enumerate(TEXTS):
        letters = bool(re.search(r"[^\W\d_]", t or ""))
        assert (found[i]["lang_pred"] == "und") == (not letters) and 0 <= found[i]["score"] <= 1
    assert langid.predict(none, model).count() == 0
    assert langid.fit(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.accepted(docs, model).columns == docs.columns


def brute_kneser_ney(words, floor, order=4):
    """Interpolated Kneser-Ney from the definition, with dictionaries: a function of context and character."""
    counts = Counter()
    for w, n in words.items():
        marked = f"\x02{w}\x03"
        for i in range(1, len(marked)):
            counts[marked[max(0, i - order + 1) : i + 1]] += n
    tables = {}
    for k in range(order, 0, -1):
        tables[k] = Counter({g: n for g, n in counts.items() if len(g) == k})
        counts = Counter({g: n for g, n in counts.items() if len(g) < k})
        for g in tables[k]:
            counts[g[1:]] += 1

    def p(context, char):
        context = context[-(order - 1) :]
        k = len(context) + 1
        table = tables[k]
        n1, n2 = (sum(v == x for v in table.values()) for x in (1, 2))
        d = min(0.9, max(0.1, n1 / max(1, n1 + 2 * n2)))
        after = [v for g, v in table.items() if g[:-1] == context]
        lower = p(context[1:], char) if context else floor
        if not after:
            return lower
        return max(table[context + char] - d, 0) / sum(after) * (table[context + char] > 0) + d * len(after) / sum(after) * lower

    return p


def test_kneser_ney_against_the_definition():
    import numpy as np
    import pandas as pd

    corpora = {"xx": Counter("the then there other that three then the".split()), "yy": Counter("dass das der die den dem des da".split())}
    rows = [(lang, g, n) for lang, words in corpora.items() for g, n in langid.gram_counts(words).items()]
    model = langid.model_of(pd.DataFrame(rows, columns=["lang", "gram", "n"]))
    everything = {c for words in corpora.values() for w in words for c in w} | {"\x03"}
    asked = ["the", "thermal", "das", "q", "zzz", "eth", "dash"]
    bits, lengths = model.char_bits(asked)
    ends = np.cumsum(lengths)
    for col, lang in enumerate(model.languages):
        p = brute_kneser_ney(corpora[lang], 1 / (len(everything) + 1))
        for word, end, n in zip(asked, ends, lengths, strict=True):
            marked = f"\x02{word}\x03"
            for i in range(1, len(marked)):
                assert 2 ** -bits[end - n + i - 1, col] == pytest.approx(p(marked[max(0, i - 3) : i], marked[i]), rel=1e-9), (lang, word, i)
        # over the whole alphabet and one unseen character, each context's probabilities add up to one
        for head in ("th", "d", "zz"):
            tried = [head + c for c in sorted(everything - {"\x03"}) + ["\u4e2d"]]
            b, n = model.char_bits(tried)
            at = np.cumsum(n) - 2
            end_mark = model.char_bits([head])[0][-1, col]
            assert sum(2 ** -b[at, col]) + 2**-end_mark == pytest.approx(1, abs=1e-9)


def test_language_left_out_is_rejected(spark):
    """Texts of a language that was not learned, random letters and other scripts go; texts of the others stay."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL")
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(400)) for _ in range(40)]
    strange = letters + ["これは日本語の文章です。今日は天気がいいですね。", "Привет, как дела? Это русский текст для проверки.", "zzzz qqqq"]
    for left in ("fr", "en"):
        model = langid.fit(real, (F.col("lang") != left) & ~langid.held_out())
        foreign = langid.predict(real.where(F.col("lang") == left), model).where("chars >= 50").agg(F.avg(F.col("rejected").cast("int"))).first()[0]
        own = langid.predict(real.where((F.col("lang") != left) & langid.held_out()), model).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
        assert foreign >= 0.9 and own <= 0.02, (left, foreign, own)
        assert all(r["rejected"] for r in langid.predict(spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string"), model).collect())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_language_rejects_gibberish_at_any_size(spark, size):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    real = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    junk = [(k, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 12))) for _ in range(80))) for k in range(40)]
    model = langid.fit(real, F.lit(True))
    assert len(model.limit) == len(model.languages) and all(x < 1e9 for x in model.limit)
    assert all(r["rejected"] for r in langid.predict(spark.createDataFrame(junk, "doc_id long, text string"), model).collect())
    assert langid.accepted(real, model).count() >= 0.98 * real.count()
