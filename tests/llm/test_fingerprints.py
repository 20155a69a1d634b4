"""Winnowed fingerprints against their definition, and the query against a plain version of it."""

import hashlib
import random

import numpy as np
import pytest

from gridloom.llm import winnowing
from gridloom.llm.anchors import BASE

M = 1 << 64
SCHEMA = "doc_id long, text string, _row string, id long, key string, block int, guest boolean, row string, has boolean"


def mixed(h):
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 % M
    return h ^ (h >> 29)


def plain_hash(gram):
    return mixed(sum(mixed((ord(c) * BASE + 1) % M) * pow(BASE, k, M) for k, c in enumerate(gram)) % M) >> 20


def plain_winnow(text, gram, window):
    """Hashes and places by the definition: every window's smallest hash, the rightmost of equals."""
    g = [plain_hash(text[i : i + gram]) for i in range(max(1, len(text) - gram + 1))] if text else []
    found = []
    for w in range(max(1, len(g) - window + 1)) if g else []:
        part = g[w : w + window]
        at = w + max(i for i, h in enumerate(part) if h == min(part))
        if not found or found[-1] != at:
            found.append(at)
    return [g[i] for i in found], found


def own(text, gram=5, window=4):
    h, at = winnowing.winnow(winnowing.code_points(text), gram, window)
    return h.tolist(), at.tolist()


def test_winnow_by_definition():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 60)))
        assert own(text) == plain_winnow(text, 5, 4), text
    assert own("") == ([], []) and len(own("x" * 100)[0]) == 97 - 4  # all hashes are equal: each window has its rightmost
    text = "".join(rng.choice("abcdef ") for _ in range(400))
    assert own(text, 24, 37) == plain_winnow(text, 24, 37)


def test_pieces_do_not_change_a_fingerprint(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcd ") for _ in range(5000)) + "z" * 900
    whole = [x for x in zip(*own(text, 8, 9))]
    import gridloom.llm.winnowing as w

    monkeypatch.setattr(w, "PIECE", 300)  # LOW and the kept bits stay as they are
    assert [x for x in zip(*own(text, 8, 9))] == whole


def test_shared_passages_are_found_and_short_ones_are_not():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    for _ in range(60):
        passage = word(24 + 37 - 1)
        a, b = word(rng.randint(0, 200)), word(rng.randint(0, 200))
        one, two = own(a + passage + word(50), 24, 37), own(b + passage + word(70), 24, 37)
        places = {(h, at - len(a)) for h, at in zip(*one)} & {(h, at - len(b)) for h, at in zip(*two)}
        assert any(0 <= at <= 60 - 24 for _, at in places)
        short = word(23)
        one, two = own(word(200) + "<" + short + ">" + word(100), 24, 37), own(word(200) + "[" + short + "]" + word(100), 24, 37)
        assert not set(one[0]) & set(two[0])


TEXTS = [
    (5, "The quick brown fox jumps over the lazy dog. " * 6), (None, "no id " * 30), (2, None), (2, ""), (7, "aé😀x"), (9, "short"), (5, "The quick brown fox jumps over the lazy dog. " * 6),
    (-(1 << 63), "least id " * 40), (12, "q" * 3000), (None, None), ((1 << 63) - 1, "largest id " * 33), (13, "".join(chr(97 + i * i % 26) for i in range(7000))),
]


def expected(rows, gram=winnowing.GRAM, window=winnowing.WINDOW):
    """Of rows in their order: (id, n, sha, fingerprint, edited fingerprint, near_edited, near_next)."""
    out = []
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        h, e, x = (plain_winnow(t, gram, window)[0] for t in (text, edited, after))
        shown = lambda v: "".join(f"{i:012x}" for i in v)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(h), shown(e), like(set(h), set(e)), like(set(h), set(x))))
    return out


def result(df):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))


@pytest.mark.parametrize("rows_per_block", [1, 3, 2048])
def test_edited_texts(spark, tmp_path, rows_per_block):
    rows = [(d, t, "r", 1, "k", 3, True, "x", False) for d, t in TEXTS]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    order = sorted(range(len(TEXTS)), key=lambda i: (TEXTS[i][0] is not None, TEXTS[i][0] or 0, i))
    want = sorted(map(repr, expected([TEXTS[i] for i in order])))
    assert result(winnowing.edited_likeness(spark.read.parquet(path).drop("_row"), rows_per_block=rows_per_block)) == want
    assert result(winnowing.edited_likeness(spark.read.parquet(path), rows_per_block=rows_per_block)) == want


def test_few_and_no_documents(spark, tmp_path):
    for k, rows in enumerate(([], [(4, "one text " * 20)], [(4, "one " * 20), (3, "two " * 50)])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / str(k)))
        found = result(winnowing.edited_likeness(spark.read.parquet(str(tmp_path / str(k)))))
        assert found == sorted(map(repr, expected(sorted(rows))))


def test_query_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    short = [i for i in range(len(rows)) if len(rows[i][1] or "") + len(rows[(i + 1) % len(rows)][1] or "") < 3000]
    want = {i: expected([rows[i], rows[(i + 1) % len(rows)]])[0] for i in short}
    found = {r["doc_id"]: r for r in winnowing.op11(spark, sf).collect()}
    assert len(found) == len(rows) and len(short) > 20
    for i in short:
        r, w = found[rows[i][0]], want[i]
        assert tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) == w
    long = [r for r in found.values() if r["n_chars"] > 600]
    assert np.mean([r["near_edited"] for r in long]) > 0.5 > 0.1 > np.mean([r["near_next"] for r in long])


def test_matches_tell_where_passages_are(spark):
    passage = "a passage that stands in several of the documents, long enough for the guarantee to hold"
    docs = spark.createDataFrame([(i, "x" * i + str(i) * 3 + passage + "tail" * (i % 3)) for i in range(1, 40)] + [(99, "something else altogether, which nobody has copied from anywhere so far, I hope")], "doc_id long, text string")
    found = {(r["a"], r["b"]) for r in winnowing.matches(winnowing.fingerprints(docs)).collect()}
    assert {b for a, b in found if a == 1} >= set(range(2, 40)) and not any(99 in pair for pair in found)


def test_very_long_text(spark):
    text = "".join(random.Random(1).choices("abcdefgh \n", k=3_000_000))
    docs = spark.createDataFrame([(1, text), (2, text[:-1] + "#")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in winnowing.edited_likeness(docs).select("doc_id", "n_chars", "near_edited", "near_next", "n_hashes").collect()}
    assert found[1]["n_chars"] == 3_000_000 and found[1]["near_next"] > 0.999 and abs(found[1]["near_edited"] - 0.75) < 0.01  # its new part stands in it as well
    assert abs(found[1]["n_hashes"] / (3_000_000 * 2 / 38) - 1) < 0.05
