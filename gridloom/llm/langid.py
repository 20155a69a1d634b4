"""Language identification by interpolated Kneser-Ney character models.

A text's words are its runs of letters in lower case, each with a mark at either end; contexts do not
reach across words, so a word has one log probability in each language and is scored once per task.
Each language has a model of order 4.  The highest order counts n-grams, lower orders count the
different characters seen before them (n-grams at the beginning of a word keep their counts); each
order is discounted and interpolated with the next lower one, down to a uniform distribution.

A model is a sorted array of n-gram hashes for each order, with a row of discounted probabilities per
language, and one of context hashes with rows of interpolation weights.  The language with the lowest
cross-entropy per character wins.  A text is rejected when that entropy is above the language's limit and a
margin of ``slack / sqrt(characters)``, which leaves room for the chance in short texts.

The limit is calibrated on texts that were not learned.  On one side stand the language's own: their 99th
percentile, so about one in a hundred texts of a known language may be rejected at most.  On the other
stand texts that are foreign to all but one model: those of each other language, scored without its own model (their
5th percentile, of the language that comes nearest).  The limit lies halfway between, or at the own
percentile where the two overlap.

Models are fitted on a sample: each language gives whole texts of ``fit_chars`` characters in
expectation and another tenth of that for calibration, chosen by hashes of their ids; that bounds
the model's size.  A language with less is divided in the same proportion, unless it has fewer than ``least``
texts: then all are learned.  A language with fewer than ``marks`` calibration texts takes the largest own percentile of the
others; where no language has that many, it comes from all calibration texts together.  With one language alone, the foreign
side is the cost of guessing among all characters.  Prediction reads whole texts and nothing else of a row.

Null texts and texts without a letter get ``und``, score 0 and are rejected.  With nothing to learn
from, every text is ``und``.  Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

ORDER = 4
LETTERS = re.compile(r"[^\W\d_]+")
BEGIN, END = 2, 3
MIX = np.uint64(0x9E3779B97F4A7C15)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with their marks as code points in one array, the words' lengths and, at each character, its place in its word."""
    text = "".join([f"\x02{w}\x03" for w in words])
    flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return flat, lengths, place


def hashes(flat: np.ndarray, order: int) -> np.ndarray:
    """For each place the hash of the ``order`` characters that end there; meaningless where fewer precede."""
    h = np.zeros(len(flat), np.uint64)
    for back in range(order - 1, -1, -1):
        shifted = np.zeros(len(flat), np.uint64)
        shifted[back:] = flat[: len(flat) - back]
        h = (h ^ (shifted + np.uint64(1))) * MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """Per order k (index k - 1): n-gram hashes and probabilities, context hashes and weights."""

    languages: list[str]
    grams: list[np.ndarray]
    alpha: list[np.ndarray]
    contexts: list[np.ndarray]
    gamma: list[np.ndarray]
    base: np.ndarray
    limit: np.ndarray
    slack: float = 4.0

    def char_bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits that each character costs in each language, word after word and end marks included, and the words' numbers of them."""
        flat, lengths, place = codes(words)
        want = place > 0
        at = np.flatnonzero(want)
        p = np.repeat(self.base[None, :], len(at), axis=0)
        for k in range(1, ORDER + 1):
            ok = place[at] >= k - 1
            rows = np.flatnonzero(ok)
            if k > 1:
                h = hashes(flat, k - 1)[at[rows] - 1]
                c = np.minimum(np.searchsorted(self.contexts[k - 1], h), len(self.contexts[k - 1]) - 1)
                hit = self.contexts[k - 1][c] == h
                rows, c = rows[hit], c[hit]
                p[rows] *= self.gamma[k - 1][c]
            else:
                p *= self.gamma[0][0]
            h = hashes(flat, k)[at[rows]]
            g = np.minimum(np.searchsorted(self.grams[k - 1], h), len(self.grams[k - 1]) - 1)
            hit = self.grams[k - 1][g] == h
            p[rows[hit]] += self.alpha[k - 1][g[hit]]
        return -np.log2(np.maximum(p, 1e-12)), lengths - 1

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Bits that each word costs in each language, end mark included."""
        bits, lengths = self.char_bits(words)
        return np.add.reduceat(bits, np.cumsum(lengths) - lengths, axis=0)


def by_hash(grams: np.ndarray, ctx: np.ndarray, lang: np.ndarray, count: np.ndarray, n: int):
    """One order: discounted probabilities per (gram, language) and weights per (context, language)."""
    frame = pd.DataFrame({"g": grams, "c": ctx, "l": lang, "n": count}).groupby(["g", "c", "l"], as_index=False)["n"].sum()
    ones, twos = (frame["n"] == 1).groupby(frame["l"]).sum(), (frame["n"] == 2).groupby(frame["l"]).sum()
    discount = (ones / (ones + 2 * twos).clip(lower=1)).clip(0.1, 0.9).reindex(range(n), fill_value=0.5).to_numpy()
    per = frame.groupby(["c", "l"])["n"].agg(["sum", "size"])
    total = per["sum"].reindex(pd.MultiIndex.from_arrays([frame["c"], frame["l"]])).to_numpy()
    d = discount[frame["l"].to_numpy()]
    ids, at = np.unique(frame["g"].to_numpy(), return_inverse=True)
    alpha = np.zeros((len(ids), n))
    alpha[at, frame["l"].to_numpy()] = (frame["n"].to_numpy() - d) / total
    per = per.reset_index()
    cids, cat = np.unique(per["c"].to_numpy(), return_inverse=True)
    gamma = np.ones((len(cids), n))
    gamma[cat, per["l"].to_numpy()] = discount[per["l"].to_numpy()] * per["size"].to_numpy() / per["sum"].to_numpy()
    return ids, alpha, cids, gamma


def model_of(counts: pd.DataFrame) -> Model | None:
    """The models from ``counts(lang, gram, n)``: strings of up to ORDER characters, shorter only at a word's beginning."""
    if not len(counts):
        return None
    languages = sorted(counts["lang"].unique())
    n = len(languages)
    lang = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    gram, count = counts["gram"].tolist(), counts["n"].to_numpy()
    model = Model(languages, [None] * ORDER, [None] * ORDER, [None] * ORDER, [None] * ORDER, np.empty(0), np.empty(0))
    characters = len({g[-1] for g in gram}) + 1
    for k in range(ORDER, 0, -1):
        use = [i for i, g in enumerate(gram) if len(g) == k]  # longer ones have been cut by now
        grams = [gram[i] for i in use]
        flat = np.array([[ord(c) for c in g] for g in grams], np.uint64).reshape(len(grams), k)
        h, c = (hashes(np.ascontiguousarray(flat.ravel()), k)[k - 1 :: k], hashes(np.ascontiguousarray(flat[:, :-1].ravel()), k - 1)[k - 2 :: k - 1] if k > 1 else np.zeros(len(grams), np.uint64))
        model.grams[k - 1], model.alpha[k - 1], model.contexts[k - 1], model.gamma[k - 1] = by_hash(h, c, lang[use], count[use], n)
        if k > 1:  # each different character before a shorter n-gram counts once
            short = pd.DataFrame({"g": [g[1:] for g in grams], "l": lang[use], "n": 1}).groupby(["g", "l"], as_index=False)["n"].sum()
            rest = [i for i, g in enumerate(gram) if len(g) < k]
            gram = [gram[i] for i in rest] + short["g"].tolist()
            lang = np.concatenate([lang[rest], short["l"].to_numpy()])
            count = np.concatenate([count[rest], short["n"].to_numpy()])
    model.base = np.full(n, 1 / characters)
    model.limit = np.full(n, np.inf)  # until fit() has calibrated it
    return model


def gram_counts(words: Counter) -> Counter:
    out: Counter = Counter()
    for w, n in words.items():
        s = f"\x02{w}\x03"
        for i in range(1, len(s)):
            out[s[max(0, i - ORDER + 1) : i + 1]] += n
    return out


class Scorer:
    """Bits per language of a text's words, remembered word by word in a table of bounded size."""

    def __init__(self, model: Model, most: int = 400_000) -> None:
        self.model, self.most = model, most
        self.row: dict[str, int] = {}
        self.bits = np.zeros((1 << 12, len(model.languages)))

    def learn(self, words: list[str]) -> None:
        """Score those of the words that are not remembered."""
        new = list(dict.fromkeys(w for w in words if w not in self.row))
        if len(self.row) + len(new) > self.most:
            self.row.clear()
            new = list(dict.fromkeys(words))
        if not new:
            return
        at = len(self.row)
        if at + len(new) > len(self.bits):
            grown = np.zeros((2 * (at + len(new)), self.bits.shape[1]))
            grown[:at] = self.bits[:at]
            self.bits = grown
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.bits[at + k : at + k + len(part)] = self.model.log_probs(part)
        self.row.update(zip(new, range(at, at + len(new)), strict=True))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character in each language, and the number of characters, of each text."""
        sums, chars = np.zeros((len(texts), self.bits.shape[1])), np.zeros(len(texts), np.int64)
        for a in range(0, len(texts), 64):
            words = [LETTERS.findall(t.lower()) if t else [] for t in texts[a : a + 64]]
            self.learn([w for ws in words for w in ws])
            get = self.row.__getitem__
            for i, ws in enumerate(words, a):
                if ws:
                    sums[i] = self.bits[np.fromiter(map(get, ws), np.int64, len(ws))].sum(0)
                    chars[i] = sum(map(len, ws)) + len(ws)
        return sums / np.maximum(chars, 1)[:, None], chars


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_chars: int = 2_000_000, least: int = 20, marks: int = 5) -> Model | None:
    """Fit and calibrate on rows where ``learn`` holds and the language is not null."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(lang_col).alias("_l"), F.col(text_col).alias("_t"))
    total = rows.groupBy("_l").agg(F.sum(F.length("_t")).alias("_n"), F.count(F.lit(1)).alias("_c")).collect()  # one row per language, as many as the model has columns
    if not total:
        return None
    chars = F.create_map(*[x for r in total for x in (F.lit(r["_l"]), F.lit(r["_n"]))])[F.col("_l")]
    rows = rows.withColumn("_u", F.pmod(F.xxhash64("_i", F.lit("fit")), F.lit(1_000_003)) / 1_000_003 * chars)
    share = {r["_l"]: min(float(fit_chars), r["_n"] / 1.1 if r["_c"] >= least else r["_n"] + 1.0) for r in total}
    rows = rows.withColumn("_m", F.create_map(*[F.lit(x) for r in share.items() for x in r])[F.col("_l")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["_l"].to_pylist(), batch["_t"].to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        for lang, words in seen.items():
            grams = gram_counts(words)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "gram": list(grams), "n": list(grams.values())}, pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))

    parts = rows.where("_u < _m").select("_l", "_t").mapInArrow(count, "lang string, gram string, n long")
    model = model_of(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())  # at most the sample's n-grams
    if model is None:
        return None
    model.limit = calibrated(rows.where("_u >= _m AND _u < 1.1 * _m").select("_l", "_t"), model, marks)
    return model


def calibrated(held: DataFrame, model: Model, marks: int) -> np.ndarray:
    """The limit of each language, from texts ``held(_l, _t)`` that were not learned."""
    sent = held.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)
        place = {x: i for i, x in enumerate(sent.value.languages)}

        def step(x):
            bits, chars = scorer.entropies(x["_t"])
            rows = np.arange(len(bits))
            best = bits.argmin(1)
            at = np.array([place.get(lang, -1) for lang in x["_l"]], np.int64)
            own = bits[rows, at]
            bits[rows[at >= 0], at[at >= 0]] = np.inf
            use = chars >= 50
            return {"lang": x["_l"], "own": [v if u and b == k else None for v, u, b, k in zip(own, use, best, at, strict=True)], "other": [v if u and np.isfinite(v) else None for v, u in zip(bits.min(1), use, strict=True)]}

        return step

    scored = map_rows(held, make, "lang string, own double, other double")  # at most a tenth of the sample
    sides = (F.count("own").alias("n"), F.expr("percentile(own, 0.99)").alias("own"), F.count("other").alias("m"), F.expr("percentile(other, 0.05)").alias("other"))
    found = scored.groupBy("lang").agg(*sides).collect()
    guess = float(-np.log2(model.base[0]))
    own = {r["lang"]: r["own"] for r in found if r["n"] >= marks}
    high = max(own.values()) if own else next((r["own"] for r in [scored.agg(*sides).first()] if r["n"]), guess)
    foreign = min([r["other"] for r in found if r["m"] >= marks], default=guess)
    return np.array([max(o, (o + foreign) / 2) for o in (own.get(x, high) for x in model.languages)])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``kept`` with lang_pred, score, entropy, chars and rejected."""
    schema = docs.select(*kept).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("entropy", "double"), ("chars", "long"), ("rejected", "boolean")):
        schema = schema.add(name, kind)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        scorer = Scorer(model) if model else None

        def step(x):
            texts = x["_text"]
            out = {k: x[k] for k in kept}
            if scorer is None:
                return out | {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "entropy": [None] * len(texts), "chars": [0] * len(texts), "rejected": [True] * len(texts)}
            bits, chars = scorer.entropies(texts)
            best = bits.argmin(1) if len(texts) else np.empty(0, int)
            low = bits[np.arange(len(texts)), best]
            weight = np.exp(-4 * (bits - low[:, None]))
            none = chars == 0
            return out | {
                "lang_pred": ["und" if no else model.languages[b] for no, b in zip(none, best, strict=True)], "score": np.where(none, 0.0, 1 / weight.sum(1)),
                "entropy": [None if no else float(v) for no, v in zip(none, low, strict=True)], "chars": chars, "rejected": rejected(model, bits, chars),
            }

        return step

    return map_rows(docs.select(*kept, F.col(text_col).alias("_text")), make, schema)


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that :func:`predict` does not reject."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches:
            if scorer and batch.num_rows:
                bits, chars = scorer.entropies(batch[text_col].to_pylist())
                yield batch.filter(pa.array(~rejected(scorer.model, bits, chars)))

    return docs.mapInArrow(run, docs.schema)


def rejected(model: Model, bits: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """No letters, or more bits per character than the language's limit and what a short text may add."""
    best = bits.argmin(1)
    return (chars == 0) | (bits[np.arange(len(best)), best] > model.limit[best] + model.slack / np.sqrt(np.maximum(chars, 1)))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out())
    found = predict(docs, model, kept=("doc_id",))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")
