"""Document classes by keywords and by character n-grams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import new_folder

#: Text for each part that documents are dealt to before their n-grams are made.
PART_BYTES = 1 << 18


def by_rule(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first class of which any keyword occurs (0.8), else the default (0.3)."""
    out = None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        value = F.struct(F.lit(name).alias("doc_type"), F.lit(0.8).alias("confidence"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit(default).alias("doc_type"), F.lit(0.3).alias("confidence")))


def by_score(docs: DataFrame, keywords: list[tuple[str, str, float]], classes: list[str], default: str) -> DataFrame:
    """docs(doc_id, text): weights of the keywords that occur, summed per class; ties in the classes' order.

    The keywords are a short fixed list, so they are expressions on each row and nothing is joined.
    """
    scores = [sum((F.when(F.col("text").contains(w), weight).otherwise(0.0) for k, w, weight in keywords if k == name), F.lit(0.0)) for name in classes]
    total = sum(scores[1:], scores[0])
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    name = F.when(F.lit(False), "")
    for k, s in zip(classes, scores, strict=True):
        name = name.when(s == best, k)
    none = total == 0
    return docs.select("doc_id", F.when(none, default).otherwise(name).alias("doc_type"), F.when(none, 0.3).otherwise(F.least(best / total, F.lit(0.99))).alias("confidence"))


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """Character n-grams inside words, each word with a blank at either end."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int):
        return lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = [F.flatten(F.transform(padded, of(n))) for n in range(low, high + 1)]
    return F.flatten(F.array(*grams))


def dealt(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) in parts of bounded text, by ``doc_id``: their n-grams, a multiple of the texts, fit into a task and are counted where they stand."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)), "doc_id")


def gram_counts(docs: DataFrame, low: int, high: int) -> DataFrame:
    """(doc_id, gram, tf); no n-gram is moved where docs lie by ``doc_id``."""
    return docs.select("doc_id", F.explode(char_ngrams(F.col("text"), low, high)).alias("gram")).groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, features: int) -> DataFrame:
    """(gram, df): the most frequent n-grams, then first by code points."""
    df = counts.groupBy("gram").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    return df.orderBy(F.desc("total"), "gram").limit(features)


def tfidf_weight(tf: Column, df: Column, n_docs: Column) -> Column:
    return (1 + F.ln(tf)) * (F.ln((1 + n_docs) / (1 + df)) + 1)


def tfidf(docs: DataFrame, low: int = 2, high: int = 4, features: int = 3000) -> DataFrame:
    """docs(doc_id, text): sublinear TF-IDF of the most frequent n-grams (then first by code points)."""
    counts = gram_counts(dealt(docs.select("doc_id", "text")), low, high)
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    kept = counts.join(F.broadcast(vocabulary(counts, features)), "gram").join(F.broadcast(n))
    return kept.select("doc_id", "gram", tfidf_weight(F.col("tf"), F.col("df"), F.col("n_docs")).alias("weight"))


class Classifier:
    """Logistic regression with balanced classes on the vectors that :func:`tfidf` describes, scaled to length 1.

    The vocabulary has at most ``features`` rows, so it and the coefficients are small at any number of documents.  Documents are
    sparse from end to end: training rows are written once to the shared folder as ``index:value`` lines and read back as sparse vectors,
    and a prediction is a sum over a document's own n-grams.  A document without known n-grams gets what the intercepts say; rows
    without a label teach nothing; a single label is always predicted, with confidence 1; without labels, fitting is an error.
    """

    def __init__(self, grams: list[tuple[str, int, int, list[float]]], classes: list[tuple[str, float]], n_docs: int, low: int, high: int) -> None:
        self.grams, self.classes, self.n_docs, self.low, self.high = grams, classes, n_docs, low, high

    @classmethod
    def fit(cls, docs: DataFrame, label: str, features: int = 3000, low: int = 2, high: int = 4) -> Classifier:
        """From docs(doc_id, text, label)."""
        from pyspark.ml.classification import LogisticRegression

        spark = docs.sparkSession
        docs = docs.select("doc_id", "text", F.col(label).cast("string").alias("label")).where("label IS NOT NULL")
        sizes = [(r["label"], r["n"]) for r in docs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").collect()]
        if not sizes:
            raise ValueError("no document has a label")
        n_docs, names = sum(n for _, n in sizes), [name for name, _ in sizes]
        docs = dealt(docs)
        counts = gram_counts(docs, low, high)
        known = [(r["gram"], k, r["df"]) for k, r in enumerate(vocabulary(counts, features).collect())]
        if len(names) == 1 or not known:
            shares = [(name, math.log(n / n_docs)) for name, n in sizes]
            return cls([(g, k, df, [0.0] * len(names)) for g, k, df in known], shares, n_docs, low, high)
        blank = cls([(g, k, df, []) for g, k, df in known], [], n_docs, low, high)
        number = spark.createDataFrame([(name, k) for k, name in enumerate(names)], "label string, k int")
        rows = docs.join(F.broadcast(number), "label").select("doc_id", "k").join(blank.vectors(docs), "doc_id", "left")
        entry = lambda s: F.concat((s["i"] + 1).cast("string"), F.lit(":"), s["w"].cast("string"))
        folder = new_folder(spark, "training")
        rows.select(F.concat_ws(" ", F.col("k").cast("string"), F.transform("entries", entry))).write.text(folder)
        read = spark.read.format("libsvm").option("numFeatures", str(len(known))).load(folder)
        share = F.create_map(*[F.lit(x) for k, (_, n) in enumerate(sizes) for x in (float(k), n_docs / (len(sizes) * n))])
        fitted = LogisticRegression(weightCol="weight", maxIter=50, regParam=1e-4).fit(read.withColumn("weight", share[F.col("label")]))
        by_class, at = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
        if len(names) == 2:  # one row of coefficients says how far the second class is ahead
            by_class, at = [[0.0] * len(known), by_class[0]], [0.0, at[0]]
        return cls([(g, k, df, [float(c[k]) for c in by_class]) for g, k, df in known], [(name, float(b)) for name, b in zip(names, at, strict=True)], n_docs, low, high)

    def found(self, docs: DataFrame) -> DataFrame:
        """(doc_id, i, w, coefficients): a row for each n-gram of the vocabulary that a document has."""
        known = docs.sparkSession.createDataFrame(self.grams, "gram string, i int, df long, coefficients array<double>")
        weight = tfidf_weight(F.col("tf"), F.col("df"), F.lit(self.n_docs))
        return gram_counts(docs, self.low, self.high).join(F.broadcast(known), "gram").select("doc_id", "i", weight.alias("w"), "coefficients")

    def vectors(self, docs: DataFrame) -> DataFrame:
        """(doc_id, entries): the numbers and weights of a document's n-grams, by number, scaled to length 1; documents without any have no row."""
        per = self.found(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("l"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return per.select("doc_id", F.transform("l", lambda s: F.struct(s["i"].alias("i"), (s["w"] / F.col("norm")).alias("w"))).alias("entries"))

    def predict(self, docs: DataFrame) -> DataFrame:
        """(doc_id, predicted, confidence) of each row of docs(doc_id, text); ids are unique."""
        docs = dealt(docs.select("doc_id", "text"))
        sums = [F.sum(F.col("w") * F.col("coefficients")[k]).alias(f"s{k}") for k in range(len(self.classes))]
        per = self.found(docs).groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *sums)
        margins = [F.coalesce(F.col(f"s{k}") / F.col("norm"), F.lit(0.0)) + F.lit(at) for k, (_, at) in enumerate(self.classes)]
        rows = docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.array(*margins).alias("m")).withColumn("top", F.array_max("m"))
        share = F.aggregate("m", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
        names = F.array(*[F.lit(name) for name, _ in self.classes])
        return rows.select("doc_id", F.element_at(names, F.array_position("m", F.col("top")).cast("int")).alias("predicted"), (1 / share).alias("confidence"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Two small tables under ``path``: classes, and n-grams with their coefficients; an older model there is replaced."""
        spark.createDataFrame(self.grams, "gram string, i int, df long, coefficients array<double>").write.mode("overwrite").parquet(f"{path}/grams")
        rows = [(k, name, at, self.n_docs, self.low, self.high) for k, (name, at) in enumerate(self.classes)]
        spark.createDataFrame(rows, "k int, name string, intercept double, n_docs long, low int, high int").write.mode("overwrite").parquet(f"{path}/classes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Classifier:
        grams = [(r["gram"], r["i"], r["df"], r["coefficients"]) for r in spark.read.parquet(f"{path}/grams").orderBy("i").collect()]
        rows = spark.read.parquet(f"{path}/classes").orderBy("k").collect()
        return cls(grams, [(r["name"], r["intercept"]) for r in rows], rows[0]["n_docs"], rows[0]["low"], rows[0]["high"])


def best_of(rows: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), tie))).where("_r = 1").drop("_r")
