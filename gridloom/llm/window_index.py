"""Incremental substring deduplication with a log-structured index of window fingerprints.

Remove each word that a window of ``width`` words covers whose word sequence starts earlier as well: in a
smaller id, or in the same document before it.  Words are runs of characters that are not ASCII white
space, unchanged.  Null texts have no words; a null id sorts first; rows that share an id
are documents of their own, one after the other in a fixed order.

The index keeps one fingerprint for each run of neighbouring windows: the hash of the gram they choose
(:mod:`.anchors`).  It consists of immutable runs in a folder, each sorted by fingerprint within a fixed number of buckets.  A
new batch is sorted into a run of its own and merge-joined with the older ones, bucket by bucket and without moving them:
fingerprints that an older run has, or that the batch has twice, are hits.  While the newest run has at least half as many
fingerprints as the one before it, the two are merged, again by a join of their buckets; so there are logarithmically many runs and each fingerprint is
rewritten logarithmically often.  An index outlives its session: :meth:`FingerprintIndex.load` finds its runs again.

Hits are verified on the windows.  Contexts (all windows of an anchor) that occur more than once are
settled by their first occurrence; different contexts of one anchor give their windows, and each
window is settled by its own first occurrence.  Equality is that of a digest of the words themselves, beside the fingerprint.  Both are pre-aggregated
minima joined back, so a passage may be in any share of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Slots
from .common import delete, new_path, written
from .substrings import Content, anchor_hashes, chosen, contexts, cut, keyed, occurrence_slots, occurrences, signed, undecided

GRAM = 8


class FingerprintIndex:
    """Sorted immutable runs of (ah, n): fingerprints, and how often they have been seen."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None) -> None:
        self.spark, self.folder = spark, folder
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, int]] = []  # path and number of fingerprints, oldest first
        self.compactions = 0

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """An index that :meth:`save` has left in a folder."""
        rows = spark.read.schema("place int, path string, size long, buckets int").json(f"{folder}/runs").orderBy("place").collect()  # a few rows
        index = cls(spark, folder, rows[0]["buckets"] if rows else None)
        index.runs = [(r["path"], r["size"]) for r in rows]
        return index

    def save(self) -> None:
        rows = [(i, path, size, self.buckets) for i, (path, size) in enumerate(self.runs)]
        self.spark.createDataFrame(rows, "place int, path string, size long, buckets int").coalesce(1).write.mode("overwrite").json(f"{self.folder}/runs")

    def read(self, path: str) -> DataFrame:
        """A run with its buckets known to Spark, so joins on fingerprints move nothing."""
        name = "gridloom_" + path.rsplit("-", 1)[-1]
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (ah BIGINT, n BIGINT) USING parquet CLUSTERED BY (ah) SORTED BY (ah) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def write(self, rows: DataFrame) -> tuple[str, int]:
        """Rows that are hashed to as many partitions as there are buckets become a run, one file a bucket."""
        name = uuid4().hex
        path = f"{self.folder}/run-{name}"
        rows.write.bucketBy(self.buckets, "ah").sortBy("ah").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(f"gridloom_{name}")
        return path, self.spark.table(f"gridloom_{name}").count()

    def add(self, batch: DataFrame) -> DataFrame:
        """Append a batch of (ah, n) as a run; give its fingerprints that are no longer single."""
        run = self.write(batch.repartition(self.buckets, "ah").groupBy("ah").agg(F.sum("n").alias("n")))
        new = self.read(run[0])
        hits = [new.where("n > 1").select("ah")]
        for path, _ in self.runs:
            hits.append(new.where("n = 1").join(self.read(path).select("ah").hint("merge"), "ah", "left_semi").select("ah"))
        found = written(reduce(DataFrame.unionByName, hits), "hits")
        self.runs.append(run)
        while len(self.runs) > 1 and 2 * self.runs[-1][1] >= self.runs[-2][1]:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge the two newest runs."""
        old = [path for path, _ in self.runs[-2:]]
        a, b = (self.read(path) for path in old)
        merged = a.join(b.withColumnRenamed("n", "m").hint("merge"), "ah", "full_outer")
        self.runs[-2:] = [self.write(merged.select("ah", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))]
        self.compactions += 1
        self.forget(old)

    def forget(self, paths: list[str]) -> None:
        for path in paths:
            self.spark.sql(f"DROP TABLE IF EXISTS gridloom_{path.rsplit('-', 1)[-1]}")
            delete(self.spark, path)

    def drop(self) -> None:
        """Delete the index and its runs."""
        self.forget([path for path, _ in self.runs])
        delete(self.spark, self.folder)


def emit(content: Content, at: int, doc: int, ah: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    n = last - first + 1
    start = at + np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    yield pa.RecordBatch.from_arrays([pa.array(signed(np.repeat(ah, n))), pa.array(signed(content.digests(start, start + width))), pa.array(np.full(len(start), doc)), pa.array(start)], ["ah", "w", "doc", "start"])


def batch_rows(docs: DataFrame, id_col: str, text_col: str, history: DataFrame | None) -> DataFrame:
    """Keyed rows of the new documents and of the history, ``later`` tells which; of rows that share an id the history's come first."""
    some = lambda d, later: d.select(F.col(id_col), F.col(text_col), F.lit(later).alias("later"))
    return keyed(some(docs, True) if history is None else some(docs, True).unionByName(some(history, False)), id_col, text_col, "later")


def later_spans(docs: DataFrame, width: int = 20, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """(doc, start, n): windows start .. start + n - 1 of a document, under its number of :func:`.substrings.keyed`, have an earlier equal; rows may overlap.

    The documents go into the index in ``batches`` by their ids.  With an ``index`` of earlier documents, the same ones are given as
    ``history``; only those of their anchors that the new batches hit are looked at, and only spans of new documents are returned.
    """
    return spans_of(batch_rows(docs, id_col, text_col, history), width, batches, index, history is not None)


def spans_of(rows: DataFrame, width: int, batches: int, index: FingerprintIndex | None, history: bool) -> DataFrame:
    """The same of :func:`batch_rows`."""
    spark, texts = rows.sparkSession, rows.where("later")
    own = index or FingerprintIndex(spark, new_path(spark, "index"))
    cuts = [] if batches < 2 else sorted({int(x) for x in texts.approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01)})
    hits = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = texts
        if low is not None:
            part = part.where(F.col("doc") > low)
        if high is not None:
            part = part.where(F.col("doc") <= high)
        hits.append(own.add(anchor_hashes(part, "words", width, GRAM)))
    if index is None:
        own.drop()
    slots = Slots.of(reduce(DataFrame.unionByName, hits), "ah")
    if history:
        texts = rows
    occurring = written(occurrences(texts, "words", width, GRAM, slots), "occurrences")
    found = written(contexts(occurring), "contexts")
    first = found.where("c > 1").select("ah", "ch", F.col("doc").alias("d0"), F.col("start").alias("s0"))
    after = "doc > d0 OR doc = d0 AND start > s0"
    copies = occurring.where("times > 0").join(first, ["ah", "ch"]).where(after).select("doc", "start", "n")
    copies = copies.unionByName(occurring.where("times = 0").select("doc", "start", "n"))
    shown = chosen(texts, "words", width, GRAM, slots, occurrence_slots(undecided(found)), lambda *a: emit(*a, width), "ah long, w long, doc long, start long")
    shown = written(shown, "windows")
    least = shown.groupBy("ah", "w").agg(F.min(F.struct("doc", "start")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    least = least.select("ah", "w", F.col("f.doc").alias("d0"), F.col("f.start").alias("s0"))
    partly = shown.join(least, ["ah", "w"]).where(after).select("doc", "start", F.lit(1).cast("long").alias("n"))
    spans = copies.unionByName(partly)
    return spans.join(rows.where("later").select("doc"), "doc", "left_semi") if history else spans


def window_dedup(docs: DataFrame, width: int = 20, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """id, n_units, n_removed, n_spans, kept_sha256 and, with ``texts``, kept of each document."""
    rows = batch_rows(docs, id_col, text_col, history)
    return cut(rows.where("later").drop("later"), spans_of(rows, width, batches, index, history is not None), "words", width, id_col, texts)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return window_dedup(docs, texts=False).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS i, len(l) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents) q
), windows AS (
  SELECT doc_id, w, i, CASE WHEN i + 20 <= n THEN string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS s
  FROM words
), later AS (
  SELECT doc_id, w, i, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM windows
), covered AS (
  SELECT doc_id, w, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM later
), per AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM covered GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""
