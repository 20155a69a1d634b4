"""Document fingerprints by winnowing.

A text is a sequence of code points.  Each run of ``gram`` code points has a rolling hash (a polynomial modulo 2^64,
from prefix sums, of which 44 bits are kept); every window of ``window`` neighbouring hashes chooses its smallest, the rightmost of equals;
the choices with their positions are the fingerprint.  So

* no match shorter than ``gram`` code points is seen, and
* of any passage of ``gram + window - 1`` code points or more that two texts share, at least one hash is in both
  fingerprints, at places that lie equally far from the passage's start.

A text with fewer hashes than a window has one choice out of all of them; one shorter than ``gram`` has one hash,
that of the whole text; an empty text (or null) has none.  Equal texts have equal fingerprints.  Long texts are worked on
in pieces of 2^20 code points that share a window, so memory stays bounded; a fingerprint does not depend on the cuts.

Likeness of two fingerprints is the Jaccard similarity of their sets of hashes: 1 for two empty ones, 0 for an empty and another.

:func:`with_successors` brings each document together with the one that follows it by id: null ids come first, rows of
one id follow each other by file and place, and the first document follows the last (itself, if it is the only one).  The order is cut
into blocks of about ``rows_per_block`` rows by a pass over ids alone, so no id is too frequent; texts move once, each to its block, and the
first text of a block to the block before it as well.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import BASE, PIECE, Piece, mixed
from .common import map_rows, numbered, written

GRAM, WINDOW = 24, 37
#: Hashes are compared without their lowest bits, which hold places within a piece instead.
LOW = np.uint64(PIECE - 1)
DROPPED = np.uint64(PIECE.bit_length() - 1)
MOST_BLOCKS = 1 << 16


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def characters(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def winnow(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions that the windows choose, in order."""
    n = len(points)
    units = lambda part: mixed(part.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))
    if n < gram + window:  # one window, or a gram of its own
        if not n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        g = Piece.of(0, units(points)).rolling(min(gram, n)) >> DROPPED
        at = len(g) - 1 - int(np.argmin(g[::-1]))
        return g[at : at + 1], np.array([at])
    hashes, places = [], []
    step_on = PIECE - gram - window
    for start in range(0, n - gram - window + 2, step_on):
        g = Piece.of(start, units(points[start : start + step_on + gram + window - 2])).rolling(gram)
        low = (g & ~LOW) | (LOW - np.arange(len(g), dtype=np.uint64))
        step = 1
        while 2 * step <= window:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < window:
            low = np.minimum(low[: len(low) - (window - step)], low[window - step :])
        low = low[np.concatenate(([True], low[1:] != low[:-1]))]
        at = (LOW - (low & LOW)).astype(np.int64) + start
        new = at > places[-1][-1] if places else np.ones(len(at), bool)  # the last choice of a piece may be the next one's first
        hashes.append(low[new] >> DROPPED)
        places.append(at[new])
        if not new.any():
            hashes.pop()
            places.pop()
    return np.concatenate(hashes), np.concatenate(places)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, each sorted and without repeats."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def rendered(hashes: np.ndarray) -> str:
    """Twelve lowercase hex digits for each hash, in order."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, n_chars, hashes, positions): one row for each document, hashes in the order of their positions."""

    def make():
        def step(x):
            out = {"id": x["_i"], "n_chars": [], "hashes": [], "positions": []}
            for text in x["_t"]:
                points = code_points(text)
                h, at = winnow(points, gram, window)
                for name, value in (("n_chars", len(points)), ("hashes", h.astype(np.int64)), ("positions", at)):
                    out[name].append(value)
            return out

        return step

    found = map_rows(docs.select(F.col(id_col).cast("long").alias("_i"), F.col(text_col).alias("_t")), make, "id long, n_chars long, hashes array<long>, positions array<long>")
    return found.withColumnRenamed("id", id_col)


def matches(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(a, b, shift, shared) of :func:`fingerprints`: how many hashes two documents share at one distance of their places.

    Each hash is joined to the first document that has it (smallest id, then place), so a passage in n documents gives n rows and not all its pairs.
    """
    flat = prints.select(F.col(id_col).alias("b"), F.explode(F.arrays_zip("hashes", "positions")).alias("h")).select("b", F.col("h.hashes").alias("h"), F.col("h.positions").alias("at"))
    first = flat.groupBy("h").agg(F.min(F.struct("b", "at")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", F.col("f.b").alias("a"), F.col("f.at").alias("a_at"))
    return flat.join(first, "h").where("a <> b").groupBy("a", "b", (F.col("at") - F.col("a_at")).alias("shift")).agg(F.count(F.lit(1)).alias("shared"))


def with_successors(docs: DataFrame, id_col: str, text_col: str, rows_per_block: int = 2048) -> DataFrame:
    """(block, id, guest, text), partitioned by block and sorted: each document is followed by its successor, a guest at the end of a block."""
    named = numbered(docs.select(id_col, text_col) if "_row" in docs.columns else docs)
    rows = named.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), "_row")
    key = F.struct(F.col("id").isNotNull().alias("has"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.col("_row").alias("row"))
    keys = written(rows.select(key.alias("key")), "keys")
    blocks = min(MOST_BLOCKS, max(1, keys.count() // rows_per_block))
    firsts = keys.repartitionByRange(blocks, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    cuts = sorted(tuple(r["key"]) for r in firsts.collect())  # the first of each block, at most MOST_BLOCKS of them
    last = len(cuts) - 1

    @F.pandas_udf("array<int>")
    def blocks_of(keys: pd.DataFrame) -> pd.Series:
        """A document's block; of a block's first document, also the block before, where it is a guest."""
        out = []
        for k in zip(keys["has"], keys["id"], keys["row"], strict=True):
            b = bisect_right(cuts, k) - 1
            out.append([b, -1 - ((b or last + 1) - 1)] if cuts[b] == k else [b])
        return pd.Series(out)

    dealt = rows.select(key.alias("key"), "id", "text", F.explode(blocks_of(key)).alias("b"))
    dealt = dealt.withColumn("guest", F.col("b") < 0).withColumn("block", F.when(F.col("guest"), -1 - F.col("b")).otherwise(F.col("b")))
    order = ["block", "guest", "key.has", "key.id", "key.row"]
    return dealt.repartitionById(len(cuts) or 1, F.col("block")).sortWithinPartitions(*order).select("block", "id", "guest", "text")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, rows_per_block: int = 2048) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, and how alike they and the next document's are.

    The edited text has its last floor(n / 4) code points replaced by the first as many (or all) of the next document.
    id, n_chars, edited_sha256, fingerprint, edited_fingerprint (:func:`rendered`), near_edited, near_next, n_hashes, and edited_from, where the new part starts.
    """
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_hashes", "edited_from"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for block, doc, guest, text in zip(batch["block"].to_pylist(), batch["id"].to_pylist(), batch["guest"].to_pylist(), batch["text"], strict=True):
                points = code_points(text.as_py())
                hashes = winnow(points, gram, window)[0]
                kinds_of = np.unique(hashes)
                if held is not None and held[0] == block:
                    _, own, before, h, s = held
                    keep = len(before) - len(before) // 4
                    edited = np.concatenate((before[:keep], points[: len(before) - keep]))
                    e = winnow(edited, gram, window)[0]
                    sha = hashlib.sha256(characters(edited).encode("utf-8", "surrogatepass")).hexdigest()
                    for column, value in zip(out, (own, len(before), sha, rendered(h), rendered(e), likeness(s, np.unique(e)), likeness(s, kinds_of), len(h), keep), strict=True):
                        column.append(value)
                held = None if guest else (block, doc, points, hashes, kinds_of)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long, edited_from long"
    return with_successors(docs, id_col, text_col, rows_per_block).mapInArrow(run, schema)


def op11(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
