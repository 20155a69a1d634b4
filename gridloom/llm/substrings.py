"""What the two substring operators share: map passes over documents and the last pass that cuts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Slots, merged_spans, mixed, occurrence, pieces
from .common import written

BYTE_VALUES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


class WordValues(dict):
    """A random value for each word, remembered in a table of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordValues()


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def texts_of(batch: pa.RecordBatch) -> Iterator[str | None]:
    """A batch's texts one at a time, so that only one is held as a Python string."""
    return (t.as_py() for t in batch["text"])


class Content:
    """A text's units and the bytes that they stand for: its bytes themselves, or its words with one blank between them."""

    def __init__(self, text: str | None, unit: str) -> None:
        self.unit = unit
        self.words = encoded(text).split() if unit == "words" else []
        self.raw, self.ends = encoded(text) if unit == "bytes" else b"", None
        self.units = np.fromiter(map(_words.__getitem__, self.words), np.uint64, len(self.words)) if unit == "words" else BYTE_VALUES[np.frombuffer(self.raw, np.uint8)]

    def joined(self) -> None:
        """Make the words' bytes and where each begins, when they are asked for first."""
        self.raw = b" ".join(self.words)
        self.ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)))

    def digests(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit digests of the units [begin, end), from their bytes."""
        gap = int(self.unit == "words")
        if gap:
            if self.ends is None:
                self.joined()
            begin, end = self.ends[begin], self.ends[end]
        h, raw = xxhash.xxh3_64_intdigest, self.raw
        return np.fromiter((h(raw[a : b - gap]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(begin))


def keyed(docs: DataFrame, id_col: str, text_col: str, later: str | None = None) -> DataFrame:
    """(doc, id, text): each row under a number of its own; numbers are in the order of ids, null first.

    Where no id is null or repeated, the number is the id.  Otherwise the rows are sorted once by id, then ``later`` (a boolean
    column that is kept), then a hash of the text, which lets no id be too frequent for a task, and written with their places.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[later] * bool(later))
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id IS NULL OR n > 1").isEmpty():
        return rows.withColumn("doc", F.col("id"))
    order = ["id", *[later] * bool(later), "_h"]
    placed = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(placed.withColumn("doc", F.monotonically_increasing_id()).drop("_h"), "rows")


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def unsigned(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.uint64)


def anchor_hashes(texts: DataFrame, unit: str, width: int, gram: int) -> DataFrame:
    """(ah, n) of ``texts(doc, text)``: how often an anchor hash occurs, summed up per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p.anchors(width, gram)[0] for t in texts_of(batch) for p in pieces(Content(t, unit).units, width)]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int64))], ["ah", "n"])

    return texts.select("text").mapInArrow(run, "ah long, n long")


def occurrences(texts: DataFrame, unit: str, width: int, gram: int, slots: Slots) -> DataFrame:
    """(ah, ch, doc, start, n, times): contexts of the anchors that the slots let pass; windows start .. start + n - 1 are theirs.

    A context that a piece of a text has several times is told once with its number of ``times``, at its first place; the
    later places have ``times`` 0.  So one line that repeats inside a document is one row of its group.
    """
    sent = texts.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pass_ = sent.value
        for batch in batches:
            rows: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for doc, text in zip(batch["doc"].to_pylist(), texts_of(batch), strict=True):
                content = Content(text, unit)
                for p in pieces(content.units, width):
                    ah, _, first, last = p.anchors(width, gram)
                    use = pass_.has(ah)
                    if not use.any():
                        continue
                    ah, first, last = ah[use], first[use], last[use]
                    ch = content.digests(first + p.at, last + width + p.at)
                    _, one, count = np.unique(mixed(ch ^ mixed(ah)), return_index=True, return_counts=True)
                    times = np.zeros(len(ah), np.int64)
                    times[one] = count
                    for column, value in zip(rows, (signed(ah), signed(ch), np.full(len(ah), doc), first + p.at, last - first + 1, times), strict=True):
                        column.append(value)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows], ["ah", "ch", "doc", "start", "n", "times"])

    return texts.select("doc", "text").mapInArrow(run, "ah long, ch long, doc long, start long, n long, times long")


def contexts(occurring: DataFrame) -> DataFrame:
    """(ah, ch, c, n, doc, start): distinct contexts, how often they occur, and where first."""
    per = occurring.where("times > 0").groupBy("ah", "ch").agg(F.sum("times").alias("c"), F.min(F.struct("doc", "start", "n")).alias("f"))
    return per.select("ah", "ch", "c", F.col("f.n").alias("n"), F.col("f.doc").alias("doc"), F.col("f.start").alias("start"))


def undecided(found: DataFrame) -> DataFrame:
    """Those contexts whose anchor has another, different context."""
    several = found.groupBy("ah").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("ah")
    return found.join(several, "ah", "left_semi")


def occurrence_slots(found: DataFrame) -> Slots:
    """A filter for the first occurrences of some contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = occurrence(b["doc"].to_numpy(), b["start"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(signed(h))], ["o"])

    return Slots.of(found.select("doc", "start").mapInArrow(run, "o long"), "o")


def chosen(texts: DataFrame, unit: str, width: int, gram: int, slots: Slots, firsts: Slots, emit: Callable, schema: str) -> DataFrame:
    """``emit(content, at, doc, ah, place, first, last)`` of the anchors at first occurrences; ``at`` is where the piece begins."""
    sent = texts.sparkSession.sparkContext.broadcast((slots, firsts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sent.value
        for batch in batches:
            for doc, text in zip(batch["doc"].to_pylist(), texts_of(batch), strict=True):
                content = Content(text, unit)
                for p in pieces(content.units, width):
                    ah, place, first, last = p.anchors(width, gram)
                    use = one.has(ah)
                    if use.any():
                        ah, place, first, last = ah[use], place[use], first[use], last[use]
                        use = two.has(occurrence(np.full(len(ah), doc), first + p.at))
                        if use.any():
                            yield from emit(content, p.at, doc, ah[use], place[use], first[use], last[use])

    return texts.select("doc", "text").mapInArrow(lambda b: rebatched(run(b)), schema)


def rebatched(batches: Iterator[pa.RecordBatch], rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Small batches joined into larger ones."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def cut(rows: DataFrame, spans: DataFrame, unit: str, width: int, id_col: str, texts: bool = True) -> DataFrame:
    """Remove from each text of :func:`keyed` rows what its spans (doc, start, n: windows start .. start + n - 1) cover.

    id, n_units, n_removed, n_spans, kept_sha256 and, with ``texts``, kept (text) of each document.
    """
    per = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    rows = rows.join(per, "doc", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(texts_of(batch), batch["spans"], strict=True):
                raw = encoded(text)
                parts = raw if unit == "bytes" else raw.split()
                removed = runs = 0
                kept = parts
                if found.is_valid:
                    flat = found.values.flatten()
                    begin = flat[0].to_numpy()
                    a, b = merged_spans(begin, begin + flat[1].to_numpy() + width - 1)
                    removed, runs = int((b - a).sum()), len(a)
                    stay = zip([0, *b.tolist()], [*a.tolist(), len(parts)], strict=True)
                    kept = b"".join(parts[x:y] for x, y in stay) if unit == "bytes" else [w for x, y in stay for w in parts[x:y]]
                if unit == "words":
                    kept = b" ".join(kept)
                for column, value in zip(out, (len(parts), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [batch["id"], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    names = ["id", "n_units", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts]
    schema = "id long, n_units long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * texts
    return rows.select("id", "text", "spans").mapInArrow(run, schema).withColumnRenamed("id", id_col)
