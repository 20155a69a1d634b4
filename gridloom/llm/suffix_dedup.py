"""Substring deduplication with suffix arrays: remove every byte that a repeated string of ``width`` bytes covers.

Texts are UTF-8 bytes, matches never cross documents, and a string counts as repeated if it starts anywhere
else, in the same document or overlapping itself included.  Null counts as empty; texts shorter than
``width`` have nothing to remove.  Rows that share an id or have none
are documents of their own.

1. Each text's windows are dealt to anchors (:mod:`.anchors`).  Anchor hashes that occur once own no repeated
   window and are left out by a filter.
2. An anchor's context (its windows' bytes) that occurs more than once has only repeated windows: its
   occurrences are found with a pre-aggregated count and a join.
3. Different contexts of one anchor can share some windows.  A context is cut at borders, 64 bytes apart and counted from the
   anchor; a window's first border is followed by 320 bytes of the window at least.  So equal windows have equal
   bytes of that number after borders at the same distance from equal anchors: those bytes are a border's key.  Keys that
   occur once are left out, again by a count.  Each of the others brings the bytes around it, and the borders
   of one key come together.
4. A suffix array (:mod:`.suffixes`) of the bytes around a key's borders puts equal windows next to each other: two
   neighbours that share a window's length are repeated.  The bytes of the key itself, which all have, stand as one
   symbol for each different 128-bit digest of them; all others are compared as they are.

A key with many borders, as a line shared by millions of documents, is dealt to parts of bounded size; each border goes to one of them, so work grows
with the number of borders.  Of a key in several parts, one window of each kind in a part is shown to the other parts by
its 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Slots, mixed
from .common import groups, parts, written
from .substrings import Content, anchor_hashes, chosen, contexts, cut, keyed, occurrence_slots, occurrences, rebatched, signed, undecided, unsigned
from .suffixes import classes

GRAM = 32
BLOCK = 64


def emit(content: Content, at: int, doc: int, ah: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    data = [content.raw[at + a : at + b + width] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(signed(ah)), pa.array(np.full(len(ah), doc)), pa.array(first + at), pa.array(place - first), pa.array(data, pa.binary())], ["ah", "doc", "start", "off", "data"]
    )


def borders(batch: pa.RecordBatch, width: int) -> tuple[list[int], list[int], np.ndarray]:
    """Row, place in the row's bytes, and key of each border of a batch of contexts."""
    same = width - width % BLOCK - BLOCK
    rows, places, key = [], [], []
    for k, (off, data) in enumerate(zip(batch["off"].to_pylist(), batch["data"].to_pylist(), strict=True)):
        for at in range(off % BLOCK, len(data) - same + 1, BLOCK):
            rows.append(k)
            places.append(at)
            key.append(xxhash.xxh3_64_intdigest(data[at : at + same], off - at & 0xFFFF))
    ah = unsigned(batch["ah"].to_numpy())[rows] if rows else np.empty(0, np.uint64)
    return rows, places, mixed(np.array(key, np.uint64) ^ mixed(ah))


def border_keys(shown: DataFrame, width: int) -> DataFrame:
    """(k, n): how often a border's key occurs, summed up per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n = np.unique(borders(batch, width)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(n.astype(np.int64))], ["k", "n"])

    return shown.mapInArrow(run, "k long, n long")


def surroundings(shown: DataFrame, width: int, slots: Slots) -> DataFrame:
    """(k, doc, at, left, same, right) of the borders whose keys the slots let pass: bytes before, digest of the key's bytes, bytes after them."""
    sent = shown.sparkSession.sparkContext.broadcast(slots)
    same = width - width % BLOCK - BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, key = borders(batch, width)
            use = np.flatnonzero(sent.value.has(key)) if rows else []
            doc, start, data = batch["doc"].to_numpy(), batch["start"].to_numpy(), batch["data"]
            out: list[list] = [[], [], [], [], [], []]
            for i in use:
                d, b, k = data[rows[i]].as_py(), places[i], rows[i]
                value = (doc[k], start[k] + b, d[max(0, b - BLOCK + 1) : b], xxhash.xxh3_128_digest(d[b : b + same]), d[b + same : b + width])
                for column, v in zip(out, (signed(key[i : i + 1])[0], *value), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["k", "doc", "at", "left", "same", "right"])

    return shown.mapInArrow(run, "k long, doc long, at long, left binary, same binary, right binary")


def longest_shared(texts: list[bytes]) -> list[int]:
    """How many first bytes each text has in common with the one that shares most with it: a neighbour in sorted order."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    best = [0] * len(texts)
    for i, j in zip(order[:-1], order[1:], strict=True):
        a, b = texts[i], texts[j]
        k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        best[i], best[j] = max(best[i], k), max(best[j], k)
    return best


def shared_windows(left: list[bytes], same: list[bytes], right: list[bytes], width: int) -> tuple[list[list[int]], list[list[int]]]:
    """Of different surroundings of one key: the windows' places in ``left`` that another one has as well, and the others' places."""
    size = width - (width - width % BLOCK - BLOCK) + 1  # symbols of a window: the key's bytes are one
    before, after = longest_shared([a[::-1] for a in left]), longest_shared(right)
    number = {s: 256 + i for i, s in enumerate(dict.fromkeys(same))}
    symbols: list[int] = []
    first: list[int | None] = []
    for i, (a, s, b) in enumerate(zip(left, same, right, strict=True)):
        if before[i] + after[i] < size - 1:  # no other has enough of both sides
            first.append(None)
        else:
            first.append(len(symbols))
            symbols += [*a, number[s], *b, -1 - i]  # strings end in different symbols: nothing is shared across
    found = classes(symbols, size)
    twins, singles = [], []
    for at, a, b in zip(first, left, right, strict=True):
        places = range(0, min(len(a), len(a) + 1 + len(b) - size) + 1)
        twins.append([p for p in places if at is not None and found[at + p] >= 0])
        singles.append([p for p in places if at is None or found[at + p] < 0])
    return twins, singles


def runs_of(places: list[int]) -> Iterator[tuple[int, int]]:
    """(first, length) of the runs of neighbours in a rising list."""
    begin = 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i] != places[i - 1] + 1:
            yield places[begin], i - begin
            begin = i


def compare(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc, start, n, shown): repeated windows; of keys in several parts also single windows with their digest, and one of each kind with start -1."""

    def solve(t: pa.Table) -> Iterator[tuple[int, int, int, bytes | None]]:
        members: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        for doc, at, *text in zip(*(t[c].to_pylist() for c in ("doc", "at", "left", "same", "right")), strict=True):
            members.setdefault(tuple(text), []).append((doc, at))
        several = t["parts"][0].as_py() > 1
        if len(t) < 2 and not several:
            return
        texts = list(members)
        digest = lambda text, p: xxhash.xxh3_128_digest(text[1] + bytes([len(text[0]) - p]) + text[0][p:] + text[2][: BLOCK + width % BLOCK - len(text[0]) + p])
        for text, twins, singles in zip(texts, *shared_windows(*zip(*texts, strict=True), width), strict=True):
            every = members[text]
            if len(every) > 1:
                twins, singles = sorted(twins + singles), []
            for doc, at in every:
                for p, n in runs_of(twins):
                    yield doc, at - len(text[0]) + p, n, None
            if several:
                for p in twins:
                    yield 0, -1, 1, digest(text, p)
                for p in singles:
                    yield every[0][0], every[0][1] - len(text[0]) + p, 1, digest(text, p)

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for t in groups(batches, ["k", "part"]):
        rows = list(solve(t))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc", "start", "n", "shown"])


def repeated_spans(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", block: int = 300) -> DataFrame:
    """(doc, start, n): windows start .. start + n - 1 of a document, under its number of :func:`.substrings.keyed`, occur elsewhere; rows may overlap."""
    return spans_of(keyed(docs, id_col, text_col), width, block)


def spans_of(texts: DataFrame, width: int = 400, block: int = 300) -> DataFrame:
    """The same of keyed rows."""
    twice = anchor_hashes(texts, "bytes", width, GRAM).groupBy("ah").agg(F.sum("n").alias("n")).where("n > 1")
    slots = Slots.of(twice, "ah")
    occurring = written(occurrences(texts, "bytes", width, GRAM, slots), "occurrences")
    found = written(contexts(occurring), "contexts")
    copies = occurring.where("times > 0").join(found.where("c > 1").select("ah", "ch"), ["ah", "ch"], "left_semi").select("doc", "start", "n")
    copies = copies.unionByName(occurring.where("times = 0").select("doc", "start", "n"))
    firsts = occurrence_slots(undecided(found))
    shown = chosen(texts, "bytes", width, GRAM, slots, firsts, lambda *a: emit(*a, width), "ah long, doc long, start long, off long, data binary")
    shown = written(shown, "bytes")
    keys = written(border_keys(shown, width).groupBy("k").agg(F.sum("n").alias("n")).where("n > 1").select("k"), "keys")
    around = surroundings(shown, width, Slots.of(keys, "k")).join(keys, "k", "left_semi")
    dealt = parts(written(around, "borders"), ["k"], F.xxhash64("doc", "at"), block)
    found = dealt.select("k", "part", "parts", "doc", "at", "left", "same", "right").mapInArrow(lambda b: rebatched(compare(b, width)), "doc long, start long, n long, shown binary")
    found = written(found, "found")
    decided = found.where("shown IS NULL").select("doc", "start", "n")
    several = found.where("shown IS NOT NULL")
    again = several.groupBy("shown").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("shown")
    across = several.where("start >= 0").join(again, "shown", "left_semi").select("doc", "start", "n")
    return copies.unionByName(decided).unionByName(across)


def suffix_dedup(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """id, n_units, n_removed, n_spans, kept_sha256 and, with ``texts``, kept of each document."""
    rows = keyed(docs, id_col, text_col)
    return cut(rows, spans_of(rows, width), "bytes", width, id_col, texts)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs, texts=False).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


ORACLE = """
WITH bytes AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c
  FROM (SELECT doc_id, i, md5_number(b[i + 1:i + 400]) AS k FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 399)) AS i FROM bytes) q) z
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM windows WHERE c > 1
), spans AS (
  SELECT doc_id, run, min(i) AS low, max(i) + 400 AS high
  FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) q GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(high) OVER w, 0) AS low, low AS high FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY low)
  UNION ALL SELECT d.doc_id, coalesce(s.high, 0), octet_length(b) FROM bytes d LEFT JOIN (SELECT doc_id, max(high) AS high FROM spans GROUP BY doc_id) s ON s.doc_id = d.doc_id
), kept AS (
  SELECT d.doc_id, string_agg(hex(b[g.low + 1:g.high]), '' ORDER BY g.low) AS h FROM bytes d JOIN gaps g ON g.doc_id = d.doc_id AND g.low < g.high GROUP BY d.doc_id
), removed AS (
  SELECT doc_id, sum(high - low) AS n, count(*) AS c FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.c, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM bytes d LEFT JOIN removed r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
