"""Anchored windows: how substring operators find equal windows without moving every window.

A text is a sequence of units (bytes or words).  Every window of ``width`` units chooses the gram of
``gram`` units inside it whose hash is smallest (the leftmost of equals).  Neighbouring windows mostly choose
the same gram, so an *anchor* owns a run of windows.  The choice depends on the window's content alone:
equal windows have equal anchors at the same offset.  So windows need to be compared only among
anchors of the same hash, and anchors whose hash occurs once own no repeated window.

Unit sequences are hashed with a polynomial modulo 2^64 over random unit values; with prefix sums every
range's hash costs a subtraction and a product.  A context (the units of all windows that an
anchor owns) is compared by its own 64 bits and its anchor's 64.

A :class:`Slots` filter tells map tasks which hashes can matter: a bitmap of fixed size, so it can be
broadcast at any input size.  It only saves traffic: exact joins follow, and a full bitmap lets all pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Units of one piece; a longer text is cut into pieces that overlap by a window less one unit.
PIECE = 1 << 20
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for b in (BASE, INVERSE):
            p = np.full(PIECE + 1, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@dataclass
class Piece:
    """Prefix sums over a piece's unit values; ``at`` is where the piece begins in its text."""

    at: int
    units: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, at: int, units: np.ndarray) -> Piece:
        sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * powers()[0][: len(units)], out=sums[1:])
        return cls(at, units, sums)

    def hashes(self, begin, end) -> np.ndarray:
        """Hashes of the ranges [begin, end)."""
        return mixed((self.sums[end] - self.sums[begin]) * powers()[1][begin])

    def rolling(self, width: int) -> np.ndarray:
        n = len(self.units) - width + 1
        return mixed((self.sums[width:] - self.sums[:n]) * powers()[1][:n])

    def anchors(self, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place, first and last owned window start of each anchor."""
        g = self.rolling(gram)
        reach = width - gram + 1
        low = (g & ~np.uint64(PIECE - 1)) | np.arange(len(g), dtype=np.uint64)
        step = 1
        while 2 * step <= reach:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < reach:
            low = np.minimum(low[: len(low) - (reach - step)], low[reach - step :])
        place = (low & np.uint64(PIECE - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:] - 1, [len(place) - 1]))
        place = place[first]
        return g[place], place, first, last


def pieces(units: np.ndarray, width: int) -> Iterator[Piece]:
    """The pieces of a text that has at least one window; each window is in exactly one."""
    step = PIECE - width
    for at in range(0, max(len(units) - width + 1, 0), step):
        yield Piece.of(at, units[at : at + step + width - 1])


class Slots:
    """A bitmap of 2**bits slots that a hash may or may not be in."""

    def __init__(self, bits: int, chunks: dict[int, bytes]) -> None:
        self.bits = bits
        self.map = np.zeros(1 << (bits - 3), np.uint8)
        size = len(self.map) >> 8
        for k, raw in chunks.items():
            self.map[k * size : (k + 1) * size] = np.frombuffer(raw, np.uint8)

    @classmethod
    def of(cls, hashes: DataFrame, column: str, most: int = 30) -> Slots:
        """From a column of hashes, read twice: 256 chunks of the bitmap are made on the executors."""
        bits = min(most, max(16, (16 * hashes.count()).bit_length()))
        slot = F.col(column).bitwiseAND((1 << bits) - 1)
        rows = hashes.select(slot.alias("slot")).distinct().withColumn("chunk", F.shiftright("slot", bits - 8)).repartition("chunk").sortWithinPartitions("chunk")
        size = 1 << (bits - 8)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in groups(batches, ["chunk"]):
                k = t["chunk"][0].as_py()
                raw = np.zeros(size >> 3, np.uint8)
                at = t["slot"].to_numpy() - k * size
                np.bitwise_or.at(raw, at >> 3, (1 << (at & 7)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([raw.tobytes()], pa.binary())], ["chunk", "raw"])

        found = rows.select("chunk", "slot").mapInArrow(run, "chunk long, raw binary")
        return cls(bits, {r["chunk"]: bytes(r["raw"]) for r in found.collect()})  # at most 2**(bits - 3) bytes

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def occurrence(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of a context's place, for :class:`Slots`."""
    return mixed(mixed(doc.astype(np.uint64) * np.uint64(BASE)) + start.astype(np.uint64))


def merged_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unions of some intervals, in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return start[first], end[np.concatenate((first[1:] - 1, [len(end) - 1]))]
