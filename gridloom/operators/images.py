"""Pages as pictures: images(doc_id, height, width, channels, pixels BINARY) become grids, filled cells and facts.

Pixels are bytes in rows, the channels blue, green and red or one gray.  Each picture is handled by itself in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import pixels


def pictures(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    for doc, h, w, c, raw in zip(*(batch[x] for x in ("doc_id", "height", "width", "channels", "pixels")), strict=True):
        shape = (h.as_py(), w.as_py(), c.as_py())
        image = np.frombuffer(raw.as_py(), np.uint8).reshape(shape)
        yield doc.as_py(), image[..., 0] if shape[2] == 1 else image


def each(images: DataFrame, rows: Callable[[np.ndarray], Iterator[tuple]], schema: str) -> DataFrame:
    """``rows(image)`` of each picture, under its doc_id (a long)."""
    names = ["doc_id", *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(doc, *r) for doc, image in pictures(batch) for r in rows(image)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names)

    return images.select("doc_id", "height", "width", "channels", "pixels").mapInArrow(run, "doc_id long, " + schema)


def grids(images: DataFrame) -> DataFrame:
    """(doc_id, row, col, x_min, x_max, y_min, y_max, filled) of the cells of ruled tables."""

    def rows(image: np.ndarray) -> Iterator[tuple]:
        for c in pixels.table_cells(image):
            yield c["row"], c["col"], c["x_min"], c["x_max"], c["y_min"], c["y_max"], pixels.occupied(image, c)

    return each(images, rows, "row long, col long, x_min long, x_max long, y_min long, y_max long, filled boolean")


def columns(images: DataFrame) -> DataFrame:
    """(doc_id, idx, x): vertical lines, also where there is no grid."""
    return each(images, lambda image: enumerate(pixels.column_boundaries(image)), "idx long, x long")


def facts(images: DataFrame) -> DataFrame:
    """(doc_id, high, wide, screenshot, kind, fingerprint) of each picture; kind by the header's colour."""

    def rows(image: np.ndarray) -> Iterator[tuple]:
        h = pixels.perceptual_hash(image)
        yield image.shape[0], image.shape[1], pixels.is_screenshot(image), pixels.header_kind(image, pixels.table_cells(image)), h - (1 << 64) if h >> 63 else h

    return each(images, rows, "high long, wide long, screenshot boolean, kind string, fingerprint long")


def crops(images: DataFrame, row: int | None = None) -> DataFrame:
    """(doc_id, row, col, high, wide, body): the cells' pixels for a recogniser, of one row or of all; dark cells are inverted."""

    def rows(image: np.ndarray) -> Iterator[tuple]:
        for c in pixels.table_cells(image):
            if row is None or c["row"] == row:
                part = pixels.crop(image, c)
                yield c["row"], c["col"], part.shape[0], part.shape[1], part.tobytes()

    return each(images, rows, "row long, col long, high long, wide long, body binary")


def prepared(images: DataFrame, least: int = 1500) -> DataFrame:
    """(doc_id, high, wide, body): gray pictures as a recogniser wants them."""

    def rows(image: np.ndarray) -> Iterator[tuple]:
        out = pixels.prepared(image, least)
        yield out.shape[0], out.shape[1], out.tobytes()

    return each(images, rows, "high long, wide long, body binary")
