"""Reading documents: files to pages to text boxes, with a pluggable recogniser.

Recognition itself (a neural model, a PDF parser, a vendor's service) is not part of this package.  A
:class:`Recogniser` is made once in each Python worker and is given the bytes of a file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as c

BOXES = "doc_id string, page int, box_id int, text string, confidence double, x_min double, x_max double, y_min double, y_max double, x_center double, y_center double"


class Recogniser(Protocol):
    def boxes(self, content: bytes, kind: str) -> Iterator[tuple[int, str, float, float, float, float, float]]:
        """(page, text, confidence, x_min, x_max, y_min, y_max) in reading order."""


def files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), content, kind (image, pdf) and content hash of supported files; others are left out."""
    raw = spark.read.format("binaryFile").load(path)
    routed = raw.select(F.col("path").alias("doc_id"), "content", c.route(F.col("path")).alias("kind"), F.sha2("content", 256).alias("content_hash"))
    return routed.where("kind <> 'unsupported'")


def recognise(found: DataFrame, make: Callable[[], Recogniser], least: float = 0.3) -> DataFrame:
    """Boxes of each file; boxes under the least confidence are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for batch in batches:
            for doc_id, content, kind in zip(batch["doc_id"], batch["content"], batch["kind"], strict=True):
                rows = [(doc_id, page, i, text, conf, x0, x1, y0, y1, (x0 + x1) / 2, (y0 + y1) / 2) for i, (page, text, conf, x0, x1, y0, y1) in enumerate(reader.boxes(bytes(content), kind)) if conf >= least]
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in BOXES.split(", ")])

    return found.select("doc_id", "content", "kind").mapInPandas(run, BOXES)


def misses(found: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content hash is not in cache(content_hash): only these need to be recognised."""
    return found.join(cache.select("content_hash").distinct(), "content_hash", "left_anti")
