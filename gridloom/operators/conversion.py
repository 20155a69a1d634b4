"""From documents to finished workbooks in one chain.

Documents take one of four ways to their cells: results that are known by content (cached), raw tables that a document holds itself (raw), boxes in a detected grid
(ruled), boxes alone (lines).  A document whose grid gives no table goes on to the lines.  Then names are corrected, types are told, cells are checked, and
workbooks are planned.  Cells are written twice, as they were extracted and as they are corrected; every output is made from those tables, none reads the boxes again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learning, sheets, tables, validate
from .shared import checkpointed, kept

CELLS = ["doc_id", "row_idx", "col_idx", "col_name", "value"]


@dataclass
class Inputs:
    """documents(doc_id, content_hash, width, height); boxes, grid and raw tables by doc_id; cache(content_hash, row_idx, col_idx, col_name, value); known names and variants by kind."""

    documents: DataFrame
    boxes: DataFrame
    grid: DataFrame
    raw: DataFrame
    cache: DataFrame
    known: DataFrame
    variants: DataFrame
    pairs: tuple[tuple[str, str], ...] = ()


@dataclass
class Outputs:
    cells: DataFrame  # doc_id, row_idx, col_idx, col_name, value, route
    types: DataFrame  # doc_id, doc_type
    errors: DataFrame  # doc_id, row_idx, col_idx, rule
    events: DataFrame  # see learning
    plan: DataFrame  # see sheets


def extracted(i: Inputs) -> DataFrame:
    """Cells with their route.  They are written by route as they are made, so what follows reads them and neither boxes nor raw tables."""
    by = lambda d, route: d.select(*CELLS).withColumn("route", F.lit(route))
    hit = i.documents.join(i.cache, "content_hash")
    closed = hit.select("doc_id", F.lit(True).alias("cached")).unionByName(i.raw.select("doc_id", F.lit(False).alias("cached")))
    closed = kept(closed.groupBy("doc_id").agg(F.max("cached").alias("cached")), "closed")  # documents whose boxes are not looked at
    raw = tables.normalize_raw(i.raw.join(closed.where("cached").select("doc_id"), "doc_id", "left_anti"))
    boxed = i.boxes.join(closed.select("doc_id"), "doc_id", "left_anti")
    first = kept(by(hit, "cached").unionByName(by(raw, "raw")).unionByName(by(tables.grid_tables(boxed, i.grid), "ruled")), "cells")
    rest = boxed.join(first.where("route = 'ruled'").select("doc_id").distinct(), "doc_id", "left_anti")
    return first.unionByName(kept(by(tables.line_tables(rest, i.documents.select("doc_id", "height")), "lines"), "cells"))


def corrected(i: Inputs) -> DataFrame:
    """The cells of all documents with corrected names, and their route, which comes along with each cell."""
    return tables.correct_table(extracted(i), list(i.pairs), i.known, i.variants, True).select(*CELLS, "route")


def document_types(cells: DataFrame, titles: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, doc_type) by the words of a document's title and column names and the shape of its page; ``default`` if nothing tells."""
    names = cells.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("col_name")), " ").alias("names"))
    rows = names.join(documents.select("doc_id", "width", "height"), "doc_id").join(titles, "doc_id", "left")
    return rows.select("doc_id", F.coalesce(tables.document_type(F.concat_ws(" ", "title", "names"), F.col("width"), F.col("height")), F.lit("default")).alias("doc_type"))


def convert(i: Inputs) -> Outputs:
    """All outputs of a batch of documents."""
    cells = checkpointed(corrected(i))
    above = tables.metadata(i.boxes.join(cells.select("doc_id").distinct(), "doc_id", "left_semi"), tables.header_line(i.boxes, i.documents.select("doc_id", "height")))
    pairs = lambda side: F.transform(side, lambda t: F.struct(t.alias("label"), F.lit("").alias("value"))).alias(side)
    metadata = checkpointed(above.select("doc_id", "title", pairs("info"), pairs("market_info")))
    types = checkpointed(document_types(cells, metadata.select("doc_id", "title"), i.documents))
    demand = cells.join(types.where("doc_type = 'demand_forecast'").select("doc_id"), "doc_id", "left_semi")
    errors = validate.invalid_cells(cells).select("doc_id", "row_idx", "col_idx", F.lit("number").alias("rule")).unionByName(validate.control_totals(demand))
    events = learning.learn(cells, types, metadata)
    shown = cells.join(types, "doc_id")
    plan = sheets.sheet_plan(shown.select(*CELLS, "doc_type"), errors, metadata, i.documents.select("doc_id"), F.col("doc_type"))
    return Outputs(cells, types, errors, events, plan)
