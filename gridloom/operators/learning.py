"""What a batch of tables teaches: one pass over its cells gives all events, and state is kept as mergeable partial aggregates.

An event is (kind, doc_type, doc_id, name, position, weight, number, text):

=========  ==================================================================================
column     ``name`` of a column and its ``position``
header     ``text``: the names of a table with three of them or more, as JSON; ``number`` of rows
keyword    ``name``: a word, with its ``weight`` (3 title, 2 column names, 1 first column)
metadata   ``name``: info_labels, market_info_labels or title_sample, and its ``text``
number     ``name`` of a column; ``number``, one of its values
entity     ``name``: a text of the first or second column; ``text``: company or department
=========  ==================================================================================

Cells are shuffled once, by document; everything else happens inside a document.  A batch's events replace what an earlier run of the batch has
written (:func:`write_batch`), so running it again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as c

EVENT = "struct<kind:string,name:string,position:int,weight:double,number:double,text:string>"
FIRST_VALUES, LEAST_HEADERS, SHORTEST = 20, 3, 2


def event(kind: str, name: Column | None = None, position: Column | None = None, weight: float | None = None, number: Column | None = None, text: Column | None = None) -> Column:
    none = F.lit(None)
    parts = [F.lit(kind), name, position, None if weight is None else F.lit(weight), number, text]
    return F.struct(*[(none if p is None else p).cast(t).alias(n) for p, (n, t) in zip(parts, (x.split(":") for x in EVENT[7:-1].split(",")), strict=True)])


def words(text: Column, weight: float) -> Column:
    return F.transform(c.tokens(F.coalesce(text, F.lit(""))), lambda w: event("keyword", w, weight=weight))


KINDS = ("column", "header", "keyword", "metadata", "number", "entity")


def column_events(values: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The events of one column from its (row_idx, value), sorted: its place, its words, its numbers, and names where it is one of the first two."""
    name, place = c.strip(F.col("col_name")), F.col("col_idx")
    named = (name != "") & ~name.startswith("Col_")
    texts = F.array_distinct(F.transform(values, lambda v: v["value"]))
    stripped = F.filter(F.array_distinct(F.transform(texts, c.strip)), lambda v: (F.length(v) >= SHORTEST) & ~F.replace(F.replace(v, F.lit(","), F.lit("")), F.lit("-"), F.lit("")).rlike("^[0-9]+$"))
    numbers = F.filter(F.transform(values, lambda v: c.safe_float(v["value"])), lambda x: x.isNotNull())
    kind = F.when(place == 0, "company").when(place == 1, "department")
    none = F.array().cast(f"array<{EVENT}>")
    parts = {
        "column": [F.when(named, F.array(event("column", name, place))).otherwise(none)],
        "keyword": [words(F.col("col_name"), 2.0), F.when(place == 0, F.flatten(F.transform(F.slice(texts, 1, FIRST_VALUES), lambda v: words(v, 1.0)))).otherwise(none)],
        "number": [F.transform(numbers, lambda x: event("number", F.col("col_name"), number=x))],
        "entity": [F.when((place < 2) & (F.col("columns") >= 4), F.transform(stripped, lambda v: event("entity", v, text=kind))).otherwise(none)],
    }
    return F.concat(none, *[x for kind_, found in parts.items() if kind_ in kinds for x in found])


def learn(cells: DataFrame, types: DataFrame, metadata: DataFrame | None = None, kinds: tuple[str, ...] = KINDS, dealt: bool = False) -> DataFrame:
    """Events of cells(doc_id, row_idx, col_idx, col_name, value); types(doc_id, doc_type), metadata(doc_id, title, info, market_info) with lists of (label, value).

    Events of other kinds than those asked for are not made.  Cells are read once: what is told of a table as a whole goes along with its first column.
    Cells that are ``dealt`` by document already, to whatever number of parts, are not moved.
    """
    by_doc = cells.select("doc_id", "row_idx", "col_idx", "col_name", F.coalesce("value", F.lit("")).alias("value"))
    by_doc = by_doc if dealt else by_doc.repartition("doc_id")
    columns = by_doc.groupBy("doc_id", "col_idx", "col_name").agg(F.array_sort(F.collect_list(F.struct("row_idx", "value"))).alias("values"))
    typed = lambda d: d.join(types.select("doc_id", "doc_type").hint("shuffle_hash"), "doc_id")  # noqa: E731  # a document looks its type up before it becomes events, so these are not sorted for it
    docs = typed(columns.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "col_name", "values"))).alias("columns")))
    names = F.filter(F.transform("columns", lambda x: c.strip(x["col_name"])), lambda n: (n != "") & ~n.startswith("Col_"))
    height = F.array_max(F.transform("columns", lambda x: F.element_at(x["values"], -1)["row_idx"])) + 1
    none = F.array().cast(f"array<{EVENT}>")
    header = F.when(F.size(names) >= LEAST_HEADERS, F.array(event("header", text=F.to_json(names), number=height)).cast(f"array<{EVENT}>")).otherwise(none) if "header" in kinds else none
    flat = docs.select("doc_id", "doc_type", F.size("columns").alias("columns"), header.alias("header"), F.posexplode("columns").alias("place", "own")).select("doc_id", "doc_type", "columns", F.when(F.col("place") == 0, F.col("header")).otherwise(none).alias("header"), "own.*")
    out = flat.select("doc_id", "doc_type", F.inline(F.concat("header", column_events(F.col("values"), kinds))))
    if metadata is not None and {"keyword", "metadata"} & set(kinds):
        labels = lambda side: F.filter(F.transform(side, lambda p: p["label"]), lambda x: x.isNotNull())
        told = lambda name, side: F.when(F.size(side) > 0, F.array(event("metadata", F.lit(name), text=F.to_json(labels(side)))))
        title = F.when(F.col("title") != "", F.array(event("metadata", F.lit("title_sample"), text=F.col("title"))))
        parts = {"keyword": [words(F.col("title"), 3.0)], "metadata": [told("info_labels", F.col("info")), told("market_info_labels", F.col("market_info")), title]}
        out = out.unionByName(typed(metadata).select("doc_id", "doc_type", F.inline(F.concat(none, *[F.coalesce(x, none) for kind, found in parts.items() if kind in kinds for x in found]))))
    return out.select("kind", "doc_type", "doc_id", "name", "position", "weight", "number", "text")


def write_batch(events: DataFrame, folder: str, batch: str) -> None:
    """The events of a batch, in place of those that an earlier run of it has written; other batches are not touched."""
    events.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)


# -- state -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Aggregate:
    """State under a key, from partial aggregates that can be merged in any order.

    ``make`` turns events into rows of the key and one column for each operation; ``how`` says how that column is merged: sum, min, max, or latest
    (the value that was written last: a struct whose first field is the order).
    """

    key: tuple[str, ...]
    how: dict[str, str]
    make: Callable[[DataFrame], DataFrame]
    seeds: Callable[[SparkSession], DataFrame] | None = field(default=None)

    def merged(self, rows: DataFrame) -> DataFrame:
        op = {"sum": F.sum, "min": F.min, "max": F.max, "latest": F.max}
        return rows.groupBy(*self.key).agg(*[op[kind](name).alias(name) for name, kind in self.how.items()])

    def partial(self, events: DataFrame) -> DataFrame:
        return self.merged(self.make(events))

    def with_seeds(self, state: DataFrame) -> DataFrame:
        """Seeds that the state does not know yet are added; those that it knows change nothing."""
        if self.seeds is None:
            return state
        new = self.seeds(state.sparkSession).join(state.select(*self.key), list(self.key), "left_anti")
        return state.unionByName(new)


def _kind(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("kind") == kind)


#: What is kept of each kind of event.
AGGREGATES: dict[str, Aggregate] = {
    "keywords": Aggregate(("doc_type", "name"), {"n": "sum", "weight": "max"}, lambda e: _kind(e, "keyword").select("doc_type", "name", F.lit(1).cast("long").alias("n"), "weight")),
    "headers": Aggregate(("doc_type", "text"), {"n": "sum", "rows": "max"}, lambda e: _kind(e, "header").select("doc_type", "text", F.lit(1).cast("long").alias("n"), F.col("number").alias("rows"))),
    "numbers": Aggregate(("doc_type", "name"), {"n": "sum", "total": "sum", "low": "min", "high": "max"}, lambda e: _kind(e, "number").select("doc_type", "name", F.lit(1).cast("long").alias("n"), F.col("number").alias("total"), F.col("number").alias("low"), F.col("number").alias("high"))),
    "entities": Aggregate(("text", "name"), {"n": "sum"}, lambda e: _kind(e, "entity").select("text", "name", F.lit(1).cast("long").alias("n"))),
    "metadata": Aggregate(("doc_type", "name"), {"n": "sum", "last": "latest"}, lambda e: _kind(e, "metadata").select("doc_type", "name", F.lit(1).cast("long").alias("n"), F.struct("doc_id", "text").alias("last"))),
}


class State:
    """An aggregate's partial rows in a folder: a base and one delta for each batch that it does not hold yet.

    Adding a batch reads that batch alone; reading the state merges base and deltas; :meth:`compact` makes a new base of them, which names
    the batches that it holds, so a batch that comes again after that is known.  A base counts once its list of batches is written, so a run that breaks off leaves the old one.
    """

    def __init__(self, spark: SparkSession, folder: str, aggregate: Aggregate) -> None:
        self.spark, self.folder, self.aggregate = spark, folder.rstrip("/"), aggregate

    def _names(self, under: str) -> list[str]:
        """Folders below one, by name."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{under}")
        where = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in where.listStatus(path) if f.isDirectory()) if where.exists(path) else []

    def _finished(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def base(self) -> tuple[str | None, set[str]]:
        """The newest complete base and the batches that it holds."""
        for name in reversed(self._names("lists")):
            if self._finished(f"lists/{name}"):
                return name, {r["batch"] for r in self.spark.read.schema("batch string").json(f"{self.folder}/lists/{name}").collect()}
        return None, set()

    def add(self, batch: str, events: DataFrame) -> bool:
        """Take a batch's events in, in place of an earlier run of it; a batch that the base holds is not taken in again."""
        if batch in self.base()[1]:
            return False
        self.aggregate.partial(events).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        return True

    def _parts(self) -> tuple[list[str], list[str]]:
        name, held = self.base()
        new = [b for b in self._names("deltas") if b.split("=", 1)[1] not in held and self._finished(f"deltas/{b}")]
        return [f"{self.folder}/bases/{name}"] if name else [], new

    def current(self) -> DataFrame:
        """The state, with seeds."""
        base, deltas = self._parts()
        paths = base + [f"{self.folder}/deltas/{b}" for b in deltas]
        if not paths:
            empty = self.aggregate.partial(self.spark.createDataFrame([], f"kind string, doc_type string, doc_id string, {EVENT[7:-1].replace(':', ' ').replace('kind string,', '')}"))
            return self.aggregate.with_seeds(empty)
        rows = None
        for p in paths:
            one = self.spark.read.parquet(p)
            rows = one if rows is None else rows.unionByName(one)
        return self.aggregate.with_seeds(self.aggregate.merged(rows))

    def compact(self) -> str | None:
        """Merge the deltas into a new base; the old one and the deltas go when it is complete."""
        base, deltas = self._parts()
        if not deltas:
            return None
        old, held = self.base()
        name = f"{int(old) + 1 if old else 0:09d}"
        rows = None
        for p in base + [f"{self.folder}/deltas/{b}" for b in deltas]:
            one = self.spark.read.parquet(p)
            rows = one if rows is None else rows.unionByName(one)
        self.aggregate.merged(rows).write.mode("overwrite").parquet(f"{self.folder}/bases/{name}")
        batches = sorted(held | {b.split("=", 1)[1] for b in deltas})
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/lists/{name}")
        for gone in [f"deltas/{b}" for b in deltas] + ([f"bases/{old}", f"lists/{old}"] if old else []):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{gone}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return name
