"""What people change in finished workbooks becomes correction events, each change once.

A snapshot is what a workbook held at a time: (path, modified, sheet, row, col, value, number, head).  :func:`register_outputs` takes one of a folder after it
was written.  :func:`poll` is a stream of files that have changed since; each batch is compared with the newest older snapshot of each
file, its events are written under the batch's number, and the batch itself becomes a snapshot.  A batch that runs again
finds the same older snapshots and replaces its own events.  A file without a snapshot is only taken down.

Cells are compared as numbers where both are numbers, so a format is never a correction, else as stripped texts; a cell that is empty on either side is none, nor are the
column names and what stands above them.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from ..functions import cells as c
from ..sources.xlsx import CELLS

PLACE = ["path", "sheet", "row", "col"]


def snapshots(spark: SparkSession, state: str) -> DataFrame:
    """All snapshots in a state folder, with the batch that took them."""
    return spark.read.schema(f"{CELLS}, batch string").option("basePath", f"{state}/snapshots").parquet(f"{state}/snapshots")


def register_outputs(spark: SparkSession, folder: str, state: str) -> None:
    """Take down what the workbooks of a folder hold now."""
    spark.read.format("xlsx").load(folder).write.parquet(f"{state}/snapshots/batch=r{uuid4().hex}")


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, modified, sheet, row, col, col_name, original, corrected, kind): cells of ``now`` against the newest older snapshot of their file."""
    now, before = now.repartition("path"), before.repartition("path")  # all that follows works within a file, so cells are moved once
    files = now.select("path", F.col("modified").alias("at")).distinct()
    newest = F.max("modified").over(W.partitionBy("path", "at"))
    older = before.join(files, "path").where("modified < at").withColumn("_newest", newest).where("modified = _newest")
    base = older.dropDuplicates([*PLACE, "at"]).select(*PLACE, F.col("at").alias("modified"), F.col("value").alias("_value"), F.col("number").alias("_number"))
    name = F.max(F.when(F.col("row") == F.col("head"), F.col("value"))).over(W.partitionBy("path", "modified", "sheet", "col"))
    rows = now.withColumn("col_name", F.coalesce(name, F.lit(""))).where("row > head").join(base, [*PLACE, "modified"])
    old, new = c.strip(F.col("_value")), c.strip(F.col("value"))
    same = F.coalesce(F.col("number") == F.col("_number"), F.lit(False)) | (old == new)
    kind = c.correction_kind_by_header(F.col("col_name"), old)
    return rows.where((old != "") & (new != "") & ~same).select("path", "modified", "sheet", "row", "col", "col_name", old.alias("original"), new.alias("corrected"), kind.alias("kind"))


def poll(spark: SparkSession, folder: str, state: str, checkpoint: str, **options: str) -> StreamingQuery:
    """A stream that writes correction events to ``<state>/events``; ``processAllAvailable`` brings it up to date."""

    def step(batch: DataFrame, number: int) -> None:
        name = f"{number:09d}"
        batch.write.mode("overwrite").parquet(f"{state}/snapshots/batch={name}")
        now = spark.read.schema(CELLS).parquet(f"{state}/snapshots/batch={name}")
        before = snapshots(spark, state).where((F.col("batch") < name) | F.col("batch").startswith("r")).drop("batch")
        unknown = now.join(before.select("path", "modified").distinct(), ["path", "modified"], "left_anti")  # others were written by the conversion
        changes(unknown, before).write.mode("overwrite").parquet(f"{state}/events/batch={name}")

    stream = spark.readStream.format("xlsx").options(**options).load(folder)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def events(spark: SparkSession, state: str) -> DataFrame:
    """All correction events so far."""
    return spark.read.option("basePath", f"{state}/events").parquet(f"{state}/events")
