"""Incremental runs: new files become cells, and what is learned from them is appended as events.

A stream only decides which rows are new; each micro-batch goes through the same batch operators.
Events are appended under the batch's number, so a batch that is run again replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema, learn: Callable[[DataFrame], DataFrame], events: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Read new Parquet files of ``source``, apply ``learn`` to each batch and append its events."""
    stream = spark.readStream.schema(schema).options(**options).parquet(source)

    def step(batch: DataFrame, number: int) -> None:
        learn(batch).write.mode("overwrite").parquet(f"{events}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, events: str, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Current state from all events so far."""
    return reduce(spark.read.parquet(events))


def windowed_counts(stream: DataFrame, ts: str, late: str, width: str, *by: str) -> DataFrame:
    """Counts per window; rows that come later than ``late`` are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"))
