"""Ordered folds over a stream: each later position of a column moves the known one half the way, in the order of events.

The fold depends on the order, so events wait until the watermark says that nothing earlier will come, and are then folded by (time, seq).  State is one small
row for each key and the events of the last ``late`` of time.  An event that comes later than that is dropped, as Spark drops late rows for every
operator with a watermark; the query's progress counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PositionFold(StatefulProcessor):
    """Frequency and folded position of a key; gives a row whenever they change."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "position long, frequency long")
        self.waiting = handle.getListState("waiting", "time long, seq long, position long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t.timestamp() * 1000), int(s), int(p)) for f in rows for t, s, p in zip(f["ts"], f["seq"], f["position"], strict=True)]
        if new:
            self.waiting.appendList(new)
        yield from self.fold(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.fold(key, timerValues.getCurrentWatermarkInMs())

    def fold(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """Take in what is older than the watermark; a timer wakes the key for the rest."""
        events = sorted(self.waiting.get())
        due = [e for e in events if e[0] <= watermark]
        if due:
            position, frequency = self.known.get() if self.known.exists() else (None, 0)
            for _, _, p in due:
                position = p if position is None else (position + p) // 2
            self.known.update((position, frequency + len(due)))
            yield pd.DataFrame([(*key, position, frequency + len(due))], columns=[*self.names, "position", "frequency"])
        rest = events[len(due) :]
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if rest:
            self.handle.registerTimer(rest[0][0])


def prepare(spark: SparkSession) -> None:
    """Keyed state needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def column_positions(stream: DataFrame, key: list[str], late: str) -> DataFrame:
    """stream(*key, ts, seq, position): a row of (*key, position, frequency) for each change; the row of the highest frequency is the state."""
    kinds = T.StructType([stream.schema[k] for k in key] + [T.StructField("position", T.LongType()), T.StructField("frequency", T.LongType())])
    rows = stream.select(*key, "ts", F.col("seq").cast("long").alias("seq"), F.col("position").cast("long").alias("position")).withWatermark("ts", late)
    return rows.groupBy(*key).transformWithStateInPandas(PositionFold(key), kinds, "Update", "EventTime")


def latest(changes: DataFrame, key: list[str]) -> DataFrame:
    """The state from all changes so far."""
    return changes.groupBy(*key).agg(F.max_by("position", "frequency").alias("position"), F.max("frequency").alias("frequency"))
