"""Running totals over keys of any size.

A window over a key holds the key in one task.  Here rows are sorted into ranges of (key, order), each range is summed by itself, and
what the ranges before it add up to comes from a small table with one row for each range and key.  A key may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import checkpointed


def running_total(rows: DataFrame, key: list[str], order: list[str], value: str, out: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the rows of the same key that come before in ``order``, and of the row itself.

    ``order`` must tell the rows of a key apart; null values count 0.  The rows are checkpointed once they are dealt to ranges, as the ranges are
    read twice and must be the same both times.
    """
    by = [*key, *order]
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()))
    inside = W.partitionBy("_range", *key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = dealt.groupBy("_range", *key).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    before = W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    same = (F.col("a._range") == F.col("b._range")) & _all_equal(key)
    found = dealt.withColumn("_in", F.sum(F.coalesce(value, F.lit(0))).over(inside)).alias("a").join(totals.alias("b"), same)
    return found.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("a._in") + F.col("b._before")).alias(out))


def _all_equal(key: list[str]):
    """Null keys are equal to each other."""
    out = F.lit(True)
    for k in key:
        out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out
