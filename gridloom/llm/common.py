"""Helpers that several operators of this subpackage share.

All of them are ordinary DataFrame jobs.  Intermediate results that are read more than once are
written as Parquet into the folder named by ``spark.checkpoint.dir``, which every executor can
reach, so a lost executor costs a re-read and never a re-computation of the whole lineage.
:func:`scratch` deletes them when a caller has written its result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: The ASCII white space that all contracts of this package mean, as a regex class body.
SPACE = r"\x20\x09-\x0D"
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


_made: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where that is absent a temporary one serves a local session; on a cluster it is an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_folder(spark)}/gridloom-{what}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """Delete at the end what :func:`written` makes inside; results that are read later must be written elsewhere by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            delete(spark, path)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a text of their own in ``_row`` that stays the same whenever they are read.

    Rows that come straight from files are named by file and place; others are written once with a number.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
        return docs.select("*", place.alias("_row"))
    return written(docs.withColumn("_row", F.monotonically_increasing_id().cast("string")), "numbered")


def moved(rows: DataFrame) -> DataFrame:
    """A list of rows that a join brings to the texts by a shuffle at every size, as it grows with the input: never sent whole to all executors."""
    return rows.hint("merge")


def text_of(text: str | Column = "text") -> Column:
    """The text, with null counted as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; null counts 0."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")).cast("long")


def unit(hex_digits: Column) -> Column:
    """A number in [0, 1) from the first 8 of some hexadecimal digits."""
    return F.conv(F.substring(hex_digits, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def running_sum(df: DataFrame, key: str, order: Sequence[str], value: str, out: str, rows_per_bucket: int = 1024) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``key`` that come before.

    The rows of a key are ordered by ``order``, whose first column must be a hexadecimal digest.
    A key may hold any share of the rows: its range of digests is cut into buckets of about
    ``rows_per_bucket`` rows, rows are summed inside each bucket, and the buckets' totals are summed
    over two coarser levels.  No task ever holds more than a bucket or one level of totals.
    """
    df = written(df, "rows")
    buckets = max(1, -(-df.count() // rows_per_bucket))
    rows = df.withColumn("_b", F.floor(unit(F.col(order[0])) * buckets))
    inner = W.partitionBy(key, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    totals = df.withColumn("_b", F.floor(unit(F.col(order[0])) * buckets)).groupBy(key, "_b").agg(F.sum(value).alias("_s"))
    totals = totals.withColumn("_c", F.floor(F.col("_b") / 4096))
    coarse = totals.groupBy(key, "_c").agg(F.sum("_s").alias("_cs"))
    before = lambda *part: W.partitionBy(*part[:-1]).orderBy(part[-1]).rowsBetween(W.unboundedPreceding, -1)
    coarse = coarse.withColumn("_co", F.coalesce(F.sum("_cs").over(before(key, "_c")), F.lit(0))).drop("_cs")
    totals = totals.withColumn("_bo", F.coalesce(F.sum("_s").over(before(key, "_c", "_b")), F.lit(0)))
    offsets = totals.join(coarse, [key, "_c"]).select(key, "_b", (F.col("_bo") + F.col("_co")).alias("_o"))
    return rows.join(offsets, [key, "_b"]).withColumn(out, (F.col("_in") + F.col("_o")).cast("long")).drop("_b", "_in", "_o")


def tiles(rows: DataFrame, key: Sequence[str], spread: Column, block: int, weight: Column | None = None) -> DataFrame:
    """Deal the rows of each key to tiles, so that each pair of rows of a key meets in exactly one tile.

    A key with n rows (or rows of a total ``weight`` n) is cut into ceil(n / block) parts; tile (i, j) gets parts i and j, and the
    pairs of a row of part i with a row of part j belong to it.  Only the keys with more rows than a
    block are joined to the rows; that list is written, so Spark knows its size and broadcasts it only if
    it is small.  Adds ``part``, ``ti`` and ``tj``; rows come back partitioned and sorted by key and tile,
    ready for :func:`groups`.
    """
    large = rows.groupBy(*key).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n")).where(F.col("_n") > block)
    large = written(large.select(*key, F.ceil(F.col("_n") / block).cast("int").alias("_p")), "large")
    dealt = rows.join(large, list(key), "left").withColumn("_p", F.coalesce("_p", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(spread, F.col("_p")).cast("int"))
    dealt = dealt.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    dealt = dealt.withColumn("ti", F.least("part", "_q")).withColumn("tj", F.greatest("part", "_q")).drop("_p", "_q")
    by = [*key, "ti", "tj"]
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *by).sortWithinPartitions(*by)


def parts(rows: DataFrame, key: Sequence[str], spread: Column, block: int) -> DataFrame:
    """Deal the rows of each key to parts of about ``block`` rows: each row to one part, so their number stays the same.

    Adds ``part`` and ``parts`` (how many the key has); rows come back partitioned and sorted by key and part, ready for :func:`groups`.
    """
    large = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    large = written(large.select(*key, F.ceil(F.col("_n") / block).cast("int").alias("parts")), "large")
    dealt = rows.join(large, list(key), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(spread, F.col("parts")).cast("int"))
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *key, "part").sortWithinPartitions(*key, "part")


def groups(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in a sorted stream of batches, each as one table."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [table.column(k).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(table.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        starts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a and held or held and first != last:
                yield held[0] if len(held) == 1 else pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield held[0] if len(held) == 1 else pa.concat_tables(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 joined by the pairs (a, b): the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``: the smallest node that links reach.

    Alternating large-star and small-star steps.  Each is a minimum per node and a join, so a node
    with any number of links is pre-aggregated or split by Spark and never gathered in a task.
    """
    found = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    found = written(found, "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = state(found)
    while now[0]:
        both = found.select(F.col("u").alias("x"), F.col("v").alias("y")).union(found.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        was, now = now, state(found)
        if was == now:
            break
    ends = found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Apply a function of columns to each Arrow batch; ``make`` runs once in each task."""
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            got = step(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kinds)
