"""Links inside groups of any size, without looking at all pairs of a large group.

A group of at most ``block`` rows is one tile, where all pairs are compared.  A larger one is dealt to parts of about that size; each part is a
tile, and a few members drawn from the whole group (its centers) go to every part.  Rows grow with the members, not with their pairs.  In
a group of near copies that joins nearly everything at once, directly or over a center.

What counts is which members belong together, so a group whose members are all in one component is done.  The others may be dealt again, by another order and with
other centers, until in the last round what is still apart is settled exactly: the members outside the group's largest component are brought together with
that component, part by part, and with each other, so no link between two components is lost.  Only a large group that falls
apart into many components costs more than its size: pairs of those members are all looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forest, groups, written


def tile_links(tiles: DataFrame, key: list[str], pairs_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b): a spanning forest of the links inside each tile; ``pairs_of`` gives the linked rows of one."""
    by = [*key, "tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for t in groups(batches, by):
            if len(t) < 2:
                continue
            ids = t["id"].to_numpy()
            i, j = pairs_of(t)
            if len(i):
                root = forest(len(ids), i, j)
                apart = np.flatnonzero(root != np.arange(len(ids)))
                a.append(ids[apart])
                b.append(ids[root[apart]])
            if len(a) > 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def part(count: Column, turn: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(turn)), count).cast("int")


def dealt(rows: DataFrame, key: list[str], large: DataFrame, turn: int, centers: int) -> DataFrame:
    """Each row in one tile, and the centers of large(*key, parts) in all tiles of their group; other groups are one tile."""
    once = rows.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("tile", part(F.col("parts"), turn))
    drawn = [F.min_by("id", F.xxhash64("id", F.lit(f"{turn} {i}"))).alias(f"_{i}") for i in range(centers)]
    members = rows.join(large, key)
    heads = members.groupBy(*key).agg(*drawn).select(*key, F.explode(F.array_distinct(F.array(*[f"_{i}" for i in range(centers)]))).alias("id"))
    spread = members.join(heads, [*key, "id"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.where(F.col("tile") != part(F.col("parts"), turn))
    return once.drop("parts").unionByName(spread.drop("parts").select(once.drop("parts").columns))


def labelled(rows: DataFrame, key: list[str], open_: DataFrame, labels: DataFrame) -> DataFrame:
    """(*key, id, label): members of the open groups under the component that the links so far give them."""
    known = labels.select(F.col("node").alias("id"), F.col("component").alias("_label"))
    members = rows.join(open_, key, "left_semi").select(*key, "id")
    return members.join(known, "id", "left").select(*key, "id", F.coalesce("_label", "id").alias("label"))


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (node, component) with more links: only the components that these links join are looked at again."""
    ends = edges
    for side in ("a", "b"):
        of = labels.select(F.col("node").alias(side), F.col("component").alias("_to"))
        ends = ends.join(of, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
    new = written(components(ends.where("a <> b").distinct()), "joined")
    if new.isEmpty():
        return labels
    to = new.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    moved = labels.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    alone = new.join(labels.select("node"), "node", "left_anti").select("node", "component")
    return written(moved.unionByName(alone), "labels")


def settled(rows: DataFrame, key: list[str], open_: DataFrame, labels: DataFrame, weight: Column, block: int) -> DataFrame:
    """Tiles in which every two members of different components of an open group meet."""
    of = written(labelled(rows, key, open_, labels), "labelled")
    largest = of.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    members = rows.join(of, [*key, "id"]).join(largest, key).withColumn("rest", F.col("label") != F.col("main")).withColumn("_w", weight)
    count = lambda hit: F.greatest(F.ceil(F.coalesce(F.sum(F.when(hit, F.col("_w"))), F.lit(0)) / block), F.lit(1)).cast("int")
    sizes = written(members.groupBy(*key).agg(count(~F.col("rest")).alias("_m"), count(F.col("rest")).alias("_r")), "sizes")
    members = members.join(sizes, key)
    own = F.when(F.col("rest"), part(F.col("_r"), 0)).otherwise(part(F.col("_m"), 0))
    # tile (i, j) of the largest component's part i and the rest's part j, then the pairs of the rest's parts
    with_main = F.when(F.col("rest"), F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda i: i * F.col("_r") + own)).otherwise(F.transform(F.sequence(F.lit(0), F.col("_r") - 1), lambda j: own * F.col("_r") + j))
    among = F.transform(F.sequence(F.lit(0), F.col("_r") - 1), lambda q: F.col("_m") * F.col("_r") + F.least(own, q) * F.col("_r") + F.greatest(own, q))
    none = F.filter(with_main, lambda _: F.lit(False))
    tiles = members.withColumn("tile", F.explode(F.concat(with_main, F.when(F.col("rest") & (F.col("_r") > 1), among).otherwise(none))))
    return tiles.select(*rows.columns, "tile")


def linear_components(rows: DataFrame, key: list[str], pairs_of: Callable, block: int, weight: Column | None = None, rounds: int = 1, centers: int = 4) -> DataFrame:
    """(node, component) of all rows(*key, id, ...) that a link inside some group joins to another: the smallest id that links reach.

    ``rows`` are read several times and should be cheap to make again.  ``weight`` says how much of a block a row takes; 1 by default.
    """
    weight = F.lit(1) if weight is None else weight
    sizes = rows.groupBy(*key).agg(F.sum(weight).alias("_n")).where(F.col("_n") > block)
    open_ = written(sizes.select(*key, F.ceil(F.col("_n") / block).cast("int").alias("parts")), "large")
    labels = written(components(tile_links(dealt(rows, key, open_, 0, centers), key, pairs_of)), "labels")
    for turn in range(1, rounds + 1):
        several = labelled(rows, key, open_, labels).groupBy(*key).agg(F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l < _h")
        open_ = written(open_.join(several.select(*key), key, "left_semi"), "open")
        if open_.isEmpty():
            return labels
        some = rows.join(open_, key, "left_semi")
        tiles = dealt(some, key, open_, turn, centers) if turn < rounds else settled(rows, key, open_, labels, weight, block)
        labels = joined(labels, tile_links(tiles, key, pairs_of))
    return labels
