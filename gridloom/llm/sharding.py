"""Sharding by a hierarchical weighted hash tree, in DataFrame operations only.

A tree has regions, racks and shards.  A row descends from the root: at each level every child draws
``-ln(u) / weight`` with u hashed from the row's id and the child's name, and the smallest draw wins,
so children are chosen in proportion to their weights.  A child's draw depends on nothing but its own
name and weight.  Therefore when a weight grows, rows move only into that child, and rows of
subtrees whose weights stay do not move among their own children.

Law: ``key``.  The id and the number of shards decide.  Shards added with :meth:`Tree.grow` open a
region of their own: a region's larger weight would otherwise pull rows into its older shards as well.
So one more shard takes rows only into itself, any number of times.

Null texts have no bytes; a null id is an id like any other (all such rows share a shard).  Equal
ids share a shard; their slots differ.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sum, text_of


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    shards: tuple[Shard, ...]

    @classmethod
    def of(cls, shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> Tree:
        """Shards of weight 1 in full racks and regions, the last ones perhaps smaller."""
        per = racks_per_region * shards_per_rack
        return cls(tuple(Shard(i, f"g{i // per}", f"g{i // per}/r{i % per // shards_per_rack}") for i in range(shards)))

    def grow(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, in a region of its own."""
        n = len(self.shards)
        return Tree((*self.shards, Shard(n, f"x{n}", f"x{n}/r0", weight)))

    def place(self, key: Column, seed: int = 0) -> Column:
        """The number of the shard that a key belongs to."""

        def choose(children: dict[str, list[Shard]], down) -> Column:
            if len(children) == 1:
                return down(next(iter(children.values())))
            draws = []
            for i, (name, below) in enumerate(children.items()):
                digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), key.cast("string"))), 1, 12)
                u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
                draws.append(F.struct((-F.ln(u) / sum(s.weight for s in below)).alias("d"), F.lit(i).alias("i")))
            won = F.least(*draws)["i"]
            out = None
            for i, below in enumerate(children.values()):
                out = F.when(won == i, down(below)) if out is None else out.when(won == i, down(below))
            return out

        def split(shards: list[Shard], by) -> dict[str, list[Shard]]:
            out: dict[str, list[Shard]] = {}
            for s in shards:
                out.setdefault(by(s), []).append(s)
            return out

        leaf = lambda shards: choose(split(shards, lambda s: f"s{s.number}"), lambda below: F.lit(below[0].number))
        rack = lambda shards: choose(split(shards, lambda s: s.rack), leaf)
        return choose(split(list(self.shards), lambda s: s.region), rack).cast("int")


def shard_rows(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """id, size, text_crc32, order (a digest that shuffles rows), shard, grown_shard and slot of each row."""
    key = F.col(id_col)
    rows = docs.select(
        key, (F.octet_length(text_of(text_col)) + 1).cast("long").alias("size"), F.crc32(text_of(text_col)).alias("text_crc32"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))).alias("order"), tree.place(key, seed).alias("shard"), tree.grow().place(key, seed).alias("grown_shard"), F.lit(1).alias("_one"),
    )
    return running_sum(rows, "shard", ["order", "size", "text_crc32"], "_one", "slot").drop("_one")


def write_shards(docs: DataFrame, path: str, tree: Tree, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> None:
    """Write the documents as one folder ``shard=n`` per shard; a large shard becomes several files."""
    placed = docs.withColumn("shard", tree.place(F.col(id_col), seed))
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_rows(docs, Tree.of(16))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The descent of op4's tree in SQL; CRC-32 is folded over the text's bytes.
ORACLE = r"""
WITH k AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM (SELECT unnest(range(256)) AS n) q) z),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS i, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, i, (length(h) // 2 + 1)::BIGINT AS size, list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)) AS bytes FROM d),
c AS (SELECT doc_id, i, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, k.t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, k),
g AS (SELECT *, list_sort(list_transform([0, 1, 2, 3], lambda n: {'d': -ln((('0x' || substr(md5('0:g' || n || ':' || i), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE) / 4, 'n': n}))[1] AS g, -ln((('0x' || substr(md5('0:x16:' || i), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE) AS x FROM c),
r AS (SELECT *, g.n AS region, list_sort(list_transform([0, 1], lambda n: {'d': -ln((('0x' || substr(md5('0:g' || g.n || '/r' || n || ':' || i), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE), 'n': n}))[1].n AS rack FROM g),
s AS (SELECT *, list_sort(list_transform([0, 1], lambda n: {'d': -ln((('0x' || substr(md5('0:s' || (4 * region + 2 * rack + n) || ':' || i), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE), 'n': (4 * region + 2 * rack + n)::INT}))[1].n AS shard FROM r)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY md5('0|' || i), size, text_crc32) - 1)::BIGINT AS slot, CASE WHEN x < g.d THEN 16 ELSE shard END::INT AS grown_shard FROM s
"""
