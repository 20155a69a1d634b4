"""A stored index of image hashes: results of documents that look alike are found without reading the others.

An entry is (h, key, verified): a 64-bit hash, the key of a result, and whether somebody has confirmed it.  Two hashes within ``most`` bits agree in one of
most + 1 bands of bits, so each entry is stored once for each band, in buckets by (band, value) that Spark knows: a batch is sorted
into the same buckets and joined there, and the stored side is never moved.  Batches are appended as runs; :meth:`compact` merges them, and
with them the flags of entries that were stored again or confirmed later.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed


def bands_of(h: Column, most: int) -> Column:
    """(k, v) of the bands of a hash."""
    n = most + 1
    cut = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("k"), F.shiftrightunsigned(h, cut[i]).bitwiseAND((1 << (cut[i + 1] - cut[i])) - 1).alias("v")) for i in range(n)])


class NearIndex:
    """Runs of entries in a folder, each a bucketed table; a small list names them."""

    def __init__(self, spark: SparkSession, folder: str, most: int = 5, buckets: int = 32) -> None:
        self.spark, self.folder, self.most, self.buckets = spark, folder.rstrip("/"), most, buckets
        self.runs: list[str] = []

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> NearIndex:
        """An index that :meth:`save` has left in a folder."""
        rows = spark.read.schema("place int, run string, most int, buckets int").json(f"{folder.rstrip('/')}/list").orderBy("place").collect()  # one row a run
        index = cls(spark, folder, rows[0]["most"], rows[0]["buckets"])
        index.runs = [r["run"] for r in rows if r["run"]]
        return index

    def save(self) -> None:
        rows = [(i, run, self.most, self.buckets) for i, run in enumerate(self.runs or [""])]
        self.spark.createDataFrame(rows, "place int, run string, most int, buckets int").coalesce(1).write.mode("overwrite").json(f"{self.folder}/list")

    def _table(self, run: str) -> DataFrame:
        name = f"gridloom_near_{run}"
        columns = "k INT, v BIGINT, h BIGINT, key STRING, verified BOOLEAN"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (k, v) SORTED BY (k, v) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/run-{run}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        run = uuid4().hex
        dealt = rows.repartition(self.buckets, "k", "v").select("k", "v", "h", "key", "verified")
        dealt.write.bucketBy(self.buckets, "k", "v").sortBy("k", "v").option("path", f"{self.folder}/run-{run}").format("parquet").saveAsTable(f"gridloom_near_{run}")
        return run

    def banded(self, rows: DataFrame) -> DataFrame:
        return rows.select("*", F.inline(bands_of(F.col("h"), self.most)))

    def add(self, entries: DataFrame) -> None:
        """Store entries(h, key, verified) as a run; an entry may come again, verified once means verified."""
        self.runs.append(self._write(self.banded(entries.select("h", "key", "verified"))))

    def lookup(self, batch: DataFrame, verified: bool = True) -> DataFrame:
        """(id, key, distance): for batch(id, h) the nearest stored entry within the distance, the smallest key of equals; only confirmed ones by default.

        Each run is joined with the batch in its buckets; only the batch is moved.
        """
        asked = checkpointed(self.banded(batch.select("id", F.col("h").alias("q"), "h")).select("id", "q", "k", "v").repartition(self.buckets, "k", "v"))
        found = None
        for run in self.runs:
            stored = self._table(run).where("verified") if verified else self._table(run)
            hits = asked.repartition(self.buckets, "k", "v").hint("merge").join(stored, ["k", "v"]).withColumn("distance", F.bit_count(F.col("q").bitwiseXOR(F.col("h"))).cast("long"))
            best = hits.where(F.col("distance") <= self.most).groupBy("id").agg(F.min(F.struct("distance", "key")).alias("b"))
            found = best if found is None else found.unionByName(best)
        if found is None:
            return self.spark.createDataFrame([], "id long, key string, distance long")
        return found.groupBy("id").agg(F.min("b").alias("b")).select("id", "b.key", "b.distance")

    def compact(self) -> None:
        """All runs as one; an entry is verified if any of its copies is."""
        rows = None
        for run in self.runs:
            one = self._table(run)
            rows = one if rows is None else rows.unionByName(one)
        if rows is None or len(self.runs) == 1:
            return
        old = self.runs
        self.runs = [self._write(rows.groupBy("k", "v", "h", "key").agg(F.max("verified").alias("verified")))]
        self.save()
        self._forget(old)

    def _forget(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS gridloom_near_{run}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/run-{run}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
