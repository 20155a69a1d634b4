"""The ordered fold over a stream against the fold over all events at once."""

import datetime
import random

from pyspark.sql import functions as F

from gridloom.operators import learn
from gridloom.streaming import folds

START = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "name string, ts timestamp, seq long, position int"


def test_fold_over_shuffled_batches(spark, tmp_path):
    folds.prepare(spark)
    rng = random.Random(4)
    events = [(f"k{rng.randrange(3)}", START + datetime.timedelta(seconds=10 * i), i, rng.randrange(120)) for i in range(90)]
    moved = sorted(events, key=lambda e: e[2] + rng.random() * 8)  # at most 80 seconds out of order
    end = [(k, START + datetime.timedelta(hours=9), 10_000, 7) for k in ("k0", "end")]  # brings the watermark past all of them; itself still waits
    source = str(tmp_path / "in")
    for a in range(0, 90, 18):
        spark.createDataFrame(moved[a : a + 18], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("k1", START, 20_000, 99)], SCHEMA).coalesce(1).write.mode("append").parquet(source)  # too late: dropped
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(source)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = folds.column_positions(stream, ["name"], "100 seconds").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    dropped = sum(int(o.numRowsDroppedByWatermark) for p in query.recentProgress for o in p.stateOperators)
    query.stop()
    got = {r["name"]: (r["position"], r["frequency"]) for r in folds.latest(spark.read.parquet(out), ["name"]).collect()}
    batch = learn.column_positions(spark.createDataFrame(events, SCHEMA).select("name", "seq", "position"), ["name"])
    assert got == {r["name"]: (r["position"], r["frequency"]) for r in batch.collect()}
    assert dropped == 1
