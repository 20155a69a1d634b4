"""State learned from history: append-only events, current state by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import cells as c


def column_stats(events: DataFrame, key: list[str], value: str) -> DataFrame:
    """Mergeable minimum, maximum, mean and count."""
    return events.groupBy(*key).agg(F.min(value).alias("min_val"), F.max(value).alias("max_val"), F.avg(value).alias("mean_val"), F.count(value).alias("n"))


def column_positions(events: DataFrame, key: list[str]) -> DataFrame:
    """events(key, seq, position): frequency, and the position halved towards each later one in integers."""
    listed = F.array_sort(F.collect_list(F.struct("seq", F.col("position").cast("long").alias("position"))))
    step = lambda acc, x: F.when(acc.isNull(), x["position"]).otherwise(F.floor((acc + x["position"]) / 2).cast("long"))
    return events.groupBy(*key).agg(F.count(F.lit(1)).alias("frequency"), F.aggregate(listed, F.lit(None).cast("long"), step).alias("position"))


def keyword_weights(events: DataFrame) -> DataFrame:
    """events(doc_type, keyword, weight): occurrences and the highest weight."""
    return events.groupBy("doc_type", "keyword").agg(F.count(F.lit(1)).alias("occurrence_count"), F.max("weight").alias("weight"))


def top_patterns(events: DataFrame, key: str, pattern: str, n: int) -> DataFrame:
    counted = events.groupBy(key, pattern).agg(F.count(F.lit(1)).alias("frequency"))
    return counted.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("frequency"), pattern))).where(F.col("_r") <= n).drop("_r")


def corrections(events: DataFrame, least: float = 0.5) -> DataFrame:
    """events(doc_type, wrong, correct, kind, confidence, seq): counts, highest confidence, first kind."""
    per = events.groupBy("doc_type", "wrong", "correct").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.min_by("kind", "seq").alias("kind"))
    return per.where(F.col("confidence") >= least)


def within_budget(rows: DataFrame, key: str, order: list[Column], line: Column, used: int, most: int, limit: int) -> DataFrame:
    """The first rows of each key whose lines fit a budget; the first that does not fit ends the list."""
    w = W.partitionBy(key).orderBy(*order)
    run = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).withColumn("chars", F.lit(used) + F.sum(F.length(line)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.where(F.col("chars") <= most)


def daily_quota(events: DataFrame, ts: str, limit: int, reserve: int) -> DataFrame:
    per = events.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("calls"))
    return per.withColumn("allowed", F.col("calls") < limit - reserve)


def confirmed(documents: DataFrame) -> DataFrame:
    """Documents whose type somebody has confirmed, the latest first."""
    return documents.where("confirmed_type IS NOT NULL").orderBy(F.desc("seq"))


def correction_events(before: DataFrame, after: DataFrame, longest: int = 50) -> DataFrame:
    """(doc_id, wrong, correct, kind, confidence) from two versions of tables of the same shape; long cells are left out."""
    shape = lambda d, n: d.groupBy("doc_id").agg(F.struct(F.max("row_idx"), F.max("col_idx")).alias(n))
    same = shape(before, "a").join(shape(after, "b"), "doc_id").where("a = b").select("doc_id")
    strip = lambda x: c.strip(F.col(x))
    key = ["doc_id", "row_idx", "col_idx"]
    both = before.select(*key, strip("value").alias("wrong")).join(after.select(*key, strip("value").alias("correct")), key).join(same, "doc_id", "left_semi")
    changed = both.where((F.col("wrong") != "") & (F.col("correct") != "") & (F.col("wrong") != F.col("correct")) & (F.length("wrong") < longest))
    return changed.select("doc_id", "wrong", "correct", c.correction_kind_by_value(F.col("wrong"), F.col("correct")).alias("kind"), F.lit(0.9).alias("confidence"))


def against_truth(cells: DataFrame, truth: DataFrame, labels: list[str], kinds: tuple[str, ...] = ("company", "department", "name", "account")) -> DataFrame:
    """(doc_id, row, col_idx, wrong, correct, kind): the first four columns of data rows against those of a truth, by ordinal.

    Rows without a first cell count on neither side; closing rows do not count as data.
    """

    def rows(d: DataFrame, skip: list[str], name: str) -> DataFrame:
        v = c.strip(F.col("value"))
        data = d.where((F.col("col_idx") == 0) & ~v.isin(skip)).select("doc_id", "row_idx")
        data = data.withColumn("row", F.row_number().over(W.partitionBy("doc_id").orderBy("row_idx")) - 1)
        return d.where(F.col("col_idx") < len(kinds)).join(data, ["doc_id", "row_idx"]).select("doc_id", "row", "col_idx", v.alias(name))

    both = rows(cells, ["", *labels], "wrong").join(rows(truth, [""], "correct"), ["doc_id", "row", "col_idx"])
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.col("col_idx").cast("int") + 1)
    return both.where("wrong <> '' AND correct <> '' AND wrong <> correct").withColumn("kind", kind)


def learnable(corrections_: DataFrame, known: DataFrame) -> DataFrame:
    """corrections(wrong, correct, kind) without those whose sides are both known(kind, canonical_name): rows have shifted there."""
    names = known.select("kind", "canonical_name").distinct()
    side = lambda x: names.withColumnRenamed("canonical_name", x).withColumn(f"_{x}", F.lit(True))
    both = corrections_.join(side("wrong"), ["kind", "wrong"], "left").join(side("correct"), ["kind", "correct"], "left")
    return both.where("_wrong IS NULL OR _correct IS NULL").select(*corrections_.columns)


def still_cached(cache: DataFrame, corrected_types: DataFrame) -> DataFrame:
    """cache(doc_type, verified, ...) without unverified results of types that something was learned for."""
    stale = cache.where(~F.col("verified")).join(corrected_types.select("doc_type").distinct(), "doc_type", "left_semi")
    return cache.where("verified").unionByName(cache.where(~F.col("verified")).join(stale.select("doc_type").distinct(), "doc_type", "left_anti"))


def correction_map(learned: DataFrame, doc_type: str, least: float = 0.5) -> DataFrame:
    """(wrong, correct) for a type: its own pairs and the default ones, which win; the rarest of several wins within each."""
    mine = learned.where((F.col("confidence") >= least) & F.col("doc_type").isin(doc_type, "default"))
    order = [F.desc(F.col("doc_type") == "default"), F.col("n"), F.desc("correct")]
    return mine.withColumn("_i", F.row_number().over(W.partitionBy("wrong").orderBy(*order))).where("_i = 1").select("wrong", "correct")


def header_hint(headers: Column, most: int = 30) -> Column:
    """The first header names as one line, with the number of those left out."""
    rest = F.size(headers) - most
    return F.concat(F.array_join(F.slice(headers, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" ... (+"), rest.cast("string"), F.lit(")"))).otherwise(""))


def correction_hints(pairs: DataFrame, key: str, head: str, most: int = 20, chars: int = 600) -> DataFrame:
    """(key, prompt): the most frequent pairs(key, wrong, correct, n) as lines under a head, as many as fit."""
    line = F.concat(F.lit('- "'), "wrong", F.lit('" → "'), "correct", F.lit('"'))
    fitting = within_budget(pairs, key, [F.desc("n"), F.col("wrong"), F.col("correct")], line, len(head), chars, most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("t")))), lambda s: s["t"])
    return fitting.groupBy(key).agg(F.concat(F.lit(head + "\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("prompt"))
