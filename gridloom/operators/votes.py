"""Several extractions of one table: majority votes, merging and arbitration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import cells as c


def vote(candidates: DataFrame, key: list[str]) -> DataFrame:
    """candidates(key, pos, value): the most frequent value (first seen of equals), its count and whether it is a majority."""
    counted = candidates.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    best = counted.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("m"), "p", "value")).alias("b"), F.sum("n").alias("total"))
    n = -F.col("b.m")
    return best.select(*key, F.col("b.value").alias("value"), n.alias("votes"), "total", (n > F.floor(F.col("total") / 2)).alias("majority"))


def counted(candidates: DataFrame, key: list[str]) -> DataFrame:
    """(key, found): the different values of candidates(key, pos, value) with count and first place, to be decided on by column functions.

    A key has as many entries as different values, so equal ones are counted before they move.
    """
    per = candidates.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    return per.groupBy(*key).agg(F.collect_list(F.struct("n", "p", "value")).alias("found"))


def total(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])


def most_frequent(found: Column, of=lambda x: x["value"]) -> Column:
    """struct(m, p, value): minus the count, first place and value of the most frequent of ``found``, the first seen of equals."""
    return F.array_min(F.transform(found, lambda x: F.struct((-total(F.filter(found, lambda y: of(y).eqNullSafe(of(x))))).alias("m"), x["p"].alias("p"), of(x).alias("value"))))


def by_characters(found: Column) -> Column:
    """A value seen twice, else the winners of each place among values of the most frequent length."""
    size = most_frequent(found, lambda x: F.length(x["value"]))["value"]
    same = F.filter(found, lambda x: F.length(x["value"]) == size)
    text = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: most_frequent(same, lambda x: F.substr(x["value"], i, F.lit(1)))["value"]), "")
    top = most_frequent(found)
    return F.when(top["m"] <= -2, top["value"]).otherwise(F.coalesce(F.when(size > 0, text), F.lit("")))


def vote_characters(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Text vote: a value seen twice wins, else the characters' votes among candidates of the most frequent length."""
    return counted(candidates, key).select(*key, by_characters(F.col("found")).alias("value"))


def fill_empty(base: DataFrame, aux: DataFrame, key: list[str]) -> DataFrame:
    """The base's cells, empty ones filled from the other where that has a value."""
    b = base.select(*key, "value").join(aux.select(*key, F.col("value").alias("aux")), key, "left")
    empty = F.trim("value").isin("", "nan")
    use = empty & F.col("aux").isNotNull() & ~F.trim("aux").isin("", "nan")
    return b.select(*key, F.when(use, F.trim("aux")).otherwise(F.col("value")).alias("value"), use.alias("filled"))


def arbitrate(api: DataFrame, local: DataFrame, known: DataFrame, key: list[str], column: Column, index: Column) -> DataFrame:
    """api(key, col_name, value) against local(key, value): digits from the local side, names from whichever side is known."""
    names = known.select(F.col("canonical_name").alias("value")).distinct()
    rows = api.join(local.select(*key, F.col("value").alias("local")), key, "left")
    rows = rows.join(names.select(F.col("value").alias("local"), F.lit(True).alias("kl")), "local", "left").join(names.select("value", F.lit(True).alias("ka")), "value", "left")
    digits = F.regexp_replace("local", "[,.-]", "").rlike("^[0-9]+$")
    local_wins = F.when(c.numeric_header(column), digits).when(index < 4, F.col("kl").isNotNull() & F.col("ka").isNull()).otherwise(False)
    return rows.select(*key, F.when(F.coalesce(local_wins, F.lit(False)), F.col("local")).otherwise(F.col("value")).alias("value"))


def first_confident(results: DataFrame, key: list[str], rank: str, confidence: str, least: float) -> DataFrame:
    """Per key the result of the first engine that is confident enough, else the last engine's."""
    ok = (F.col(confidence) >= least).cast("int")
    w = W.partitionBy(*key).orderBy(F.desc("_ok"), F.when(F.col("_ok") == 1, F.col(rank)).otherwise(-F.col(rank)))
    return results.withColumn("_ok", ok).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_ok")
