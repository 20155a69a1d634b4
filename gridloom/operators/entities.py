"""Names: dictionaries, variants, fuzzy matches and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import cells as c


def lookup_variants(values: DataFrame, variants: DataFrame) -> DataFrame:
    """values(value) with the canonical name of variants(variant_text, canonical_name); the most frequent, then first by name."""
    best = variants.groupBy("variant_text").agg(F.min(F.struct((-F.col("occurrence_count")).alias("n"), "canonical_name")).alias("b"))
    return values.join(best, values["value"] == best["variant_text"], "left").withColumn("canonical_name", F.col("b.canonical_name")).drop("b", "variant_text")


#: Lengths of a value and of a name that is offered to it may differ by this much; a shorter value is no name.
BAND, SHORTEST = 3, 2


def by_frequency(*first: str | Column) -> Column:
    """What decides between names: what is given first, then the higher frequency, then the name."""
    return F.struct(*first, (-F.col("frequency")).alias("f"), "canonical_name")


def segment_start(length: Column, i: Column, most: Column) -> Column:
    """Where segment i of most + 1 begins in a text: segments are as even as they can be, longer ones last."""
    n, base = most + 1, F.floor(length / (most + 1)).cast("int")
    return i * base + F.greatest(i - (n - length % n), F.lit(0))


def segment_length(length: Column, i: Column, most: Column) -> Column:
    n, base = most + 1, F.floor(length / (most + 1)).cast("int")
    return base + (i >= n - length % n).cast("int")


def name_segments(names: DataFrame, key: list[str], most: Column) -> DataFrame:
    """The index of names(*key, spelled, ...): each name once for each of its most + 1 segments, with the length of the name, the segment's number and its letters."""
    rows = names.withColumn("_size", F.length("spelled")).withColumn("_most", most).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_most"))))
    at, length = (f(F.col("_size"), F.col("_i"), F.col("_most")) for f in (segment_start, segment_length))
    return rows.withColumn("_segment", F.substr("spelled", at + 1, length)).drop("_most")


def value_probes(values: DataFrame, key: list[str], most: Column) -> DataFrame:
    """The places of values(*key, spelled, ...) where a segment of a name within ``most`` edits can stand.

    Of such a name one segment at least stands unchanged, and segment i can have moved by i letters at most and, as what follows it must fit as well, by most - i from the
    place that the lengths' difference moves it to.
    """
    size, most_, name_size, i = F.col("_own"), F.col("_most"), F.col("_size"), F.col("_i")
    rows = values.withColumn("_own", F.length("spelled")).withColumn("_most", most)
    rows = rows.withColumn("_size", F.explode(F.sequence(F.greatest(size - most_, F.lit(0)), size + most_))).withColumn("_i", F.explode(F.sequence(F.lit(0), most_)))
    start, length, moved = segment_start(name_size, i, most_), segment_length(name_size, i, most_), size - name_size
    low = F.greatest(F.lit(0), start - i, start + moved - (most_ - i))
    high = F.least(size - length, start + i, start + moved + (most_ - i))
    rows = rows.withColumn("_length", length).withColumn("_at", F.explode(F.when(low <= high, F.sequence(low, high))))
    return rows.withColumn("_segment", F.substr("spelled", F.col("_at") + 1, F.col("_length"))).drop("_own", "_most", "_at", "_length")


def candidates(values: DataFrame, names: DataFrame, key: list[str], most: Column) -> DataFrame:
    """Pairs of values(*key, value, spelled) and names(*key, canonical_name, frequency, spelled) that share a segment where it may stand: every pair within ``most`` edits is among them."""
    index = name_segments(names.select(*key, "canonical_name", "frequency", F.col("spelled")), key, most).withColumnRenamed("spelled", "_name")
    return value_probes(values.select(*key, "value", "spelled"), key, most).join(index, [*key, "_size", "_i", "_segment"])


def fuzzy_match(values: DataFrame, entities: DataFrame, most: int | Column = 3, spell=c.jamo, key: tuple[str, ...] = ()) -> DataFrame:
    """values(*key, value) with the entity(*key, canonical_name, frequency) that it most likely is: (*key, value, canonical_name, distance).

    A name that differs in spaces only wins, whatever its length; else the one at the smallest letter distance up to ``most`` whose length differs by three at
    most.  Of equals the more frequent wins, then the first by name.  Values are compared without white space around them, and those shorter than two
    characters are no names.  ``most`` may be a column of the key.

    Pairs come from an index over the spelled names (:func:`candidates`), so a value meets the names that share a piece of it, not all of its length.
    """
    key, bare = list(key), lambda x: F.replace(x, F.lit(" "), F.lit(""))
    limit = F.lit(most) if isinstance(most, int) else most
    asked = values.select(*key, "value").distinct().withColumn("_text", c.strip(F.col("value"))).where(F.length("_text") >= SHORTEST)
    spaced = asked.withColumn("_bare", bare(F.col("_text"))).join(entities.select(*key, "canonical_name", "frequency", bare(F.col("canonical_name")).alias("_bare")), [*key, "_bare"])
    same = spaced.groupBy(*key, "value").agg(F.min(by_frequency()).alias("b")).select(*key, "value", F.col("b.canonical_name").alias("canonical_name"), F.lit(0).cast("long").alias("distance"))
    rest = asked.join(same, [*key, "value"], "left_anti")
    pairs = candidates(rest.withColumn("spelled", spell(F.col("_text"))), entities.withColumn("spelled", spell(F.col("canonical_name"))), key, limit)
    pairs = pairs.where(F.abs(F.length(c.strip(F.col("value"))) - F.length("canonical_name")) <= BAND).withColumn("distance", F.levenshtein("spelled", "_name"))
    best = pairs.where(F.col("distance") <= limit).groupBy(*key, "value").agg(F.min(by_frequency("distance")).alias("b"))
    return same.unionByName(best.select(*key, "value", F.col("b.canonical_name").alias("canonical_name"), F.col("b.distance").cast("long").alias("distance")))


def correct(values: DataFrame, entities: DataFrame, variants: DataFrame, most: int | Column = 3, spell=c.jamo, key: tuple[str, ...] = ()) -> DataFrame:
    """(*key, value, corrected, tier) of the distinct values: tier is known, variant, fuzzy or none, and a value of the last stays as it is.

    Values are looked up without white space around them; one that is known, or shorter than two characters, is not touched.
    """
    key = list(key)
    asked = values.select(*key, "value").distinct().withColumn("_text", c.strip(F.col("value")))
    known = entities.select(*key, F.col("canonical_name").alias("_text"), F.lit(True).alias("known")).distinct()
    best = variants.groupBy(*key, F.col("variant_text").alias("_text")).agg(F.min(F.struct((-F.col("occurrence_count")).alias("n"), "canonical_name")).alias("v"))
    rows = asked.join(known, [*key, "_text"], "left").join(best, [*key, "_text"], "left")
    long = F.length("_text") >= SHORTEST
    rows = rows.withColumn("by_variant", F.when(long, F.col("v.canonical_name")))
    fuzzy = fuzzy_match(rows.where("known IS NULL AND by_variant IS NULL"), entities, most, spell, tuple(key))
    rows = rows.join(fuzzy.select(*key, "value", F.col("canonical_name").alias("by_fuzzy")), [*key, "value"], "left")
    tier = F.when(F.col("known"), "known").when(F.col("by_variant").isNotNull(), "variant").when(F.col("by_fuzzy").isNotNull(), "fuzzy").otherwise("none")
    fixed = F.when(F.col("known"), F.col("value")).otherwise(F.coalesce("by_variant", "by_fuzzy", "value"))
    return rows.select(*key, "value", fixed.alias("corrected"), tier.alias("tier"))


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements in the given order; a later one sees what an earlier one wrote."""
    for wrong, right in pairs:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def cell_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Cells that are filled on both sides and differ."""
    both = before.select(*key, F.col("value").alias("original")).join(after.select(*key, F.col("value").alias("corrected")), key)
    return both.where("original <> '' AND corrected <> '' AND original <> corrected")


def hamming_neighbours(hashes: DataFrame, most: int, exact_bands: bool = True) -> DataFrame:
    """hashes(id, h): for each the nearest other within ``most`` bits, smallest id of equals.

    Bits are cut into most + 1 bands: two hashes within the distance agree on one of them, so they meet there.
    """
    n = most + 1
    cut = [64 * i // n for i in range(n + 1)]
    band = F.array(*[F.struct(F.lit(i).alias("k"), F.shiftrightunsigned("h", cut[i]).bitwiseAND((1 << (cut[i + 1] - cut[i])) - 1).alias("v")) for i in range(n)])
    rows = hashes.select("id", "h", F.explode(band).alias("b"))
    left, right = rows.select("b", F.col("id").alias("id"), F.col("h").alias("h")), rows.select("b", F.col("id").alias("other"), F.col("h").alias("h2"))
    pairs = left.join(right, "b").where("id <> other").select("id", "other", F.bit_count(F.col("h").bitwiseXOR(F.col("h2"))).alias("d")).where(F.col("d") <= most)
    return pairs.groupBy("id").agg(F.min(F.struct("d", "other")).alias("m")).select("id", F.col("m.other").alias("nearest"), F.col("m.d").cast("long").alias("distance"))


def latest(events: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Current state of an append-only log: the latest value and how often the key was written."""
    return events.groupBy(*key).agg(F.max_by(value, order).alias(value), F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
