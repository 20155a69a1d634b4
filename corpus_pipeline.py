"""From raw documents to a tokenised training mix, in five stages.

Each stage takes the documents that its predecessor kept and returns documents; the last returns one
row for each document of the mix, repeats included, with its token count and digests.  Stages that drop or
repeat documents name the rows and work by that name, so rows of a null or a repeated id count one by one.
Tables that a stage makes on its way are deleted once its documents are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, langid, mixing, pieces, simhash
from gridloom.llm.common import new_path, numbered, scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language identification rejects."""
    return langid.accepted(docs, langid.fit(docs, F.lit(True)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one of each group of texts that are equal but for white space: the longest, then the smallest id, null last."""
    return exact_dedup.without_copies(numbered(docs), "_row").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_one(docs, width=5, similarity=0.8).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it; equal rows are documents of their own."""
    taken = mixing.mixed(numbered(docs), row_col="_row").where("_times > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return pieces.encode_decode(docs, pieces.Vocabulary.load(pieces.default_model()))


STAGES = [("language ID", known_language), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies), ("mixing sources", mixture), ("SentencePiece", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name.split()[0]}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
