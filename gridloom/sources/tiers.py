"""Recognition in tiers: cheap engines first, dear ones only for what is left, and never more calls than a quota allows.

Every attempt is a row of a log, (doc_id, tier, day, calls, ok, confidence, answer, error), kept in a folder by tier and run.  A tier

1. sees only documents that no earlier tier has answered well enough and that it has not been asked about before (two anti-joins with the log),
2. is allotted those of them, in their order, whose calls fit into what is left of the day's quota (a running total over all waiting documents),
3. writes its attempts before the next tier looks at what is left.

So a run that breaks off is continued by running it again: finished tiers are in the log, and no document is shown to a tier twice on
the tier's account.  (Spark itself may repeat the task of a lost executor before its attempts are written.)  Every call counts for the quota, whether it gave
an answer or not; a quota is met by never allotting more, not by stopping in the middle.

The answer of a document is that of the first tier whose confidence reached its limit; without one, the most confident of the others
(the earlier tier of equals), so a poor local reading is better than none.  A document without any answer is absent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running_total

#: What an engine gives for one document: a confidence from 0 to 1 and the answer as text, or None.
Engine = Callable[[bytes, str], tuple[float, str] | None]
ATTEMPTS = "doc_id string, day date, calls int, ok boolean, confidence double, answer string, error string"


@dataclass(frozen=True)
class Tier:
    """An engine and its terms.  ``make`` runs once in each Python worker."""

    name: str
    make: Callable[[], Engine]
    least: float = 0.0  # the confidence from which an answer needs no further tier
    limit: int | None = None  # calls a day; none: no quota
    reserve: int = 0  # of these, calls that are kept back
    calls: int = 1  # calls that one document takes, such as runs of a vote


def allotted(waiting: DataFrame, left: DataFrame | int, order: list[str], calls: str = "calls", key: list[str] | None = None) -> DataFrame:
    """Those of ``waiting`` whose calls fit into what is left: one number, or ``left(*key, left)`` for accounts with quotas of their own.

    Documents are taken in ``order`` until one does not fit; it and all after it wait.
    """
    total = running_total(waiting, key or [], order, calls, "_total")
    if key:
        return total.join(left, key).where("_total <= left").drop("_total", "left")
    return total.where(F.col("_total") <= F.lit(left)).drop("_total")


def chosen(attempts: DataFrame, tiers: DataFrame) -> DataFrame:
    """(doc_id, tier, confidence, answer): one answer for each document of attempts(doc_id, tier, ok, confidence, answer); tiers(tier, rank, least)."""
    rows = attempts.where("ok").join(F.broadcast(tiers), "tier")  # a fixed list of a few engines
    enough = F.col("confidence") >= F.col("least")
    place = F.struct((~enough).alias("poor"), F.when(enough, F.lit(0.0)).otherwise(-F.col("confidence")).alias("by"), F.col("rank").alias("rank"), "tier", "confidence", "answer")
    return rows.groupBy("doc_id").agg(F.min(place).alias("b")).select("doc_id", "b.tier", "b.confidence", "b.answer")


class Ladder:
    """The tiers over a folder with the log of their attempts."""

    def __init__(self, spark: SparkSession, folder: str, tiers: list[Tier]) -> None:
        self.spark, self.folder, self.tiers = spark, folder, tiers

    def terms(self) -> DataFrame:
        return self.spark.createDataFrame([(t.name, i, float(t.least)) for i, t in enumerate(self.tiers)], "tier string, rank int, least double")

    def log(self) -> DataFrame:
        """All attempts so far, with their tier."""
        files = self.spark.read.schema(f"{ATTEMPTS}, tier string, run string").option("basePath", self.folder)
        try:
            return files.parquet(f"{self.folder}/tier=*")
        except Exception as e:  # no attempt yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{ATTEMPTS}, tier string, run string")

    def left(self, tier: Tier, day) -> int | None:
        """What the tier may still be asked on that day."""
        if tier.limit is None:
            return None
        used = self.log().where((F.col("tier") == tier.name) & (F.col("day") == F.lit(day))).agg(F.sum("calls")).first()[0] or 0
        return max(0, tier.limit - tier.reserve - used)

    def waiting(self, docs: DataFrame, place: int) -> DataFrame:
        """Documents that no earlier tier has answered well enough and that this one has not been asked about."""
        log, tier = self.log(), self.tiers[place]
        done = log.join(F.broadcast(self.terms()), "tier").where(f"rank < {place} AND ok AND confidence >= least OR rank = {place}").select("doc_id").distinct()
        return docs.join(done, "doc_id", "left_anti").withColumn("calls", F.lit(tier.calls))

    def ask(self, docs: DataFrame, place: int, day, order: list[str]) -> None:
        """One tier: its allotted documents are recognised and logged."""
        tier = self.tiers[place]
        waiting = self.waiting(docs, place)
        left = self.left(tier, day)
        if left is not None:
            turn = allotted(waiting.select("doc_id", "calls", *[c for c in order if c != "doc_id"]), left, order).select("doc_id")
            waiting = waiting.join(turn, "doc_id", "left_semi")
        calls, make = tier.calls, tier.make

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            engine = make()
            for batch in batches:
                rows = []
                for doc_id, content, kind in zip(batch["doc_id"], batch["content"], batch["kind"], strict=True):
                    try:
                        got, error = engine(bytes(content), kind), None
                    except Exception as e:  # an engine that fails leaves the document to the next tier
                        got, error = None, f"{type(e).__name__}: {e}"
                    rows.append((doc_id, day, calls, got is not None, got and float(got[0]), got and got[1], error))
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in ATTEMPTS.split(", ")])

        attempts = waiting.select("doc_id", "content", "kind").mapInPandas(run, ATTEMPTS)
        attempts.write.parquet(f"{self.folder}/tier={tier.name}/run={uuid4().hex}")

    def climb(self, docs: DataFrame, day, order: list[str] | None = None) -> DataFrame:
        """Answers for docs(doc_id, content, kind): all tiers in turn, then the choice among everything that the log has for these documents.

        ``order`` says who is served first where a quota is short; the id by default.
        """
        for place in range(len(self.tiers)):
            self.ask(docs, place, day, order or ["doc_id"])
        mine = self.log().join(docs.select("doc_id"), "doc_id", "left_semi")
        return chosen(mine, self.terms())
