"""Tiers of recognition: who is asked, how often, and whose answer counts."""

import datetime
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from gridloom.operators.running import running_total
from gridloom.sources import tiers

DAY = datetime.date(2026, 1, 5)


def counting(folder, name, answer):
    """An engine that leaves a file for each call; ``answer`` of the content's number, an exception is raised."""

    def make():
        def engine(content, kind):
            n = int(content)
            with open(os.path.join(folder, f"{name}-{n}-{uuid.uuid4().hex}"), "w"):
                pass
            got = answer(n)
            if isinstance(got, Exception):
                raise got
            return got

        return engine

    return make


def calls(folder, name):
    return sorted(int(f.split("-")[1]) for f in os.listdir(folder) if f.startswith(f"{name}-"))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(f"d{i:03d}", str(i).encode(), "image", 100 - i) for i in range(60)], "doc_id string, content binary, kind string, seq int").repartition(7)


def test_tiers_see_only_what_is_left(spark, docs, tmp_path):
    seen = tmp_path / "calls"
    seen.mkdir()
    local = counting(seen, "local", lambda n: (0.9, f"local {n}") if n % 3 == 0 else (n / 100, f"poor {n}") if n % 3 == 1 else None)
    cloud = counting(seen, "cloud", lambda n: ValueError("refused") if n % 5 == 0 else (0.7, f"cloud {n}"))
    last = counting(seen, "last", lambda n: (0.1, f"last {n}"))
    ladder = tiers.Ladder(spark, str(tmp_path / "log"), [tiers.Tier("local", local, 0.8), tiers.Tier("cloud", cloud, 0.0, limit=20, reserve=5), tiers.Tier("last", last, 0.95, limit=3)])
    first = {r["doc_id"]: (r["tier"], r["answer"]) for r in ladder.climb(docs, DAY, ["seq", "doc_id"]).collect()}
    open_ = [n for n in range(60) if n % 3]
    order = sorted(open_, key=lambda n: 100 - n)
    assert calls(seen, "local") == list(range(60))
    assert calls(seen, "cloud") == sorted(order[:15])
    after = [n for n in order if n not in order[:15] or n % 5 == 0]
    assert calls(seen, "last") == sorted(after[:3])
    for n in range(60):
        by_last = n in after[:3]
        want = ("local", f"local {n}") if n % 3 == 0 else ("cloud", f"cloud {n}") if n in order[:15] and n % 5 else None
        if want is None:
            poor = n % 3 == 1
            want = ("local", f"poor {n}") if poor and (not by_last or n / 100 >= 0.1) else ("last", f"last {n}") if by_last else None
        assert first.get(f"d{n:03d}") == want, n

    again = {r["doc_id"]: (r["tier"], r["answer"]) for r in ladder.climb(docs, DAY, ["seq", "doc_id"]).collect()}
    assert again == first and calls(seen, "local") == list(range(60)) and len(calls(seen, "cloud")) == 15  # the day's quota is used up
    ladder.climb(docs, DAY + datetime.timedelta(1), ["seq", "doc_id"]).count()
    asked = calls(seen, "cloud")
    assert asked == sorted(order[:30]) and len(set(asked)) == len(asked)
    for _ in range(2):
        ladder.climb(docs, DAY + datetime.timedelta(2), ["seq", "doc_id"]).count()
    assert calls(seen, "cloud") == sorted(order)
    per_day = {(r["tier"], r["day"]): r["n"] for r in ladder.log().groupBy("tier", "day").agg(F.sum("calls").alias("n")).collect()}
    assert all(n <= {"cloud": 15, "last": 3}.get(t, 60) for (t, _), n in per_day.items())


def test_a_run_that_broke_off_is_continued(spark, docs, tmp_path):
    seen = tmp_path / "calls"
    seen.mkdir()
    cheap = tiers.Tier("cheap", counting(seen, "cheap", lambda n: (0.9, "a") if n < 30 else None), 0.5)
    dear = tiers.Tier("dear", counting(seen, "dear", lambda n: (0.9, "b")), 0.5, limit=100, calls=3)
    tiers.Ladder(spark, str(tmp_path / "log"), [cheap, dear]).ask(docs, 0, DAY, ["doc_id"])  # and nothing after it
    found = tiers.Ladder(spark, str(tmp_path / "log"), [cheap, dear]).climb(docs, DAY).collect()
    assert len(calls(seen, "cheap")) == 60 and calls(seen, "dear") == list(range(30, 60)) and len(found) == 60
    short = tiers.Ladder(spark, str(tmp_path / "other"), [tiers.Tier("dear", counting(seen, "short", lambda n: (0.9, "b")), 0.5, limit=100, calls=3)])
    short.climb(docs, DAY).count()
    assert calls(seen, "short") == list(range(33))  # 33 documents of three calls each


def test_no_documents(spark, docs, tmp_path):
    seen = tmp_path / "calls"
    seen.mkdir()
    ladder = tiers.Ladder(spark, str(tmp_path / "log"), [tiers.Tier("one", counting(seen, "one", lambda n: (1.0, "x")), limit=4)])
    assert ladder.climb(docs.limit(0), DAY).count() == 0 and calls(seen, "one") == []
    assert ladder.log().count() == 0 and ladder.left(ladder.tiers[0], DAY) == 4


@pytest.mark.parametrize("ranges", [1, 3, 9])
def test_running_total(spark, ranges):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randint(0, 9), i, rng.choice([None, 1, 2, 5])) for i in range(500)]
    found = running_total(spark.createDataFrame(rows, "k string, o int, i int, n long").repartition(5), ["k"], ["o", "i"], "n", "total", ranges)
    want, sums = {}, {}
    for k, _, i, n in sorted(rows, key=lambda r: (r[1], r[2])):
        sums[k] = want[i] = sums.get(k, 0) + (n or 0)
    assert {r["i"]: r["total"] for r in found.collect()} == want


def test_accounts_with_quotas_of_their_own(spark):
    rows = [(f"d{i}", "ab"[i % 2], i, 2) for i in range(20)]
    left = spark.createDataFrame([("a", 7), ("b", 0)], "account string, left long")
    found = tiers.allotted(spark.createDataFrame(rows, "doc_id string, account string, seq int, calls int"), left, ["seq"], key=["account"])
    assert sorted(r["doc_id"] for r in found.collect()) == ["d0", "d2", "d4"]
