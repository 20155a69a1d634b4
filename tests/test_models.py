"""Votes over whole tables against a truth table and their plan; the text model's sparse rows, saved form and edges."""

import math

import pytest

from gridloom.operators import classify, tables
from gridloom.plans import flows  # noqa: F401  registers queries
from gridloom.plans.queries import QUERIES


def runs_of(spark, listed):
    """Tables(doc, run, header, rows) as cells."""
    cells = [(d, u, i, j, h[j], v) for d, u, h, rows in listed for i, row in enumerate(rows) for j, v in enumerate(row)]
    return spark.createDataFrame(cells, "doc_id long, run_id int, row_idx int, col_idx int, col_name string, value string")


def test_consensus_by_hand(spark):
    h = ["a", "b"]
    listed = [
        (1, 0, h, [["x", "1"], ["y", "2"], ["z", "3"]]),  # another height than the two below: takes no part
        (1, 1, h, [["p", " 7 "], ["q", None]]),
        (1, 2, ["a", "c"], [["p", "8"], ["q", None]]),
        (2, 0, h, [["cat", "kitten"]]),  # no majority: characters of the most frequent length
        (2, 1, ["A", "b"], [["cot", "dog"]]),
        (2, 2, ["A", "b"], [["bat", "cow"]]),
        (3, 5, ["n"], [[""]]),
        (4, 0, h, [["u", "v"]]),  # equally frequent shapes: the earlier run's
        (4, 1, h, [["u", "w"], ["", ""]]),
    ]
    found = {tuple(r)[:3]: tuple(r)[3:] for r in tables.consensus_tables(runs_of(spark, listed)).collect()}
    assert found == {
        (1, 0, 0): ("a", "p"), (1, 0, 1): ("b", "7"), (1, 1, 0): ("a", "q"), (1, 1, 1): ("b", None),
        (2, 0, 0): ("A", "cat"), (2, 0, 1): ("b", "dog"), (3, 0, 0): ("n", ""), (4, 0, 0): ("a", "u"), (4, 0, 1): ("b", "v"),
    }
    assert tables.consensus_tables(runs_of(spark, listed).limit(0)).count() == 0


def test_consensus_plan(spark):
    plan = QUERIES["consensus_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 6 and plan.count("Exchange hash") <= 9


@pytest.fixture(scope="module")
def labelled(spark):
    words = {"fruit": ["apple", "plum", "cherry"], "metal": ["iron", "copper", "zinc"], "tree": ["oak", "willow", "birch"]}
    rows = [(i, " ".join(words[k][(i + j) % 3] for j in range(3 + i % 4)), k) for i, k in enumerate(list(words) * 20)]
    return spark.createDataFrame([*rows, (1000, "unlabelled apple", None)], "doc_id long, text string, label string")


def test_model_saved_and_loaded(spark, labelled, tmp_path):
    model = classify.Classifier.fit(labelled, "label", features=200)
    new = spark.createDataFrame([(1, "copper and iron"), (2, "Willow oak"), (3, "cherry"), (4, "!"), (5, ""), (6, None)], "doc_id long, text string")
    first = {r["doc_id"]: (r["predicted"], r["confidence"]) for r in model.predict(new).collect()}
    assert [first[i][0] for i in (1, 2, 3)] == ["metal", "tree", "fruit"] and len(first) == 6
    assert all(1 / 3 - 1e-9 <= c <= 1 for _, c in first.values())
    model.save(spark, str(tmp_path / "model"))
    model.save(spark, str(tmp_path / "model"))
    again = classify.Classifier.load(spark, str(tmp_path / "model"))
    second = {r["doc_id"]: (r["predicted"], r["confidence"]) for r in again.predict(new).collect()}
    assert {i: p for i, (p, _) in second.items()} == {i: p for i, (p, _) in first.items()}
    assert {i: c for i, (_, c) in second.items()} == pytest.approx({i: c for i, (_, c) in first.items()})


def test_entries_are_the_texts_own(spark, labelled):
    """Rows hold as many numbers as a text has known n-grams, whatever the vocabulary, and have length 1."""
    model = classify.Classifier.fit(labelled, "label", features=200)
    rows = model.vectors(spark.createDataFrame([(1, "iron"), (2, "iron iron"), (3, "~")], "doc_id long, text string")).collect()
    per = {r["doc_id"]: [(e["i"], e["w"]) for e in r["entries"]] for r in rows}
    assert set(per) == {1, 2} and 0 < len(per[1]) <= 12 and [i for i, _ in per[1]] == sorted(i for i, _ in per[2])
    assert all(math.isclose(sum(w * w for _, w in l), 1) for l in per.values())


@pytest.mark.parametrize("count", [0, 1, 2])
def test_few_classes(spark, labelled, count):
    docs = labelled.where(f"label IN {('none', 'none') if count == 0 else ('fruit', 'fruit') if count == 1 else ('fruit', 'tree')}")
    if count == 0:
        with pytest.raises(ValueError):
            classify.Classifier.fit(docs, "label")
        return
    found = classify.Classifier.fit(docs, "label", features=100).predict(docs.select("doc_id", "text", "label")).join(docs, "doc_id").collect()
    assert all(r["predicted"] == r["label"] for r in found) and all(r["confidence"] > 0.5 for r in found)
