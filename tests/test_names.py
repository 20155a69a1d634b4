"""Corrections of names and the start of spread columns, by hand and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import cells as c
from gridloom.operators import entities, tables


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def names(spark, rows):
    return spark.createDataFrame(rows, "canonical_name string, frequency long")


#: value, what it becomes (None: nothing), by the rules: spaces first and without a limit of length, then a band of three characters and three letters.
TRUTH = [
    ("삼성생명abcd", None), ("A B C D E F G", "ABCDEFG"), ("ABCDEFG", "ABCDEFG"), ("홍국증권", "흥국증권"), (" 흥국증귄 ", "흥국증권"), ("흥", None), ("", None), ("삼성생명a", "삼성생명"), ("삼성생명abc", "삼성생명"),
    ("운용 1팀", "운용1팀"), ("운용일팀", "운용1팀"), ("가나다라", "가나다마"), ("zzzzzz", None),
]


def test_names_by_hand(spark):
    known = names(spark, [("삼성생명", 5), ("ABCDEFG", 1), ("흥국증권", 9), ("운용1팀", 2), ("가나다마", 7), ("가나다바", 3)])
    found = {r["value"]: r["canonical_name"] for r in entities.fuzzy_match(spark.createDataFrame([(v,) for v, _ in TRUTH], "value string"), known).collect()}
    assert {v: found.get(v) for v, _ in TRUTH} == dict(TRUTH)
    variants = spark.createDataFrame([("흥국증귄", "한국증권", 4), ("흥", "흥국증권", 9), ("삼성생명", "ABCDEFG", 1)], "variant_text string, canonical_name string, occurrence_count long")
    rows = entities.correct(spark.createDataFrame([(v,) for v in (" 흥국증귄 ", "흥", " 삼성생명", "zz", "홍국증권")], "value string"), known, variants).collect()
    assert {r["value"]: (r["corrected"], r["tier"]) for r in rows} == {" 흥국증귄 ": ("한국증권", "variant"), "흥": ("흥", "none"), " 삼성생명": (" 삼성생명", "known"), "zz": ("zz", "none"), "홍국증권": ("흥국증권", "fuzzy")}


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4])
def test_index_against_brute_force(spark, most):
    rng = random.Random(most)
    text = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    known = sorted({text(rng.randint(1, 14)).strip() or "a" for _ in range(150)})
    frequency = {k: rng.randint(1, 4) for k in known}

    def edited(s):
        s = list(s)
        for _ in range(rng.randint(0, most + 1)):
            at = rng.randint(0, len(s))
            rng.choice([lambda: s.insert(at, rng.choice("abc")), lambda: s.pop(at) if at < len(s) else None, lambda: s.__setitem__(at, "b") if at < len(s) else None])()
        return "".join(s)

    values = sorted({edited(rng.choice(known)) for _ in range(200)} | {text(rng.randint(0, 15)) for _ in range(100)})
    found = {r["value"]: (r["canonical_name"], r["distance"]) for r in entities.fuzzy_match(spark.createDataFrame([(v,) for v in values], "value string"), names(spark, list(frequency.items())), most, lambda x: x).collect()}
    for v in values:
        s, want = v.strip(), None
        if len(s) >= 2:
            same = [k for k in known if k.replace(" ", "") == s.replace(" ", "")]
            near = [(distance(s, k), -frequency[k], k) for k in known if abs(len(s) - len(k)) <= 3]
            near = [x for x in near if x[0] <= most]
            if same:
                want = (min(same, key=lambda k: (-frequency[k], k)), 0)
            elif near:
                want = (min(near)[2], min(near)[0])
        assert found.get(v) == want, v


def test_index_looks_at_few_pairs(spark):
    """Of 20,000 values and 5,000 names, a value meets a handful of names, and only those within reach are more than a share of their letters."""
    rng = random.Random(1)
    syllable = lambda: chr(0xAC00 + rng.randrange(11172))
    known = ["".join(syllable() for _ in range(rng.randint(3, 8))) for _ in range(5000)]
    values = [("".join(syllable() if rng.random() < 0.2 else ch for ch in rng.choice(known)),) for _ in range(20_000)]
    spelled = lambda d, name: d.withColumn("spelled", c.jamo(F.col(name)))
    pairs = entities.candidates(spelled(spark.createDataFrame(values, "value string").distinct(), "value"), spelled(names(spark, [(k, 1) for k in known]), "canonical_name"), [], F.lit(3))
    assert pairs.count() < 20 * 20_000  # of 100 million


def test_limits_by_kind(spark):
    cells = spark.createDataFrame([("d", 0, 0, "회사명", "abcdxxxx"), ("d", 0, 1, "부서명", "deskxxx"), ("d", 0, 3, "계정", "acctxxx"), ("d", 1, 3, "계정", "acctxx"), ("d", 1, 7, "x", "acctx"), ("d", 1, 0, "회사명", "")], "doc_id string, row_idx int, col_idx int, col_name string, value string")
    known = spark.createDataFrame([("company", "abcd", 1), ("department", "desk", 1), ("account", "acct", 1)], "kind string, canonical_name string, frequency long")
    none = spark.createDataFrame([], "kind string, variant_text string, canonical_name string, occurrence_count long")
    found = {(r["row_idx"], r["col_idx"]): (r["value"], r["tier"]) for r in tables.correct_names(cells, known, none).collect()}
    assert found == {(0, 0): ("abcdxxxx", "none"), (0, 1): ("desk", "fuzzy"), (0, 3): ("acctxxx", "none"), (1, 3): ("acct", "fuzzy"), (1, 7): ("acctx", None), (1, 0): ("", None)}
    plan = tables.correct_names(cells, known, none)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize(
    ("heads", "start"),
    [
        (["-100", "a"], 0), (["회사명", "Col_1", "총참여금액", "Col_3"], 3), (["a", "4.078% (-50)", "-3"], 1), (["a", "+66.5%"], 1), (["a", "(+3) x"], 1), (["a", "(3)b)"], None), (["a", "()"], None), (["a", "1,000"], None),
        (["참여금액", "총참여"], 1), (["a", "b"], None), (["총참여금액", "b", "(1.5)"], 2), (["", " - 5"], None), (["+-+7"], 0), (["a (1) (b)"], None), (["5(a)"], None),
    ],
)
def test_where_spreads_begin(spark, heads, start):
    cells = spark.createDataFrame([("d", 0, k, h, "") for k, h in enumerate(heads)], "doc_id string, row_idx int, col_idx int, col_name string, value string")
    assert tables.spread_start(cells).collect()[0]["start_col"] == start
