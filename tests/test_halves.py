"""Tables from coordinates, halves of a page, stored lists of tables and reports of cases, each against a plain version."""

import json
import random

import pandas as pd

from gridloom.operators import tables, validate

CELLS = "doc_id long, row_idx int, col_idx int, col_name string, value string"


def frame(rows):
    """{doc: (names, lines)} of cells."""
    out: dict = {}
    for r in rows:
        names, lines = out.setdefault(r["doc_id"], ({}, {}))
        names[r["col_idx"]] = r["col_name"]
        lines.setdefault(r["row_idx"], {})[r["col_idx"]] = r["value"]
    return {d: ([n[k] for k in sorted(n)], [[ls[i].get(k, "") for k in sorted(n)] for i in sorted(ls)]) for d, (n, ls) in out.items()}


def plain_coordinates(boxes):
    """The rule by hand: anchored rows, columns where boxes gather, text between midpoints, the first row as names."""
    tol = int(sum(b["y_max"] - b["y_min"] for b in boxes) / len(boxes) * 0.6)
    rows, anchor = [], None
    for b in sorted(boxes, key=lambda b: (b["y_center"], b["box_id"])):
        if anchor is None or b["y_center"] - anchor > tol:
            rows.append([])
            anchor = b["y_center"]
        rows[-1].append(b)
    k = max(map(len, rows))
    xs = sorted(b["x_center"] for b in boxes)

    def clusters():
        u = sorted(set(xs))
        if len(u) <= k:
            return u + [u[-1] + 100 * (i + 1) for i in range(k - len(u))]
        cuts = sorted(sorted(range(1, len(u)), key=lambda i: (u[i] - u[i - 1], i))[-(k - 1) :]) if k > 1 else []
        return [sum(u[a:b]) / (b - a) for a, b in zip([0, *cuts], [*cuts, len(u)])]

    places = None
    if xs[-1] > xs[0]:
        wide = max(sum(b["x_max"] - b["x_min"] for b in boxes) / len(boxes) * 0.3, 5)
        bins = max(int((xs[-1] - xs[0]) / wide), 2 * k)
        step = (xs[-1] - xs[0]) / bins
        n = [0] * bins
        for x in xs:
            at = int((x - xs[0]) / step)
            if at < bins:
                n[at] += 1
        peaks = sorted(((n[i], xs[0] + i * step + step / 2) for i in range(1, bins - 1) if n[i] and n[i] >= n[i - 1] and n[i] >= n[i + 1]), reverse=True)
        if len(peaks) >= k:
            places = sorted(p for _, p in peaks[:k])
    places = places or clusters()
    mids = [(a + b) / 2 for a, b in zip(places, places[1:])]
    lines = []
    for row in rows:
        line = [""] * k
        for b in sorted(row, key=lambda b: (b["x_center"], b["y_center"], b["box_id"])):
            at = min(sum(b["x_center"] > m for m in mids), k - 1)
            line[at] = f"{line[at]} {b['text']}" if line[at] else b["text"]
        lines.append(line)
    names, data = ([h or f"Col_{i}" for i, h in enumerate(lines[0])], lines[1:]) if len(lines) > 1 else ([str(i) for i in range(k)], lines)
    data = [r for r in data if any(r)]
    kept = [i for i in range(k) if any(r[i] for r in data)]
    return [names[i] for i in kept], [[r[i] for i in kept] for r in data]


def test_tables_from_coordinates(spark):
    rng = random.Random(6)
    boxes = []
    for d in range(60):
        columns = rng.randint(1, 5)
        for r in range(rng.randint(1, 6)):
            for k in range(columns):
                if rng.random() < 0.8 or not (r or k):
                    x, y, w = 120.0 * k + rng.randint(0, 25), 40.0 * r + rng.randint(0, 9), float(rng.randint(10, 60))
                    boxes.append({"doc_id": d, "box_id": len(boxes), "text": f"t{r}.{k}", "x_center": x, "y_center": y, "x_min": x - w, "x_max": x + w, "y_min": y - 8, "y_max": y + 8})
    found = frame(tables.coordinate_tables(spark.createDataFrame(pd.DataFrame(boxes))).collect())
    for d in range(60):
        want = plain_coordinates([b for b in boxes if b["doc_id"] == d])
        assert found.get(d, (want[0] if not want[1] else None, [])) == want, d


def test_grids_come_first(spark):
    boxes = [(d, 3 * r + k, f"{r}{k}", 100.0 * k + 50, 40.0 * r + 20) for d in (1, 2) for r in range(3) for k in range(3)]
    df = spark.createDataFrame([(d, i, t, x, y, x - 9, x + 9, y - 8, y + 8) for d, i, t, x, y in boxes], "doc_id long, box_id int, text string, x_center double, y_center double, x_min double, x_max double, y_min double, y_max double")
    grid = spark.createDataFrame([(1, r, k, 100.0 * k, 100.0 * k + 99, 40.0 * r, 40.0 * r + 39) for r in range(4) for k in range(4)] + [(2, r, 0, 0.0, 400.0, 40.0 * r, 40.0 * r + 39) for r in range(3)], "doc_id long, row int, col int, gx_min double, gx_max double, gy_min double, gy_max double")
    rows = tables.grid_or_coordinates(df, grid).collect()
    assert {(r["doc_id"], r["by"]) for r in rows} == {(1, "grid"), (2, "coordinates")}
    assert frame(rows)[1] == frame(rows)[2] == (["00", "01", "02"], [["10", "11", "12"], ["20", "21", "22"]])


def test_halves_like_pandas(spark):
    rng = random.Random(7)
    docs, left, right = {}, [], []
    for d in range(40):
        names = rng.sample(["회사명", "b", "c", "d", "e"], rng.randint(1, 3))
        others = rng.sample(["회사명", "b", "c", "d", "e", "f"], rng.randint(1, 4))
        table = lambda names, n: pd.DataFrame([[rng.choice(["x", "y", "z"]) if k == 0 else str(rng.randrange(99)) for k in range(len(names))] for _ in range(n)], columns=names)
        a, b = table(names, rng.randint(0, 4)), table(others, rng.randint(0, 4))
        docs[d] = (a, b)
        for df, rows in ((a, left), (b, right)):
            rows += [(d, i, k, df.columns[k], df.iloc[i, k]) for i in range(len(df)) for k in range(len(df.columns))]
    found = frame(tables.merge_halves(spark.createDataFrame(left, CELLS), spark.createDataFrame(right, CELLS)).collect())
    for d, (a, b) in docs.items():
        new = [c for c in b.columns if c not in set(a.columns)]
        if a.empty or b.empty or not new:
            want = b if a.empty else a
        elif a.columns[0] in b.columns:
            want = pd.merge(a, b[[a.columns[0], *new]], on=a.columns[0], how="left").fillna("")
        else:
            n = min(len(a), len(b))
            want = pd.concat([a.iloc[:n].reset_index(drop=True), b[new].iloc[:n].reset_index(drop=True)], axis=1)
        if len(want):
            assert found[d] == (list(want.columns), want.values.tolist()), d
        else:
            assert d not in found


def test_stored_lists_of_tables(spark):
    results = {
        "one": {"metadata": {"title": "T"}, "headers": ["a", "b"], "rows": [["1", "2"], ["3"]]},
        "list": [{"headers": [], "rows": [["x"]]}, {"headers": ["a"], "rows": [["1", "beyond"]], "metadata": {"title": "second"}}, {"headers": ["p", "q"], "rows": [["5"], ["6", "7"]], "metadata": {"title": "third"}}, {"headers": ["h"]}],
        "empty": [], "none": {"headers": ["a"], "rows": []}, "text": "no json",
    }
    cache = spark.createDataFrame([(k, json.dumps(v) if not isinstance(v, str) else v) for k, v in results.items()] + [("null", None)], "k string, result string")
    found = sorted(tuple(r) for r in tables.stored_tables(cache, "k", "result").collect())
    assert found == sorted([("one", 0, 0, 0, "a", "1"), ("one", 0, 0, 1, "b", "2"), ("one", 0, 1, 0, "a", "3"), ("one", 0, 1, 1, "b", ""), ("list", 0, 0, 0, "a", "1"), ("list", 1, 0, 0, "p", "5"), ("list", 1, 1, 0, "p", "6")])
    titles = {r["k"]: r["title"] for r in tables.stored_metadata(cache, "k", "result").collect()}
    assert titles == {"one": "T", "list": "second", "empty": "", "none": "", "text": "", "null": ""}


def test_reports_of_cases(spark):
    kind = "case string, row_idx int, label string, v1 string, v2 string"
    expected = [("a", 0, "자산, 총계", "1,000", "x"), ("a", 1, "부채", "2", "y"), ("a", 2, "자본", "3", "z"), ("b", 0, "r", "1", "1")] + [("c", i, f"L{i}", "1", "2") for i in range(15)]
    actual = [("a", 5, "자산총계", "1000", "x"), ("a", 6, "부채", "2", "no"), ("a", 7, "부채", "2", "y"), ("b", 1, "r", "1", "1")] + [("c", i, f"L{i}", "1", "no") for i in range(12)]
    found = {r["case"]: r.asDict(True) for r in validate.case_reports(spark.createDataFrame(expected, kind), spark.createDataFrame(actual, kind), ["label", "v1", "v2"]).collect()}
    a = found["a"]
    assert (a["expected_rows"], a["row_hits"], a["exact_row_hits"], a["cell_matches"], a["total_cells"]) == (3, 2, 1, 5, 9)
    assert (a["row_recall"], a["exact_row_accuracy"], a["cell_accuracy"]) == (0.6667, 0.3333, 0.5556)
    assert a["sample_mismatches"] == [{"label": "부채", "reason": "differs", "expected": ["부채", "2", "y"], "actual": ["부채", "2", "no"]}, {"label": "자본", "reason": "row_not_found", "expected": None, "actual": None}]
    assert found["b"]["sample_mismatches"] == [] and found["b"]["cell_accuracy"] == 1.0
    reasons = [m["reason"] for m in found["c"]["sample_mismatches"]]
    assert reasons == ["differs"] * 10 + ["row_not_found"] * 3  # what differs is listed up to ten, what is missing always


def test_overlap_with_many_patterns(spark):
    cells = spark.createDataFrame([(1, 0, k, n, "") for k, n in enumerate(["a", " b", "c"])] + [(2, 0, 0, "z", "")], CELLS)
    patterns = spark.createDataFrame([(["a", "b", "q", "r"],), (["c", "c"],), (["b", "x"],), ([],)], "headers array<string>")
    found = {r["doc_id"]: r["overlap"] for r in tables.header_overlap(cells, patterns).collect()}
    assert found == {1: 1.0, 2: 0.0}
    assert tables.header_overlap(cells, patterns.limit(0)).count() == 0
