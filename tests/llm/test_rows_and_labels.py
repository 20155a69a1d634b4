"""Rows that share an id or have none, and licences held against each other."""

import hashlib
from collections import Counter

import pytest

from gridloom.llm import licenses, mixing, suffix_dedup, window_index

LEAST = -(1 << 63)


def noise(n, seed):
    import random

    return "".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz", k=n))


def digest(b):
    return hashlib.sha256(b).hexdigest()


PASSAGE = noise(600, 1)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, PASSAGE), (1, noise(600, 2)), (2, PASSAGE)],
        [(None, PASSAGE), (LEAST, noise(600, 3)), (None, noise(700, 4) + PASSAGE), (LEAST, None), (3, PASSAGE[:450]), (3, "")],
        [(7, PASSAGE)] * 3 + [(7, noise(500, 5)), (8, PASSAGE * 2)],
    ],
)
def test_suffixes_by_row(spark, rows):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    want = []
    for (i, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        want.append((str(i), len(b), sum(gone), digest(bytes(x for x, g in zip(b, gone) if not g))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((str(r["doc_id"]), r["n_units"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert found == sorted(want)


def words(n, seed):
    return " ".join(f"w{seed}x{k}" for k in range(n))


def plain_windows(rows):
    """(id, words, removed words, digest) of rows in their order."""
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        out.append((str(i), len(w), sum(gone), digest(b" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


def found_windows(df):
    return sorted((str(r["doc_id"]), r["n_units"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_windows_by_row(spark):
    """Equal texts stand apart from the others of their id, so every order within the id gives the same multiset."""
    p = words(40, 0)
    for rows in (
        [(1, p), (2, p), (2, words(40, 1))],
        [(None, p), (None, words(30, 2)), (LEAST, words(25, 3) + " " + p), (LEAST, words(50, 4)), (5, p), (5, None), (5, "")],
        [(3, p)] * 4 + [(4, words(33, 5)), (4, words(33, 6))],
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert found_windows(window_index.window_dedup(docs, batches=2)) == plain_windows(rows), rows


def test_history_with_the_same_ids(spark, tmp_path):
    p = words(40, 0)
    kind = "doc_id long, text string"
    old, new = spark.createDataFrame([(1, p), (2, words(30, 1))], kind), spark.createDataFrame([(1, words(30, 2)), (1, p), (2, words(30, 1)), (2, words(30, 3))], kind)
    index = window_index.FingerprintIndex(spark, str(tmp_path / "index"), buckets=2)
    window_index.window_dedup(old, batches=1, index=index).count()
    found = [(r["doc_id"], r["n_units"], r["n_removed"]) for r in window_index.window_dedup(new, batches=1, index=index, history=old).collect()]
    assert sorted(found) == [(1, 30, 0), (1, 40, 40), (2, 30, 0), (2, 30, 30)]
    index.drop()


def test_mixing_rows_without_an_id(spark):
    rows = [(None, "one two three", "a")] * 60 + [(4, "one two three", "a")] * 40 + [(k, "four five", "b") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = mixing.mix(docs).collect()
    for source_size in {r["source_size"] for r in found}:
        own = [r for r in found if r["source_size"] == source_size]
        assert abs(sum(r["size"] * r["times"] for r in own) - own[0]["target"]) <= 1.5 and max(r["times"] for r in own) <= 2


# -- licences ----------------------------------------------------------------------------------------

WARRANTY = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
AUTHORS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
HEAD, SOURCE, BINARY, NAMES = licenses.BSD_HEAD + ":\n", licenses.BSD_SOURCE, licenses.BSD_BINARY, licenses.BSD_NAMES
ACK = licenses.BSD_ADVERTISING + ": This product includes software developed by the organization."
MIT = licenses.MIT_GRANT + licenses.MIT_RIGHTS
NOTICE = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
WHOLE = {
    "bsd-2": (HEAD + f"1. {SOURCE}\n2. {BINARY}\n" + AUTHORS, "bsd-2-clause"),
    "bsd-2 with stars": (HEAD + f"* {SOURCE}\n\n* {BINARY}\n\n" + AUTHORS, "bsd-2-clause"),
    "bsd-3": (HEAD + f"1. {SOURCE}\n2. {BINARY}\n3. {NAMES}\n" + AUTHORS, "bsd-3-clause"),
    "bsd-3 with stars": (HEAD + f" * {SOURCE}\n * {BINARY}\n * {NAMES}\n" + AUTHORS, "bsd-3-clause"),
    "bsd-4": (HEAD + f"1. {SOURCE}\n2. {BINARY}\n3. {ACK}\n4. {NAMES}\n" + AUTHORS, "bsd-4-clause"),
    "bsd, cut short": (HEAD, "bsd"),
    "mit": (MIT + licenses.MIT_CONDITIONS + WARRANTY, "mit"),
    "mit, cut short": (licenses.MIT_GRANT + ", and so on", "mit"),
    "mit-0": (MIT + "." + WARRANTY, "mit-0"),
    "mit-0 with title": ("MIT No Attribution\n\nCopyright 2020\n\n" + MIT + ".\n\n" + WARRANTY, "mit-0"),
    "isc": (licenses.ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + WARRANTY, "isc"),
    "0bsd": (licenses.ISC_GRANT + '. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE', "0bsd"),
    "gpl-3 notice": (NOTICE.format("program", "General Public License", "3"), "gpl,gpl-3"),
    "gpl-2 notice": (NOTICE.format("program", "General Public License", "2"), "gpl,gpl-2"),
    "lgpl-3 notice": (NOTICE.format("library", "Lesser General Public License", "3"), "gpl,lgpl-3"),
    "lgpl-2.1 notice": (NOTICE.format("library", "Lesser General Public License", "2.1"), "gpl,lgpl-2.1"),
    "agpl-3 notice": (NOTICE.format("program", "Affero General Public License", "3"), "agpl-3,gpl"),
    "gpl-3 head": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright", "gpl,gpl-3"),
    "gpl-2 head": ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", "gpl,gpl-2"),
    "lgpl-3 head": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gpl,lgpl-3"),
    "lgpl-2.1 head": ("GNU LESSER GENERAL PUBLIC LICENSE\n\tVersion 2.1, February 1999", "gpl,lgpl-2.1"),
    "agpl-3 head": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "agpl-3,gpl"),
    "apache head": ("Apache License\nVersion 2.0, January 2004", "apache,apache-2.0"),
    "spdx one": ("// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;", "lgpl-2.1"),
    "spdx either": ("# spdx-license-identifier: (MIT OR Apache-2.0) AND BSD-2-Clause", "apache-2.0,bsd-2-clause,mit"),
    "spdx with": ("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 */", "gpl-2"),
    "spdx mit-0": ("SPDX-License-Identifier: MIT-0", "mit-0"),
    "spdx unknown": ("SPDX-License-Identifier: see the file", ""),
    "spdx elsewhere": ("We discuss SPDX and the mit in this text", ""),
}


def test_licences_against_each_other(spark):
    """Each licence has its own label and no other, alone and beside any other one."""
    names = list(WHOLE)
    texts = [WHOLE[n][0] for n in names] + [f"{WHOLE[a][0]}\n\n-----\n\n{WHOLE[b][0]}" for a in names for b in names]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()}
    for i, n in enumerate(names):
        assert found[i] == WHOLE[n][1], n
    both = lambda a, b: ",".join(sorted(set(filter(None, (WHOLE[a][1] + "," + WHOLE[b][1]).split(",")))))
    for i, (a, b) in enumerate(((a, b) for a in names for b in names), len(names)):
        assert found[i] == both(a, b), (a, b)
