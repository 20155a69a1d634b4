"""Licence scans with a positional index of rare words, in DataFrame operations only.

Words are runs of digits, a-z (A-Z lower-cased) and all characters beyond ASCII.  Only words that occur
in some template are kept with their positions; their document frequencies over all documents
give their IDF.  A document that lacks a word of every key phrase cannot be labelled and goes no
further; none of its words is moved.  Each template is looked up by the ``rare`` words of its key phrase that
have the highest IDF; every hit says where the template would begin, and places that all of these words
agree on are candidates.  The key phrase must stand in full, so no place is lost, whatever else the document
holds.  A candidate is verified: all words of the template's key phrase must stand
at their places, and at least ``share`` of the template's words as well.

A licence has several templates: the first clause of its text, its whole first paragraph, its title and its usual notice.
One verified template gives the label, so a text that is cut short or edited further down still counts;
the score is the best share.  Licences whose texts begin alike (BSD with two, three or four clauses, MIT with and without conditions, ISC and 0BSD) are
told apart by the words where they part, which are their key phrases; a text that ends before those has the label of the shared beginning (``bsd``, ``mit``, ``isc``).
A template that is the beginning of another one counts only where that other one is not verified at the same place.

Short identifiers after ``SPDX-License-Identifier:`` are read as expressions: each identifier of :data:`SPDX` in it, with or without ``+``, ``-only`` and
``-or-later``, is a label with share 1.

Besides, ``base`` finds all places where the plain phrases of :data:`PHRASES` stand.

The postings are a fixed list of some hundred words; nothing else is broadcast.  A document's hits are
handled by document, so its length is the largest group.  Null and empty texts have no words; a
document without hits has null places, empty labels and score 0.  Every row is a document of its own, whatever its id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import text_of, written

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The phrases that the base scan looks for, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Clauses of the BSD licences, and how the warranty paragraph after them begins.
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement"
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
#: The grants that MIT and MIT-0, ISC and 0BSD begin with.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
MIT_RIGHTS = ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
MIT_CONDITIONS = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


def clauses(numbered: bool, *texts: str) -> str:
    """The BSD head and clauses one after the other, numbered or with other marks, which are no words."""
    return ": ".join([BSD_HEAD, " ".join(f"{i if numbered else '*'} {t}" for i, t in enumerate(texts, 1))])


#: Label, key phrase that must stand in full, passage of the licence or its usual notice.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge", MIT_GRANT),
    ("mit", "furnished to do so, subject to the following conditions", MIT_GRANT + MIT_RIGHTS + MIT_CONDITIONS),
    ("mit-0", "furnished to do so. THE SOFTWARE IS PROVIDED", MIT_GRANT + MIT_RIGHTS + ". THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND"),
    ("mit-0", "MIT No Attribution", "MIT No Attribution"),
    ("mit-notice", "released under the MIT License", "released under the MIT License"),
    ("apache-2.0", "Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-2", "General Public License, version 2", "licensed under the GNU General Public License, version 2"),
    ("apache-2.0", "Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004"),
    ("gpl-2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl-3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("agpl-3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("gpl-2", "GNU General Public License as published by the Free Software Foundation; either version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "General Public License, version 3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "GNU General Public License as published by the Free Software Foundation, either version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "Lesser General Public License, version 2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl-3", "Lesser General Public License, version 3", "licensed under the GNU Lesser General Public License, version 3"),
    ("lgpl-3", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3", "Affero General Public License, version 3", "licensed under the GNU Affero General Public License, version 3"),
    ("agpl-3", "GNU Affero General Public License as published by the Free Software Foundation, either version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms", BSD_HEAD),
    ("bsd-2-clause", "provided with the distribution. THIS SOFTWARE IS PROVIDED", clauses(True, BSD_SOURCE, BSD_BINARY) + " " + BSD_WARRANTY),
    ("bsd-2-clause", "provided with the distribution. THIS SOFTWARE IS PROVIDED", clauses(False, BSD_SOURCE, BSD_BINARY) + " " + BSD_WARRANTY),
    ("bsd-3-clause", "provided with the distribution. 3. Neither the name of", clauses(True, BSD_SOURCE, BSD_BINARY, BSD_NAMES)),
    ("bsd-3-clause", "provided with the distribution. * Neither the name of", clauses(False, BSD_SOURCE, BSD_BINARY, BSD_NAMES)),
    ("bsd-4-clause", "3. All advertising materials mentioning features or use of this software", clauses(True, BSD_SOURCE, BSD_BINARY, BSD_ADVERTISING)),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software", clauses(False, BSD_SOURCE, BSD_BINARY, BSD_ADVERTISING)),
    ("mpl-2.0", "Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "Mozilla Public License Version 2.0", "Mozilla Public License Version 2.0"),
    ("mpl-2.0", "Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify", ISC_GRANT),
    ("isc", "hereby granted, provided that the above copyright notice", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd", "hereby granted. THE SOFTWARE IS PROVIDED", ISC_GRANT + ". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"),
    ("unlicense", "free and unencumbered software", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "free and unencumbered software", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "In no event will the authors be held liable", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("bsl-1.0", "Boost Software License, Version 1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("epl-2.0", "Eclipse Public License 2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("cc-by-4.0", "CC BY 4.0", "licensed under CC BY 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0-1.0", "CC0 1.0 Universal", "released under CC0 1.0 Universal"),
]

#: Short identifiers that are known in expressions, lower-cased; those whose label here is another.
SPDX = (
    "0bsd afl-3.0 agpl-3.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc0-1.0 cddl-1.0 cecill-2.1 "
    "ecl-2.0 epl-1.0 epl-2.0 eupl-1.2 gpl-1.0 gpl-2.0 gpl-3.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0 ms-pl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 postgresql python-2.0 ruby unlicense upl-1.0 vim w3c wtfpl x11 zlib"
).split()
RENAMED = {"agpl-3.0": "agpl-3", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "lgpl-3.0": "lgpl-3"}


def words_of(text: str) -> list[str]:
    """The words of a template, which is ASCII."""
    return re.findall("[0-9a-z]+", text.lower())


#: (label, words of the key phrase, words of the passage)
PARTS = [(label, words_of(key), words_of(passage)) for label, key, passage in TEMPLATES]


def beginnings() -> list[tuple[int, int]]:
    """(longer, shorter): templates of different labels of which one begins with the other."""
    return [(n, m) for n, (a, _, long) in enumerate(PARTS) for m, (b, _, short) in enumerate(PARTS) if a != b and len(long) > len(short) and long[: len(short)] == short]


def identifiers(text: Column) -> Column:
    """The labels of all short identifiers in a text."""
    lines = F.regexp_extract_all(text, F.lit(r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)"), F.lit(1))
    each = F.flatten(F.transform(lines, lambda e: F.regexp_extract_all(F.lower(e), F.lit("[a-z0-9.-]+"), F.lit(0))))
    named = F.transform(each, lambda i: F.regexp_replace(F.regexp_replace(i, "[.]$", ""), "-(only|or-later)$", ""))
    known = F.filter(named, lambda i: i.isin(SPDX))
    other = F.create_map(*[F.lit(x) for pair in RENAMED.items() for x in pair])
    return F.array_distinct(F.transform(known, lambda i: F.coalesce(F.try_element_at(other, i), i)))


def postings(spark) -> DataFrame:
    """(template, label, place, word, key, size) of the fixed templates."""
    rows = []
    for n, (label, need, words) in enumerate(PARTS):
        at = next(i for i in range(len(words)) if words[i : i + len(need)] == need)
        rows += [(n, label, i, w, at <= i < at + len(need), len(words)) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "template int, label string, place int, word string, key boolean, size int")


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, seen, spdx, hits): each document's licence words, its short identifiers, and all positions of the words where it can be labelled."""
    vocabulary = sorted({w for _, _, words in PARTS for w in words} | {w for p in PHRASES for w in p.split()} | {"spdx"})
    words = F.array_remove(F.split(text_of(text_col), SEPARATORS), "")
    plain = lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w))
    placed = F.filter(F.transform("_w", lambda w, i: F.struct(i.cast("long").alias("pos"), plain(w).alias("word"))), lambda s: F.coalesce(s["word"].isin(vocabulary), F.lit(False)))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("_t"), words.alias("_w")).select("id", "_t", F.size("_w").cast("long").alias("n_words"), placed.alias("hits"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "_t", "n_words", "hits", F.array_distinct("hits.word").alias("seen"))
    spdx = F.when(F.array_contains("seen", "spdx"), identifiers(F.col("_t")))
    return rows.select("row", "id", "n_words", "seen", spdx.alias("spdx"), F.when(possible(F.col("seen")), F.col("hits")).alias("hits"))


def possible(words: Column) -> Column:
    """Whether an array has all words of some key phrase or plain phrase: no other document can be labelled."""
    keys = sorted({tuple(sorted(set(key))) for _, key, _ in PARTS} | {tuple(sorted(set(p.split()))) for p in PHRASES})
    keys = [k for k in keys if not any(set(other) < set(k) for other in keys)]  # the rest holds where these do
    out = F.lit(False)
    for key in keys:
        out = out | (F.size(F.array_except(F.array(*map(F.lit, key)), words)) == 0)
    return out


def base(found: DataFrame) -> DataFrame:
    """(row, pos, label) of each place of a plain phrase, from hits with words."""
    order = W.partitionBy("row").orderBy("pos")
    after = lambda k: F.when(F.lead("pos", k).over(order) == F.col("pos") + k, F.lead("word", k).over(order))
    seen = found.select("row", "pos", "word", after(1).alias("w1"), after(2).alias("w2"))
    label = None
    for phrase, name in PHRASES.items():
        test = F.lit(True)
        for column, word in zip(("word", "w1", "w2"), phrase.split()):  # noqa: B905
            test = test & (F.col(column) == word)
        label = F.when(test, name) if label is None else label.when(test, name)
    return seen.withColumn("label", label).where("label IS NOT NULL").select("row", "pos", "label")


def matches(found: DataFrame, idf: DataFrame, rare: int = 2, share: float = 0.8) -> DataFrame:
    """(row, label, share) of each verified template place, from hits with words and the words' idf."""
    index = F.broadcast(postings(found.sparkSession))
    best = F.row_number().over(W.partitionBy("template").orderBy(F.desc_nulls_first("idf"), "word", "place"))
    top = index.where("key").join(F.broadcast(idf), "word", "left").withColumn("rank", best).where(F.col("rank") <= rare)
    top = top.select("word", "template", "place", F.count(F.lit(1)).over(W.partitionBy("template")).alias("need"))
    asked = found.join(F.broadcast(top), "word").select("row", "template", "need", (F.col("pos") - F.col("place")).alias("start"))
    candidates = asked.groupBy("row", "template", "start", "need").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("need"))
    wanted = candidates.join(index, "template").select("row", "template", "start", "label", "key", "size", "word", (F.col("start") + F.col("place")).alias("pos"))
    seen = wanted.join(found.select("row", "pos", "word", F.lit(1).alias("seen")), ["row", "pos", "word"], "left")
    tested = seen.groupBy("row", "template", "start", "label", "size").agg(F.sum("seen").alias("n"), F.count(F.when(F.col("key") & F.col("seen").isNull(), 1)).alias("missing"))
    verified = tested.where("missing = 0").withColumn("share", F.col("n") / F.col("size")).where(F.col("share") >= share)
    pairs = found.sparkSession.createDataFrame(beginnings(), "template int, shorter int")
    covered = verified.join(F.broadcast(pairs), "template").select("row", F.col("shorter").alias("template"), "start")  # a fixed list of a few pairs
    return verified.join(covered, ["row", "template", "start"], "left_anti").select("row", "label", "share")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels and score."""
    table = written(hits(docs, id_col, text_col), "hits")
    df = table.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))  # over all documents
    idf = df.select("word", F.ln((F.lit(table.count()) + 1) / (F.col("df") + 1)).alias("idf"))
    found = written(table.where("hits IS NOT NULL").select("row", F.inline("hits")), "licence-words")
    plain = base(found).select("row", "pos", "label", F.lit(1.0).alias("share"), F.lit(True).alias("base"))
    more = matches(found, idf, **limits).select("row", F.lit(None).cast("long").alias("pos"), "label", "share", F.lit(False).alias("base"))
    short = table.where(F.size("spdx") > 0).select("row", F.lit(None).cast("long").alias("pos"), F.explode("spdx").alias("label"), F.lit(1.0).alias("share"), F.lit(False).alias("base"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = plain.unionByName(more).unionByName(short).groupBy("row").agg(
        F.count("pos").alias("n_base"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"), names(F.when(F.col("base"), F.col("label"))).alias("base_labels"), names("label").alias("labels"), F.max("share").alias("score"),
    )
    return table.select("row", "id", "n_words").join(per, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
