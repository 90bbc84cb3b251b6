"""What the operators and the pipeline once left out."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import licenses, line_dedup, similarity


def alike(rows: list[tuple]) -> tuple[set, set]:
    """Ids that stay and all similar pairs, by comparing every pair."""
    sets = {i: similarity.shingles(t.encode()) for i, t in rows}
    root, pairs = {i: i for i in sets}, set()
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs.add((j, i))
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return set(root.values()), pairs


def near_copies(n: int) -> list[tuple]:
    """Texts of 200 words and copies of each with one to five words changed."""
    rng, rows = random.Random(3), []
    for group in range(n):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        for changed in (0, 1, 2, 3, 4, 5):
            words = list(base)
            for at in rng.sample(range(200), changed):
                words[at] = f"x{rng.randrange(3000)}"
            rows.append((10 * group + changed, " ".join(words)))
    return rows


def test_similar_documents_against_every_pair(spark):
    rows = near_copies(40)
    stay, _ = alike(rows)
    loose = {i for i, _, c in brute.components(rows) if c == i}
    assert len(loose) > len(stay)  # three bits do not connect them
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in similarity.one_of_similar(df).collect()} == stay


def chained_copies(n: int) -> list[tuple]:
    """Texts of 60 words of which each differs from the one before in one word, so that few are alike."""
    rng = random.Random(8)
    words, rows = [f"w{k}" for k in range(60)], []
    for i in range(n):
        words = list(words)
        words[rng.randrange(60)] = f"y{i}"
        rows.append((i, " ".join(words)))
    return rows


def test_long_runs_lose_no_link(spark, monkeypatch):
    """Runs so short and blocks so small that nearly all links are left to the second step."""
    for name, value in (("RUN_ALL", 2), ("RUN_NEAR", 1), ("BLOCK", 3), ("PROBES", 7)):
        monkeypatch.setattr(similarity, name, value)
    rows = chained_copies(60) + [(100 + i, t) for i, t in near_copies(4)]
    stay, _ = alike(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in similarity.one_of_similar(df).collect()} == stay


def test_similar_documents_awkward_rows(spark):
    big = [(100 + i, " ".join(f"w{k}" for k in range(300)) + f" end{i}", "s") for i in range(60)]
    rows = [(1, None, "s"), (2, "", "s"), (None, "a b", "s"), (4, "A  b", "s"), (4, "other words", "s"), (5, "a b c", "s"), *big]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = similarity.one_of_similar(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 4, 5, 100]
    assert similarity.one_of_similar(df.limit(0)).count() == 0


def without_long_lines(rows: list[tuple], words: int = 13) -> dict:
    """Texts without later runs of three lines, or of one or two of 13 words or more."""
    first, own, out = {}, {}, {}
    for i, t in sorted(rows):
        own[i] = [(n, x.strip(" \t\x0b\x0c\r")) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")]
        gone = set()
        for size in (1, 2, 3):
            for s in range(len(own[i]) - size + 1):
                window = tuple(x for _, x in own[i][s : s + size])
                if size < 3 and len(brute.words("\n".join(window))) < words:
                    continue
                at = first.setdefault(window, (i, s))
                if at[0] != i or s - at[1] >= size:
                    gone |= {n for n, _ in own[i][s : s + size]}
        out[i] = t if not gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    return out


def test_line_dedup_takes_long_passages_of_few_lines(spark, tables):
    long = " ".join(f"w{i}" for i in range(13))
    pair = "one two three four five six\nseven eight nine ten eleven twelve thirteen"
    rows = [(1, f"head\n{long}\ntail"), (2, long), (3, f"other\n {long} \nshort"), (4, pair), (5, f"a\n{pair}\nb"), (6, "short"), (7, "short"), (8, f"{long} x\n{long} x"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(df, long_words=13).collect()}
    assert got == without_long_lines(rows)
    assert (got[2], got[3], got[5], got[7], got[8]) == ("", "other\nshort", "a\nb", "short", f"{long} x")
    small = spark.read.parquet(f"{tables}/documents.parquet")
    want = without_long_lines([(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()])
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(small, long_words=13).collect()} == want


def licences(spark, texts: dict) -> dict:
    df = spark.createDataFrame([(t,) for t in texts], "doc_id string").withColumn("text", F.col("doc_id"))
    return {r.doc_id: r.licenses for r in licenses.scan_licenses(df).collect()}


def test_license_prefilter_loses_no_sentence(spark):
    texts = {
        "Distributed under GPL v3.": "GPL-3.0", "This program is GPLv2.": "GPL-2.0", "CC0 1.0 Universal.": "CC0-1.0", "Available as CC BY-SA 4.0.": "CC-BY-SA",
        "Creative Commons Attribution 4.0 International.": "CC-BY", "All rights\nreserved.": "Proprietary", "Under the LGPL v3.": "LGPL", "AGPLv3": "AGPL",
        "a licence to think": "", "plain prose, and more of it": "",
    }
    assert licences(spark, texts) == texts


#: An example of each known sentence, some of them with line ends and punctuation inside.
EXAMPLES = {
    "ap": "Apache License,\nVersion 2.0", "ax": "you may not use this file except in compliance with the License", "ay": "You may obtain a copy of the License at",
    "az": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an 'AS IS' BASIS",
    "am": "The MIT License (MIT)", "mp": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mn": "The above copyright notice and this permission notice shall be included in all copies", "mw": "The software is provided 'as is', without warranty of any kind",
    "ml": "In no event shall the authors or copyright holders be liable", "is": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "iw": "The software is provided 'as is' and the author disclaims all warranties", "ag": "AGPLv3", "lg": "LGPL-2.1", "gl": "GPL-2.0-or-later", "g3": "gpl v3", "g2": "GPLv2",
    "gp": "GNU\nGeneral Public License", "mz": "MPL 2.0", "ep": "Eclipse Public License 2.0", "m1": "Mozilla Public License 1.1", "bo": "Boost Software License - Version 1.0", "zl": "zlib license", "bd": "BSD licensed",
    "br": "Redistribution and use in source and binary forms, with or without modification, are permitted", "bs": "Redistributions of source code must retain the above copyright notice",
    "bb": "Redistributions in binary form must reproduce the above copyright notice", "bn": "Neither the name of the X nor its members may be used to endorse or promote products",
    "bw": "This software is provided by the authors 'as is' and any express or implied warranties", "b3": "3-clause BSD", "b2": "BSD 2-Clause License", "cz": "CC0 1.0",
    "cs": "CC BY-NC-SA 4.0", "cd": "CC BY-NC-ND", "cn": "CC\nBY-NC", "ca": "Creative Commons\nAttribution ShareAlike", "cr": "CC-BY-ND", "cc": "licensed under CC BY",
    "ul": "This is free and unencumbered software released into the public domain", "ar": "All\nrights reserved", "co": "Copyright (c) 2020 someone",
}


def test_every_known_sentence_is_found(spark):
    assert set(EXAMPLES) == {name for name, _ in licenses.SENTENCES}
    df = spark.createDataFrame(list(EXAMPLES.items()), "doc_id string, text string")
    for r in licenses.scan_licenses(df).collect():
        assert r.sentences.split("|")[1] == f"<{r.doc_id}>", r


def test_licenses_in_gaps_and_unknown_sentences(spark):
    mit = [EXAMPLES["mp"], EXAMPLES["mn"], EXAMPLES["mw"]]
    texts = {
        f"{mit[0]}. Parts are under the GNU Affero General Public License. {mit[1]}. {mit[2]}.": "AGPL,MIT",
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
        "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-or-later", "The MIT License (MIT)": "MIT", "Licensed under the Eclipse Public License 2.0.": "EPL-2.0",
        "This work is CC0.": "CC0-1.0", "Released under GPLv3.": "GPL-3.0", "cc by design, license fee": "", "license costs gpl 300 dollars": "", "a permit licence": "",
        "Transmit license": "", "Your licence has expired. No warranty is given.": "",
    }
    assert licences(spark, texts) == texts
    df = spark.createDataFrame([(1, "Your licence has expired. No warranty is given. MIT license. Prose."), (2, None), (3, "")], "doc_id int, text string")
    assert {r.doc_id: (r.n_sentences, r.n_unknown) for r in licenses.scan_licenses(df).collect()} == {1: (1, 2), 2: (0, 0), 3: (0, 0)}


def test_wordings_of_notices(spark):
    """Licences by hand, each in a wording of its own (fixed values)."""
    texts = {
        "GNU General Public License, version 2 or later": "GPL-or-later", "Under GPL v2.0+": "GPL-or-later", "GPLv3+ applies": "GPL-or-later", "GPL version 2 or any later version": "GPL-or-later",
        "Licensed under Apache 2.0": "Apache-2.0", "New BSD License": "BSD-3-Clause", "Simplified BSD License": "BSD-2-Clause", "A BSD license": "BSD", "Boost Software License - Version 1.0": "BSL-1.0",
        "zlib license": "Zlib", "Mozilla Public License 1.1": "MPL-1.1", "The license is MIT.": "MIT", "MIT-licensed code": "MIT", "Licensed under the MIT and BSD licenses": "BSD,MIT", "This is GPL software": "GPL",
        "GPL-2.0": "GPL-2.0", "GPL 2 + extras": "GPL-2.0", "GNU General Public License, version 2\nor later": "GPL-or-later", "the new\nBSD license": "BSD-3-Clause", "C++ and 1+1, license fee": "",
    }
    assert licences(spark, texts) == texts


def test_gaps_of_any_length(spark):
    between = ". ".join(["zlib license", "Boost Software License", "Eclipse Public License 2.0", "MPL 2.0", "MPL 1.1", "CC0"])
    text = f"{EXAMPLES['mp']}. {between}. {EXAMPLES['mn']}. {between}. {EXAMPLES['mw']}."
    assert licences(spark, {text: 0})[text] == "BSL-1.0,CC0-1.0,EPL-2.0,MIT,MPL-1.1,MPL-2.0,Zlib"


def test_sentence_names_all_its_licenses(spark):
    texts = {
        "It is released under the MIT license or the GNU General Public License, version 3.": "GPL-3.0,MIT",
        "Under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.": "GPL-or-later",
        "GNU Lesser General Public License": "LGPL",
        "Licensed under the Apache License, Version 2.0, all rights reserved": "Apache-2.0,Proprietary",
    }
    assert licences(spark, texts) == texts
