"""License rules against plain phrase search, ungated matching and pairwise suppression."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillwise.llm import licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEXTS = [
    None, "", " \n", "no words of interest", "MIT License", "the MIT, License; mit\nLICENSE", "mit licenses permit license", "é mit license é", "émit license",
    "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: BSD-3-Clause", "GNU Lesser General Public License v2.1",
    "see https://www.gnu.org/licenses/gpl-3.0.html", "apache license apache license " * 500, "word " * 20000 + "cc by", "Creative Commons Attribution-ShareAlike 4.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
    "mit einer Lizenz", "cc\x00by", "CC BY", "x" * 100000, "published under the terms of the Mozilla Public License 2.0",
]


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(text)
    places = []
    for phrase, label in PHRASES.items():
        want = phrase.split()
        places += [(i, label) for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def reported(spark, rows, schema):
    return licenses.report(licenses.scan(spark.createDataFrame(rows, schema))).collect()


def test_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1000 + r["doc_id"], r["text"], "x") for r in docs]
    texts = {i: t for i, t, _ in rows}
    found = reported(spark, [*rows, (None, "mit license", "x"), (4, "MIT License", "x")], "doc_id long, text string, found string")
    assert len(found) == len(rows) + 2
    for r in found:
        text = "mit license" if r["doc_id"] is None else texts[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))


def test_labels(spark):
    wanted = {
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "GNU Lesser General Public License v2.1": "lgpl-2.1",
        "Released under the MIT License.": "mit",
        "mit einer Lizenz": "",
        "published under the terms of the Mozilla Public License 2.0": "mpl-2.0",
        "see https://www.gnu.org/licenses/gpl-3.0.html": "gpl-3.0",
    }
    found = {r["doc_id"]: r for r in reported(spark, [(t, t) for t in wanted], "doc_id string, text string")}
    assert {t: r["labels"] for t, r in found.items()} == wanted
    assert found["mit einer Lizenz"]["score"] == 0 and found["SPDX-License-Identifier: BSD-3-Clause"]["score"] == 1


def test_empty_table(spark):
    assert reported(spark, [], "doc_id long, text string") == []


def test_hundreds_of_rules():
    assert len(licenses.rules()) > 300


@pytest.mark.parametrize("rule", licenses.rules(), ids=lambda r: r.name)
@settings(max_examples=3, deadline=None)
@given(data=st.data())
def test_gate_words_are_necessary(rule, data):
    """Every text that a rule matches holds the rule's gate words, so the prefilter loses nothing."""
    text = data.draw(st.from_regex(rule.pattern, fullmatch=True))
    words = f" {text} ".encode()
    assert licenses._compiled(rule.pattern).search(words)
    assert set(rule.gate) <= set(text.split())
    assert set(licenses.detect(words)) == set(licenses.detect(words, gated=False))


def plain_kept(found):
    def inside(i, j):
        a, b = found[i], found[j]
        if i == j or not (b.start <= a.start and a.end <= b.end):
            return False
        equal = (a.start, a.end) == (b.start, b.end)
        return b.priority > a.priority or (b.priority == a.priority and (not equal or j < i))

    return [d.priority == licenses.PHRASE or not any(inside(i, j) for j in range(len(found))) for i, d in enumerate(found)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 6), st.integers(1, 6)), max_size=25))
def test_suppression(spans):
    found = [licenses.Detection(a, a + n, "x", "x", p) for a, n, p in spans]
    assert licenses.kept(found) == plain_kept(found)
