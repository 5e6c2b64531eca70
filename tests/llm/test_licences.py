"""Licence scans: full texts as they occur in files, a plain comparison, and the SQL."""

import random
import textwrap
from collections import Counter

import pytest

from check_oracles import compare, connect
from genomeframe.llm import licences
from genomeframe.llm.licence_texts import TEXTS

FOLDER = "/root/testdata/sf0.001"


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.licence, r.dice, r.n_matches) for r in licences.scan(rows).orderBy("doc_id").collect()]


def wrapped(name, prefix="", which=-1, width=76):
    lines = []
    for paragraph in TEXTS[name][which]:
        lines += [*textwrap.wrap(paragraph, width), ""]
    return "\n".join(f"{prefix}{line}".rstrip() if prefix else line for line in lines[:-1])


@pytest.mark.parametrize("name", ["MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "Apache-2.0", "ISC", "MPL-2.0"])
def test_full_texts_wrapped_and_in_comments(spark, name):
    plain = f"Copyright (c) 2020 A. Writer\n\n{wrapped(name)}\n\nimport this\n"
    comment = f"#!/bin/x\n\n{wrapped(name, ' * ', width=60)}\n\nint main;"
    hashes = wrapped(name, "# ").upper()
    got = found(spark, [plain, comment, hashes])
    assert [g[0] for g in got] == [name] * 3
    assert all(g[1] >= 0.8 and g[2] > 0 for g in got)


def test_a_notice_inside_a_longer_line(spark):
    filler = "Some words about the project and who wrote it in which year. "
    notice = "Licensed under the Apache License, Version 2.0. "
    long = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    got = found(spark, [filler * 3 + notice + filler * 4, filler + long + filler, filler * 9, "permission is granted to the", None, ""])
    assert [g[0] for g in got] == ["Apache-2.0", "Apache-2.0", None, None, None, None]
    assert [g[2] for g in got][2:] == [0, 0, 0, 0]


def test_ties_take_the_first_name(spark):
    rows = spark.createDataFrame([(1, "one two three four"), (2, "a b a b a b")], "doc_id long, text string")
    texts = {"b": [["one two three four"]], "a": [["one two three four"]], "c": [["a b a b a b"]]}
    got = {r.doc_id: (r.licence, r.dice) for r in licences.scan(rows, texts=texts).collect()}
    assert got == {1: ("a", 1.0), 2: ("c", 1.0)}


def test_dice_of_multisets(spark):
    """Repeated bigrams count as often as they occur on both sides."""
    rng = random.Random(4)
    template = [rng.choice("ab") for _ in range(14)]
    texts, want = {"t": [[" ".join(template)]]}, []
    grams = Counter(zip(template, template[1:]))
    docs = [[rng.choice("ab") for _ in range(rng.randint(2, 22))] for _ in range(60)]
    for words in docs:
        own = Counter(zip(words, words[1:]))
        dice = 2 * sum((own & grams).values()) / (len(words) + len(template) - 2)
        want.append(round(dice, 9) if dice >= 0.8 else None)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = [r.dice for r in licences.scan(rows, texts=texts).orderBy("doc_id").collect()]
    assert got == want and any(want)


def test_query_equals_sql(spark):
    same, note = compare(spark, connect(FOLDER), "op7_licences", FOLDER)
    assert same, note
