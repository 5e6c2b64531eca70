"""Benchmark passages against a search for every window, and the query against its SQL."""

import hashlib
import random
import re

import pytest

from check_oracles import compare, connect
from genomeframe.llm import decontamination

FOLDER = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string, window string", "item_id long, text string, n string"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(docs, items, width=10):
    out = []
    for doc_id, text, *_ in docs:
        own, hit, found = words(text), set(), set()
        for item_id, item, *_ in items:
            w = words(item)
            for at in range(max(len(w) - width, 0) + 1 if w else 0):
                cut = w[at : at + width]
                for i in range(len(own) - len(cut) + 1):
                    if own[i : i + len(cut)] == cut:
                        hit.update(range(i, i + len(cut)))
                        found |= {str(item_id)} if item_id is not None else set()
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_report_equals_search(spark):
    """A small vocabulary, so windows overlap, repeat and share their rarest tokens."""
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choice("a b c".split()) for _ in range(n))
    items = [(i, text(rnd.choice([1, 3, 4, 5, 9, 10, 11, 14])), None) for i in range(60)]
    docs = [(i, text(rnd.choice([0, 2, 8, 12, 40, 200])), "x") for i in range(120)]
    docs += [(500 + i, f"{items[i][1].upper()}, - {text(20)}", None) for i in range(20)]
    made = decontamination.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got(made) == expected(docs, items)


def test_awkward_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, passage, "x"), (1, passage, "y"), (2, passage, None), (None, "Größe Maß", None), (3, None, None),
             (4, " ,. ", None), (10, "solo", None), (None, None, None)]
    docs = [(1, None, "a"), (2, "", None), (3, passage.replace(" ", " ;\n"), None), (None, passage + " x", None),
            (5, passage, None), (5, passage, None), (6, "word " * 60_000 + passage.replace(" ", "  "), None),
            (7, "größe, maß! GRÖßE MAß solo-solo", None), (8, "one two three four five six seven eight nine", None)]
    made = decontamination.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got(made) == expected(docs, items)


def test_spans_and_items(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"x {passage} y {passage}", None), (2, "x", None)], DOCS)
    items = spark.createDataFrame([(7, passage, None), (30, passage, None)], ITEMS)
    rows = {r.doc_id: r for r in decontamination.scan(docs, items).collect()}
    assert [tuple(s) for s in rows[1].spans] == [(1, 12), (13, 24)]
    assert rows[1]["items"] == ["30", "7"] and rows[2]["items"] == [] and rows[2].spans == []


@pytest.mark.parametrize("empty", ["documents", "benchmark", "both"])
def test_empty_tables(spark, empty):
    docs = [] if empty != "benchmark" else [(1, "some text", None)]
    items = [] if empty != "documents" else [(1, "some text", None)]
    made = decontamination.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got(made) == expected(docs, items)


def test_a_full_bitmap_gives_the_same(spark, monkeypatch):
    """False positives of the bitmap are dropped by the joins."""
    monkeypatch.setattr(decontamination, "bitmap", lambda hashes: ~decontamination.np.zeros(1 << 18, "uint64"))
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choice("abcde") for _ in range(60)), None) for i in range(40)]
    items = [(i, docs[i][1][10:60], None) for i in range(10)]
    made = decontamination.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got(made) == expected(docs, items)


def test_query_equals_sql(spark):
    same, note = compare(spark, connect(FOLDER), "op12_decontamination", FOLDER)
    assert same, note
