"""Spelling variants against comparing all words."""

import collections
import random
import re
import zlib

import pytest

from genomeframe.llm import spelling
from genomeframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts):
    by_length = collections.defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    out = {}
    for w, n in counts.items():
        found = [v for d in (-1, 0, 1) for v in by_length[len(w) + d] if near(w, v)]
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[w] = (n, len(found), form, counts[form] if form else None)
    roots = {}
    for w in out:
        at = w
        while out[at][2]:
            at = out[at][2]
        roots[w] = at
    return {w: (*v, roots[w]) for w, v in out.items()}


def got(frame):
    rows = frame.select("word", "n", "n_near", "form", "form_n", "root").collect()
    found = {r[0]: tuple(r[1:]) for r in rows}
    assert len(found) == len(rows)
    return found


def brute_counts(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("most", [spelling.GROUP_WORDS, 30, 2])
def test_variants_equal_all_pairs(spark, most):
    """Also where groups are cut down to ranges of one letter."""
    rnd = random.Random(11)
    counts = {}
    while len(counts) < 500:
        word = "".join(rnd.choice("abàÿ") for _ in range(rnd.choice([6, 6, 7, 7, 8, 9])))
        counts[word] = rnd.choice([5, 5, 6, 25, 30, 125, 700])
    counts |= {"a" * 40: 9, "a" * 39: 60, "b" + "a" * 39: 5, "a" * 39 + "b": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.variants(words, most=most)) == expected(counts)


def test_query_equals_all_pairs(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert got(QUERIES["op11_spelling"](spark, FOLDER)) == expected(brute_counts([tuple(r) for r in rows]))


def test_words_of_a_hot_group(spark):
    """Hundreds of words that agree but for their last letters: more than a block, one group."""
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäå"
    counts = {"prefix" + a + b: 5 + (i * 7 + j) % 31 for i, a in enumerate(letters) for j, b in enumerate(letters)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.variants(words, most=100)) == expected(counts)


def test_awkward_documents(spark):
    schema = "doc_id long, text string, word string, n string"
    rows = [
        (1, None, "x", None),
        (2, "", None, "y"),
        (None, "ÀÉÎÕÜß àéîõüß abcdefg " * 3, None, None),
        (3, "colour colours color's Colour_colour", None, None),
        (3, "colour colours color's Colour_colour", None, None),
        (4, "x" * 60_000 + " " + "colour " * 9 + "日本語語語語 abcdef1abcdef", None, None),
    ]
    frame = spark.createDataFrame(rows, schema)
    runs = spelling.letter_runs(frame, spelling.SHORTEST)
    found = got(spelling.variants(spelling.vocabulary(spelling.misspelt(runs), fewest=1)))
    counts = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    assert found == expected({w: n for w, n in counts.items() if len(w) >= 6})


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(spelling.letter_runs(frame))).count() == 0
