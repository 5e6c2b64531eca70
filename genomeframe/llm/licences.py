"""Licence scans: normalised passages against licence templates by Dice over word bigrams.

A document's passages are its lines, its paragraphs (parted by empty lines), the
sentences of its paragraphs and its whole text; equal passages count once. Text is normalised to
lower-case ASCII letters and digits, words parted by single spaces, so marks of comments and line
breaks within a notice do not matter. A licence's templates are its whole text, its paragraphs and their
sentences. Bigrams count as often as they occur on both sides: each is labelled with how
often it came before. Dice = 2 |both| / (|passage| + |template|). With a limit d, a passage can only
reach a template of n bigrams if its size lies between n d / (2 - d) and
n (2 - d) / d, and at least d / (2 - d) of its bigrams, so one more words, are in some template. Passages
outside every template's bounds or of other words are dropped before any bigram is made, and
a template outside a passage's bounds is not compared.

The best match is the one with most shared bigrams, then the highest Dice, then the first by name: a whole
text tells two licences apart that share paragraphs.

Everything is built-in expressions in one narrow pass: no shuffle, and the
templates are literals of fixed size.

Cases: null and empty texts, and passages of fewer than two words, match
nothing; repeated rows get equal results; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomeframe.llm.common import free_name
from genomeframe.llm.licence_texts import TEXTS

#: Least Dice of a match; bigrams of a sentence that is a template of its own.
LIMIT, SENTENCE = 0.8, 5
_BREAK = r"(?:\r\n|\r|\n)"
_EMPTY = rf"{_BREAK}[ \t]*{_BREAK}"
#: Ends of sentences; the mark stays, the space after it becomes ``_CUT``.
_STOP, _CUT = r"([.!?;:])[ \t\r\n]+", "\x01"


def words_of(text: str) -> list[str]:
    """The normalised words of a template or passage."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    """The bigrams of a text, each labelled with how often it came before."""
    words, seen, out = words_of(text), Counter(), []
    for gram in (f"{a} {b}" for a, b in zip(words, words[1:])):
        out.append(f"{gram}#{seen[gram]}")
        seen[gram] += 1
    return out


def size_bounds(n: int, limit: float) -> tuple[int, int]:
    """Least and greatest number of bigrams that reach ``limit`` with a template of ``n``."""
    return math.ceil(n * limit / (2 - limit) - 1e-9), math.floor(n * (2 - limit) / limit + 1e-9)


def templates_of(texts: dict[str, list[list[str]]]) -> list[tuple[str, list[str]]]:
    """(name, bigrams) of every distinct template: whole texts, paragraphs and their sentences."""
    found = {}
    for name in sorted(texts):
        for paragraphs in texts[name]:
            made = ["\n\n".join(paragraphs), *paragraphs]
            grams = [bigrams_of(t) for t in made]
            for p in paragraphs:
                sentences = (bigrams_of(s) for s in re.sub(_STOP, rf"\1{_CUT}", p).split(_CUT))
                grams += [g for g in sentences if len(g) >= SENTENCE]
            for g in grams:
                if g:
                    found[name, tuple(g)] = list(g)
    return [(name, grams) for (name, _), grams in found.items()]


def _passages(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    paragraphs = F.split(whole, _EMPTY)
    sentences = F.transform(paragraphs, lambda p: F.split(F.regexp_replace(p, _STOP, f"$1{_CUT}"), _CUT))
    return F.concat(F.split(whole, _BREAK), paragraphs, F.flatten(sentences), F.array(whole))


def _normalised(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), "[^a-z0-9]+", " "))


def _bigrams(words: Column) -> Column:
    n = F.size(words) - 1
    return F.zip_with(
        F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)
    )


def _labelled(grams: Column) -> Column:
    def label(gram: Column, i: Column) -> Column:
        before = F.filter(F.slice(grams, F.lit(1), i), lambda x: x == gram)
        return F.concat_ws("#", gram, F.size(before))

    return F.transform(grams, label)


def best_matches(text: Column, texts=None, limit: float = LIMIT) -> Column:
    """For every passage that reaches a template a struct (fewer, less, name) of its best one:
    ``fewer`` is minus the shared bigrams, ``less`` minus the Dice."""
    templates = templates_of(TEXTS if texts is None else texts)
    bounds = [size_bounds(len(grams), limit) for _, grams in templates]
    least, most = min(low for low, _ in bounds), max(high for _, high in bounds)
    known = sorted({g.rpartition("#")[0] for _, grams in templates for g in grams})
    words_known = sorted({w for g in known for w in g.split()})
    share = limit / (2 - limit)

    def best(grams: Column) -> Column:
        n = F.size(grams)
        found = []
        for (name, own), (low, high) in zip(templates, bounds):
            shared = F.size(F.array_intersect(grams, F.lit(own)))
            less = -2.0 * shared / (n + len(own))
            match = F.struct((-shared).alias("fewer"), less.alias("less"), F.lit(name).alias("name"))
            found.append(F.when(n.between(low, high) & (less <= -limit), match))
        return F.array_min(F.array(*found))

    def familiar(items: Column, of: list[str], n: Column) -> Column:
        return F.size(F.filter(items, lambda x: x.isin(of))) >= n * F.lit(share) - 1e-9

    passages = F.array_distinct(F.transform(_passages(text), _normalised))
    words = F.transform(passages, lambda p: F.split(p, " "))
    sized = F.filter(
        words,
        lambda w: (F.size(w) - 1).between(max(1, least), most) & familiar(w, words_known, F.size(w) - 1),
    )
    grams = F.filter(F.transform(sized, _bigrams), lambda g: familiar(g, known, F.size(g)))
    return F.array_compact(F.transform(F.transform(grams, _labelled), best))


def scan(docs: DataFrame, text: str = "text", texts=None, limit: float = LIMIT) -> DataFrame:
    """``docs`` with licence and dice of the best match and n_matches, the distinct matching passages."""
    name = free_name(docs, "licence_matches")
    found = docs.withColumn(name, best_matches(F.col(text), texts, limit))
    best = F.array_min(name)
    return found.withColumns(
        {
            "licence": best["name"],
            "dice": F.round(-best["less"], 9),
            "n_matches": F.size(name).cast("long"),
        }
    ).drop(name)


def _values() -> str:
    rows = []
    for k, (name, grams) in enumerate(templates_of(TEXTS)):
        low, high = size_bounds(len(grams), LIMIT)
        rows += [f"({k}, '{name}', {len(grams)}, {low}, {high}, '{g}')" for g in grams]
    return ", ".join(rows)


ORACLE = rf"""
WITH t(k, name, n, low, high, gram) AS (VALUES {_values()}),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
para AS (SELECT r, unnest(regexp_split_to_array(text, '{_EMPTY}')) AS passage FROM doc),
p AS (
  SELECT r, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS passage FROM doc
  UNION ALL SELECT * FROM para
  UNION ALL SELECT r, unnest(string_split(regexp_replace(passage, '{_STOP}', '\1' || chr(1), 'g'), chr(1))) FROM para
  UNION ALL SELECT r, text FROM doc
), w AS (
  SELECT r, norm, string_split(norm, ' ') AS words FROM (
    SELECT DISTINCT r, trim(regexp_replace(lower(passage), '[^a-z0-9]+', ' ', 'g')) AS norm FROM p)
), g AS (
  SELECT r, norm, len(words) - 1 AS size, words[i] || ' ' || words[i + 1] AS gram
  FROM (SELECT *, unnest(range(1, len(words))) AS i FROM w
        WHERE len(words) - 1 BETWEEN (SELECT min(low) FROM t) AND (SELECT max(high) FROM t))
), l AS (
  SELECT r, norm, size, gram || '#' || (row_number() OVER (PARTITION BY r, norm, gram) - 1) AS gram FROM g
), d AS (
  SELECT r, norm, name, count(*) AS shared, 2.0::DOUBLE * count(*) / (any_value(size) + any_value(n)) AS dice
  FROM l JOIN t USING (gram) WHERE size BETWEEN low AND high
  GROUP BY r, norm, name, k
), m AS (
  SELECT r, count(DISTINCT norm) AS n_matches, arg_min(dice, (-shared, -dice, name)) AS dice,
    arg_min(name, (-shared, -dice, name)) AS licence
  FROM d WHERE dice >= {LIMIT} GROUP BY r
)
SELECT doc_id, licence, round(dice, 9) AS dice, coalesce(n_matches, 0) AS n_matches
FROM doc LEFT JOIN m USING (r)
"""
