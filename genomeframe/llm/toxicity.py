"""Toxicity by a weighted lexicon matched with Aho-Corasick over folded text.

Text is folded (letter case, accents, homoglyphs, digit and sign substitutions)
and cut to words; lexicon entries are word beginnings, so inflected forms match.
The lexicon and its weights are learned from labelled documents: the log-odds of
an entry, kept where its odds are over twice the base odds (so any share of toxic
rows will do) and its association with the label passes a significance bound over
all candidates. A document's score is a logistic function of its total
weight, that weight per word, and the number of distinct entries; words inside
exception phrases do not count.

Bounds: training reads at most about ``sample_rows`` labelled documents, drawn
by a hash of the id. The logistic curve
is fitted on each half of the sample with the lexicon of the other half. Scoring is a narrow pass over every whole
text.

Cases: null and empty texts get the score of a text without a hit; without
labelled rows of both kinds the lexicon is empty and every score is the share
of the label (0 without rows). Repeated rows get equal scores, other columns
pass through, and a column with a result's name is replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomeframe.llm.common import free_name, replaced, small_batches, with_fields
from genomeframe.session import materialize

#: Letters of other scripts that look like Latin ones, and signs written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ø": "o", "ł": "l",
}
SUBSTITUTES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
}
#: Phrases whose words are not counted.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "sore loser", "stupid simple")
PREFIX_LENGTHS = range(3, 11)
SCORE_LIMIT = 0.3


def _folding() -> dict[int, str]:
    table: dict[int, str] = {}
    for code in range(0x250):
        char = chr(code).lower()
        plain = unicodedata.normalize("NFKD", char)
        plain = "".join(c for c in plain if not unicodedata.combining(c))
        plain = "".join(LOOKALIKES.get(c, SUBSTITUTES.get(c, c)) for c in plain)
        table[code] = "".join(c if c.isalnum() else " " for c in plain)
    for code in [*range(0x250, 0x530), *range(0xFF01, 0xFF5F)]:
        char = unicodedata.normalize("NFKC", chr(code)).lower()
        table[code] = "".join(LOOKALIKES.get(c, SUBSTITUTES.get(c, c)) for c in char)
    for code in [*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD]:
        table[code] = ""
    for code in [*range(0x2000, 0x200B), *range(0x2010, 0x2070), 0x3000]:
        table[code] = " "
    return table


FOLDING = _folding()
_ENDING_SIGNS = re.compile(r"!+(?=\s|$)")


def fold(text: str | None) -> str:
    """The folded text: words parted by single spaces, with a space at both ends.

    Exclamation marks at the end of a word are punctuation, others letters.
    """
    if not text:
        return " "
    if "!" in text:
        text = _ENDING_SIGNS.sub(" ", text)
    return f" {' '.join(text.translate(FOLDING).split())} "


@dataclass
class ToxicityModel:
    """Lexicon entries (word beginnings, folded) with weights, and the logistic coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-30.0, 0.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(" " + entry, (len(entry) + 1, weight, entry))
        for phrase in self.exceptions:
            found.add_word(fold(phrase), (len(fold(phrase)), None, phrase))
        if len(found):
            found.make_automaton()
        return found


def features(automaton, text: str | None) -> tuple[float, float, float]:
    """log1p of total weight, of weight per hundred words, and of distinct entries."""
    folded = fold(text)
    if not len(automaton):
        return 0.0, 0.0, 0.0
    best: dict[int, tuple[float, str]] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight, entry) in automaton.iter(folded):
        start = end - length + 1
        if weight is None:
            spared.append((start, end))
        elif start not in best or weight > best[start][0]:
            best[start] = (weight, entry)
    for a, b in spared:
        for start in [s for s in best if a <= s < b]:
            del best[start]
    total = sum(w for w, _ in best.values())
    words = folded.count(" ") - 1 or 1
    return (
        math.log1p(total),
        math.log1p(100.0 * total / words),
        math.log1p(len({e for _, e in best.values()})),
    )


def probability(curve: tuple[float, ...], x) -> float:
    z = curve[0] + sum(c * v for c, v in zip(curve[1:], x))
    return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic, part) of all labelled documents, or of about ``sample_rows`` of them.

    Labels outside the held-out fold are drawn by a hash of the id before they meet
    the texts: the drawn ids are few (their number is the parameter), so they are
    broadcast and no text is shuffled.
    """
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), 4) != 2))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    n = known.count()
    pick = F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 20))
    if n > sample_rows:
        known = known.filter(pick < int((1 << 20) * sample_rows / n))
    known = known.withColumn("part", F.pmod(F.xxhash64(F.lit("toxicity part"), "doc_id"), F.lit(2)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").drop("doc_id")


def _prefixes(folded: str) -> set[str]:
    return {w[:n] for w in set(folded.split()) for n in PREFIX_LENGTHS if n <= len(w)}


def _candidates(rows: DataFrame, share: float) -> list[tuple]:
    """(entry, clean and toxic documents of part 0 and of part 1) of the entries that toxic rows
    have at least three times and over twice as often; the sample bounds their number."""
    names = ["clean0", "toxic0", "clean1", "toxic1"]
    schema = pa.schema([("entry", pa.string()), *((n, pa.int64()) for n in names)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in names]
        for batch in batches:
            for text, label, part in zip(*(c.to_pylist() for c in batch.columns)):
                counts[2 * part + label].update(_prefixes(fold(text)))
            if sum(map(len, counts)) > 500_000:
                yield from give(counts)
        yield from give(counts)

    def give(counts: list[Counter]) -> Iterator[pa.RecordBatch]:
        keys = list(set().union(*counts))
        for a in range(0, len(keys), 50_000):
            some = keys[a : a + 50_000]
            columns = [[c[k] for k in some] for c in counts]
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, [some, *columns])), schema=schema)
        for c in counts:
            c.clear()

    counted = (
        rows.select("text", "toxic", "part")
        .mapInArrow(count, "entry string, " + ", ".join(f"{n} long" for n in names))
        .groupBy("entry")
        .agg(*(F.sum(n).alias(n) for n in names))
    )
    toxic, clean = F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1")
    found = counted.filter((toxic >= 3) & (toxic * (1 - share) > 2 * share * clean)).select("entry", *names)
    return [tuple(r) for r in found.collect()]


def _lexicon(candidates: list[tuple[str, int, int]], clean: int, toxic: int) -> dict[str, float]:
    """Weights of the significant entries; of entries that say the same the longest stays."""
    share = toxic / (toxic + clean)
    rated = []
    for entry, c, t in candidates:
        if t >= 3 and t * clean > 2 * c * toxic:
            rate = t / (t + c)
            gain = t * math.log(rate / share) + (c * math.log((1 - rate) / (1 - share)) if c else 0.0)
            weight = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
            if gain > 10.0 and weight > 1.5:
                rated.append((-gain, -len(entry), entry, (t, c), weight))
    chosen: dict[str, float] = {}
    spoken: dict[str, set] = {}
    for _, _, entry, counts, weight in sorted(rated):
        if counts in spoken.get(entry, ()):
            continue  # a longer entry has the same documents
        shorter = (chosen.get(entry[:n]) for n in range(PREFIX_LENGTHS[0], len(entry)))
        if any(w is not None and w > weight - 0.3 for w in shorter):
            continue  # a shorter entry says as much
        chosen[entry] = weight
        for n in range(PREFIX_LENGTHS[0], len(entry)):
            spoken.setdefault(entry[:n], set()).add(counts)
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Newton steps for a logistic curve with a small ridge on the slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    beta = np.zeros(x.shape[1])
    beta[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta
        )
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 24_000,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> ToxicityModel:
    """A model from the labels (doc_id, toxic) outside the held-out fold; see the bounds above."""
    sample = materialize(labelled_rows(docs, labels, sample_rows), "toxicity-sample")
    counts = {(r.part, r.toxic): r["count"] for r in sample.groupBy("part", "toxic").count().collect()}
    n = [[counts.get((part, label), 0) for label in (0, 1)] for part in (0, 1)]
    seen = [n[0][0] + n[1][0], n[0][1] + n[1][1]]
    if not all(map(all, n)):
        share = math.log((seen[1] + 1e-9) / (seen[0] + 1e-9)) if sum(seen) else -60.0
        return ToxicityModel(curve=(max(-60.0, min(60.0, share)), 0.0, 0.0, 0.0))
    found = _candidates(sample, seen[1] / sum(seen))
    parts = [_lexicon([(r[0], r[1 + 2 * p], r[2 + 2 * p]) for r in found], *n[p]) for p in (0, 1)]
    whole = _lexicon([(r[0], r[1] + r[3], r[2] + r[4]) for r in found], *seen)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features of each part by the lexicon of the other part."""
        automata = [ToxicityModel(parts[1 - p], exceptions=exceptions).automaton() for p in (0, 1)]
        for batch in batches:
            texts, owns = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            x = [features(automata[p], t) for t, p in zip(texts, owns)]
            columns = [pa.array([v[i] for v in x], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["a", "b", "c", "toxic"])

    got = (
        sample.select("text", "toxic", "part")
        .mapInArrow(measure, "a double, b double, c double, toxic int")
        .toPandas()
    )
    curve = _logistic(got[["a", "b", "c"]].to_numpy(), got["toxic"].to_numpy(dtype=float))
    return ToxicityModel(whole, curve, exceptions)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in small_batches(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            values = [probability(model.curve, features(automaton, t)) for t in texts]
            yield replaced(batch, **{name: pa.array(values, pa.float64())})

    return docs.mapInArrow(run, with_fields(docs.schema, (name, "double")))


def without_toxic(docs: DataFrame, model: ToxicityModel, limit: float = SCORE_LIMIT) -> DataFrame:
    """The documents whose score is below ``limit``."""
    name = free_name(docs, "toxicity")
    return score(docs, model, name=name).filter(F.col(name) < limit).drop(name)
