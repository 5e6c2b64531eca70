"""Spelling variants: words one edit apart, found by a bit-sliced position index.

Two words are near if they differ by exactly one inserted, deleted or replaced code
point. Take the longer length L of such a pair and cut the positions of its longer word
into two ranges: the first difference lies in one of them, and the words agree
outside it. So every word stands in four groups: for L its own length and one more, and for either
range the group of all words with the same letters outside. Inside a group the words
of length L are the index: for each position of the range and each letter a bitset
over them. The words of the group are the queries; for all queries and all index words at once, a
set without errors and a set with one error are carried along the range: a replaced letter
compares the same position, an inserted one the position after it (shifted bitsets).
An error is only let in where the zero-error set first fails, so a pair is found in one group
and once.

A group of over ``GROUP_WORDS`` words is cut again at the middle of its range, until it
is smaller or its range is one letter (then it holds one word a letter and
one more). So groups stay bounded, whatever the vocabulary, and no pair is lost or emitted:
tasks return a count and the best near word of each word in each group.

Cases: null texts have no words; a null doc_id is an empty one; repeated rows count again;
of equally frequent near words the smallest in code-point order is the best; words without
near words have ``n_near`` 0 and null ``form``; an empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomeframe.session import materialize

#: Words of a group before it is cut again; words that are worked on together.
GROUP_WORDS, BLOCK_WORDS, QUERIES = 4_096, 1_024, 512
#: Code points of a word, and its occurrences, at least.
SHORTEST, FEWEST = 6, 5
#: A near word is a word's form if it is so many times as frequent.
RATIO = 5
LETTERS = "A-Za-zÀ-ÿ"
GROUP = ["length", "low", "high", "key"]


def lowered(column: Column) -> Column:
    """A-Z as a-z; every other letter stays."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def letter_runs(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """(doc_id, run): the lower-cased maximal letter runs of at least ``shortest`` code points."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    found = docs.select(F.col("doc_id"), F.explode(runs).alias("run"))
    return found.select("doc_id", lowered(F.col("run")).alias("run"))


def misspelt(runs: DataFrame, every: int = 199) -> DataFrame:
    """The runs, some with a code point less: those whose hash with the document ``every`` divides."""
    marked = runs.withColumn(
        "_hash", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    )
    without = F.expr(
        "concat(left(run, cast(_hash % char_length(run) as int)), "
        "substring(run, cast(_hash % char_length(run) as int) + 2))"
    )
    return marked.withColumn("run", F.when(F.col("_hash") % every == 0, without).otherwise(F.col("run"))).drop("_hash")


def vocabulary(runs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n): the runs of at least ``shortest`` code points that occur ``fewest`` times or more."""
    long = runs.filter(F.char_length("run") >= shortest)
    return long.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)


def _keyed(rows: DataFrame) -> DataFrame:
    """With ``key``: the letters outside the range of the longer length, the gap marked."""
    shorter = F.col("length") - F.char_length("word")
    key = F.concat(
        F.expr("left(word, low)"),
        F.lit("-"),
        F.col("word").substr(F.col("high") + 1 - shorter, F.char_length("word")),
    )
    return rows.select("word", "n", "length", "low", "high", key.alias("key"))


def _halves(rows: DataFrame) -> DataFrame:
    """Every row for both halves of its range."""
    middle = F.expr("(low + high) div 2").cast("int")
    both = F.array(
        F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high"))
    )
    cut = rows.select("word", "n", "length", F.explode(both).alias("range"))
    return _keyed(cut.select("word", "n", "length", "range.low", "range.high"))


def grouped(words: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """(word, n, length, low, high, key): every word in its groups, none of over ``most`` words
    unless its range is one letter."""
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("length"))
    rows = rows.select("*", F.lit(0).alias("low"), F.col("length").alias("high"))
    todo, done = materialize(_halves(rows), "spelling-groups"), None
    while True:
        large = todo.groupBy(*GROUP).count().filter((F.col("count") > most) & (F.col("high") - F.col("low") > 1))
        large = materialize(large.select(*GROUP), "spelling-large")
        if large.limit(1).count() == 0:
            return todo if done is None else done.unionByName(todo)
        fit = todo.join(large, GROUP, "left_anti")
        done = fit if done is None else done.unionByName(fit)
        todo = materialize(_halves(todo.join(large, GROUP, "left_semi")), "spelling-groups")


def _bitsets(cells: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One bitset (a row of 64-bit words) over ``cells`` for each value, and an empty one."""
    wide = -(-len(cells) // 64) * 64
    bits = np.zeros((len(values) + 1, wide), dtype=bool)
    bits[:-1, : len(cells)] = cells[None, :] == values[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class PositionIndex:
    """Bitsets over words of one length for every position of a range and every letter."""

    def __init__(self, codes: np.ndarray, low: int, high: int):
        self.low, self.high = low, high
        self.letters = np.unique(codes[:, low:high])
        self.sets = [_bitsets(codes[:, p], self.letters) for p in range(low, high)]

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each letter the words with it at the position."""
        place = np.searchsorted(self.letters, letters)
        known = place < len(self.letters)
        known[known] = self.letters[place[known]] == letters[known]
        return self.sets[position - self.low][np.where(known, place, len(self.letters))]

    def replaced(self, queries: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """For queries as long as the words: those of ``mask`` with one other letter in the range."""
        zero, one = mask, np.zeros_like(mask)
        for p in range(self.low, self.high):
            hit = self.at(p, queries[:, p])
            one = (one & hit) | (zero & ~hit)
            zero = zero & hit
        return one

    def longer(self, queries: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """For queries one letter shorter: the words of ``mask`` that have one more, first
        differing inside the range."""
        zero, one = mask, np.zeros_like(mask)
        for p in range(self.low, self.high - 1):
            here, shifted = self.at(p, queries[:, p]), self.at(p + 1, queries[:, p])
            one = (one | (zero & ~here)) & shifted
            zero = zero & here
        last = self.high - 1
        if last < queries.shape[1] and queries[:, last].any():  # the letter after the range; 0 pads
            zero = zero & ~self.at(last, queries[:, last])
        return one | zero


def _bits(sets: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(sets.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def near_words(
    words: list[str], counts: np.ndarray, groups: np.ndarray, length: int, low: int, high: int
) -> tuple[np.ndarray, np.ndarray]:
    """The number of near words of each word in its group, and the position of the best (or -1)."""
    order = np.array(sorted(range(len(words)), key=lambda i: (-counts[i], words[i])), dtype=np.int64)
    codes = np.array([words[i] for i in order], dtype=f"<U{length}").view(np.uint32).reshape(len(order), length)
    is_long = codes[:, length - 1] != 0
    group = groups[order]
    found, best = np.zeros(len(order), dtype=np.int64), np.full(len(order), len(order), dtype=np.int64)
    rows = np.flatnonzero(is_long)
    if len(rows):
        index = PositionIndex(codes[rows], low, high)
        kinds = np.unique(group)
        own = _bitsets(group[rows], kinds)
        for queries, search in ((rows, index.replaced), (np.flatnonzero(~is_long), index.longer)):
            for start in range(0, len(queries), QUERIES):
                some = queries[start : start + QUERIES]
                hits = _bits(search(codes[some], own[np.searchsorted(kinds, group[some])]), len(rows))
                n = hits.sum(axis=1)
                found[some] += n
                first = np.where(n > 0, rows[hits.argmax(axis=1)], len(order))
                best[some] = np.minimum(best[some], first)
                if search == index.longer:
                    n = hits.sum(axis=0)
                    found[rows] += n
                    first = np.where(n > 0, some[hits.argmax(axis=0)], len(order))
                    best[rows] = np.minimum(best[rows], first)
    n_near, at = np.empty_like(found), np.empty_like(best)
    n_near[order] = found
    at[order] = np.where(best < len(order), order[np.minimum(best, len(order) - 1)], -1)
    return n_near, at


def _near_in_groups(rows: DataFrame) -> DataFrame:
    """(word, n, n_near, near): per word and group, ``near`` being the best near word there."""
    kind = "word string, n long, n_near long, near struct<less:long,word:string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def give(block: list[tuple]) -> pa.RecordBatch:
            words, counts = [r[4] for r in block], np.array([r[5] for r in block], dtype=np.int64)
            cuts = np.array([True, *(a[3] != b[3] for a, b in zip(block, block[1:]))])
            n_near, at = near_words(words, counts, np.cumsum(cuts), *block[0][:3])
            near = [None if i < 0 else {"less": -int(counts[i]), "word": words[i]} for i in at.tolist()]
            shape = pa.struct([("less", pa.int64()), ("word", pa.string())])
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(counts), pa.array(n_near), pa.array(near, shape)],
                ["word", "n", "n_near", "near"],
            )

        last: tuple = ()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                new_group = row[:4] != last
                if held and new_group and (row[:3] != last[:3] or len(held) >= BLOCK_WORDS):
                    yield give(held)
                    held = []
                held.append(row)
                last = row[:4]
        if held:
            yield give(held)

    dealt = rows.select(*GROUP, "word", "n").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(run, kind)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word of each chain, by doubling."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(roots.join(further, "root", "left"), "spelling-roots")
        roots = step.select("word", F.coalesce("further", "root").alias("root"))
        if not step.filter("further is not null").limit(1).count():
            return roots


def variants(words: DataFrame, ratio: int = RATIO, most: int = GROUP_WORDS) -> DataFrame:
    """Per row of ``words`` (distinct word, n): word, n, n_near, form, form_n and root.

    ``form`` is the near word of largest n if that is at least ``ratio`` times the
    word's own; ``root`` is where its chain of forms ends.
    """
    found = _near_in_groups(grouped(words, most))
    per_word = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))
    is_form = -F.col("near.less") >= ratio * F.col("n")
    named = per_word.select(
        "word",
        "n",
        "n_near",
        F.when(is_form, F.col("near.word")).alias("form"),
        F.when(is_form, -F.col("near.less")).alias("form_n"),
    )
    named = materialize(named, "spelling-forms")
    roots = _roots(named.filter("form is not null"))
    return named.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
