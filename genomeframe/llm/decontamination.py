"""Benchmark passages in documents by a prefix-filtered set join.

Words are lower-cased in ASCII. A window is ``width`` consecutive words of a benchmark item, or all
words of a shorter one; a window's tokens are its shingles of five words (of all its words,
if it has fewer). A document that holds the window holds every token of it, so one
token is a sufficient prefix: the rarest. Three steps:

1. Count the tokens in the documents. A bitmap of fixed size (``2**CELL_BITS`` bits of the token
   hashes) drops nearly all other shingles where the text is read; a join with the tokens drops
   the rest. Windows with a token that no document has are out.
2. Read the documents again with a bitmap of the prefix tokens only. What passes leaves
   with its position and the words around it, once for each distinct text.
3. Join with the prefixes; positions bound where the window would begin and end, and
   the words around are compared with it as text. Hits are merged to spans.

The bitmap is the only thing sent to all tasks, whatever the size of the benchmark;
a larger benchmark only drops fewer shingles early. A frequent passage joins by its
rarest token, and copies of a text are searched once.

Cases: null texts have no words; items without words have no window; equal windows of
several items count for each; repeated items are one; null item ids are left out of
lists, but their windows hit; repeated rows and null doc_ids give their own rows; an empty
benchmark leaves every document clean. Texts of one MD5 digest count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomeframe.llm.spans import ascii_words, joined, mix, slices, span_hashes
from genomeframe.session import materialize

WIDTH, SHINGLE, CELL_BITS = 10, 5, 24
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of words as they are (A-Z lower-cased), all others as spaces.
_BYTES = np.full(256, 32, dtype=np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _BYTES[_a:_b] = np.arange(_a, _b)
_BYTES[65:91] = np.arange(97, 123)
_PLACES = mix(np.arange(31, 31 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, n, items): the distinct windows, their words and the ids of their items."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(
        F.col("item_id").cast("string").alias("item"),
        F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"),
    ).filter(F.size("words") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    cut = words.select("item", "words", F.explode(at).alias("at")).select(
        "item", F.slice("words", F.col("at"), F.lit(width)).alias("cut")
    )
    return cut.groupBy(F.array_join("cut", " ").alias("window"), F.size("cut").alias("n")).agg(
        F.collect_set("item").alias("items")
    )


class Words:
    """The words of texts as hashes, and as text where they are asked for."""

    def __init__(self, texts: list[bytes]):
        raw, offsets = joined(texts)
        self.data = _BYTES[raw]
        self.starts, self.ends, self.first = ascii_words(self.data, offsets)
        self.hashes = span_hashes(self.data, self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)

    def shingles(self, size: int) -> np.ndarray:
        """A hash of the ``size`` words from each word on, over text ends as well; too few words: none."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return self.hashes[:0]
        out = np.full(n, size, dtype=np.uint64)
        for j in range(size):
            out += self.hashes[j : j + n] * _PLACES[j]
        return mix(out)

    def places(self, size: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, hash) of the shingles inside one text whose bit is set."""
        values = self.shingles(size)
        cell = values >> np.uint64(64 - CELL_BITS)
        hit = np.flatnonzero((bitmap[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1))
        text = np.searchsorted(self.first, hit, side="right") - 1
        inside = hit + size <= self.first[text + 1]
        hit, text = hit[inside], text[inside]
        return text, hit, values[hit]

    def joined(self, first: int, end: int) -> str:
        spans = zip(self.starts[first:end].tolist(), self.ends[first:end].tolist())
        return b" ".join(self.data[a:b].tobytes() for a, b in spans).decode("utf-8", "surrogatepass")


def _tokens(cut: DataFrame) -> DataFrame:
    """(window, n, size, offset, hash): every token of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Words([text.encode("utf-8", "surrogatepass")])
                made.append(words.shingles(min(n, SHINGLE)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.list_(pa.int64()))], ["window", "n", "hashes"]
            )

    hashed = cut.select("window", "n").mapInArrow(run, "window string, n int, hashes array<long>")
    return hashed.select(
        "window", "n", F.least("n", F.lit(SHINGLE)).alias("size"), F.posexplode("hashes").alias("offset", "hash")
    )


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for each value of the upper ``CELL_BITS`` bits of ``hash``; at most ``2**CELL_BITS / 64`` rows come in."""
    cell = F.shiftrightunsigned("hash", 64 - CELL_BITS)
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    rows = (
        hashes.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("at")).agg(F.bit_or(bit).alias("bits"))
    ).toPandas()
    out = np.zeros(1 << (CELL_BITS - 6), dtype=np.uint64)
    out[rows["at"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _sizes(tokens: DataFrame) -> list[int]:
    """The sizes of tokens: at most ``SHINGLE`` values."""
    return sorted(r["size"] for r in tokens.select("size").distinct().collect())


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _counts(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(hash, count) of the tokens that occur in the documents."""
    sizes, bits = _sizes(tokens), bitmap(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0).to_pylist()):
                words = Words(texts)
                found = [words.places(size, bits)[2] for size in sizes]
                values, n = np.unique(np.concatenate(found), return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["hash", "n"])

    if not sizes:
        return tokens.select("hash", F.lit(0).cast("long").alias("count"))
    seen = docs.select(_text(docs).alias("text")).mapInArrow(run, "hash long, n long")
    counts = seen.groupBy("hash").agg(F.sum("n").alias("count"))
    return counts.join(tokens.select("hash").distinct(), "hash", "left_semi")


def prefixes(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, n, items, size, offset, hash): the rarest token of each window whose tokens all occur."""
    cut = materialize(windows(benchmark, width), "windows")
    tokens = materialize(_tokens(cut), "window-tokens")
    counts = materialize(_counts(docs, tokens), "token-counts")
    rarest = F.min(F.struct("count", "offset", "hash")).alias("rarest")
    chosen = (
        tokens.join(counts, "hash", "left")
        .groupBy("window", "n", "size")
        .agg(rarest, F.min(F.col("count").isNotNull()).alias("all_occur"))
        .filter("all_occur")
    )
    return chosen.join(cut.select("window", "items"), "window").select(
        "window", "n", "items", "size", "rarest.offset", "rarest.hash"
    )


def _found(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n_words, found) per row; ``found`` has the prefix tokens with the words around."""
    sizes, bits = _sizes(chosen), bitmap(chosen)
    one = pa.struct([("hash", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("around", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found = [], []
            for _, texts in slices(batch.column(2).to_pylist()):
                words = Words(texts)
                here: list[list[dict]] = [[] for _ in texts]
                for size in sizes:
                    for text, at, value in zip(*(x.tolist() for x in words.places(size, bits))):
                        first, end = int(words.first[text]), int(words.first[text + 1])
                        begin = max(first, at - (width - size))
                        around = words.joined(begin, min(end, at + width))
                        value = value - (1 << 64) if value >> 63 else value
                        here[text].append({"hash": value, "at": at - first, "before": at - begin, "around": around})
                n_words += np.diff(words.first).tolist()
                found += here
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n_words, pa.int64()), pa.array(found, pa.list_(one))],
                ["doc_id", "key", "n_words", "found"],
            )

    text = _text(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.md5(text).alias("key"), text.alias("text"))
    kind = "array<struct<hash:long,at:long,before:int,around:string>>"
    return rows.mapInArrow(run, f"doc_id long, key string, n_words long, found {kind}")


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, spans (start and end words of what
    is hit) and items (their ids as strings, in order)."""
    chosen = materialize(prefixes(docs, benchmark, width), "prefixes")
    rows = materialize(_found(docs, chosen, width), "decontamination-found")
    texts = rows.filter(F.size("found") > 0).dropDuplicates(["key"])
    candidates = texts.select("key", "n_words", F.inline("found")).join(chosen, "hash")
    start = F.col("at") - F.col("offset")
    same = F.expr("array_join(slice(split(around, ' '), before - offset + 1, n), ' ') = window")
    hits = (
        candidates.withColumn("start", start)
        .withColumn("end", start + F.col("n"))
        .filter((F.col("start") >= 0) & (F.col("end") <= F.col("n_words")))
        .filter(same)
        .select("key", "start", "end", "items")
    )
    in_text = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    apart = (reach.isNull() | (F.col("start") > reach)).cast("int")
    spans = (
        hits.withColumn("apart", apart)
        .withColumn("span", F.sum("apart").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "span")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("items").alias("items"))
    )
    per_text = spans.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.flatten(F.collect_list("items"))))).alias("items"),
    )
    return rows.select("doc_id", "key", "n_words").join(per_text, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return scan(docs, benchmark, width).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


#: The same rows by comparing every window of every document as text.
ORACLE = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
part AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (
  SELECT r, i, part.n, item_id FROM part JOIN win ON win.n = part.n AND array_to_string(w[i:i + part.n - 1], ' ') = win.s),
covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit))
  GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
