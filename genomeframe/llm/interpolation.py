"""Deleted interpolation: word bigram, unigram and uniform estimates mixed by context frequency.

p(w | v) = l2 c(vw) / c(v) + l1 c(w) / N + l0 / (V + 1), with weights for each
bucket of the context's frequency (0, 1, 2-3, 4-7, ...). A fifth of the documents
is deleted from the counts to learn the weights: expectation-maximisation on
the events of that part under the counts of the rest. Scores use all training
counts. Every document ends with one end token, and starts in its context.

Scale. Documents are packed into chunks of ``chunk_bytes`` of text, written once
as compressed rows. A chunk sends each of its distinct n-grams (64-bit hashes)
once, with its count, to the bucket of that hash; a bucket adds up its n-grams and
answers each chunk with the totals, in the order asked. So a frequent n-gram
costs one entry per chunk, rows are never more than the chunks' distinct n-grams, nothing grows on the driver, no task holds more than
a chunk or a bucket, and the scores need no table of all n-grams in one place.
For the weights, events are counted in cells of a quarter octave of both
estimates, whose number is fixed; the iterations run over these cells, until no weight
moves by 1e-7 or for ``rounds``.

Cases: null and empty texts have the end token only; a null id counts as an
empty text in the fold; without training documents every token is unknown;
without a deleted part the weights are equal; repeated rows all count and get
equal scores; an empty table gives no rows. Other columns are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomeframe.llm.spans import ascii_words, lower_ascii, mix, span_hashes
from genomeframe.session import materialize

TRAIN, DELETED, HELD_OUT = 0, 1, 2
CONTEXTS = 33
#: Cells of a quarter octave down to 2**-40; the last one is for zero.
CELLS = 161
#: Distinct words, words, deleted words and distinct words of the rest.
FACTS = ["types", "tokens", "gone", "kept"]
_END = np.uint64(0x5851F42D4C957F2E)
_ONE = np.uint64(1)


def fold_of(doc_id: Column) -> Column:
    """0: counted, 1: counted and deleted for the weights, 2: held out (crc32 of the id mod 5 is 1)."""
    rest = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5
    return F.when(rest == 1, HELD_OUT).when(rest == 0, DELETED).otherwise(TRAIN)


def pack_chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows (chunk, fold, n_bytes, doc_ids, lengths, texts): documents of one fold, compressed."""
    schema = pa.schema(
        [
            ("chunk", pa.int64()), ("fold", pa.int32()), ("n_bytes", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("texts", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        made = 0
        open_chunks: dict[int, tuple[list, list]] = {}

        def close(fold: int) -> pa.RecordBatch:
            nonlocal made
            ids, texts = open_chunks.pop(fold)
            raw = b"".join(texts)
            row = [base + made, fold, len(raw), ids, [len(t) for t in texts], zstandard.compress(raw, 3)]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        size = {TRAIN: 0, DELETED: 0, HELD_OUT: 0}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                for doc_id, fold, text in zip(*(c.to_pylist() for c in part.columns)):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    ids, texts = open_chunks.setdefault(fold, ([], []))
                    ids.append(doc_id)
                    texts.append(raw)
                    size[fold] += len(raw)
                    if size[fold] >= chunk_bytes:
                        size[fold] = 0
                        yield close(fold)
        for fold in list(open_chunks):
            yield close(fold)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold_of(F.col("doc_id")).alias("fold"), "text")
    return rows.mapInArrow(
        run, "chunk long, fold int, n_bytes long, doc_ids array<long>, lengths array<long>, texts binary"
    )


class _Chunk:
    """The tokens of a chunk and its distinct n-gram keys (unigrams even, bigrams odd) in order."""

    def __init__(self, lengths: list[int], texts: bytes):
        offsets = np.append(0, np.cumsum(np.array(lengths, dtype=np.int64)))
        data = lower_ascii(np.frombuffer(zstandard.decompress(texts), dtype=np.uint8))
        starts, ends, first = ascii_words(data, offsets)
        hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
        words = np.insert(hashes, first[1:], _END)
        self.bounds = first + np.arange(len(first))  # the first token of each document, and the end
        context = np.empty_like(words)
        context[1:] = words[:-1]
        context[self.bounds[:-1]] = _END  # a document starts where the last one ended
        single = words & ~_ONE
        pair = mix(context * np.uint64(0x9E3779B97F4A7C15) + mix(words)) | _ONE
        self.keys, inverse, self.counts = np.unique(
            np.concatenate([single, pair]), return_inverse=True, return_counts=True
        )
        self.word, self.pair = inverse[: len(words)], inverse[len(words) :]
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        end = np.searchsorted(self.keys, _END & ~_ONE)
        before[self.bounds[:-1]] = end
        self.before = before


def _bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of the sorted keys starts (buckets + 1 places)."""
    borders = [(i << 64) // buckets for i in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(borders, dtype=np.uint64)), [len(keys)]])


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences in as few bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps[1:].max()).bit_length() + 7) // 8) if len(keys) > 1 else 1
    low = steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return int(keys[0]).to_bytes(8, "little") + bytes([width]) + low.tobytes()


def _unpack_keys(packed: bytes) -> np.ndarray:
    width = packed[8]
    low = np.frombuffer(packed, dtype=np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(low) + 1, 8), dtype=np.uint8)
    steps[0] = np.frombuffer(packed[:8], dtype=np.uint8)
    steps[1:, :width] = low
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    for kind in ("<u1", "<u2", "<u4", "<u8"):
        if not len(counts) or counts.max() <= np.iinfo(kind).max:
            return kind[1:].encode() + counts.astype(kind).tobytes()
    raise AssertionError


def _unpack_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<" + packed[:2].decode(), offset=2).astype(np.int64)


def _asked(chunks: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, chunk, fold, keys, counts): the distinct n-grams of each chunk by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, fold, lengths, texts = (c[row].as_py() for c in batch.columns)
                found = _Chunk(lengths, texts)
                at = _bucket_bounds(found.keys, buckets)
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int64()),
                        pa.array([chunk] * len(full), pa.int64()),
                        pa.array([fold] * len(full), pa.int32()),
                        pa.array([_pack_keys(found.keys[at[b] : at[b + 1]]) for b in full], pa.binary()),
                        pa.array([_pack_counts(found.counts[at[b] : at[b + 1]]) for b in full], pa.binary()),
                    ],
                    ["bucket", "chunk", "fold", "keys", "counts"],
                )

    return chunks.select("chunk", "fold", "lengths", "texts").mapInArrow(
        run, "bucket long, chunk long, fold int, keys binary, counts binary"
    )


def _answered(asked: DataFrame) -> DataFrame:
    """Rows (chunk, bucket, totals, deleted), and per bucket one of chunk -1 with its ``FACTS``."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        chunks, folds = table["chunk"].to_pylist(), table["fold"].to_pylist()
        keys = [_unpack_keys(k.as_buffer().to_pybytes()) for k in table["keys"]]
        sizes = [len(k) for k in keys]
        counts = np.concatenate([_unpack_counts(c.as_buffer().to_pybytes()) for c in table["counts"]])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        owner = np.repeat(np.array(folds), sizes)
        total = np.bincount(inverse, np.where(owner == HELD_OUT, 0, counts), len(distinct)).astype(np.int64)
        gone = np.bincount(inverse, np.where(owner == DELETED, counts, 0), len(distinct)).astype(np.int64)
        single = (distinct & _ONE) == 0
        facts = [(single & (total > 0)).sum(), total[single].sum(), gone[single].sum(), (single & (total > gone)).sum()]
        ends = np.cumsum(sizes)
        parts = [inverse[e - s : e] for e, s in zip(ends, sizes)]
        empty = _pack_counts(np.zeros(0, dtype=np.int64))
        return pa.table(
            {
                "chunk": pa.array([*chunks, -1], pa.int64()),
                "bucket": pa.array([bucket] * (len(chunks) + 1), pa.int64()),
                "fold": pa.array([*folds, -1], pa.int32()),
                "totals": pa.array(
                    [*(_pack_counts(total[p]) for p in parts), empty], pa.binary()
                ),
                "deleted": pa.array(
                    [*(_pack_counts(gone[p]) if f == DELETED else empty for p, f in zip(parts, folds)), empty],
                    pa.binary(),
                ),
            }
            | {name: pa.array([None] * len(chunks) + [int(n)], pa.int64()) for name, n in zip(FACTS, facts)}
        )

    numbers = ", ".join(f"{name} long" for name in FACTS)
    return asked.groupBy("bucket").applyInArrow(
        run, f"chunk long, bucket long, fold int, totals binary, deleted binary, {numbers}"
    )


def _opened(left: pa.Table, right: pa.Table):
    """(row, chunk, totals, deleted) of one chunk and its answers."""
    row = left.to_pylist()[0]
    answers = right.sort_by("bucket")
    totals, gone = (
        np.concatenate([_unpack_counts(v.as_buffer().to_pybytes()) for v in answers[name]])
        for name in ("totals", "deleted")
    )
    return row, _Chunk(row["lengths"], row["texts"]), totals, gone


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for none, else one more than the whole binary logarithm."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], CONTEXTS - 1)


def _cell(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        cell = np.floor(-4 * np.log2(p))
    return np.where(p > 0, np.minimum(cell, CELLS - 2), CELLS - 1).astype(np.int64)


def _events(chunks: DataFrame, answers: DataFrame, tokens: int) -> pd.DataFrame:
    """Counts of the deleted part's events by context bucket and cells of both estimates."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        _, chunk, totals, gone = _opened(left, right)
        rest = totals - gone
        context = rest[chunk.before]
        p2 = rest[chunk.pair] / np.maximum(context, 1)
        p1 = rest[chunk.word] / max(tokens, 1)
        cell = (context_bucket(context) * CELLS + _cell(p2)) * CELLS + _cell(p1)
        found, at, n = np.unique(cell, return_inverse=True, return_counts=True)
        logs = [np.bincount(at, np.log(np.where(p > 0, p, 1.0)), len(found)) for p in (p2, p1)]
        return pa.table(dict(zip(names, (pa.array(v, t) for v, t in zip([found, n, *logs], kinds)))))

    names, kinds = ["cell", "n", "log2", "log1"], [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    parts = chunks.filter(F.col("fold") == DELETED).groupBy("chunk")
    return (
        parts.cogroup(answers.filter(F.col("fold") == DELETED).groupBy("chunk"))
        .applyInArrow(run, "cell long, n long, log2 double, log1 double")
        .groupBy("cell")
        .agg(*(F.sum(c).alias(c) for c in names[1:]))
        .toPandas()
    )


def learn_weights(cells: pd.DataFrame, uniform: float, rounds: int = 60) -> np.ndarray:
    """(contexts, 3) weights of bigram, unigram and uniform by expectation-maximisation."""
    weights = np.full((CONTEXTS, 3), 1 / 3)
    weights[0] = (0.0, 0.5, 0.5)
    if not len(cells):
        return weights
    cell, n = cells["cell"].to_numpy(), cells["n"].to_numpy(dtype=float)
    bucket = cell // (CELLS * CELLS)
    estimates = np.column_stack(
        [
            np.where(cell // CELLS % CELLS < CELLS - 1, np.exp(cells["log2"].to_numpy() / n), 0.0),
            np.where(cell % CELLS < CELLS - 1, np.exp(cells["log1"].to_numpy() / n), 0.0),
            np.full(len(cell), uniform),
        ]
    )
    for _ in range(rounds):
        share = weights[bucket] * estimates
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.column_stack([np.bincount(bucket, share[:, i], CONTEXTS) for i in range(3)])
        sums += weights * 0.5 + 1e-3 * np.array([0.0, 1.0, 1.0])  # rare buckets stay smooth and no lower weight is 0
        new = sums / sums.sum(axis=1, keepdims=True)
        if np.abs(new - weights).max() < 1e-7:
            return new
        weights = new
    return weights


def score(docs: DataFrame, chunk_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Scores of all documents (doc_id, text) under the model learned from the training fold.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams
    with half a count added) and score. ``bucket_bytes``: bytes of text for which
    there is one bucket of n-grams.
    """
    chunks = materialize(pack_chunks(docs, chunk_bytes), "lm-chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    answers = materialize(_answered(_asked(chunks, buckets)), "lm-counts")
    facts = answers.filter("chunk = -1").agg(*(F.sum(name) for name in FACTS)).first()
    types, tokens, gone, kept = (n or 0 for n in facts)
    answers = answers.filter("chunk >= 0").drop(*FACTS)
    weights = learn_weights(_events(chunks, answers, tokens - gone), 1 / (kept + 1))
    uniform = 1 / (types + 1)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, chunk, totals, _ = _opened(left, right)
        known = totals[chunk.word]
        context = totals[chunk.before]
        mixed = weights[context_bucket(context)]
        p = mixed[:, 0] * (totals[chunk.pair] / np.maximum(context, 1))
        p += mixed[:, 1] * (known / max(tokens, 1)) + mixed[:, 2] * uniform
        base = np.log10((known + 0.5) / (tokens + 0.5 * (types + 1)))
        first = chunk.bounds[:-1]
        n = len(first)
        values = [
            row["doc_ids"],
            [row["fold"] == HELD_OUT] * n,
            np.diff(chunk.bounds),
            np.add.reduceat((known > 0).astype(np.int64), first),
            [tokens] * n,
            np.add.reduceat(base, first),
            np.add.reduceat(np.log10(p), first),
        ]
        return pa.table({k: pa.array(v, t) for k, v, t in zip(names, values, kinds)})

    return (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(
            run,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
            " base_score double, score double",
        )
    )
