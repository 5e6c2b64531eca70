"""Quartile bucket digests: locality-sensitive fingerprints of whole texts.

Every window of five bytes gives six byte triplets (all that hold its newest
byte); each is hashed to one of 256 buckets. The digest is one byte of
logarithmic length and two bits per bucket, saying in which quartile of the bucket
counts its count lies. Two digests differ by the sum of quartile steps plus the
length steps; the likeness is 1 for equal digests and 0 at the greatest
difference.

Cases: null text is empty; a text under five bytes is padded with zero bytes to
one window, so that every text has a digest; equal texts have equal digests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomeframe.llm.common import replaced, small_batches, with_fields
from genomeframe.llm.spans import mix
from genomeframe.session import materialize

BUCKETS = 256
LENGTH_STEP = math.log(1.1)
MOST_LENGTH = 40  # length steps that count as wholly different
#: A length step weighs as much as this many quartile steps.
LENGTH_WEIGHT = 2
#: Places of the two older bytes of each triplet in a window, counted back from the newest.
PAIRS = tuple((a, b) for a in range(1, 5) for b in range(a + 1, 5))
_TABLES = [mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (k + 1))) for k in range(3)]
_FIRST = [(t >> np.uint64(40)).astype(np.uint16) for t in _TABLES]
_CHUNK = 1 << 18


def _salted(position: int) -> list[np.ndarray]:
    return [np.roll(t, 37 * position + k) for k, t in enumerate(_FIRST)]


_SALTED = [_salted(i) for i in range(len(PAIRS))]


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """How many hashed triplets of the bytes fall in each bucket."""
    if len(data) < 5:
        data = np.concatenate([data, np.zeros(5 - len(data), dtype=np.uint8)])
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(4, len(data), _CHUNK):
        part = data[start - 4 : start + _CHUNK]
        n = len(part) - 4
        for (a, b), (x, y, z) in zip(PAIRS, _SALTED):
            h = x[part[4:]] + y[part[4 - a : 4 - a + n]] * np.uint16(3) + z[part[4 - b : 4 - b + n]] * np.uint16(7)
            h ^= h >> np.uint16(7)
            h *= np.uint16(0x9E3B)
            counts += np.bincount(h >> np.uint16(8), minlength=BUCKETS)
    return counts


def digest(text: bytes) -> bytes:
    """Length byte and 64 bytes of quartile codes."""
    counts = bucket_counts(np.frombuffer(text, dtype=np.uint8))
    ordered = np.sort(counts)
    q1, q2, q3 = ordered[BUCKETS // 4 - 1], ordered[BUCKETS // 2 - 1], ordered[3 * BUCKETS // 4 - 1]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    steps = min(255, int(math.log(len(text) + 1) / LENGTH_STEP))
    return bytes([steps]) + packed.astype(np.uint8).tobytes()


def difference(a: bytes, b: bytes) -> int:
    """Quartile steps between two digests plus weighted, bounded length steps."""
    x, y = (np.frombuffer(v[1:], dtype=np.uint8) for v in (a, b))
    total = sum(
        int(np.abs(((x >> s) & 3).astype(np.int16) - ((y >> s) & 3)).sum()) for s in (0, 2, 4, 6)
    )
    return total + LENGTH_WEIGHT * min(abs(a[0] - b[0]), MOST_LENGTH)


MOST = 3 * BUCKETS + LENGTH_WEIGHT * MOST_LENGTH


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - difference(a, b) / MOST


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the digest of every whole text, in hexadecimal letters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            values = batch.column(batch.schema.get_field_index(text)).to_pylist()
            made = [digest((v or "").encode("utf-8", "surrogatepass")).hex() for v in values]
            yield replaced(batch, **{name: pa.array(made, pa.string())})

    return docs.mapInArrow(run, with_fields(docs.schema, (name, "string")))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of the next text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def successor_blocks(
    docs: DataFrame, block_rows: int = 1_000, most_blocks: int = 100_000
) -> DataFrame:
    """Rows (block, doc_id, text, extra) in which each block of ascending ids ends with its successor.

    Block borders are ids of the table, one for about ``block_rows`` rows (more
    where that would be over ``most_blocks`` borders, which go to every task); the
    row at a border is also given, as ``extra``, to the block before it, and the
    first row of all to the last block. One shuffle of the texts.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = materialize(slim.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")), "digest-ids")
    n = ids.count()
    if not n:
        return spark.createDataFrame([], "block long, doc_id long, text string, extra int")
    block_rows = max(block_rows, n // most_blocks + 1)
    part = F.monotonically_increasing_id()
    ordered = ids.repartitionByRange(max(1, n // 1_000_000 + 1), "doc_id").sortWithinPartitions("doc_id")
    numbered = materialize(ordered.select("doc_id", part.alias("at")), "digest-order")
    row = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    borders = (
        numbered.filter(row % block_rows == 0)
        .select("doc_id")
        .distinct()
        .orderBy("doc_id")
        .toPandas()["doc_id"]
        .to_numpy(dtype=np.int64)
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            block = np.searchsorted(borders, ids, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int64()), batch.column(0), batch.column(1), pa.array(np.zeros(len(ids)), pa.int32())],
                ["block", "doc_id", "text", "extra"],
            )
            at = np.flatnonzero(ids == borders[np.maximum(block, 0)])
            if len(at):
                rows = batch.take(pa.array(at))
                before = (block[at] - 1) % len(borders)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(before, pa.int64()), rows.column(0), rows.column(1), pa.array(np.ones(len(at)), pa.int32())],
                    ["block", "doc_id", "text", "extra"],
                )

    return slim.mapInArrow(deal, "block long, doc_id long, text string, extra int")


def edit_report(docs: DataFrame) -> DataFrame:
    """Per document its digest, the digest of its edited text, and how like they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. The next document follows in ascending doc_id (null
    first, equal ids by text); the last is followed by the first.
    """
    blocks = successor_blocks(docs)
    # blocks are small, so several lie in a partition; a task holds two neighbouring texts at a time
    spread = blocks.repartition("block").sortWithinPartitions("block", "extra", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    schema = pa.schema(list(zip(names, kinds)))

    def compare(one: tuple, following: tuple) -> tuple:
        doc_id, text, own = one
        changed = edited(text, following[1]).encode("utf-8", "surrogatepass")
        other = digest(changed)
        return (
            doc_id,
            len(text),
            hashlib.sha256(changed).hexdigest(),
            own.hex(),
            other.hex(),
            likeness(own, other),
            likeness(own, following[2]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_block, closed = None, None, True
        for batch in small_batches(batches, 500):
            out = []
            columns = (batch.column(i).to_pylist() for i in range(4))
            for block, doc_id, text, extra in zip(*columns):
                if extra and block == held_block and closed:
                    continue  # a further row of the border's id
                row = (doc_id, text, digest(text.encode("utf-8", "surrogatepass")))
                if block == held_block and not closed:
                    out.append(compare(held, row))
                held, held_block, closed = row, block, bool(extra)
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return spread.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double",
    )
