"""Token-ID files: flat unsigned integers plus 64-bit document offsets.

A shard is three flat little-endian files: ``.bin`` (ids, 16 or 32 bits by the
size of the vocabulary), ``.off`` (64-bit token offsets inside the shard, one
more than documents) and ``.doc`` (64-bit document ids). Documents lie in
ascending order of ``doc_id`` over the shards; a shard's base, the number of ids
before it, is the prefix sum of the shard sizes.

Writing is one shuffle: texts are ranged by ``doc_id`` and every task encodes
and writes its own shard, under a name of its attempt that is renamed when the
shard is complete, so a lost executor or a speculative copy leaves no half
shard. Only one row per shard reaches the driver. Reading maps the files.

Cases: null text is empty and has only the end id; repeated ids are all
written, ordered by text; a null id comes first and is stored as the smallest
64-bit value; an empty table gives no shard. Other columns are not stored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomeframe.llm.spans import SpanCache, joined, slices, take_ranges

NULL_ID = -(1 << 63)
#: Fixed value: the pattern by which byte-level BPE vocabularies of this kind cut text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: UTF-8 forms of the white space beyond ASCII.
WIDE_SPACES = tuple(
    chr(c).encode()
    for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ALNUM = np.array([bytes([b]).isalnum() for b in range(256)])
_PUNCTUATION = np.array([32 < b < 127 for b in range(256)]) & ~_ALNUM
_SPACE_LEADS = np.isin(np.arange(256), [w[0] for w in WIDE_SPACES])


def _spaces(data: np.ndarray) -> np.ndarray:
    """Marks every byte of a white-space character."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    leads = np.flatnonzero(_SPACE_LEADS[data])
    for wide in WIDE_SPACES:
        at = leads[leads <= len(data) - len(wide)]
        for i, b in enumerate(wide):
            at = at[data[at + i] == b]
        for i in range(len(wide)):
            space[at + i] = True
    return space


class ByteLevelEncoder:
    """Encodes whole texts with a byte-level BPE of the ``tokenizers`` library.

    No token of such a vocabulary starts before white space and goes on in it,
    nor goes on from an ASCII letter or digit to ASCII punctuation, so a text is
    cut at these places; the library's model encodes every distinct cut once and
    repeats come from a bounded cache. A text that holds a special token's string
    goes through the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut = spec.get("pre_tokenizer") or {}
        plain = (
            spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE"
            and cut.get("type") == "ByteLevel"
            and not cut.get("add_prefix_space")
            and cut.get("use_regex", True)
        )
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = plain
        self.size = self.tokenizer.get_vocab_size()
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.pieces = regex.compile(PIECES)
        letters = _byte_letters()
        self.letters = letters
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.known: dict[bytes, list[int]] = {}
        self.cache = SpanCache(self._fill, self.dtype)

    def _piece(self, piece: bytes) -> list[int]:
        got = self.known.get(piece)
        if got is None:
            written = piece.decode("latin-1").translate(self.letters)
            got = self.known[piece] = [t.id for t in self.model.tokenize(written)]
        return got

    def _fill(self, spans: list[bytes]) -> tuple[list[int], list[int]]:
        if len(self.known) > 200_000:
            self.known.clear()
        ids: list[int] = []
        lengths = []
        piece_ids, find = self._piece, self.pieces.findall
        for span in spans:
            before = len(ids)
            if span[1:].isalpha() and (span[0] == 32 or span[:1].isalpha()):  # one piece
                ids += piece_ids(span)
            else:
                for piece in find(span.decode("utf-8", "surrogatepass")):
                    ids += piece_ids(piece.encode("utf-8", "surrogatepass"))
            lengths.append(len(ids) - before)
        return ids, lengths

    def whole(self, text: bytes) -> np.ndarray:
        found = self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False)
        return np.array(found.ids, dtype=self.dtype)

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each closed by ``end_id``, and the ids of each text."""
        data, offsets = joined(texts)
        apart = {
            i for i, t in enumerate(texts) if not self.plain or any(s in t for s in self.special)
        }
        space = _spaces(data)
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            cut[1:-1] = space[1:] & ~space[:-1] | _PUNCTUATION[data[1:]] & _ALNUM[data[:-1]]
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        begin, length = self.cache.lookup(data, starts, ends) if len(starts) else (starts, starts)
        first = np.searchsorted(starts, offsets)
        ids = take_ranges(self.cache.flat, begin, length)
        upto = np.append(0, np.cumsum(length))[first]
        counts = np.diff(upto)
        if apart:
            parts = [ids[upto[i] : upto[i + 1]] for i in range(len(texts))]
            for i in apart:
                parts[i] = self.whole(texts[i])
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
            upto = np.append(0, np.cumsum(counts))
        return np.insert(ids, upto[1:], end_id), counts + 1


@lru_cache(maxsize=2)
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


def local_path(uri: str) -> str:
    """The path of a folder that driver and executors mount alike; other stores are refused."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"token files are memory-mapped and need a mounted folder, not {uri}")
    return uri


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0
) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards below ``folder``; one row per shard.

    Returns shard, n_docs, n_tokens and base (ids before the shard), in order.
    """
    target = local_path(folder)
    os.makedirs(target, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level_encoder(tokenizer_path)
        task = TaskContext.get()
        stem = f"{target}/shard-{task.partitionId():08d}"
        trial = f"{target}/.{uuid.uuid4().hex}"
        n_docs = n_tokens = 0
        files = None
        for batch in batches:
            if not batch.num_rows:
                continue
            files = files or [open(f"{trial}{end}", "wb") for end in (".bin", ".off", ".doc")]
            doc_ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for first, texts in slices(batch.column(1).to_pylist()):
                ids, counts = encoder.encode(texts, end_id)
                files[0].write(ids.tobytes())
                offsets = n_tokens + np.cumsum(counts) - counts
                files[1].write(offsets.astype("<u8").tobytes())
                files[2].write(doc_ids[first : first + len(texts)].astype("<i8").tobytes())
                n_docs += len(texts)
                n_tokens += len(ids)
        if files:
            files[1].write(np.array([n_tokens], dtype="<u8").tobytes())
            for file, end in zip(files, (".bin", ".off", ".doc")):
                file.close()
                os.replace(f"{trial}{end}", f"{stem}{end}")
            yield pa.RecordBatch.from_pydict(
                {"shard": [task.partitionId()], "n_docs": [n_docs], "n_tokens": [n_tokens]}
            )

    shards = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, "shard long, n_docs long, n_tokens long")
        .toArrow()
        .sort_by("shard")
    )
    sizes = shards["n_tokens"].to_numpy()
    bases = np.cumsum(sizes) - sizes
    shards = shards.append_column("base", pa.array(bases, pa.int64()))
    return docs.sparkSession.createDataFrame(
        shards.to_pandas(), "shard long, n_docs long, n_tokens long, base long"
    )


def read_token_files(
    spark: SparkSession, shards: DataFrame, folder: str, tokenizer_path: str, digests: bool = False
) -> DataFrame:
    """The documents of all shards: doc_id, start, n_tokens and ids (or their crc32).

    ``ids`` is an array, or with ``digests`` its unsigned crc32 over little-endian
    unsigned 32-bit values (``ids_crc32``).
    """
    source = local_path(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = byte_level_encoder(tokenizer_path).dtype
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{source}/shard-{row['shard']:08d}"
                ids = np.memmap(f"{stem}.bin", dtype=dtype, mode="r")
                offsets = np.memmap(f"{stem}.off", dtype="<u8", mode="r").astype(np.int64)
                doc_ids = np.memmap(f"{stem}.doc", dtype="<i8", mode="r")
                for a in range(0, row["n_docs"], 2000):
                    b = min(a + 2000, row["n_docs"])
                    got = [ids[offsets[i] : offsets[i + 1]] for i in range(a, b)]
                    last = (
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in got], pa.int64())
                        if digests
                        else pa.array([x.astype(np.int64) for x in got], pa.list_(pa.int64()))
                    )
                    these = np.asarray(doc_ids[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(these, pa.int64(), mask=these == NULL_ID),
                            pa.array(row["base"] + offsets[a:b], pa.int64()),
                            pa.array(np.diff(offsets[a : b + 1]), pa.int64()),
                            last,
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"],
                    )

    last = "ids_crc32 long" if digests else "ids array<long>"
    spread = shards.repartition(max(1, min(shards.count(), 10_000)), "shard")
    return spread.mapInArrow(read, f"doc_id long, start long, n_tokens long, {last}")
