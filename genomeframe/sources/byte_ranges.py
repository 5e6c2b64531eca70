"""FASTA as a data source of byte ranges: ``spark.read.format("fasta")``.

A file is cut into ranges of ``range_bytes``, whatever its lines, so a record of one line is read by
as many tasks as one of many. A range gives a row for each header that begins in it (read to
its end, beyond the range if need be) and rows of up to ``PIECE`` bases between them. What
lies before the first line break of a range goes on with a line that began earlier: such rows
are marked ``fragment``. Whether that line is a header only earlier ranges know, so a
range's last row (``row`` -1) says whether it ends inside a header, or null if no line begins in it.
Compressed files are one range.
"""

from __future__ import annotations

import gzip
import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES, BLOCK_BYTES, PIECE = 16 << 20, 1 << 20, 16_384
SCHEMA = "file string, block long, row long, header boolean, fragment boolean, in_header boolean, value string"
#: Bytes that are no bases.
_SPACE = b" \t\r\n\x0b\x0c"
_NAMES = ["file", "block", "row", "header", "fragment", "in_header", "value"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int


class _Rows:
    """The rows of one range, sequence text gathered to pieces."""

    def __init__(self, file: str, block: int):
        self.file, self.block = file, block
        self.rows: list[tuple] = []
        self.number, self.text, self.fragment = 0, bytearray(), False

    def _add(self, header: bool, value: str) -> None:
        self.rows.append((self.file, self.block, self.number, header, self.fragment and not header, None, value))
        self.number += 1

    def header(self, line: bytes) -> None:
        self.flush()
        self._add(True, line.decode("utf-8", "replace"))

    def bases(self, text: bytes) -> None:
        self.text += text.translate(None, _SPACE)
        while len(self.text) >= PIECE:
            self._add(False, self.text[:PIECE].decode("latin-1"))
            del self.text[:PIECE]

    def flush(self) -> None:
        if self.text:
            self._add(False, self.text.decode("latin-1"))
            self.text = bytearray()

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in _NAMES]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)
        self.rows = []
        return batch


def read_range(data: BinaryIO, part: ByteRange, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of one range of an opened file."""
    rows = _Rows(part.file, part.start)
    line_start = part.start == 0
    if not line_start:
        data.seek(part.start - 1)
        line_start = data.read(1) == b"\n"
    rows.fragment = not line_start
    known, header, left = line_start, None, part.end - part.start
    while left > 0:
        block = data.read(min(block_bytes, left))
        if not block:
            break
        left -= len(block)
        i = 0
        while i < len(block):
            if header is not None:
                j = block.find(b"\n", i)
                header += block[i : j if j >= 0 else len(block)]
                i = j + 1 if j >= 0 else len(block)
                if j >= 0:
                    rows.header(bytes(header))
                    header, line_start = None, True
                continue
            if line_start and block[i] == ord(">"):
                header, line_start = bytearray(), False
                continue
            j = block.find(b"\n", i) if rows.fragment else block.find(b"\n>", i)
            chunk = block[i : j + 1] if j >= 0 else block[i:]
            rows.bases(chunk)
            i += len(chunk)
            line_start = chunk.endswith(b"\n")
            if line_start and rows.fragment:
                rows.flush()
                rows.fragment, known = False, True
        if len(rows.rows) >= 256:
            yield rows.take()
    rows.flush()
    in_header = header is not None
    while header is not None:  # a header belongs to the range it begins in
        block = data.read(4096)
        j = block.find(b"\n")
        header += block if j < 0 else block[:j]
        if j >= 0 or not block:
            rows.header(bytes(header))
            header = None
    rows.rows.append((part.file, part.start, -1, False, False, in_header if known else None, None))
    yield rows.take()


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.size = int(options.get("range_bytes", RANGE_BYTES))
        if "files" in options:
            self.files = json.loads(options["files"])
        else:
            store, path = fs.FileSystem.from_uri(_uri(options["path"]))
            found = store.get_file_info(path)
            below = store.get_file_info(fs.FileSelector(path)) if found.type == fs.FileType.Directory else [found]
            scheme = _uri(options["path"]).split("://")[0]
            self.files = sorted(
                [f"{scheme}://{f.path}", f.size] for f in below if f.is_file and not f.base_name.startswith(("_", "."))
            )

    def partitions(self) -> Sequence[ByteRange]:
        parts = []
        for file, size in self.files:
            step = max(size, 1) if file.endswith(".gz") else self.size
            parts += [ByteRange(file, a, min(a + step, size)) for a in range(0, size, step)]
        return parts

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(_uri(partition.file))
        with store.open_input_file(path) as raw:
            if partition.file.endswith(".gz"):
                whole = ByteRange(partition.file, 0, 1 << 62)
                yield from read_range(gzip.GzipFile(fileobj=raw), whole)
            else:
                yield from read_range(raw, partition)


def _uri(path: str) -> str:
    """A location as pyarrow takes it."""
    if path.startswith("file:"):
        return "file:///" + path[5:].lstrip("/")
    return path if "://" in path else f"file://{path}"


class FastaDataSource(DataSource):
    """``format("fasta")``: options ``path`` (a file or folder) and ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


#: Stores that tasks can open by themselves.
OPENED = ("file", "s3", "gs", "hdfs")


def fasta_pieces(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame | None:
    """Rows of ``format("fasta")`` over all files that Spark lists, or None if tasks can not open their store."""
    listed = spark.read.format("binaryFile").load(paths).select("path", "length").collect()  # one row a file
    if any(r["path"].split(":")[0] not in OPENED for r in listed):
        return None
    # The processes that plan and read the source need not have this package on their path.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        spark.dataSource.register(FastaDataSource)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    files = json.dumps([[r["path"], r["length"]] for r in sorted(listed)])
    return spark.read.format("fasta").option("files", files).option("range_bytes", range_bytes).load()


def without_header_rests(pieces: DataFrame) -> DataFrame:
    """Pieces without markers and without fragments that go on with a header.

    ``pieces`` is a written table; its markers are one row a range.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marks = pieces.filter("row = -1").select(
        "file", "block", F.coalesce(F.last("in_header", ignorenulls=True).over(before), F.lit(False)).alias("rest")
    )
    rest: Column = F.col("fragment") & F.col("rest")
    return pieces.filter("row >= 0").join(marks, ["file", "block"]).filter(~rest).drop("rest")
