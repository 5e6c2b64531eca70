"""SentencePiece BPE with source offsets: normalise, merge, project to bytes, decode.

A text is normalised by the longest prefixes that the model's compiled
character map holds, and every normalised byte keeps the source byte it came
from. The text is then cut wherever two neighbouring characters stand together
in no piece of the vocabulary (no merge can cross such a place), every distinct
cut is merged once, many cuts at a time in numpy, and the pieces are projected
through the alignment to byte spans of the source.

Cases: null and empty texts have only the begin and end ids; characters outside
the vocabulary become byte pieces, each spanning its own byte; a space that the
normaliser adds spans no byte. Repeated rows give repeated results, other
columns pass through, and a column with a result's name is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from genomeframe.llm.common import replaced, with_fields
from genomeframe.llm.spans import SpanCache, joined, slices, take_ranges

#: The mark that stands for a space, and the model format's piece types.
SPACE_MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_MARK_BYTES = SPACE_MARK.encode()
_NONE = np.iinfo(np.int64).max
_WIDE = 40


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 and its replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.strings = blob[4 + size :]
        self.leads = {b for b in range(256) if self.units and self._child(self._root(), b) is not None}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _root(self) -> int:
        return self._offset(self.units[0])

    def _child(self, base: int, byte: int) -> int | None:
        at = base ^ byte
        if at < len(self.units) and self.units[at] & 0x800000FF == byte:
            return at
        return None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(matched bytes, replacement) of the longest key that starts at ``at``."""
        if not self.units:
            return None
        base, found = self._root(), None
        for i in range(at, len(text)):
            node = self._child(base, text[i])
            if node is None:
                break
            unit = self.units[node]
            base = node ^ self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.units[base] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


def _char_length(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class PieceModel:
    """One BPE model file: normaliser, merges, byte fallback and decoding."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        trainer, rule = model.trainer_spec, model.normalizer_spec
        kinds = [p.type for p in model.pieces]
        if trainer.model_type != trainer.BPE or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with spaces in front of words are read")
        if USER in kinds or UNUSED in kinds:
            raise ValueError("models with user-defined or unused pieces are not read")
        self.map = CharacterMap(rule.precompiled_charsmap)
        self.prefix, self.squeeze = rule.add_dummy_prefix, rule.remove_extra_whitespaces
        self.escape = rule.escape_whitespaces
        self.begin, self.end, self.unknown = trainer.bos_id, trainer.eos_id, trainer.unk_id
        self.names = [p.piece for p in model.pieces]
        self.kinds = kinds
        bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_ids = [bytes_[b] for b in range(256)] if trainer.byte_fallback else None
        shown = [self._shown(i, trainer.unk_surface) for i in range(len(kinds))]
        self.shown, self.shown_starts = joined(shown)
        self._compile_merges(model.pieces)
        self.cache = SpanCache(self._fill, np.uint32, most_values=4 << 20)
        if len(kinds) >= 1 << 20:
            raise ValueError("vocabularies over 2**20 pieces are not read")

    def _shown(self, i: int, unknown: str) -> bytes:
        kind, name = self.kinds[i], self.names[i]
        if kind == BYTE:
            return bytes([int(name[3:5], 16)])
        if kind == CONTROL:
            return b""
        return (unknown if kind == UNKNOWN else name.replace(SPACE_MARK, " ")).encode()

    def _compile_merges(self, pieces) -> None:
        ids = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        self.size = len(pieces)
        self.symbols = {name: i for name, i in ids.items() if len(name) == 1}
        self.extra: list[str] = []
        together = np.zeros((129, 129), dtype=bool)  # characters in one piece; 128: not ASCII
        for name in ids:
            codes = [32 if c == SPACE_MARK else min(ord(c), 128) for c in name]
            together[codes[:-1], codes[1:]] = True
            for c in name:
                if c not in self.symbols:  # a character that only stands in longer pieces
                    self.symbols[c] = self.size + len(self.extra)
                    self.extra.append(c)
        together[128, :] |= together[32, :]  # a written mark is merged as a space
        together[:, 128] |= together[:, 32]
        together[128, 128] = True
        kind = np.minimum(np.arange(256), 128)
        self.cuts = ~together[np.ix_(kind, kind)]
        rank = {i: r for r, i in enumerate(sorted(ids.values(), key=lambda i: (-pieces[i].score, i)))}
        self.first_free = self.size + len(self.extra)
        self.of_char = np.arange(0x110000, dtype=np.int32) + np.int32(self.first_free)
        for c, symbol in self.symbols.items():
            self.of_char[ord(c)] = symbol
        self.of_char[ord(" ")] = self.of_char[ord(SPACE_MARK)]
        merges: dict[int, tuple[int, int]] = {}
        whole = ids | self.symbols
        for name, i in ids.items():
            for cut in range(1, len(name)):
                a, b = whole.get(name[:cut]), whole.get(name[cut:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = (rank[i], i)
        self.merges = merges
        self.merge_keys = np.array(sorted(merges), dtype=np.int64)
        self.merge_ranks = np.array([merges[k][0] for k in sorted(merges)], dtype=np.int64)
        self.by_rank = np.array([i for i, _ in sorted(rank.items(), key=lambda x: x[1])], dtype=np.int64)
        self.width = np.zeros(self.first_free, dtype=np.int64)  # bytes of a symbol, a space being 1
        for i in range(self.size):
            name = self.names[i]
            self.width[i] = 1 if self.kinds[i] == BYTE else len(name.replace(SPACE_MARK, " ").encode())
        for i, c in enumerate(self.extra):
            self.width[self.size + i] = len(c.encode())

    # normalisation -------------------------------------------------------

    def plain(self) -> bool:
        """Whether normalising only adds the leading space."""
        return not self.map.units and not self.squeeze and self.escape

    def normalise(self, text: bytes) -> tuple[bytes, list[int]]:
        """The normalised text (spaces not yet marked) and the source byte of each of its bytes.

        One more position closes the alignment.
        """
        out, source = bytearray(), []
        at, previous_space = 0, self.squeeze
        started = not self.prefix
        while at < len(text):
            found = self.map.longest(text, at) if text[at] in self.map.leads else None
            if found is None:
                size = _char_length(text[at])
                piece = text[at : at + size]
            else:
                size, piece = found
            if self.squeeze:
                if previous_space:
                    piece = piece.lstrip(b" ")
                if piece:
                    previous_space = piece.endswith(b" ")
            if piece:
                if not started:
                    out += b" "
                    source.append(at)
                    started = True
                out += piece
                same = found is None
                source += range(at, at + size) if same else [at] * len(piece)
            at += size
        if self.squeeze:
            while out.endswith(b" "):
                out.pop()
                at = source.pop()
        source.append(at if out else 0)
        return bytes(out), source

    # merging -------------------------------------------------------------

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == key, self.merge_ranks[at], _NONE)

    def _merge_rows(self, rows: np.ndarray, lengths: np.ndarray) -> None:
        """Merge the symbols of every row in place, always the best leftmost pair first."""
        n, width = rows.shape
        if width < 2:
            return
        columns = np.arange(width)
        ranks = np.full((n, width), _NONE, dtype=np.int64)
        ranks[:, :-1] = self._rank(rows[:, :-1], rows[:, 1:])
        ranks[columns[None, :] >= lengths[:, None] - 1] = _NONE
        live = np.arange(n)
        while len(live):
            at = ranks[live].argmin(axis=1)
            best = ranks[live, at]
            keep = best != _NONE
            live, at, best = live[keep], at[keep], best[keep]
            if not len(live):
                return
            follow = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            rows[live] = np.take_along_axis(rows[live], follow, axis=1)
            ranks[live] = np.take_along_axis(ranks[live], follow, axis=1)
            rows[live, at] = self.by_rank[best]
            lengths[live] -= 1
            size = lengths[live]
            right = np.minimum(at + 1, width - 1)
            ranks[live, at] = np.where(
                at + 1 < size, self._rank(rows[live, at], rows[live, right]), _NONE
            )
            left = np.maximum(at - 1, 0)
            inner = at > 0
            ranks[live[inner], left[inner]] = self._rank(
                rows[live[inner], left[inner]], rows[live[inner], at[inner]]
            )
            ranks[live, size - 1] = _NONE

    def _merge_long(self, codes: list[int]) -> list[int]:
        """The same for one long cut, with a heap over a linked list."""
        n = len(codes)
        codes, before, after = list(codes), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (got := self.merges.get(codes[i] << 32 | codes[j])):
                heapq.heappush(heap, (got[0], i, codes[i], codes[j]))

        for i in range(n - 1):
            offer(i)
        gone = bytearray(n)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or codes[i] != a or codes[j] != b:
                continue
            codes[i] = int(self.by_rank[rank])
            gone[j] = 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [codes[i] for i in range(n) if not gone[i]]

    def _spell(self, symbol: int) -> list[tuple[int, int]]:
        """(id, bytes) of a symbol that is no piece."""
        char = self.extra[symbol - self.size] if symbol < self.first_free else chr(symbol - self.first_free)
        raw = char.encode("utf-8", "surrogatepass")
        if self.byte_ids is None:
            return [(self.unknown, len(raw))]
        return [(self.byte_ids[b], 1) for b in raw]

    def _values(self, symbols: list[int], marks: list[int] | None) -> list[int]:
        """Pieces as ``bytes << 20 | id``; ``marks`` has the bytes of each source character."""
        out, at = [], 0
        for s in symbols:
            if s >= self.size:
                out += [width << 20 | i for i, width in self._spell(s)]
                at += 1
            elif marks is None:
                out.append(int(self.width[s]) << 20 | s)
            else:
                count = len(self.names[s])
                out.append(sum(marks[at : at + count]) << 20 | s)
                at += count
        return out

    def _fill(self, spans: list[bytes]) -> tuple[np.ndarray, list[int]]:
        text = b"".join(spans).decode("utf-8", "surrogatepass")
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols = self.of_char[chars].astype(np.int64)
        raw, bounds = joined(spans)
        starts = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[bounds]
        sizes = np.diff(starts)
        marked = np.diff(np.append(0, np.cumsum(chars == ord(SPACE_MARK)))[starts]) > 0
        lengths = sizes.copy()
        apart: dict[int, list[int]] = {}
        merged = []
        order = np.argsort(sizes, kind="stable")
        short = order[sizes[order] <= _WIDE]
        for some in np.split(short, np.flatnonzero(np.diff(sizes[short])) + 1):
            if not len(some):
                continue
            columns = np.arange(sizes[some[0]])
            rows = symbols[starts[some][:, None] + columns]
            size = sizes[some]
            self._merge_rows(rows, size)
            inside = columns < size[:, None]
            for k in np.flatnonzero(((rows >= self.size) & inside).any(axis=1) | marked[some]):
                i = int(some[k])
                apart[i] = self._apart(rows[k, : size[k]].tolist(), spans[i])
                inside[k] = False
                size[k] = len(apart[i])
            lengths[some] = size
            packed = self.width[np.minimum(rows, self.size - 1)] << 20 | rows
            merged.append((some, packed, inside))
        for i in order[len(short) :].tolist():
            long = self._merge_long(symbols[starts[i] : starts[i] + sizes[i]].tolist())
            apart[i] = self._apart(long, spans[i])
            lengths[i] = len(apart[i])
        first = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), dtype=np.uint32)
        for some, packed, inside in merged:
            where = first[some][:, None] + np.arange(packed.shape[1])
            out[where[inside]] = packed[inside]
        for i, values in apart.items():
            out[first[i] : first[i] + len(values)] = values
        return out, lengths.tolist()

    def _apart(self, symbols: list[int], span: bytes) -> list[int]:
        marks = None
        if _MARK_BYTES in span:
            marks = [len(c.encode("utf-8", "surrogatepass")) for c in span.decode("utf-8", "surrogatepass")]
        return self._values(symbols, marks)

    # whole texts ---------------------------------------------------------

    def encode(self, normal: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``bytes << 20 | id`` of the pieces of all normalised texts, and each text's first piece."""
        data, offsets = joined(normal)
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            cut[1:-1] = self.cuts[data[:-1], data[1:]]
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        starts = starts[starts < len(data)]
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(normal) + 1, dtype=np.int64)
        ends = np.append(starts[1:], len(data))
        begin, length = self.cache.lookup(data, starts, ends)
        first = np.searchsorted(starts, offsets)
        return (
            take_ranges(self.cache.flat, begin, length),
            np.append(0, np.cumsum(length))[first],
        )

    def aligned(self, texts: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
        """Every text normalised, and the source byte of each byte and of the end.

        Where the map has no entries and spaces stay, the walk only adds the leading space, and
        the alignment is known without it.
        """
        if not self.plain():
            return [(normal, np.array(source)) for normal, source in map(self.normalise, texts)]
        lead = 1 if self.prefix else 0
        return [
            (b" " * (lead if t else 0) + t, np.maximum(np.arange(len(t) + 1 + (lead if t else 0)) - (lead if t else 0), 0))
            for t in texts
        ]

    def encode_spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of every piece of one text, in bytes of its UTF-8 form."""
        normal, source = self.normalise(text.encode("utf-8", "surrogatepass"))
        values, _ = self.encode([normal])
        ends = np.cumsum(values >> np.uint32(20))
        begins = ends - (values >> np.uint32(20))
        return [
            (int(v & 0xFFFFF), source[int(a)], source[int(b)])
            for v, a, b in zip(values.tolist(), begins, ends)
        ]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library's ``decode``: bytes that form no text become U+FFFD."""
        raw = take_ranges(
            self.shown,
            self.shown_starts[np.array(ids, dtype=np.int64)],
            np.diff(self.shown_starts)[np.array(ids, dtype=np.int64)],
        ).tobytes()
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") and (self.prefix or self.squeeze) else text


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(
    docs: DataFrame, model_path: str, text: str = "text", spans: bool = False
) -> DataFrame:
    """``docs`` with ``ids`` (begin and end ids included) and ``decoded``, the text of the ids.

    With ``spans`` also ``span_starts`` and ``span_ends``, the source bytes of
    every id (-1 for the begin and end ids). A narrow pass over Arrow batches.
    """
    names = ["ids", "decoded"] + ["span_starts", "span_ends"] * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ids, shown, begins, ends = [], [], [], []
                for value in column.slice(first, 500).to_pylist():
                    found = model.encode_spans(value or "")
                    ids.append([model.begin, *(x[0] for x in found), model.end])
                    shown.append(model.decode(ids[-1]))
                    begins.append([-1, *(x[1] for x in found), -1])
                    ends.append([-1, *(x[2] for x in found), -1])
                made = [pa.array(ids, pa.list_(pa.int32())), pa.array(shown, pa.string())]
                if spans:
                    made += [pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))]
                yield replaced(part, **dict(zip(names, made)))

    kinds = {"ids": "array<int>", "decoded": "string", "span_starts": "array<int>", "span_ends": "array<int>"}
    return docs.mapInArrow(run, with_fields(docs.schema, *((n, kinds[n]) for n in names)))


def encode_digests(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_tokens, ids_sha256, decoded_sha256, spans_sha256 and source_bytes.

    ids are hashed as little-endian unsigned 32-bit values, spans as the first and end
    source byte of every piece (begin and end ids have none) in 64 bits each; ``source_bytes`` is the
    number of source bytes that the spans cover together. Texts of a
    batch are encoded in slices, so memory follows the longest text.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() != text.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        strip = model.prefix or model.squeeze
        shown_widths = np.diff(model.shown_starts)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            rest = batch.select([i for i in range(batch.num_columns) if i != at])
            counts, id_hashes, text_hashes, span_hashes_, covered = [], [], [], [], []
            for _, texts in slices(batch.column(at).to_pylist()):
                aligned = model.aligned(texts)
                values, upto = model.encode([normal for normal, _ in aligned])
                reach = np.append(0, np.cumsum(values >> np.uint32(20), dtype=np.int64))
                ids = values & np.uint32(0xFFFFF)
                widths = shown_widths[ids]
                shown = take_ranges(model.shown, model.shown_starts[ids], widths).tobytes()
                places = np.append(0, np.cumsum(widths))
                ids = ids.astype("<u4")
                ends = [np.array([i], dtype="<u4").tobytes() for i in (model.begin, model.end)]
                bounds = upto.tolist()
                for k in range(len(texts)):
                    a, b = bounds[k], bounds[k + 1]
                    counts.append(b - a + 2)
                    id_hashes.append(
                        hashlib.sha256(ends[0] + ids[a:b].tobytes() + ends[1]).hexdigest()
                    )
                    got = shown[places[a] : places[b]]
                    if strip and got.startswith(b" "):
                        got = got[1:]
                    text_hashes.append(hashlib.sha256(got).hexdigest())
                    source = aligned[k][1][reach[a : b + 1] - reach[a]]
                    spans = np.stack([source[:-1], source[1:]], axis=1).astype("<i8")
                    span_hashes_.append(hashlib.sha256(spans.tobytes()).hexdigest())
                    covered.append(int(source[-1] - source[0]))
            yield replaced(
                rest,
                n_tokens=pa.array(counts, pa.int64()),
                ids_sha256=pa.array(id_hashes, pa.string()),
                decoded_sha256=pa.array(text_hashes, pa.string()),
                spans_sha256=pa.array(span_hashes_, pa.string()),
                source_bytes=pa.array(covered, pa.int64()),
            )

    schema = with_fields(
        T.StructType(kept),
        ("n_tokens", "long"),
        ("ids_sha256", "string"),
        ("decoded_sha256", "string"),
        ("spans_sha256", "string"),
        ("source_bytes", "long"),
    )
    return docs.mapInArrow(run, schema)
