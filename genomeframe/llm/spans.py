"""Byte spans of many texts at once: cutting, 64-bit span hashes and a bounded span cache.

Everything here works on one Arrow batch inside a task. A batch is handled in
slices of about ``SLICE_BYTES`` (a longer text is a slice of its own), so memory
does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

SLICE_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        tables = []
        for base in (_MULTIPLIER, _INVERSE):
            steps = np.full(max(n + 1, SLICE_BYTES + 1), base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        if n > SLICE_BYTES:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte stays."""
    return _LOWER[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``, equal for equal bytes wherever they lie."""
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(_MULTIPLIER))


def slices(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first text, UTF-8 texts) of slices of about ``SLICE_BYTES``; null is empty."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > SLICE_BYTES:
            yield first, held
            first, size, held = i, 0, []
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 offsets of the texts in them."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def ascii_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``[^\\x20\\x09-\\x0D]`` and each text's first run (n + 1 values)."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = word
    before &= ~first
    here = np.append(word, False)
    starts = np.flatnonzero(here[:-1] & ~before[:-1])
    stops = np.empty(len(data), dtype=bool)
    if len(data):
        stops[:] = word & (~here[1:] | first[1:])
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def take_ranges(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[start : start + length]`` over all ranges."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
    return flat[at]


class SpanCache:
    """Values of distinct byte spans in a direct-mapped table keyed by span hash.

    ``fill`` gets the spans that the table does not hold and returns their values
    (integers) in a row and the length of each. A new span takes the place of
    another with the same slot, and the values are dropped together when they
    reach ``most_values``: memory is fixed and the results do not depend on it.
    """

    def __init__(
        self,
        fill: Callable[[list[bytes]], tuple[list[int] | np.ndarray, list[int]]],
        dtype,
        slot_bits: int = 20,
        most_values: int = 6 << 20,
    ):
        self.fill, self.dtype, self.most = fill, dtype, most_values
        self.slots = np.uint64((1 << slot_bits) - 1)
        self.keys = np.zeros(1 << slot_bits, dtype=np.uint64)
        self.starts = np.zeros(1 << slot_bits, dtype=np.int32)
        self.lengths = np.zeros(1 << slot_bits, dtype=np.int32)
        self.flat = np.zeros(1 << 16, dtype=dtype)
        self.used = 0

    def _append(self, values: np.ndarray) -> None:
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(values)] = values
        self.used += len(values)

    def lookup(
        self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Start and length in ``self.flat`` of the value of each span, in order."""
        if self.used > self.most:
            self.keys[:] = 0
            self.used = 0
        hashes = span_hashes(data, starts, ends)
        slot = (hashes & self.slots).astype(np.int64)
        begin, length = self.starts[slot].astype(np.int64), self.lengths[slot].astype(np.int64)
        missing = np.flatnonzero((self.keys[slot] != hashes) | (hashes == 0))
        if len(missing):
            keys, first, inverse = np.unique(
                hashes[missing], return_index=True, return_inverse=True
            )
            raw, where = data.tobytes(), missing[first]
            spans = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
            values, sizes = self.fill(spans)
            new_length = np.array(sizes, dtype=np.int64)
            new_begin = self.used + np.cumsum(new_length) - new_length
            self._append(np.asarray(values, dtype=self.dtype))
            at = (keys & self.slots).astype(np.int64)
            self.keys[at], self.starts[at], self.lengths[at] = keys, new_begin, new_length
            # of spans with one slot the last is kept: all three columns keep the same one
            begin[missing], length[missing] = new_begin[inverse], new_length[inverse]
        return begin, length
