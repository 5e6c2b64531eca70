"""Ordered scans in one range shuffle, whatever the distribution of keys.

Rows are range-partitioned and sorted by (keys, coordinate), so a hot key is spread
over as many partitions as it needs and equal coordinates of a key are together. One
pass over the sorted partitions computes everything that a partition knows by itself and
writes it with the partition's number; a partition's last key also leaves its state (a
sum, a reach, the last anchor). The states, one row a partition, are carried on by a
window over these rows, and what a partition gets from those before it is added to the rows of its
first key where the written table is read. Neither rows nor states are joined with
themselves, and no key is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genomeframe.session import materialize

PART, FIRST, MARK = "_part", "_first", "_mark"
#: Kinds of written rows: results, and the first and last row of a partition.
ROW, HEAD, TAIL = range(3)


class Part:
    """One sorted partition on its way through a scan.

    ``segments(batch)`` numbers the keys of a batch from 0 for the partition's first key on.
    """

    def __init__(self, keys: Sequence[str]):
        self.number = TaskContext.get().partitionId()
        self.keys = list(keys)
        self.last: tuple | None = None
        self.segment = 0

    def segments(self, batch: pa.RecordBatch) -> np.ndarray:
        n = batch.num_rows
        new = np.zeros(n, dtype=bool)
        columns = [batch.column(batch.schema.get_field_index(k)) for k in self.keys]
        for c in columns:
            a, b = c.slice(0, n - 1), c.slice(1)
            same = pc.fill_null(pc.equal(a, b), False)
            same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
            new[1:] |= ~same.to_numpy(zero_copy_only=False)
        first = tuple(c[0].as_py() for c in columns)
        new[0] = self.last is not None and first != self.last
        self.last = tuple(c[n - 1].as_py() for c in columns)
        numbers = self.segment + np.cumsum(new)
        self.segment = int(numbers[-1])
        return numbers


def values(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def key_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The runs of equal keys of a sorted stream, each with its key."""
    held: list[pa.RecordBatch] = []
    key = lambda batch, i: tuple(batch.column(k)[i].as_py() for k in keys)
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[-1], -1) != key(batch, 0):
            yield key(held[-1], -1), pa.Table.from_batches(held)
            held = []
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy()
            new |= codes[1:] != codes[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            held.append(batch.slice(low, high - low))
            if high < batch.num_rows:
                yield key(held[-1], -1), pa.Table.from_batches(held)
                held = []
    if held:
        yield key(held[-1], -1), pa.Table.from_batches(held)


def segment_starts(segments: np.ndarray) -> np.ndarray:
    """For each row the position of its segment's first row in the batch."""
    new = np.append(True, segments[1:] != segments[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(segments)), 0))


def running_sums(amounts: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Inclusive sums within the segments of a batch."""
    sums = np.cumsum(amounts)
    starts = segment_starts(segments)
    return sums - sums[starts] + amounts[starts]


def running_max(numbers: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Inclusive maxima within the segments of a batch."""
    distinct, rank = np.unique(numbers, return_inverse=True)
    base = (segments - segments[0]) * len(distinct)
    return distinct[np.maximum.accumulate(base + rank) - base]


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    make: Callable[[Part], object],
    schema: T.StructType,
    name: str,
) -> DataFrame:
    """The written rows of ``make(part)`` for each sorted partition.

    It has ``batch(batch, segments)`` and ``end()``, both giving record batches; ``end``
    is called for partitions with rows only.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Part(keys)
        worker, seen = make(part), False
        for batch in batches:
            if batch.num_rows:
                seen = True
                yield from worker.batch(batch, part.segments(batch))
        if seen:
            yield from worker.end()

    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return materialize(placed.mapInArrow(run, schema), name)


def result_schema(df: DataFrame, *more: str) -> T.StructType:
    """The columns of ``df`` and those of a scan's bookkeeping, ``more`` before them."""
    own = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]
    text = ", ".join([*more, f"{PART} int", f"{FIRST} boolean", f"{MARK} int"])
    return T.StructType([*own, *T._parse_datatype_string(text).fields])


def marked(batch: pa.RecordBatch, part: Part, first: np.ndarray, mark: int, **columns) -> pa.RecordBatch:
    """The batch with columns replaced or added, and the bookkeeping."""
    n = batch.num_rows
    arrays = dict(zip(batch.schema.names, batch.columns)) | columns
    arrays |= {
        PART: pa.array(np.full(n, part.number, dtype=np.int32)),
        FIRST: pa.array(np.broadcast_to(first, n)),
        MARK: pa.array(np.full(n, mark, dtype=np.int32)),
    }
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def states(written: DataFrame, keys: Sequence[str], *state: str) -> DataFrame:
    """One row a partition: its first and last key, and ``state`` of the last row."""
    key = F.struct(*keys)
    tail = F.col(MARK) == TAIL
    return (
        written.filter(F.col(MARK) != ROW)
        .groupBy(PART)
        .agg(
            F.max(F.when(F.col(MARK) == HEAD, key)).alias("first_key"),
            F.max(F.when(tail, key)).alias("last_key"),
            *(F.max(F.when(tail, F.col(c))).alias(c) for c in state),
        )
    )


def carried(known: DataFrame, state: Column, name: str) -> DataFrame:
    """``known`` (see ``states``) with ``name``: what a partition's first key gets from those before it.

    ``state`` is an aggregate, e.g. a sum. Partitions with one last key follow each
    other, so it runs over them; there is one row a partition.
    """
    in_order = Window.orderBy(PART)
    same_key = Window.partitionBy("last_key").orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)
    run = known.withColumn("_run", state.over(same_key))
    goes_on = F.lag("last_key").over(in_order).eqNullSafe(F.col("first_key"))
    return run.withColumn(name, F.when(goes_on, F.lag("_run").over(in_order))).drop("_run")


def with_carry(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Rows with the carried state of their partition, null unless they are of its first key.

    The states are broadcast: one row for each partition of the scan.
    """
    carry = F.broadcast(known.select(PART, name))
    return rows.join(carry, PART, "left").withColumn(name, F.when(F.col(FIRST), F.col(name)))


class _Sums:
    """Rows with local prefix sums; the last row leaves the sums of its key."""

    def __init__(self, part: Part, names: Sequence[str]):
        self.part, self.names = part, list(names)
        self.sums: dict[str, float] = dict.fromkeys(names, 0)
        self.segment, self.last = None, None

    def batch(self, batch: pa.RecordBatch, segments: np.ndarray) -> Iterator[pa.RecordBatch]:
        made, goes_on = {}, segments == self.segment
        for c in self.names:
            amounts = values(batch, c)
            amounts = amounts.astype(np.int64 if amounts.dtype.kind in "iu" else np.float64)
            local = running_sums(amounts, segments) + np.where(goes_on, self.sums[c], 0)
            made[f"{c}_sum"], self.sums[c] = pa.array(local), local[-1]
        if self.last is None:
            yield marked(batch.slice(0, 1), self.part, True, HEAD, **{c: a.slice(0, 1) for c, a in made.items()})
        self.segment = int(segments[-1])
        self.last = batch.slice(batch.num_rows - 1), {c: a.slice(len(a) - 1) for c, a in made.items()}
        yield marked(batch, self.part, segments == 0, ROW, **made)

    def end(self) -> Iterator[pa.RecordBatch]:
        row, sums = self.last
        yield marked(row, self.part, self.segment == 0, TAIL, **sums)


def prefix_sums(
    df: DataFrame, keys: Sequence[str], position: str | Sequence[str], names: Sequence[str]
) -> DataFrame:
    """Add ``<name>_sum``: inclusive prefix sums along each key; rows at one position in any order.

    ``position`` may be several columns. Rows with a null one are left out.
    """
    order = [position] if isinstance(position, str) else list(position)
    real = {c: kind in ("float", "double") for c, kind in df.dtypes}
    schema = result_schema(df, *(f"{c}_sum {'double' if real[c] else 'long'}" for c in names))
    placed = df.dropna(subset=order)
    written = scan(placed, keys, order, lambda part: _Sums(part, names), schema, "sums")
    known = states(written, keys, *(f"{c}_sum" for c in names))
    rows = written.filter(F.col(MARK) == ROW)
    for c in names:
        known = carried(known, F.sum(f"{c}_sum"), f"_{c}_before")
    befores = [f"_{c}_before" for c in names]
    rows = rows.join(F.broadcast(known.select(PART, *befores)), PART, "left")
    add = {
        f"{c}_sum": F.col(f"{c}_sum") + F.when(F.col(FIRST), F.coalesce(b, F.lit(0))).otherwise(0)
        for c, b in zip(names, befores)
    }
    return rows.withColumns(add).select(*df.columns, *(f"{c}_sum" for c in names))


def _added(codes: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``codes`` and the sums of their amounts."""
    order = np.lexsort(codes.T)
    codes, amounts = codes[order], amounts[order]
    new = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]).any(axis=1)))
    return codes[new], np.add.reduceat(amounts, new)


def met_in_batches(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows of equal ``keys`` with their long sums of ``names``, joined as far as they are in one Arrow batch."""
    rows = df.select(*keys, *(F.col(c).cast("long").alias(c) for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = pa.Table.from_batches([batch]).group_by(list(keys)).aggregate([(c, "sum") for c in names])
            columns = [met[c] for c in keys] + [met[f"{c}_sum"] for c in names]
            yield from pa.Table.from_arrays(columns, [*keys, *names]).to_batches()

    return rows.mapInArrow(run, rows.schema)


class _DepthSums:
    """Sums of positions by local depths, of the first key and of all others; the last row leaves its key's depths."""

    #: Kept depths from which the sums of a partition are written early.
    LIMIT = 100_000

    def __init__(self, part: Part, position: str, names: Sequence[str]):
        self.part, self.position, self.names = part, position, list(names)
        self.depth = np.zeros(len(self.names), dtype=np.int64)
        self.segment, self.last = None, None
        self._clear()

    def _clear(self) -> None:
        self.codes, self.amounts = np.zeros((0, 1 + len(self.names)), dtype=np.int64), np.zeros(0, dtype=np.int64)

    def batch(self, batch: pa.RecordBatch, segments: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, goes_on = batch.num_rows, (segments == self.segment)[:, None]
        steps = np.stack([values(batch, c).astype(np.int64) for c in self.names], axis=1)
        after = np.stack([running_sums(c, segments) for c in steps.T], axis=1) + np.where(goes_on, self.depth, 0)
        at = values(batch, self.position).astype(np.int64)
        first = np.tile((segments == 0).astype(np.int64), 2)[:, None]
        codes = np.concatenate([self.codes, np.hstack([first, np.concatenate([after - steps, after])])])
        self.codes, self.amounts = _added(codes, np.concatenate([self.amounts, at, -at]))
        if self.last is None:
            yield self._row(batch.slice(0, 1), after[0], True, HEAD)
        self.segment, self.depth, self.last = int(segments[-1]), after[n - 1], batch.slice(n - 1)
        if len(self.amounts) > self.LIMIT:
            yield from self._sums()

    def _row(self, row: pa.RecordBatch, depth: np.ndarray, first: bool, mark: int) -> pa.RecordBatch:
        sums = {f"{c}_sum": pa.array([int(d)], pa.int64()) for c, d in zip(self.names, depth)}
        keys = row.select(self.part.keys)
        return marked(keys, self.part, first, mark, **sums, length=pa.array([0], pa.int64()))

    def _sums(self) -> Iterator[pa.RecordBatch]:
        keys = self.last.select(self.part.keys).take(pa.array(np.zeros(len(self.amounts), dtype=np.int64)))
        sums = {f"{c}_sum": pa.array(self.codes[:, 1 + i]) for i, c in enumerate(self.names)}
        yield marked(keys, self.part, self.codes[:, 0] == 1, ROW, **sums, length=pa.array(self.amounts))
        self._clear()

    def end(self) -> Iterator[pa.RecordBatch]:
        if len(self.amounts):
            yield from self._sums()
        yield self._row(self.last, self.depth, self.segment == 0, TAIL)


def depth_sums(df: DataFrame, keys: Sequence[str], position: str, names: Sequence[str]) -> DataFrame:
    """(``<name>_sum``..., length): the bases at each depth, for integer changes ``names`` at ``position``.

    Depths are the prefix sums along each key, as in ``prefix_sums``, and may come in several
    rows. A partition leaves a row for each depth it meets, counted from its start.
    """
    keys, names = list(keys), list(names)
    rows = df.select(*keys, position, *names).dropna(subset=[position])
    columns = ", ".join([*(f"{c}_sum long" for c in names), "length long"])
    schema = result_schema(rows.select(*keys), columns)
    written = scan(rows, keys, [position], lambda part: _DepthSums(part, position, names), schema, "depths")
    known = states(written, keys, *(f"{c}_sum" for c in names))
    for c in names:
        known = carried(known, F.sum(f"{c}_sum"), f"_{c}_before")
    befores = [f"_{c}_before" for c in names]
    found = written.filter(F.col(MARK) == ROW).join(F.broadcast(known.select(PART, *befores)), PART, "left")
    return found.select(
        *(
            (F.col(f"{c}_sum") + F.when(F.col(FIRST), F.coalesce(b, F.lit(0))).otherwise(0)).alias(f"{c}_sum")
            for c, b in zip(names, befores)
        ),
        "length",
    )


class _Islands:
    """Closed islands as rows; the island open at the end of the partition as its last row."""

    def __init__(self, part: Part, strict: bool):
        self.part, self.strict = part, strict
        self.open: tuple[pa.RecordBatch, int] | None = None  # its first row and its reach
        self.segment = None

    def _rows(self, rows: pa.RecordBatch, ends: np.ndarray, first: np.ndarray, mark: int) -> pa.RecordBatch:
        return marked(rows, self.part, first, mark, end0=pa.array(ends))

    def batch(self, batch: pa.RecordBatch, segments: np.ndarray) -> Iterator[pa.RecordBatch]:
        start, end = values(batch, "start0"), values(batch, "end0")
        if self.open is None:
            yield self._rows(batch.slice(0, 1), end[:1], True, HEAD)
        reach = running_max(end, segments)
        if self.open is not None:
            reach = np.where(segments == self.segment, np.maximum(reach, self.open[1]), reach)
        before = np.append(self.open[1] if self.open else 0, reach[:-1])
        goes_on = np.append(segments[0] == self.segment, segments[1:] == segments[:-1])
        apart = start >= before if self.strict else start > before
        heads = np.flatnonzero(~goes_on | apart)
        if len(heads):
            if self.open is not None:
                yield self._rows(self.open[0], np.array([before[heads[0]]]), self.segment == 0, ROW)
            closed = heads[:-1]
            if len(closed):
                yield self._rows(batch.take(pa.array(closed)), before[heads[1:]], segments[closed] == 0, ROW)
            self.open = batch.slice(int(heads[-1]), 1), int(reach[-1])
        else:
            self.open = self.open[0], int(reach[-1])
        self.segment = int(segments[-1])

    def end(self) -> Iterator[pa.RecordBatch]:
        yield self._rows(self.open[0], np.array([self.open[1]]), self.segment == 0, TAIL)


def islands(df: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """(keys, start0, end0): unions of intervals that overlap or, unless ``strict``, touch.

    An island of a partition's first key whose start the reach from before covers is
    part of the island that came in; that one ends with the largest such end. All but
    these and the islands open at the end of a partition are final where they are found.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col("start0").cast("long"), F.col("end0").cast("long"))
    rows = rows.filter("start0 is not null and end0 is not null")
    written = scan(
        rows, keys, ["start0", "end0"], lambda part: _Islands(part, strict), result_schema(rows), "islands"
    )
    tail_first = F.max(F.when((F.col(MARK) == TAIL) & F.col(FIRST), 1))
    singles = written.filter(F.col(MARK) == TAIL).groupBy(PART).agg(tail_first.alias("single"))
    known = states(written, keys, "start0", "end0").join(singles, PART)
    known = carried(known, F.max("end0"), "reach")
    within = F.col("start0") < F.col("reach") if strict else F.col("start0") <= F.col("reach")
    inside = F.coalesce(within, F.lit(False))
    closed = with_carry(written.filter(F.col(MARK) == ROW), known, "reach")
    swallowed = closed.filter(inside).groupBy(PART).agg(F.max("end0").alias("swallowed"))
    in_order = Window.orderBy(PART)
    opens = ~((F.col("single") == 1) & inside)
    at_borders = (
        known.join(F.broadcast(swallowed), PART, "left")
        .withColumn("opens", F.coalesce(opens, F.lit(True)))
        .withColumn("group", F.sum(F.col("opens").cast("int")).over(in_order))
    )
    last_here = F.when(~F.col("opens"), F.col("end0"))
    later = at_borders.select(
        (F.col("group") - F.col("opens").cast("int")).alias("group"),
        F.greatest("swallowed", last_here).alias("more"),
    )
    later = later.groupBy("group").agg(F.max("more").alias("more"))
    crossing = (
        at_borders.filter("opens")
        .join(later, "group", "left")
        .select(*(F.col(f"last_key.{k}").alias(k) for k in keys), "start0", F.greatest("end0", "more").alias("end0"))
    )
    return closed.filter(~inside).select(*keys, "start0", "end0").unionByName(crossing)


class _Gaps:
    """Gaps inside the partition as rows, its first start and last end as first and last row."""

    def __init__(self, part: Part):
        self.part, self.segment, self.last = part, None, None

    def batch(self, batch: pa.RecordBatch, segments: np.ndarray) -> Iterator[pa.RecordBatch]:
        start, end = values(batch, "start0"), values(batch, "end0")
        if self.last is None:
            yield marked(batch.slice(0, 1), self.part, True, HEAD)
        elif segments[0] == self.segment and start[0] > self.last[1]:
            yield self._gaps(self.last[0], [self.last[1]], [start[0]])
        at = np.flatnonzero((segments[1:] == segments[:-1]) & (start[1:] > end[:-1]))
        if len(at):
            yield self._gaps(batch.take(pa.array(at)), end[at], start[at + 1])
        self.segment, self.last = int(segments[-1]), (batch.slice(batch.num_rows - 1), int(end[-1]))

    def _gaps(self, rows: pa.RecordBatch, starts, ends) -> pa.RecordBatch:
        return marked(rows, self.part, False, ROW, start0=pa.array(starts, pa.int64()), end0=pa.array(ends, pa.int64()))

    def end(self) -> Iterator[pa.RecordBatch]:
        yield marked(self.last[0], self.part, False, TAIL)


def gaps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-empty gaps from each interval's end to the next start of its key."""
    keys = list(keys)
    rows = df.select(*keys, F.col("start0").cast("long"), F.col("end0").cast("long"))
    rows = rows.filter("start0 is not null and end0 is not null")
    written = scan(rows, keys, ["start0", "end0"], _Gaps, result_schema(rows), "gaps")
    starts = written.filter(F.col(MARK) == HEAD).select(PART, F.col("start0").alias("first_start"))
    known = states(written, keys, "end0").join(starts, PART)
    in_order = Window.orderBy(PART)
    goes_on = F.lead("first_key").over(in_order).eqNullSafe(F.col("last_key"))
    crossing = (
        known.withColumn("next", F.when(goes_on, F.lead("first_start").over(in_order)))
        .filter("next > end0")
        .select(
            *(F.col(f"last_key.{k}").alias(k) for k in keys),
            F.col("end0").alias("start0"),
            F.col("next").alias("end0"),
        )
    )
    return written.filter(F.col(MARK) == ROW).select(*keys, "start0", "end0").unionByName(crossing)


class _Touching:
    """Rows that touch the last region before their end, and those of the first key without a region yet."""

    def __init__(self, part: Part, wanted: bool):
        self.part, self.wanted = part, wanted
        self.segment, self.reach, self.last = None, None, None

    def batch(self, batch: pa.RecordBatch, segments: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.last is None:
            yield marked(batch.slice(0, 1), self.part, True, HEAD)
        region = values(batch, "_region").astype(bool)
        at = np.maximum.accumulate(np.where(region, np.arange(len(region)), -1))
        here = at >= segment_starts(segments)
        earlier = (segments == self.segment) & ~here & (self.reach is not None)
        end = np.where(here, values(batch, "end0")[at], self.reach if self.reach is not None else 0)
        known = here | earlier
        touches = known & (end > values(batch, "start0"))
        open_ = ~known & (segments == 0)
        keep = np.flatnonzero(~region & (open_ | (touches == self.wanted)))
        if len(keep):
            yield marked(batch.take(pa.array(keep)), self.part, open_[keep], ROW)
        last = len(region) - 1
        self.reach = int(end[last]) if known[last] else None
        self.segment, self.last = int(segments[-1]), batch.slice(last)

    def end(self) -> Iterator[pa.RecordBatch]:
        yield marked(self.last, self.part, self.segment == 0, TAIL, end0=pa.array([self.reach], pa.int64()))


def touching(df: DataFrame, merged: DataFrame, keys: Sequence[str], wanted: bool = True) -> DataFrame:
    """Rows of ``df`` that share a base with a merged interval, or those that do not.

    Rows and merged intervals go through one scan, a row at its last base, an
    interval at its first; nothing is joined back.
    """
    keys = list(keys)
    coordinates = [F.col(c).cast("long").alias(c) for c in ("start0", "end0")]
    others = [c for c in df.columns if c not in (*keys, "start0", "end0")]
    rows = df.select(*keys, *coordinates, *others, (F.col("end0").cast("long") - 1).alias("_at"), F.lit(False).alias("_region"))
    regions = merged.select(*keys, *coordinates, F.col("start0").cast("long").alias("_at"), F.lit(True).alias("_region"))
    both = rows.unionByName(regions, allowMissingColumns=True).filter("start0 is not null and end0 is not null")
    order = ["_at", F.col("_region").cast("int").desc()]
    written = scan(both, keys, order, lambda part: _Touching(part, wanted), result_schema(both), "touching")
    known = carried(states(written, keys, "end0"), F.last("end0", ignorenulls=True), "_reach")
    found = with_carry(written.filter(F.col(MARK) == ROW), known, "_reach")
    touches = F.coalesce(F.col("_reach") > F.col("start0"), F.lit(False))
    decided = ~F.col(FIRST) | (touches if wanted else ~touches)
    return found.filter(decided).select(*df.columns)
