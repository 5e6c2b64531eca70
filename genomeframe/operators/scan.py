"""Ordered scans along a coordinate that never put a hot key into one task.

A window partitioned by contig sorts the contig in one task, and one contig may
hold a third of all rows. Each scan therefore reduces the rows to one per
coordinate and scans them per ``(key, bin)``, a bin being ``2**BIN_BITS``
coordinates wide; what the other bins of the key contribute is joined back, and
the per-key window sees one row per bin only. A caller whose groups are bounded
(each derives from a bounded span) passes ``bins=None`` and gets the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from genomeframe.operators import ordered
from genomeframe.session import materialize

BIN_BITS = 16
BIN = "_bin"


@dataclass(frozen=True)
class Binned:
    """Rows with their bin column; ``hot`` tells whether bins are used."""

    rows: DataFrame
    keys: list[str]
    hot: bool

    def carry(self, summary: Sequence[Column], carried: Sequence[Column]) -> "Binned":
        """Summarise the bins, scan the summaries, join the result back.

        Without bins the rows get nulls: there are no other bins.
        """
        per_bin = (
            self.rows.filter(F.col(BIN).isNotNull()).groupBy(*self.keys, BIN).agg(*summary)
        )
        across = per_bin.select(*self.keys, BIN, *carried)
        if self.hot:
            joined = self.rows.join(across, [*self.keys, BIN], "left")
        else:
            nulls = {
                f.name: F.lit(None).cast(f.dataType)
                for f in across.schema
                if f.name not in (*self.keys, BIN)
            }
            joined = self.rows.withColumns(nulls)
        return replace(self, rows=joined)

    def with_columns(self, columns: dict[str, Column]) -> "Binned":
        return replace(self, rows=self.rows.withColumns(columns))


def place_in_bins(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    reduce: Sequence[Column] = (),
    bins: int | None = BIN_BITS,
) -> Binned:
    """Add the bin of the coordinate, or null without ``bins``.

    ``reduce`` lists the aggregates that turn the rows of a key at one
    coordinate into one row, named like the columns they replace. Without it
    the input must already have one row per (key, coordinate).
    """
    keys = list(keys)
    if bins is None:
        return Binned(df.withColumn(BIN, F.lit(None).cast("bigint")), keys, False)
    rows = df.groupBy(*keys, position).agg(*reduce) if reduce else df
    in_bin = F.shiftright(F.col(position).cast("bigint"), bins)
    return Binned(rows.withColumn(BIN, in_bin), keys, True)


def inside_bin(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys, BIN).orderBy(*order)


def bins_before(keys: Sequence[str]) -> WindowSpec:
    return (
        Window.partitionBy(*keys).orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
    )


def bins_after(keys: Sequence[str]) -> WindowSpec:
    """Later bins, nearest last: use ``last(ignorenulls)`` for the nearest one."""
    return (
        Window.partitionBy(*keys)
        .orderBy(F.desc(BIN))
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: Sequence[str],
    bins: int | None = BIN_BITS,
) -> DataFrame:
    """Add ``<value>_sum``: inclusive prefix sums; one input row per (key, position).

    Without ``bins`` each key is small and summed by a window.
    """
    if bins is not None:
        return ordered.prefix_sums(df, keys, position, values)
    so_far = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{v}_sum": F.sum(v).over(so_far) for v in values})


def latest_at_or_before(
    points: DataFrame,
    anchors: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    bins: int | None = BIN_BITS,
) -> DataFrame:
    """As-of lookup: for each distinct point, ``value`` of the last anchor at or before it.

    ``anchors`` has one row per (key, position) and a struct column ``value``;
    points without an earlier anchor get null. No pair of rows is ever emitted.
    """
    marks = (
        points.select(*keys, position)
        .withColumn(value, F.lit(None).cast(anchors.schema[value].dataType))
        .withColumn("_point", F.lit(True))
        .unionByName(
            anchors.select(*keys, position, value).withColumn("_point", F.lit(False))
        )
        .groupBy(*keys, position)
        .agg(F.max(value).alias(value), F.max("_point").alias("_point"))
    )
    local = inside_bin(keys, position).rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(value, ignorenulls=True).over(local)
    anchored = F.when(F.col(value).isNotNull(), F.col(position))
    return (
        place_in_bins(marks, keys, position, bins=bins)
        .carry(
            [F.max_by(value, anchored).alias("_last")],
            [F.last("_last", ignorenulls=True).over(bins_before(keys)).alias("_before")],
        )
        .rows.withColumn(value, F.coalesce(here, "_before"))
        .filter("_point")
        .select(*keys, position, value)
    )


def sum_before(df: DataFrame, order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows in the given order.

    The rows are range-partitioned and written with their place; a partition adds
    the sum of the partitions before it, of which there is one row each.
    """
    at, part, offset = "_at", "_part", "_offset"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn(at, F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn(part, F.shiftright(at, 33))
    sums = placed.groupBy(part).agg(F.sum(value).alias(offset))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(part, F.coalesce(F.sum(offset).over(earlier), F.lit(0)).alias(offset))
    inside = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    summed = F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col(offset)
    return placed.join(offsets, part).withColumn(name, summed).drop(at, part, offset)
