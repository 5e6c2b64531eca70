"""Interval algebra on half-open 0-based ``[start0, end0)`` rows.

A closed 1-based interval ``a..b`` is ``[a-1, b)``; touching intervals merge
under both conventions, so one rule serves both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomeframe.operators import ordered
from genomeframe.operators.scan import BIN_BITS, running_sum

PLACE = ["seqid", "strand"]


def merge_intervals(
    df: DataFrame, keys: Sequence[str] = PLACE, bins: int | None = BIN_BITS
) -> DataFrame:
    """Union of intervals per key; overlapping and touching intervals merge.

    Without ``bins`` each key is small and merged by windows over its rows.
    """
    if bins is not None:
        return ordered.islands(df, keys)
    by_start = Window.partitionBy(*keys).orderBy("start0", "end0")
    reach = F.max("end0").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    head = F.coalesce(F.col("start0") > reach, F.lit(True)).cast("int")
    return (
        df.select(*keys, "start0", "end0")
        .withColumn("_head", head)
        .withColumn("_island", F.sum("_head").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island")
        .agg(F.min("start0").alias("start0"), F.max("end0").alias("end0"))
        .drop("_island")
    )


def interval_gaps(
    df: DataFrame, keys: Sequence[str], bins: int | None = BIN_BITS
) -> DataFrame:
    """Non-empty gaps between consecutive intervals of a key, as ``[end0, next start0)``."""
    if bins is not None:
        return ordered.gaps(df, keys)
    following = F.lead("start0").over(Window.partitionBy(*keys).orderBy("start0", "end0"))
    return (
        df.select(*keys, "start0", "end0")
        .withColumn("_next", following)
        .filter(F.col("_next") > F.col("end0"))
        .select(*keys, F.col("end0").alias("start0"), F.col("_next").alias("end0"))
    )


def distinct_intervals(df: DataFrame, keys: Sequence[str] = PLACE) -> DataFrame:
    return df.select(*keys, "start0", "end0").distinct()


def overlapping(df: DataFrame, merged: DataFrame, keys: Sequence[str] = PLACE) -> DataFrame:
    """Rows that share at least one base with a merged interval (semi join)."""
    return ordered.touching(df, merged, keys)


def not_overlapping(df: DataFrame, merged: DataFrame, keys: Sequence[str] = PLACE) -> DataFrame:
    """Rows that share no base with any merged interval (anti join)."""
    return ordered.touching(df, merged, keys, wanted=False)


def covered_length(df: DataFrame, side: str, keys: Sequence[str] = PLACE) -> DataFrame:
    """Base pairs covered by side 0, side 1 and both, as one row.

    A sweep over depth changes. A covered stretch contributes ``end - start``, so adding
    ``position`` where coverage stops and subtracting it where coverage begins gives the
    length without pairing the two; changes at one position may come in any order, since
    what they add between them is nothing. Positions are summed by depth, so no row of the
    sweep is written (``ordered.depth_sums``).
    """
    on_side = [F.when(F.col(side) == s, 1).otherwise(0) for s in (0, 1)]
    changes = df.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    F.col("start0").alias("pos"), *(c.alias(f"d{s}") for s, c in enumerate(on_side))
                ),
                F.struct(
                    F.col("end0").alias("pos"), *((-c).alias(f"d{s}") for s, c in enumerate(on_side))
                ),
            )
        ).alias("change"),
    ).select(*keys, "change.*")
    changes = ordered.met_in_batches(changes, [*keys, "pos"], ["d0", "d1"])
    depth = ordered.depth_sums(changes, keys, "pos", ["d0", "d1"])
    over = [F.col(f"d{s}_sum") > 0 for s in (0, 1)]

    def length(covered: Column) -> Column:
        return F.coalesce(F.sum(F.when(covered, F.col("length"))), F.lit(0)).cast("bigint")

    return depth.agg(
        length(over[0]).alias("covered0"),
        length(over[1]).alias("covered1"),
        length(over[0] & over[1]).alias("shared"),
    )


def reciprocal_overlap(
    a: DataFrame, b: DataFrame, keys: Sequence[str], bins: int | None = BIN_BITS
) -> DataFrame:
    """Keys whose two forms share at least 75 % of their bases both ways.

    ``a`` and ``b`` hold disjoint exons of one form each per key. The threshold
    is ``length - length div 4`` on both sides. Shared bases come from a sweep
    per key, not from a pairwise exon join.
    """
    both = a.select(*keys, "start0", "end0", F.lit(0).alias("side")).unionByName(
        b.select(*keys, "start0", "end0", F.lit(1).alias("side"))
    )
    edge = F.explode(
        F.array(
            F.struct(F.col("start0").alias("pos"), F.lit(1).alias("step")),
            F.struct(F.col("end0").alias("pos"), F.lit(-1).alias("step")),
        )
    )
    edges = both.select(*keys, "side", edge.alias("e")).select(
        *keys,
        F.col("e.pos").alias("pos"),
        *(F.when(F.col("side") == s, F.col("e.step")).otherwise(0).alias(f"d{s}") for s in (0, 1)),
    )
    depth = running_sum(edges, keys, "pos", ["d0", "d1"], bins)
    now = (F.col("d0_sum") > 0) & (F.col("d1_sum") > 0)
    was = (F.col("d0_sum") > F.col("d0")) & (F.col("d1_sum") > F.col("d1"))
    shared = F.sum((was.cast("bigint") - now.cast("bigint")) * F.col("pos"))
    totals = [(-F.sum(F.col(d) * F.col("pos"))).alias(n) for d, n in (("d0", "len0"), ("d1", "len1"))]
    return (
        depth.groupBy(*keys)
        .agg(shared.alias("shared"), *totals)
        .withColumn(
            "reciprocal",
            F.expr("shared >= len0 - len0 div 4 and shared >= len1 - len1 div 4"),
        )
    )
