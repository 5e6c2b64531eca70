"""Contigs as fixed-size tiles with overlap, so that no task holds a contig.

A tile has ``seqid, tile, origin, length, bases``: the core starts at ``origin``
and is ``TILE`` bases wide (shorter at the contig's end); ``bases`` also holds up
to ``HALO`` bases on either side, and ``left`` says how many on the left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 16384
# A site window reaches 64 bases and the widest kernel 33 more; on the minus
# strand a boundary looks one base further to the left.
HALO = 98


def tile_contigs(contigs: DataFrame, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """Cut ``seqid, bases`` rows into tiles.

    One linear regular-expression pass cuts each string into cores; halos are
    taken from the neighbouring cores, which are at least ``halo`` wide except
    for the last.
    """
    cores = F.regexp_extract_all("bases", F.lit(f"(?s).{{1,{tile}}}"), F.lit(0))
    cut = contigs.filter(F.length("bases") > 0).select(
        "seqid", F.length("bases").cast("bigint").alias("length"), cores.alias("cores")
    )
    with_halo = F.transform(
        "cores",
        lambda core, i: F.struct(
            F.when(i > 0, F.right(F.get("cores", i - 1), F.lit(halo)))
            .otherwise(F.lit(""))
            .alias("before"),
            core.alias("core"),
            F.coalesce(F.left(F.get("cores", i + 1), F.lit(halo)), F.lit("")).alias("after"),
        ),
    )
    return cut.select("seqid", "length", F.posexplode(with_halo).alias("tile", "t")).select(
        "seqid",
        F.col("tile").cast("bigint").alias("tile"),
        (F.col("tile").cast("bigint") * tile).alias("origin"),
        "length",
        F.length("t.before").alias("left"),
        F.length("t.core").alias("core"),
        F.concat("t.before", "t.core", "t.after").alias("bases"),
    )


def tiles_from_pieces(
    pieces: DataFrame, lengths: DataFrame, tile: int = TILE, halo: int = HALO
) -> DataFrame:
    """Build tiles from ``seqid, offset, piece`` rows, such as lines of a FASTA file.

    Each piece goes to every tile whose core or halo it touches; a tile collects
    at most ``tile + 2 * halo`` bases, whatever the length of the contig.
    """
    end = F.col("offset") + F.length("piece")
    spread = pieces.withColumn(
        "tile",
        F.explode(
            F.sequence(
                F.greatest(F.floor((F.col("offset") - halo) / tile), F.lit(0)).cast("bigint"),
                F.floor((end + halo - 1) / tile).cast("bigint"),
            )
        ),
    )
    low = F.greatest(F.col("tile") * tile - halo, F.col("offset"))
    high = F.least((F.col("tile") + 1) * tile + halo, end)
    cut = F.substring("piece", low - F.col("offset") + 1, high - low)
    collected = (
        spread.withColumn("cut", cut)
        .filter(F.length("cut") > 0)
        .groupBy("seqid", "tile")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "cut"))).alias("cuts"))
    )
    origin = F.col("tile") * tile
    return (
        collected.join(lengths.select("seqid", "length"), "seqid")
        .filter(origin < F.col("length"))
        .select(
            "seqid",
            "tile",
            origin.alias("origin"),
            "length",
            F.least(F.lit(halo), origin).cast("int").alias("left"),
            F.least(F.lit(tile), F.col("length") - origin).cast("int").alias("core"),
            F.array_join(F.transform("cuts", lambda c: c["cut"]), "").alias("bases"),
        )
    )


def spread(tiles: DataFrame) -> DataFrame:
    """The tiles dealt over all tasks: contigs of one file or row group often share one."""
    return tiles.repartition("seqid", "tile")


def core_bases(tiles: DataFrame):
    """The tile's own bases, without the halo."""
    return F.substring(tiles["bases"], tiles["left"] + 1, tiles["core"])


def base_rows(tiles: DataFrame) -> DataFrame:
    """One row per base: ``seqid, pos, base``."""
    letters = F.split(core_bases(tiles), "")
    return tiles.select(
        "seqid", "origin", "core", F.posexplode(letters).alias("i", "base")
    ).filter("i < core").select("seqid", (F.col("origin") + F.col("i")).alias("pos"), "base")


def attach_tiles(
    windows: DataFrame,
    tiles: DataFrame,
    value: str,
    low: str,
    high: str,
    keep: Sequence[str],
    tile: int = TILE,
) -> DataFrame:
    """Join ``[low, high)`` windows with the per-base array or string of the tiles.

    A window meets each tile whose core it touches and gets that tile's part:
    ``part_start`` and ``part`` (a slice of ``value``). Windows stay spread over
    ``(seqid, tile)``, so the contig's size does not matter.
    """
    first = F.floor(F.greatest(F.col(low), F.lit(0)) / tile)
    last = F.floor((F.col(high) - 1) / tile)
    spread = windows.filter(F.col(high) > F.greatest(F.col(low), F.lit(0))).withColumn(
        "tile", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))
    )
    part_start = F.greatest(F.col(low), F.col("origin"))
    part_end = F.least(F.col(high), F.col("origin") + F.col("core"))
    at = (part_start - F.col("origin") + 1).cast("int")
    size = (part_end - part_start).cast("int")
    is_text = tiles.schema[value].dataType.typeName() == "string"
    cut = F.substring if is_text else F.slice
    source = F.col("_core") if is_text else F.col(value)
    sides = tiles.select(
        "seqid",
        "tile",
        "origin",
        "core",
        (core_bases(tiles).alias("_core") if is_text else F.col(value)),
    )
    return (
        spread.join(sides, ["seqid", "tile"])
        .filter(part_end > part_start)
        .select(*keep, part_start.alias("part_start"), cut(source, at, size).alias("part"))
    )


def window_text(
    windows: DataFrame, tiles: DataFrame, low: str, high: str, keep: Sequence[str]
) -> DataFrame:
    """The bases of each ``[low, high)`` window as ``text``; windows are tile-sized or less."""
    parts = attach_tiles(windows, tiles, "bases", low, high, keep)
    return (
        parts.groupBy(*keep)
        .agg(F.array_sort(F.collect_list(F.struct("part_start", "part"))).alias("_parts"))
        .withColumn("text", F.array_join(F.transform("_parts", lambda p: p["part"]), ""))
        .drop("_parts")
    )
