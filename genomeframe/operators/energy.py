"""Per-base wavelet energy and the profiles built from it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genomeframe.operators.scan import BIN_BITS, running_sum, sum_before
from genomeframe.operators.tiles import TILE, spread
from genomeframe.session import materialize

# Morlet scales, central frequency, cut-off and base encoding.
SCALES = (2, 3, 4)
OMEGA = 6.0
CUT_OFF = 8.0
#: Bases that the widest kernel reaches.
REACH = int(CUT_OFF * max(SCALES) + 1)
SIGNAL = {"A": 1 + 1j, "C": -1 - 1j, "G": -1 + 1j, "T": 1 - 1j}

RADIUS = 600
FLANK = 100
#: Tiles whose energy leaves a task at once, windows that are sent with one tile, windows added up at once.
SLICE, PACK, GATHER = 64, 4096, 256
#: Neighbouring windows that are one row of a matrix product.
STRETCH = 16


@lru_cache
def morlet_kernel(scale: int) -> np.ndarray:
    """Corrected Morlet wavelet integrated over unit-wide taps at one scale.

    Tap ``k`` is the integral over ``[(k-1/2)/scale, (k+1/2)/scale]``, cut off at
    ``|u| <= 8``, by Gauss-Legendre quadrature.
    """
    radius = int(8 * scale + 1)
    taps = np.arange(-radius, radius + 1)
    low = np.clip((taps - 0.5) / scale, -CUT_OFF, CUT_OFF)
    high = np.clip((taps + 0.5) / scale, -CUT_OFF, CUT_OFF)
    node, weight = np.polynomial.legendre.leggauss(16)
    u = (high + low)[:, None] / 2 + np.outer((high - low) / 2, node)
    wave = np.exp(-0.5 * u**2) * (np.exp(-1j * OMEGA * u) - np.exp(-0.5 * OMEGA**2))
    norm = 1 + np.exp(-(OMEGA**2)) - 2 * np.exp(-0.75 * OMEGA**2)
    scaled = np.sqrt(scale / (np.sqrt(np.pi) * norm))
    return scaled * (wave @ weight) * (high - low) / 2


@lru_cache
def _signal_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.complex128)
    for base, value in SIGNAL.items():
        table[ord(base)] = value / np.sqrt(2)
    return table


def stretch_table(weights: np.ndarray) -> np.ndarray:
    """Weights (row, place of the window, score) arranged for ``STRETCH`` neighbouring windows at once.

    The windows read one stretch of values; a column is a window and a score.
    """
    n_rows, width, n_scores = weights.shape
    table = np.zeros((n_rows, STRETCH + width - 1, STRETCH, n_scores))
    for i in range(STRETCH):
        table[:, i : i + width, i] = weights
    return table.reshape(-1, STRETCH * n_scores)


def window_products(rows: np.ndarray, count: int, table: np.ndarray) -> np.ndarray:
    """The scores of the windows that start at places 0 to ``count - 1`` of ``rows``, by a ``stretch_table``.

    Stretches overlap by less than a window, so a value is copied a few times and not once a window.
    """
    stretches, width = -(-count // STRETCH), len(table) // len(rows)
    short = (stretches - 1) * STRETCH + width - rows.shape[1]
    view = sliding_window_view(np.pad(rows, ((0, 0), (0, max(short, 0)))), width, axis=1)[:, ::STRETCH][:, :stretches]
    flat = view.transpose(1, 0, 2).reshape(stretches, -1)
    return (flat @ table).reshape(stretches * STRETCH, -1)[:count]


def _power(bases: str) -> np.ndarray:
    """Mean power over the scales for each base; powers are single precision."""
    signal = _signal_table()[np.frombuffer(bases.encode("ascii", "replace"), dtype=np.uint8)]
    total = np.zeros(len(signal))
    for scale in SCALES:
        # Correlation with the kernel is convolution with the reversed kernel.
        kernel = morlet_kernel(scale)[::-1]
        full = np.convolve(signal, kernel)
        half = len(kernel) // 2
        c = full[half : half + len(signal)]
        total += c.real.astype(np.float32) ** 2 + c.imag.astype(np.float32) ** 2
    return total / len(SCALES)


def energy_tiles(tiles: DataFrame, with_halo: bool = False) -> DataFrame:
    """Tiles with ``power``: the energy of the core bases as an array.

    ``with_halo`` keeps the halo's values too, aligned with ``bases``; they are
    exact up to the kernel radius from a cut edge.

    Each Arrow batch holds whole tiles, and the halo covers the kernels, so the
    job is one narrow pass without a shuffle. The minus strand's energy is the
    plus strand's reversed and is not computed again.
    """
    schema = T.StructType(
        [*tiles.schema.fields, T.StructField("power", T.ArrayType(T.DoubleType()))]
    )

    def add_power(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                made = []
                for bases, left, core in zip(*(part.column(c).to_pylist() for c in ("bases", "left", "core"))):
                    power = _power(bases)
                    made.append(power if with_halo else power[left : left + core])
                offsets = np.cumsum([0, *(len(m) for m in made)])
                power = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(made)))
                yield pa.RecordBatch.from_arrays([*part.columns, power], [*part.schema.names, "power"])

    return spread(tiles).mapInArrow(add_power, schema)


def energy_summary(tiles: DataFrame) -> DataFrame:
    """Per contig ``n``, ``mean_power`` and ``max_power``: one row leaves each tile."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cores = [
                _power(b)[left : left + core]
                for b, left, core in zip(batch["bases"], batch["left"], batch["core"])
            ]
            yield pd.DataFrame(
                {
                    "seqid": batch["seqid"],
                    "n": [len(c) for c in cores],
                    "total": [c.sum() for c in cores],
                    "most": [c.max() for c in cores],
                }
            )

    parts = spread(tiles).mapInPandas(summarise, "seqid string, n bigint, total double, most double")
    return parts.groupBy("seqid").agg(
        F.sum("n").alias("n"),
        (F.sum("total") / F.sum("n")).alias("mean_power"),
        F.max("most").alias("max_power"),
    )


def energy_rows(with_power: DataFrame) -> DataFrame:
    """One row per base: ``seqid, pos, power``."""
    return with_power.select(
        "seqid", "origin", F.posexplode("power").alias("i", "power")
    ).select("seqid", (F.col("origin") + F.col("i")).alias("pos"), "power")


def rank_rows(
    intervals: DataFrame, rows: int, bins: int | None = BIN_BITS
) -> DataFrame:
    """Sort intervals by (length, seqid, start, end, strand), cut into at most ``rows`` bins.

    Adds ``rank`` (from 0) and ``row``. The global rank is composed: intervals in
    earlier (length, seqid) groups, plus a prefix sum along the contig, plus the
    place among intervals with the same start; no task sorts everything.
    """
    group = ["_size", "seqid"]
    sized = intervals.withColumn("_size", F.col("end0") - F.col("start0"))
    at_start = running_sum(
        sized.groupBy(*group, "start0").agg(F.count("*").alias("_n")), group, "start0", ["_n"], bins
    )
    counts = sized.groupBy(*group).agg(F.count("*").alias("_m"))
    offsets = sum_before(counts, group, "_m", "_group_before").drop("_m")
    before = at_start.join(offsets, group).select(
        *group, "start0", (F.col("_group_before") + F.col("_n_sum") - F.col("_n")).alias("_before")
    )
    total = int(counts.agg(F.sum("_m")).first()[0] or 0)
    cuts = max(1, min(rows, total))
    within = Window.partitionBy(*group, "start0").orderBy("end0", "strand")
    # Row r holds ranks from floor(r * (total / cuts)) in double arithmetic; the
    # last edge is the total. A rank's row is the last edge not above it.
    step = total / cuts
    guess = F.least(F.floor(F.col("rank") / F.lit(step)), F.lit(cuts - 1)).cast("bigint")

    def edge(r):
        return F.when(r >= cuts, F.lit(total)).otherwise(F.floor(r * F.lit(step)))

    return (
        sized.join(before, [*group, "start0"])
        .withColumn("rank", F.row_number().over(within) - 1 + F.col("_before"))
        .withColumn("_guess", guess)
        .withColumn(
            "row",
            F.when(edge(F.col("_guess") + 1) <= F.col("rank"), F.col("_guess") + 1)
            .when(edge(F.col("_guess")) > F.col("rank"), F.col("_guess") - 1)
            .otherwise(F.col("_guess")),
        )
        .drop("_guess", "_size", "_before")
    )


def boundary_windows(intervals: DataFrame, lengths: DataFrame, keep: Sequence[str], radius: int) -> DataFrame:
    """Genomic windows of ``radius`` around both oriented boundaries of each interval."""
    first, last = F.col("start0"), F.col("end0") - 1
    plus = F.col("strand") == "+"
    sides = F.array(
        F.struct(F.lit("start").alias("boundary"), F.when(plus, first).otherwise(last).alias("centre")),
        F.struct(F.lit("end").alias("boundary"), F.when(plus, last).otherwise(first).alias("centre")),
    )
    return (
        intervals.join(lengths.select("seqid", "length"), "seqid")
        .select("seqid", "strand", "length", *keep, F.explode(sides).alias("b"))
        .select("seqid", "strand", "length", *keep, "b.*")
        .groupBy("seqid", "strand", "length", *keep, "boundary", "centre")
        .agg(F.count("*").alias("copies"))
        .withColumn("low", F.greatest(F.col("centre") - radius, F.lit(0)))
        .withColumn("high", F.least(F.col("centre") + radius + 1, F.col("length")))
    )


def _packed(windows: DataFrame, tiles: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Tiles with the windows that touch their cores: ``origin, left, length, core, bases, packed``.

    ``windows`` has ``seqid, low, high`` and the ``fields``. A row holds up to ``PACK`` windows, so bases
    are sent about once and the energy is computed where the windows are.
    """
    first = F.floor(F.greatest(F.col("low"), F.lit(0)) / TILE)
    last = F.floor((F.col("high") - 1) / TILE)
    dealt = windows.filter(F.col("high") > F.greatest(F.col("low"), F.lit(0))).select(
        "seqid", F.struct(*fields).alias("w"), F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("tile")
    )
    nth = F.row_number().over(Window.partitionBy("seqid", "tile").orderBy("w"))
    packs = (
        dealt.withColumn("pack", F.floor((nth - 1) / PACK))
        .groupBy("seqid", "tile", "pack")
        .agg(F.collect_list("w").alias("packed"))
    )
    sides = tiles.select("seqid", "tile", "origin", "left", "length", "core", "bases")
    # Merged, so both sides are dealt over all tasks and bases and windows are shuffled no second time.
    dealt = packs.hint("merge").join(sides, ["seqid", "tile"])
    return dealt.select("origin", "left", "length", "core", "bases", "packed")


def _tile_values(bases: str, origin: int, left: int, length: int, core: int, slopes: bool) -> list[np.ndarray]:
    """The energy of a tile's core and, if wanted, its central difference, one-sided at the contig's ends."""
    power = _power(bases)
    values = [power[left : left + core]]
    if slopes:
        at = np.arange(left, left + core)
        low, high = np.maximum(at - 1, left - origin), np.minimum(at + 1, length - 1 - origin + left)
        low, high = np.maximum(low, 0), np.minimum(high, len(power) - 1)
        values.append((power[high] - power[low]) / np.maximum(high - low, 1))
    return values


def _window_sums(keys: Sequence[str], radius: int, slopes: bool):
    """Add windows up per key within a task: an array of totals, of slopes if wanted, and of counts."""
    width = 2 * radius + 1

    def add_tile(sums: dict[tuple, np.ndarray], values: list[np.ndarray], origin: int, windows: pa.StructArray) -> None:
        core = len(values[0])
        centre, copies, low, high = (
            windows.field(c).to_numpy(zero_copy_only=False) for c in ("centre", "copies", "low", "high")
        )
        minus = ~np.asarray(windows.field("strand").fill_null("").to_numpy(zero_copy_only=False) == "+")
        code, names = np.zeros(len(windows), dtype=np.int64), []
        for k in keys:
            coded = windows.field(k).dictionary_encode(null_encoding="encode")
            names.append(coded.dictionary.to_pylist())
            code = code * len(names[-1]) + coded.indices.to_numpy(zero_copy_only=False)
        # positions of the windows in the core, and the core between zeros on both sides
        a, b = np.maximum(low, origin) - (centre - radius), np.minimum(high, origin + core) - (centre - radius)
        views = [sliding_window_view(np.pad(v, 2 * radius), width) for v in values]
        begin = centre - origin + radius
        order = np.argsort(code, kind="stable")
        order = order[(b > a)[order]]
        for first in range(0, len(order), GATHER):
            at = order[first : first + GATHER]
            # rare: a window that ends within the core, other than by its radius
            cut = np.flatnonzero(high[at] < np.minimum(origin + core, centre[at] + radius + 1))
            flip = minus[at]
            parts = []
            for i, view in enumerate(views):
                part = view[begin[at]]
                for k in cut:
                    part[k, max(b[at[k]], 0) :] = 0.0
                part[flip] = (part[flip] if i == 0 else -part[flip])[:, ::-1]
                parts.append(part)
            inside = np.zeros((len(at), width + 1))
            np.add.at(inside, (np.arange(len(at)), np.where(flip, width - b[at], a[at])), 1.0)
            np.add.at(inside, (np.arange(len(at)), np.where(flip, width - a[at], b[at])), -1.0)
            parts.append(np.cumsum(inside[:, :-1], axis=1))
            starts = np.flatnonzero(np.append(True, np.diff(code[at]) != 0))
            added = [np.add.reduceat(p * copies[at, None], starts, axis=0) for p in parts]
            for n, start in enumerate(starts):
                rest, key = int(code[at[start]]), []
                for name in reversed(names):
                    rest, k = divmod(rest, len(name))
                    key.append(name[k])
                total = sums.setdefault(tuple(reversed(key)), np.zeros((len(parts), width)))
                for i, rows in enumerate(added):
                    total[i] += rows[n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("origin", "left", "length", "core", "bases"))
            packed = batch.column("packed")
            for i, (origin, left, length, core, bases) in enumerate(zip(*columns)):
                values = _tile_values(bases, origin, left, length, core, slopes)
                add_tile(sums, values, origin, packed[i].values)
        yield from _sum_rows(sums)

    return run


def _sum_rows(sums: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each key and kind of sum, some at a time."""
    found = list(sums.items())
    for start in range(0, len(found), SLICE):
        part = found[start : start + SLICE]
        keys = [pa.array(c) for c in zip(*(k for k, _ in part))]
        kinds = range(len(part[0][1]))
        values = [pa.array([s[i] for _, s in part], pa.list_(pa.float64())) for i in kinds]
        yield pa.RecordBatch.from_arrays([*keys, *values], [*(f"k{i}" for i in range(len(keys))), *(f"v{i}" for i in kinds)])


def _merged_sums(n_keys: int):
    """Add rows of ``_sum_rows`` up; the rows of a key lie in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(n_keys)))
            for i, key in enumerate(keys):
                own = np.array([c[i].values.to_numpy() for c in batch.columns[n_keys:]])
                sums[key] = sums[key] + own if key in sums else own
        yield from _sum_rows(sums)

    return run


def window_sums(windows: DataFrame, tiles: DataFrame, keys: Sequence[str], radius: int, slopes: bool = False) -> DataFrame:
    """``keys, offset, total`` (and ``slope``) and ``n`` of the energy around the centres of weighted windows.

    ``windows`` has ``seqid, strand, centre, low, high, copies`` and the keys. Bases and windows
    meet by tile; a task adds its windows up as arrays, and only these, a row for each key, are shuffled.
    """
    kinds = dict(windows.dtypes)
    names = ["total", "slope", "n"] if slopes else ["total", "n"]
    schema = ", ".join([f"k{i} {kinds[k]}" for i, k in enumerate(keys)] + [f"v{i} array<double>" for i in range(len(names))])
    rows = windows.filter("centre is not null").withColumn("centre", F.col("centre").cast("bigint"))
    packed = _packed(rows, tiles, ["strand", "centre", "low", "high", "copies", *keys])
    own = [f"k{i}" for i in range(len(keys))]
    parts = packed.mapInArrow(_window_sums(keys, radius, slopes), schema)
    merged = parts.repartition(*own).mapInArrow(_merged_sums(len(keys)), schema)
    cells = F.arrays_zip(*(F.col(f"v{i}").alias(n) for i, n in enumerate(names)))
    return (
        merged.select(*(F.col(o).alias(k) for o, k in zip(own, keys)), F.posexplode(cells).alias("i", "c"))
        .select(*keys, (F.col("i") - radius).alias("offset"), "c.*")
        .withColumn("n", F.col("n").cast("bigint"))
        .filter("n > 0")
    )


def boundary_profile(
    intervals: DataFrame,
    lengths: DataFrame,
    tiles: DataFrame,
    row: str | None = "row",
    radius: int = RADIUS,
) -> DataFrame:
    """Sums and counts of energy per (row, boundary, offset) around interval boundaries.

    Offsets are oriented. Intervals sharing a boundary are counted once with a
    weight. Each task computes the energy of its tiles and adds their windows up as arrays,
    so only ``rows x 2`` of them per task are shuffled. ``row=None`` makes one
    row of all intervals, which is enough for the mean profile.
    """
    numbered = F.lit(0) if row is None else F.col(row)
    windows = boundary_windows(
        intervals.withColumn("row", numbered.cast("bigint")), lengths, ["row"], radius
    )
    return window_sums(windows, tiles, ["row", "boundary"], radius)


def profile_matrix(profile: DataFrame, row: str = "row") -> DataFrame:
    """Mean energy and ``log1p`` image value per cell; uncovered cells have no row."""
    mean = F.col("total") / F.col("n")
    return profile.select(
        row, "boundary", "offset", mean.alias("mean_power"), F.log1p(mean).alias("log_power")
    )


def mean_profile(profile: DataFrame) -> DataFrame:
    """Mean over all intervals per (boundary, offset)."""
    return profile.groupBy("boundary", "offset").agg(
        (F.sum("total") / F.sum("n")).alias("mean_power")
    )


def profile_peaks(mean: DataFrame, flank: int = FLANK) -> DataFrame:
    """Peak offset upstream of the start and downstream of the end.

    The highest local maximum (above its left and not below its right
    neighbour), the first of equals; without one, the first highest value.
    The profile has at most ``2 * flank`` rows by then.
    """
    upstream = (F.col("boundary") == "start") & F.col("offset").between(-flank, -1)
    downstream = (F.col("boundary") == "end") & F.col("offset").between(1, flank)
    curve = mean.filter(upstream | downstream)
    along = Window.partitionBy("boundary").orderBy("offset")
    power = F.col("mean_power")
    left, right = F.lag("mean_power").over(along), F.lead("mean_power").over(along)
    first_of_equals = F.struct("mean_power", -F.col("offset"))
    return (
        curve.withColumn("_local", (power > left) & (power >= right))
        .groupBy("boundary")
        .agg(
            F.coalesce(
                F.max_by("offset", F.when(F.col("_local"), first_of_equals)),
                F.max_by("offset", first_of_equals),
            ).alias("peak")
        )
    )


#: Cells of one counting pass, and values few enough to be sorted at once.
CELLS, FEW = 4096, 1 << 16


def order_statistic(values: DataFrame, column: str, rank: int) -> float:
    """The value of the given rank (from 0), by counting in ever narrower cells.

    A pass brings one row for each of at most ``CELLS`` cells to the driver, and the
    last one the at most ``FEW`` values of the cell that holds the rank.
    """
    v = F.col(column)
    low, high, count = values.agg(F.min(v), F.max(v), F.count("*")).first()
    while low < high and count > FEW:
        width = (high - low) / CELLS
        cell = F.least(F.floor((v - low) / width), F.lit(CELLS - 1))
        inside = values.filter(v.between(low, high))
        cells = inside.groupBy(cell.alias("cell")).agg(
            F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")
        )
        for r in sorted(cells.collect(), key=lambda r: r.cell):
            if rank < r.n:
                low, high, count = r.low, r.high, r.n
                break
            rank -= r.n
    if low == high:
        return low
    return sorted(r[0] for r in values.filter(v.between(low, high)).select(v).collect())[rank]


def energy_quantile(values: DataFrame, column: str, q: float = 0.995) -> DataFrame:
    """Linear-interpolation quantile of the finite values."""
    finite = values.filter(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).cast("double"))
    finite = materialize(finite, "finite")
    spark, n = values.sparkSession, finite.count()
    if not n:
        return spark.createDataFrame([(None,)], "quantile double")
    at = q * (n - 1)
    first = order_statistic(finite, column, int(at))
    second = order_statistic(finite, column, min(int(at) + 1, n - 1)) if at > int(at) else first
    return spark.createDataFrame([(first + (at - int(at)) * (second - first),)], "quantile double")


def bin_sums(power: np.ndarray, at: int, width: float, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins that the bases from ``at`` on touch, and how much energy they bring to each.

    With prefix sums a bin of any width costs two lookups between bases.
    """
    upto = np.append(0.0, np.cumsum(power))
    first, last = int(at / width), min(int((at + len(power)) / width), bins - 1)
    numbers = np.arange(first, last + 1)
    edges = np.append(numbers, last + 1) * width - at
    edges[-1] = max(edges[-1], len(power)) if last == bins - 1 else edges[-1]
    sums = np.diff(np.interp(np.clip(edges, 0, len(power)), np.arange(len(upto)), upto))
    return numbers, sums


def region_energy(
    regions: DataFrame,
    lengths: DataFrame,
    tiles: DataFrame,
    flank: int,
    pixels: int = 1600,
) -> DataFrame:
    """``log1p`` of area-resampled energy per region and oriented bin.

    ``regions`` has ``region, seqid, strand, start0, end0``. Each base spreads
    its energy over the fractional bins it covers, whatever the region's size. A part
    of a region in one tile gives a row for each bin it touches, from prefix sums. The
    bins of a region with one part are whole at once; only those of the others are shuffled.
    """
    tiles = materialize(tiles, "region-tiles")
    spans = (
        regions.join(lengths.select("seqid", "length"), "seqid")
        .withColumn("low", F.greatest(F.col("start0") - flank, F.lit(0)))
        .withColumn("high", F.least(F.col("end0") + flank, F.col("length")))
        .withColumn("size", F.col("high") - F.col("low"))
        .filter("high > low")
    )
    spans = materialize(spans.select("region", "seqid", "strand", "low", "high", "size"), "regions")
    touched = F.explode(
        F.sequence(F.floor(F.col("low") / TILE).cast("bigint"), F.floor((F.col("high") - 1) / TILE).cast("bigint"))
    )
    parts = spans.withColumn("tile", touched).join(tiles.select("seqid", "tile"), ["seqid", "tile"])
    several = parts.groupBy("region").agg(F.count("*").alias("parts")).filter("parts > 1").select("region")
    several = materialize(several, "regions-in-parts")
    fields = ["region", "strand", "low", "high", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("origin", "left", "core", "bases"))
            packed = batch.column("packed")
            for i, (origin, left, core, bases) in enumerate(zip(*columns)):
                power = _power(bases)[left : left + core]
                windows = packed[i].values
                for start in range(0, len(windows), GATHER):
                    some = windows.slice(start, GATHER)
                    regions_, bins, amounts = [], [], []
                    for k, (strand, low, high, size) in enumerate(zip(*(some.field(c).to_pylist() for c in fields[1:]))):
                        first, last = max(low, origin), min(high, origin + core)
                        if last <= first:
                            continue
                        own = power[first - origin : last - origin]
                        if strand != "+":
                            own, at = own[::-1], high - first - len(own)
                        else:
                            at = first - low
                        n = min(pixels, size)
                        numbers, found = bin_sums(own, at, size / n, n)
                        regions_.append(np.full(len(numbers), k))
                        bins.append(numbers)
                        amounts.append(found / (size / n))
                    if regions_:
                        at = pa.array(np.concatenate(regions_))
                        made = [some.field("region").take(at), pa.array(np.concatenate(bins)), pa.array(np.concatenate(amounts))]
                        yield pa.RecordBatch.from_arrays(made, ["region", "bin", "mean_power"])

    kind = dict(regions.dtypes)["region"]

    def binned(rows: DataFrame) -> DataFrame:
        return _packed(rows, tiles, fields).mapInArrow(run, f"region {kind}, bin long, mean_power double")

    same = spans["region"].eqNullSafe(several["region"])
    whole = binned(spans.join(several, same, "left_anti"))
    shared = binned(spans.join(several, same, "left_semi")).groupBy("region", "bin").agg(F.sum("mean_power").alias("mean_power"))
    return whole.unionByName(shared).withColumn("log_power", F.log1p("mean_power"))


def landmark_profile(
    landmarks: DataFrame, lengths: DataFrame, tiles: DataFrame, radius: int = 15
) -> DataFrame:
    """Mean power and slope within ``radius`` of each oriented landmark.

    ``landmarks`` has ``seqid, strand, landmark, pos`` with genomic positions.
    The slope is the central difference, one-sided at the contig's ends; the
    halo of a tile holds the power beyond its core.
    """
    windows = (
        landmarks.join(lengths.select("seqid", "length"), "seqid")
        .groupBy("seqid", "strand", "length", "landmark", F.col("pos").alias("centre"))
        .agg(F.count("*").alias("copies"))
        .withColumn("low", F.greatest(F.col("centre") - radius, F.lit(0)))
        .withColumn("high", F.least(F.col("centre") + radius + 1, F.col("length")))
    )
    # A contig that is given twice has its landmarks' copies counted above already.
    once = tiles.dropDuplicates(["seqid", "tile"])
    return window_sums(windows, once, ["landmark"], radius, slopes=True).select(
        "landmark",
        "offset",
        (F.col("total") / F.col("n")).alias("mean_power"),
        (F.col("slope") / F.col("n")).alias("mean_slope"),
        "n",
    )
