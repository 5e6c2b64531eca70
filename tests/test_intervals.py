"""Interval operators: hand cases, and scans over partitions against plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from genomeframe.operators import intervals as iv
from genomeframe.operators import ordered, scan

COLUMNS = "seqid string, strand string, start0 bigint, end0 bigint"
HOT = [None, 5]


def frame(spark, rows):
    return spark.createDataFrame([("c", "+", a, b) for a, b in rows], COLUMNS)


def pairs(df):
    return sorted((r.start0, r.end0) for r in df.collect())


def merge(rows):
    out = []
    for a, b in sorted(rows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@pytest.fixture(scope="module")
def scattered():
    rng = random.Random(3)
    starts = [rng.randrange(0, 400_000) for _ in range(300)] + [70_000] * 20
    return [(a, a + rng.choice([3, 50, 90_000 if rng.random() < 0.03 else 700])) for a in starts]


def test_hand_merge(spark):
    assert pairs(iv.merge_intervals(frame(spark, [(0, 5), (5, 9), (10, 12)]))) == [(0, 9), (10, 12)]


@pytest.mark.parametrize("hot", HOT)
def test_merge_and_gaps(spark, scattered, hot):
    merged = merge(scattered)
    df = frame(spark, scattered)
    assert pairs(iv.merge_intervals(df, iv.PLACE, hot)) == merged
    want = [(x[1], y[0]) for x, y in zip(merged, merged[1:])]
    assert pairs(iv.interval_gaps(frame(spark, merged), iv.PLACE, hot)) == want


def test_overlap_joins(spark, scattered):
    merged = merge(scattered[:100])
    rng = random.Random(5)
    probes = [(a, a + rng.choice([1, 40, 3000])) for a in (rng.randrange(0, 500_000) for _ in range(200))]
    touching = sorted(p for p in probes if any(a < p[1] and p[0] < b for a, b in merged))
    df, regions = frame(spark, probes), frame(spark, merged)
    assert pairs(iv.overlapping(df, regions)) == touching
    rest = sorted(set(probes) - set(touching))
    assert sorted(set(pairs(iv.not_overlapping(df, regions)))) == rest


def test_covered_length(spark, scattered):
    a, b = scattered[:150], scattered[150:]
    base = [{p for x, y in side for p in range(x, y)} for side in (a, b)]
    rows = [("c", "+", x, y, s) for s, side in enumerate((a, b)) for x, y in side]
    df = spark.createDataFrame(rows, COLUMNS + ", side int")
    got = iv.covered_length(df, "side").first()
    assert tuple(got) == (len(base[0]), len(base[1]), len(base[0] & base[1]))


@pytest.fixture(params=["one key", "many keys", "two keys"])
def spread_out(request, spark):
    """Rows of (key, start, end) with keys in one to several of 8 partitions that stay apart."""
    rng = random.Random(request.param)
    keys = {"one key": ["c"], "many keys": [f"k{i}" for i in range(60)] + [None], "two keys": ["a", "b"]}[request.param]
    rows = []
    for _ in range(400):
        a = rng.randrange(0, 20_000)
        rows.append((rng.choice(keys), a, a + rng.choice([1, 20, 60, 9_000 if rng.random() < 0.05 else 100])))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows, spark.createDataFrame(rows, "k string, start0 bigint, end0 bigint")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_key(rows):
    out = {}
    for k, *rest in rows:
        out.setdefault(k, []).append(tuple(rest))
    return out


def collected(df):
    return sorted(((r[0], r[1], r[2]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("strict", [False, True])
def test_islands_over_partitions(spread_out, strict):
    rows, df = spread_out
    want = []
    for k, own in by_key(rows).items():
        made = []
        for a, b in sorted(own):
            if made and (a < made[-1][1] if strict else a <= made[-1][1]):
                made[-1] = (made[-1][0], max(made[-1][1], b))
            else:
                made.append((a, b))
        want += [(k, *m) for m in made]
    assert collected(ordered.islands(df, ["k"], strict)) == sorted(want, key=repr)


def test_gaps_over_partitions(spread_out):
    rows, df = spread_out
    want = [(k, x[1], y[0]) for k, own in by_key(rows).items()
            for x, y in zip(sorted(own), sorted(own)[1:]) if y[0] > x[1]]
    assert collected(ordered.gaps(df, ["k"])) == sorted(want, key=repr)


@pytest.mark.parametrize("wanted", [True, False])
def test_touching_over_partitions(spark, spread_out, wanted):
    rows, df = spread_out
    rng = random.Random(1)
    regions = []
    for k in {r[0] for r in rows} - {"k7"}:
        regions += [(k, a, b) for a, b in merge([(x, x + 150) for x in rng.sample(range(20_000), 9)])]
    merged = spark.createDataFrame(regions, "k string, start0 bigint, end0 bigint")
    probes = [(k, a, b) for k, a, b in rows]
    want = [p for p in probes if any(r[0] == p[0] and r[1] < p[2] and p[1] < r[2] for r in regions) == wanted]
    extra = df.withColumn("more", F.lit("x"))
    got = ordered.touching(extra, merged, ["k"], wanted)
    assert got.columns == extra.columns and collected(got) == sorted(want, key=repr)


def test_prefix_sums_over_partitions(spread_out):
    rows, df = spread_out
    made = ordered.prefix_sums(df, ["k"], "start0", ["end0"]).collect()
    totals = {}
    for k, own in by_key(rows).items():
        for a, _ in own:
            totals[k, a] = sum(b for x, b in own if x <= a)
    assert len(made) == len(rows)
    last = {}
    for r in made:
        last[r.k, r.start0] = max(last.get((r.k, r.start0), 0), r.end0_sum)
    assert last == totals


def test_nothing_to_scan(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert iv.merge_intervals(empty).count() == iv.interval_gaps(empty, iv.PLACE).count() == 0
    some = frame(spark, [(0, 5)])
    assert pairs(iv.not_overlapping(some, empty)) == [(0, 5)] and iv.overlapping(some, empty).count() == 0


@pytest.mark.parametrize("hot", HOT)
def test_running_sum(spark, hot):
    rng = random.Random(9)
    rows = [("k", p, rng.randrange(-5, 6)) for p in rng.sample(range(300_000), 200)]
    df = spark.createDataFrame(rows, "k string, p bigint, v bigint")
    total, want = 0, {}
    for _, p, v in sorted(rows, key=lambda r: r[1]):
        total += v
        want[p] = total
    assert {r.p: r.v_sum for r in scan.running_sum(df, ["k"], "p", ["v"], hot).collect()} == want


@pytest.mark.parametrize("shared,answer", [(75, True), (74, False)])
def test_reciprocal(spark, shared, answer):
    a = spark.createDataFrame([(1, 0, 100)], "k int, start0 bigint, end0 bigint")
    b = spark.createDataFrame([(1, 100 - shared, 200 - shared)], "k int, start0 bigint, end0 bigint")
    assert iv.reciprocal_overlap(a, b, ["k"]).first().reciprocal is answer
