"""Steps that were rewritten for larger tables, against plain computations."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from genomeframe import driver_views, session
from genomeframe.operators import energy, samples, tiles
from genomeframe.sources import byte_ranges


@pytest.fixture(scope="module")
def spark():
    return session.local_session("4", 4)


def test_contigs_map_each_character(spark, tmp_path):
    rows = [(1, "aé\U0001F600 Z b\n\tC\x0b!"), (2, None), (3, " \n"), (4, "n")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = driver_views.contigs(spark, str(tmp_path)).orderBy("ord").collect()
    assert [tuple(r) for r in found] == [("1", 1, "ANNCCGNN", 8), ("4", 4, "C", 1)]
    plan = driver_views.contigs(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan and "regexp_replace" not in plan


@pytest.mark.parametrize("ordinal", [0, 17, -3, None])
def test_md5_draws(ordinal):
    positions = np.array([0, 9, 10, 99, 12345, 10**9])
    found = samples.md5_draws(ordinal, positions, [4, 7])
    for row, p in zip(found, positions):
        for value, bit in zip(row, (4, 7)):
            key = ":".join(str(v) for v in (0, ordinal, p, bit) if v is not None)
            assert value == int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def test_drawn_boundaries_equal_the_column_form(spark):
    contigs = spark.createDataFrame([("a", 5, 300), ("b", None, 120)], "seqid string, ord int, length bigint")
    labels = spark.createDataFrame([("a", 7, 3)], "seqid string, pos bigint, labels int")
    by_column = lambda *c: samples.md5_mix(*c)
    one, other = (sorted(map(tuple, samples.site_samples(contigs, labels, 8, m).collect())) for m in (samples.md5_mix, by_column))
    assert one == other and len(one) > 100


def test_drawn_boundaries_of_short_contigs_are_dealt_over_all_tasks(spark):
    """Ranges are a few bytes each: adaptive execution must not put them into one task."""
    contigs = spark.range(400).selectExpr("cast(id as string) seqid", "cast(id as int) ord", "id % 90 length")
    ranges = contigs.withColumn("from", F.lit(0).cast("bigint"))
    drawn = samples._drawn_boundaries(ranges, 2, samples.md5_keys, samples.keyed_hits)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks > 1 and drawn.groupBy(F.spark_partition_id()).count().count() == tasks
    want = set()
    for r in contigs.collect():
        for own in range(r.length + 1):
            for bit in range(8):
                if int(hashlib.md5(f"0:{r.ord}:{own}:{bit}".encode()).hexdigest()[:15], 16) % 2 == 0:
                    want.add((r.seqid, "+-"[bit // 4], own if bit < 4 else r.length - own, bit % 4))
    found = [tuple(r) for r in drawn.collect()]
    assert len(found) == len(want) and set(found) == want


def _cut(spark, lengths):
    rng = np.random.default_rng(3)
    rows = [(n, "".join(rng.choice(list("ACGTN"), size))) for n, size in lengths.items()]
    contigs = spark.createDataFrame(rows, "seqid string, bases string").withColumn("length", F.length("bases").cast("bigint"))
    return contigs, {n: energy._power(b) for n, b in rows}


def test_window_sums_across_tiles(spark):
    lengths = {"a": 40_000, "b": 50, "c": 1}
    contigs, power = _cut(spark, lengths)
    marks = [("a", "+", "x", 16_383), ("a", "-", "x", 16_384), ("a", "-", "x", 16_384), ("a", "+", "y", 0), ("b", "-", "y", 49), ("c", "-", "x", 0), ("b", "+", "y", None)]
    cut = tiles.tile_contigs(contigs)
    found = energy.landmark_profile(  # tiles that are given twice count once
        spark.createDataFrame(marks, "seqid string, strand string, landmark string, pos bigint"), contigs, cut.unionByName(cut), 20
    )
    want = {}
    for seqid, strand, mark, pos in marks:
        for offset in range(-20, 21):
            at = None if pos is None else pos + (offset if strand == "+" else -offset)
            if at is not None and 0 <= at < lengths[seqid]:
                own = power[seqid]
                low, high = max(at - 1, 0), min(at + 1, len(own) - 1)
                slope = (own[high] - own[low]) / max(high - low, 1) * (1 if strand == "+" else -1)
                want.setdefault((mark, offset), []).append((own[at], slope))
    rows = {(r.landmark, r.offset): r for r in found.collect()}
    assert rows.keys() == want.keys()
    for key, values in want.items():
        assert rows[key].n == len(values)
        assert np.allclose([rows[key].mean_power, rows[key].mean_slope], np.mean(values, axis=0))


def test_boundary_profile_across_tiles(spark):
    contigs, power = _cut(spark, {"a": 40_000, "b": 700})
    rows = [("a", "+", 16_000, 16_500, 0), ("a", "-", 16_000, 16_500, 1), ("b", "-", 5, 650, 0), ("b", "-", 5, 640, 0)]
    intervals = spark.createDataFrame(rows, "seqid string, strand string, start0 bigint, end0 bigint, row bigint")
    found = energy.boundary_profile(intervals, contigs, tiles.tile_contigs(contigs)).collect()
    want = {}
    for seqid, strand, a, b, row in rows:
        for boundary, centre in zip(("start", "end"), (a, b - 1) if strand == "+" else (b - 1, a)):
            for offset in range(-600, 601):
                at = centre + (offset if strand == "+" else -offset)
                if 0 <= at < len(power[seqid]):
                    want.setdefault((row, boundary, offset), []).append(power[seqid][at])
    assert {(r.row, r.boundary, r.offset): r.n for r in found} == {k: len(v) for k, v in want.items()}
    assert all(np.isclose(r.total, sum(want[r.row, r.boundary, r.offset])) for r in found)


def test_region_energy_adds_parts_and_repeats(spark):
    contigs, power = _cut(spark, {"a": 40_000, "b": 700})
    rows = [("r", "a", "+", 16_000, 17_000), ("s", "b", "-", 0, 700), ("s", "b", "-", 0, 700)]
    regions = spark.createDataFrame(rows, "region string, seqid string, strand string, start0 bigint, end0 bigint")
    found = energy.region_energy(regions, contigs, tiles.tile_contigs(contigs), 0).collect()
    values = {(r.region, r.bin): r.mean_power for r in found}
    assert len(values) == len(found) == 1700
    assert np.allclose([values["r", i] for i in range(1000)], power["a"][16_000:17_000])
    assert np.allclose([values["s", i] for i in range(700)], 2 * power["b"][::-1])


def test_site_windows_power_at_edges(spark):
    contigs, power = _cut(spark, {"a": 40_000, "b": 40})
    rows = [("a", "+", 0), ("a", "-", 16_384), ("a", "+", 40_000), ("b", "-", 20)]
    sites = spark.createDataFrame(rows, "seqid string, strand string, pos bigint").join(contigs.select("seqid", "length"), "seqid")
    found = samples.site_windows(sites, tiles.tile_contigs(contigs), "pos", ["seqid", "strand", "pos"]).collect()
    assert len(found) == 4
    for r in found:
        low = r.pos - 64 - (r.strand == "-")
        own = [power[r.seqid][i] if 0 <= i < len(power[r.seqid]) else 0.0 for i in range(low, low + 129)]
        assert np.allclose(r.powers, own if r.strand == "+" else own[::-1])


def test_fasta_source_travels_by_value(spark, tmp_path, monkeypatch):
    """The registered class can be loaded where this package is not on the path."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "x.fa").write_text(">a\nACGT\n")
    kept = []
    real = type(spark.dataSource).register

    def register(self, source):
        kept.append(cloudpickle.dumps(source))
        return real(self, source)

    monkeypatch.setattr(type(spark.dataSource), "register", register)
    byte_ranges.fasta_pieces(spark, f"file://{tmp_path}/x.fa")
    load = "import sys, pyspark.cloudpickle as c; print(c.loads(sys.stdin.buffer.read()).name())"
    done = subprocess.run([sys.executable, "-I", "-c", load], input=kept[0], capture_output=True)
    assert done.stdout.strip() == b"fasta", done.stderr
