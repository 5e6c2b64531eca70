"""Readers and writers on small own files, order statistics and global prefix sums."""

import collections
import gzip
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from genomeframe.operators import controls, energy, features, motifs, scan, tiles
from genomeframe.queries import rule_model
from genomeframe.sinks import tables as sinks
from genomeframe.sources import byte_ranges, fasta, gff3
from genomeframe.sources.model import FEATURES, read_model

GFF3 = """##gff-version 3
c1\tt\tmRNA\t1\t90\t.\t+\t.\tID=t%201;Parent=g%2B1
c1\tt\texon\t1\t30\t.\t+\t.\tParent=t%201
c1\tt\tCDS\t10\t30\t.\t+\t0\tParent=t%201;note=50%x
# comment

c1\tt\texon\t61\t90\t.\t+\t.\tParent=t%201
c1\tt\trepeat_region\t5\t9\t.\t+\t.\tID=r
"""


@pytest.fixture
def models(spark, tmp_path):
    (tmp_path / "a.gff3").write_text(GFF3)
    return gff3.read_features(spark, str(tmp_path))


def test_scoring_view_takes_ids_from_the_transcript_row(models):
    rows = gff3.scoring_view(models).rows.collect()
    assert {(r.gid, r.tid) for r in rows} == {("g+1", "t 1")}
    assert sorted((r.kind, r.start0, r.end0) for r in rows) == [("CDS", 9, 30), ("exon", 0, 30), ("exon", 60, 90)]


def test_training_and_feature_views(spark, models):
    contigs = spark.createDataFrame([("c1", 90)], "seqid string, length long")
    rows = gff3.training_view(models, contigs).rows.collect()
    assert {r.tid for r in rows} == {"t%201"} and len(rows) == 3
    assert sum(r.repeat for r in gff3.feature_view(models).rows.collect()) == 1


def test_training_view_refuses_rows_outside_their_contig(spark, models):
    for contig in (("c1", 80), ("c2", 500)):
        contigs = spark.createDataFrame([contig], "seqid string, length long")
        with pytest.raises(ValueError):
            gff3.training_view(models, contigs)


@pytest.mark.parametrize("text,want", [("50%x", "50%x"), ("a%20b+c", "a b+c"), ("%", "%"), ("%4", "%4"), ("%41%", "A%")])
def test_stray_percent_signs_stay(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(gff3._decoded(F.col("t"))).first()[0]
    assert got == want


def test_model_round_trip(spark, tmp_path):
    model = rule_model()
    sinks.write_model(spark, model, str(tmp_path))
    again = read_model(spark, str(tmp_path))
    assert (again.max_intron, again.max_span) == (model.max_intron, model.max_span)
    for name in FEATURES:
        assert np.array_equal(again.weights[name], model.weights[name])


def test_distance_table_has_its_header(spark, tmp_path):
    rows = [("c", "+", 9, 20, "start", 3, 12, "ACG")]
    kmers = spark.createDataFrame(
        rows, "seqid string, strand string, start0 long, end0 long, boundary string, peak long, centre long, kmer string"
    )
    sinks.write_kmers(kmers, str(tmp_path / "k"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "k/distances")).collect()]
    assert lines[0] == "flank\tsequence_id\tdistance_bp" and len(lines) == 2


@pytest.mark.parametrize("few", [1 << 16, 5])
def test_quantile_by_cells(spark, monkeypatch, few):
    monkeypatch.setattr(energy, "FEW", few)
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.exponential(1.0, 300), np.zeros(60), np.full(40, 2.5)])
    frame = spark.createDataFrame([(float(v),) for v in values], "p double")
    for q in (0.0, 0.1, 0.5, 0.995, 1.0):
        assert energy.energy_quantile(frame, "p", q).first()[0] == pytest.approx(np.quantile(values, q))
    assert energy.energy_quantile(frame.limit(0), "p").first()[0] is None


def test_sum_before(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 10**6), rnd.randint(0, 9)) for _ in range(500)]
    rows = list({k: (k, v) for k, v in rows}.values())
    got = scan.sum_before(spark.createDataFrame(rows, "k long, v long"), ["k"], "v", "before").collect()
    want, total = {}, 0
    for k, v in sorted(rows):
        want[k], total = total, total + v
    assert {r.k: r.before for r in got} == want


def random_fasta(rng, newline):
    """Text, and its records as (id, bases): headers of any length, one-line and wrapped records."""
    records, lines = [], []
    for i in range(rng.randint(1, 6)):
        bases = "".join(rng.choice("ACGTN") for _ in range(rng.choice([1, 5, 40, 300])))
        name = f"r{i}"
        lines.append(f">{' ' * rng.randint(0, 2)}{name}{rng.choice(['', ' some > text', ' ' + 'x' * 90])}")
        width = rng.choice([3, 7, 400])
        body = [bases[a : a + width] for a in range(0, len(bases), width)]
        lines += [b.lower() if rng.random() < 0.3 else b for b in body] + [""] * rng.randint(0, 1)
        records.append((name, bases))
    return newline.join(lines) + newline * rng.randint(0, 1), records


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_byte_ranges_find_their_borders(newline):
    """Ranges of any size give the records, also where borders lie inside headers and line ends."""
    rng = random.Random(4)
    for _ in range(150):
        text, records = random_fasta(rng, newline)
        data, size = text.encode(), rng.choice([1, 2, 3, 7, 30, 200, 10_000])
        found, in_header = [], False
        for a in range(0, len(data), size):
            part = byte_ranges.ByteRange("f", a, min(a + size, len(data)))
            rows = [r for b in byte_ranges.read_range(io.BytesIO(data), part, rng.choice([1, 5, 64])) for r in b.to_pylist()]
            assert [r["row"] for r in rows] == [*range(len(rows) - 1), -1]
            for r in rows[:-1]:
                if r["header"]:
                    found.append([re.match(r">\s*(\S*)", r["value"])[1], ""])
                elif not (r["fragment"] and in_header):
                    found[-1][1] += r["value"].upper()
            in_header = in_header if rows[-1]["in_header"] is None else rows[-1]["in_header"]
        assert [tuple(f) for f in found] == records


@pytest.mark.parametrize("packed", [False, True])
def test_one_line_records_are_read_by_many_tasks(spark, tmp_path, packed):
    rng = random.Random(5)
    bases = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in (("long", 90_000), ("short", 70), ("other", 40_000))}
    text = "".join(f">{c} {'y' * 5_000}\n{b}\n" for c, b in bases.items()).encode()
    path = tmp_path / ("a.fa.gz" if packed else "a.fa")
    path.write_bytes(gzip.compress(text) if packed else text)
    genome = fasta.read_fasta(spark, str(path), range_bytes=4_096)
    assert [tuple(r) for r in genome.contigs.orderBy("ord").collect()] == [(c, i, len(b)) for i, (c, b) in enumerate(bases.items())]
    want = tiles.tile_contigs(spark.createDataFrame(list(bases.items()), "seqid string, bases string"))
    columns = ["seqid", "tile", "origin", "length", "left", "core", "bases"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(genome.tiles) == rows(want)
    pieces = spark.read.format("fasta").option("range_bytes", 4_096).load(str(path))
    ranges = pieces.select("block").distinct().count()
    assert ranges == (1 if packed else -(-len(text) // 4_096))


@pytest.mark.parametrize(
    "text,problem",
    [
        (">\nACGT\n", "empty sequence id"),
        (">a\n>b\nAC\n", "empty sequence: a"),
        (">a\nA\n>a\nC\n", "duplicate sequence id: a"),
        ("AC\n>a\nA\n", "sequence before the first header"),
        ("\n", "no records"),
    ],
)
def test_fasta_problems(spark, tmp_path, text, problem):
    (tmp_path / "x.fa").write_text(text)
    with pytest.raises(ValueError, match=problem):
        fasta.read_fasta(spark, str(tmp_path / "x.fa"), range_bytes=3)


CONTROL_ITEMS = "seqid string, start0 long, end0 long, strand string"


def test_controls_without_a_place_are_returned(spark):
    items = spark.createDataFrame([("c", 0, 40, "+"), ("c", 5, 15, "+"), ("c", 9, 9, "+")], CONTROL_ITEMS)
    contigs = spark.createDataFrame([("c", 60)], "seqid string, length long")
    mask = features.exclusion_mask(items.filter("end0 > start0"))
    got = {r.item_end0: r for r in controls.matched_controls(items, contigs, mask, seed=1).collect()}
    assert got[40].start0 is None and got[40].reason == "no free place"
    assert got[9].start0 is None and got[9].reason == "no length left"
    assert got[15].start0 >= 40 and got[15].end0 == got[15].start0 + 10 <= 60 and got[15].reason is None


@pytest.mark.parametrize("block", [10_000, 2])
def test_controls_are_drawn_from_all_free_places(spark, monkeypatch, block):
    """Every free place of a length is drawn about equally often, whatever the blocks and tasks."""
    monkeypatch.setattr(controls, "GAPS", block)
    monkeypatch.setattr(controls, "ITEMS", 500)
    contigs = spark.createDataFrame([("a", 30), ("b", 12), ("c", 5), ("d", 9)], "seqid string, length long")
    mask = spark.createDataFrame([("a", 4, 9), ("a", 17, 18), ("b", 0, 3), ("d", 0, 20)], "seqid string, start0 long, end0 long")
    blocked = {("a", p) for p in (*range(4, 9), 17)} | {("b", p) for p in range(3)} | {("d", p) for p in range(9)}
    lengths = {"a": 30, "b": 12, "c": 5, "d": 9}
    items = spark.createDataFrame([("a", 0, n, "+") for n in (1, 3, 5, 9, 12, 13)], CONTROL_ITEMS)
    got = controls.matched_controls(items, contigs, mask, seed=3, replicates=600).collect()
    assert len(got) == 6 * 600
    for n in (1, 3, 5, 9, 12, 13):
        free = {
            (c, p) for c, length in lengths.items() for p in range(length - n + 1)
            if not any((c, q) in blocked for q in range(p, p + n))
        }
        drawn = collections.Counter((r.seqid, r.start0) for r in got if r.item_end0 == n and r.seqid)
        assert set(drawn) <= free and sum(drawn.values()) == (600 if free else 0)
        if free:
            expected = 600 / len(free)
            assert all(abs(drawn[p] - expected) < 6 * expected**0.5 + 1 for p in free)


def test_motif_controls_leave_only_items_without_a_place(spark, monkeypatch):
    """With hardly any draws the places of a length are counted."""
    monkeypatch.setattr(controls, "ROUNDS", (1,))
    rng = random.Random(6)
    bases = {c: "".join(rng.choice("ACGT") for _ in range(400)) for c in "ab"}
    genome = spark.createDataFrame(list(bases.items()), "seqid string, bases string")
    contigs = spark.createDataFrame([(c, 400) for c in bases], "seqid string, length long")
    mask = spark.createDataFrame([("a", 0, 200), ("b", 150, 330)], "seqid string, start0 long, end0 long")
    sizes = list(range(20, 190, 5))
    items = spark.createDataFrame([("a", 0, n, "+") for n in sizes], CONTROL_ITEMS)
    for mode, rule in motifs.MOTIFS.items():
        sites = motifs.motif_sites(tiles.tile_contigs(genome), mode)
        found = {r.item_end0: r for r in controls.matched_controls(items, contigs, mask, 5, motif=mode, sites=sites).collect()}
        places = collections.defaultdict(set)
        for strand in "+-":
            starts, ends = rule[strand]
            for c, text in bases.items():
                at = lambda pair, shift: {i + shift for i in range(399) if text[i : i + 2] == pair}
                lasts = at(ends, rule["end"])
                low, high = (0, 200) if c == "a" else (150, 330)
                for s in at(starts, rule["start"]):
                    for n in sizes:
                        e = s - 1 + n
                        if e in lasts and s <= 400 and e <= 400 - rule["margin"] and not (s - 1 < high and low < e):
                            places[n].add((c, s - 1, strand))
        for n in sizes:
            r = found[n]
            assert (r.seqid is None) == (not places[n]), (mode, n)
            assert r.seqid is None or (r.seqid, r.start0, r.strand) in places[n]


def test_written_fasta_files_begin_with_a_header(spark, tmp_path):
    """Contigs of several tiles, more of them than fit one file."""
    rng = random.Random(5)
    sizes = [1, 59, 60, 61, 16_384, 16_390, 16_440, 40_000, 49_152, 100_003]
    rows = [(f"c{i}", i, "".join(rng.choices("ACGTN", k=n))) for i, n in enumerate(sizes)]
    contigs = spark.createDataFrame(rows, "seqid string, ord int, bases string").repartition(4)
    path = tmp_path / "f"
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_fasta(tiles.tile_contigs(contigs), contigs, str(path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    texts = [p.read_text() for p in sorted(path.glob("part-*")) if p.stat().st_size]
    assert len(texts) > 1 and all(t.startswith(">") for t in texts)
    wrapped = lambda b: "".join(b[k : k + 60] + "\n" for k in range(0, len(b), 60))
    assert "".join(texts) == "".join(f">{name}\n{wrapped(bases)}" for name, _, bases in rows)
    lines = sinks.fasta_lines(tiles.tile_contigs(contigs)).orderBy("seqid", "offset").collect()
    want = [(name, o, line) for name, _, bases in rows for o, line in
            [(-1, f">{name}"), *((k, bases[k : k + 60]) for k in range(0, len(bases), 60))]]
    assert [tuple(r) for r in lines] == want
    again = fasta.read_fasta(spark, str(path))
    assert [tuple(r) for r in again.contigs.orderBy("ord").collect()] == [(n, i, len(b)) for n, i, b in rows]


def test_motif_starts_know_their_room(spark):
    """Starts in the mask are left out, others say where it goes on, at an empty masked interval too."""
    ranked = spark.createDataFrame(
        [("+", "a", 90, p, 9, i) for i, p in enumerate((1, 5, 6, 9, 10, 20, 21, 40))] + [("+", "b", 90, 3, 9, 8)],
        "strand string, seqid string, length long, pos long, total long, rank long",
    )
    mask = spark.createDataFrame(
        [("a", 5, 9), ("a", 12, 12), ("a", 20, 30), (None, 0, 50), ("c", 0, 90)], "seqid string, start0 long, end0 long"
    )
    for bins in (None, 3):
        found = {(r.seqid, r.pos): r.stop for r in controls._free_starts(ranked, mask, bins).collect()}
        assert found == {("a", 1): 5, ("a", 5): 5, ("a", 10): 12, ("a", 20): 20, ("a", 40): None, ("b", 3): None}


def test_motif_draws_are_dealt_over_all_tasks_and_never_scanned_with_the_mask(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(controls, "ROUNDS", (4,))
    draws = controls._motif_draws

    def seen(tries, *more):
        asked.append(tries.rdd.getNumPartitions())
        return draws(tries, *more)

    monkeypatch.setattr(controls, "_motif_draws", seen)
    text = "".join(random.Random(9).choices("ACGT", k=900))
    genome = spark.createDataFrame([("a", text)], "seqid string, bases string")
    contigs = spark.createDataFrame([("a", 900)], "seqid string, length long")
    mask = spark.createDataFrame([("a", 100, 300)], "seqid string, start0 long, end0 long")
    items = spark.createDataFrame([("a", 100, 130 + 3 * i, "+") for i in range(20)], CONTROL_ITEMS)
    sites = motifs.motif_sites(tiles.tile_contigs(genome), "gtag")
    made = controls.matched_controls(items, contigs, mask, 5, motif="gtag", sites=sites)
    assert all(r.seqid is None or r.end0 <= 100 or r.start0 >= 300 for r in made.collect())
    assert asked == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
