"""Steps whose time or disk grew faster than the input: what they compute and how they are planned."""

import random

import numpy as np

from genomeframe.operators import comparison, controls, energy, intervals, motifs, ordered, samples, tiles, transcripts
from genomeframe.sources import gff3


def plan(df):
    return df._jdf.queryExecution().toString()


def test_stretches_give_the_scores_of_windows():
    rng = np.random.default_rng(5)
    rows, weights = rng.normal(size=(3, 60)), rng.normal(size=(3, 9, 2))
    table = energy.stretch_table(weights)
    for count in (1, 15, 16, 17, 52):
        want = [[(rows[:, i : i + 9] * weights[:, :, s]).sum() for s in (0, 1)] for i in range(count)]
        assert np.allclose(energy.window_products(rows[:, : count + 8], count, table), want, rtol=0, atol=1e-12)


def test_motif_positions_leave_a_tile_as_arrays(spark):
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("ACGTN"), 700))
    cut = tiles.tile_contigs(spark.createDataFrame([("a", text), (None, text), ("b", "GT")], "seqid string, bases string"), 128)
    found = motifs.motif_sites(cut, *motifs.MOTIFS)
    assert "positions" in plan(found)
    got = sorted((r.mode, r.strand, r.role, r.pos, r.length) for r in found.collect() if r.seqid == "a")
    want = []
    for mode, rule in motifs.MOTIFS.items():
        for strand in "+-":
            for role, pair in zip(("start", "end"), rule[strand]):
                at = [i + rule[role] for i in range(len(text) - 1) if text[i : i + 2] == pair]
                want += [(mode, strand, role, p, 700) for p in at if role == "end" or p <= 700]
    assert got == sorted(want)
    assert found.filter("seqid is null").count() == len(want)


def test_bases_meet_windows_in_one_shuffle(spark):
    contigs = spark.createDataFrame([("a", "ACGT" * 300, 1200)], "seqid string, bases string, length bigint")
    rows = spark.createDataFrame([("a", "+", 100, 200), ("a", "-", 500, 700)], "seqid string, strand string, start0 bigint, end0 bigint")
    windows = energy.boundary_windows(rows.withColumn("row", rows.start0 * 0), contigs, ["row"], 50)
    packed = energy._packed(windows, tiles.tile_contigs(contigs), ["strand", "centre", "low", "high", "copies", "row"])
    text = plan(packed).split("== Physical Plan ==")[1]
    assert "REPARTITION_BY_COL" not in text and "SortMergeJoin" in text
    assert sum(len(r.packed) for r in packed.collect()) == 4


def test_gff3_files_without_fasta_are_not_joined_by_file(spark, tmp_path):
    lines = ["##gff-version 3", "c\tt\texon\t1\t9\t.\t+\t.\tParent=x", "##FASTA", "c\tt\texon\t1\t9\t.\t+\t.\tParent=y"]
    (tmp_path / "a.gff3").write_text("\n".join(lines))
    (tmp_path / "b.gff3").write_text("\n".join([lines[1], "c\tt\tCDS\t0\t99\t.\t*\t.\tID=z"]))
    models = gff3.read_features(spark, str(tmp_path))
    text = plan(models.rows).split("== Physical Plan ==")[1]
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    contigs = spark.createDataFrame([("c", 50)], "seqid string, length bigint")
    view = gff3.training_view(models, contigs, strict=False)
    assert [r.tid for r in view.rows.collect()] == ["x", "x"]
    assert sorted(r.problem for r in view.problems.collect()) == ["feature without Parent", "invalid interval or strand"]
    # lines and files' ends of the reader's problems, of the rules on rows, and of the count
    assert plan(view.problems).split("== Initial Plan ==")[-1].count("FileScan text") <= 6


MODELS = "side int, gid long, tid long, seqid string, strand string, kind string, start0 long, end0 long"


def gene_models(spark, number=400):
    """Rows of few transcripts on two contigs, nulls and copies among them."""
    draw = random.Random(8)
    rows = []
    for _ in range(number):
        tid = draw.choice([None, *range(25)])
        start = draw.choice([None, *range(0, 300, 7)])
        end = None if start is None or draw.random() < 0.03 else start + draw.randint(1, 20)
        place = (None if tid is None else tid // 3, tid, draw.choice([None, "a", "a", "b"]), draw.choice(["+", "-", None]))
        kind = draw.choices(["exon", "CDS", "gene", None], [20, 2, 2, 1])[0]
        rows += [(side, *place, kind, start, end) for side in draw.choice([(0,), (1,), (0, 1), (0, 1, 1)])]
    return spark.createDataFrame(rows, MODELS)


def test_linked_spans_are_spans_introns_and_chains_in_one_shuffle(spark):
    rows = gene_models(spark)
    linked = transcripts.linked_spans(transcripts.coding_only(rows))
    assert plan(linked).split("== Physical Plan ==")[1].count("Exchange") == 1
    for exons in (rows, transcripts.coding_only(rows)):
        place = ["side", "gid", "seqid", "strand"]
        got = transcripts.linked_spans(exons)
        spans = transcripts.scoring_spans(exons)
        found = lambda df, *more: sorted(map(repr, df.select(*place, *more).collect()))
        assert found(got, "start0", "end0") == found(spans, "start0", "end0")
        gaps = got.filter("next0 > end0").selectExpr(*place, "end0 start0", "next0 end0")
        assert found(gaps, "start0", "end0") == found(transcripts.introns_of(spans), "start0", "end0")
        ends = "n_spans", "start0", "end0"
        assert found(transcripts.linked_chains(got), *ends) == found(transcripts.chains_of(spans), *ends)


def test_coding_rows_stay_whole(spark):
    rows = [r for r in gene_models(spark).collect()]
    coding = {(r.side, r.tid) for r in rows if r.kind == "CDS" and r.tid is not None}
    want = [r for r in rows if (r.side, r.tid) in coding]
    got = transcripts.coding_only(spark.createDataFrame(rows, MODELS)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_equal_places_of_both_sides_are_counted_once(spark):
    rows = [r for r in gene_models(spark).collect()]
    report = {r.metric: (r.tp, r.fp, r.fn) for r in comparison.compare_gene_sets(spark.createDataFrame(rows, MODELS)).collect()}
    spans = transcripts.scoring_spans(spark.createDataFrame(rows, MODELS))
    for metric, df in (("exon-segment", spans), ("intron-segment", transcripts.introns_of(spans))):
        ref, pred = ({r[1:] for r in df.select("side", "seqid", "strand", "start0", "end0").collect() if r.side == s} for s in (0, 1))
        assert report[metric] == (len(ref & pred), len(pred - ref), len(ref - pred))


def test_bases_are_summed_by_depth(spark):
    draw = random.Random(9)
    rows = [("c", draw.choice("+-"), x := draw.randrange(9000), x + draw.randint(1, 30), i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "seqid string, strand string, start0 long, end0 long, side int").repartition(8)
    base = [{(r[1], p) for r in rows if r[4] == s for p in range(r[2], r[3])} for s in (0, 1)]
    assert tuple(intervals.covered_length(df, "side").first()) == (len(base[0]), len(base[1]), len(base[0] & base[1]))
    changes = df.selectExpr("seqid", "strand", "explode(array(struct(start0 p, 1 d), struct(end0 p, -1 d))) c").select("seqid", "strand", "c.*")
    depths = ordered.depth_sums(changes, ["seqid", "strand"], "p", ["d"])
    assert depths.count() < 600  # not a row for each of 6,000 changes
    assert depths.filter("d_sum > 0").agg({"length": "sum"}).first()[0] == len(base[0] | base[1])


def test_edits_of_a_tile_take_one_pass(spark):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ACGTN\u00e9"), 900))
    cut = tiles.tile_contigs(spark.createDataFrame([("a", text), (None, text), ("b", "GT")], "seqid string, bases string"), 300)
    at = sorted({int(p) for p in rng.integers(0, 900, 700)})
    positions = spark.createDataFrame([("a", p) for p in at + at] + [(None, 5), ("a", 5000)], "seqid string, pos long")
    changed = controls.mutate_sites(cut, positions, 42, 300)
    assert "aggregate(" not in plan(changed) and changed.schema == cut.schema
    draws = positions.filter("seqid = 'a'").select("pos", controls.seeded_draw(42, positions.seqid, positions.pos)).collect()
    want = list(text)
    for pos, draw in set(map(tuple, draws)):
        if pos < 900:
            others = "ACGT".replace(text[pos], "")
            want[pos] = others[draw % len(others)]
    found = {(r.seqid, r.tile): r for r in changed.collect()}
    for (seqid, _), r in found.items():
        whole = {"a": "".join(want), None: text, "b": "GT"}[seqid]
        assert r.bases == whole[r.origin - r.left :][: len(r.bases)]
    assert len(found) == cut.count() == 7


def test_pairs_are_shuffled_once_after_they_are_moved(spark):
    draw = random.Random(4)
    rows = [("a", draw.choice(["+", "-", None]), s := draw.randrange(400), s + draw.randint(1, 90)) for _ in range(30)] + [(None, "+", 1, 9)]
    observed = spark.createDataFrame(rows + [("b", "+", 3, 20), ("a", "+", None, 20)], "seqid string, strand string, start0 long, end0 long")
    lengths = spark.createDataFrame([("a", 450), ("b", 60), ("b", 60), ("b", 40), (None, 99)], "seqid string, length long")
    got = samples.pair_samples(observed, lengths, 5, 100)
    assert "Join" not in plan(got).split("== Optimized Logical Plan ==")[1].split("Union")[0]
    want = []
    for place in {r[:2] for r in rows if r[0]} | {("b", "+")}:
        own = sorted({r[2:] for r in rows if r[:2] == place}) or [(3, 20)]
        near = {(s, own[j][1]) for i, (s, _) in enumerate(own) for j in range(max(0, i - 4), min(len(own), i + 5))}
        if place[1] is None:
            near = set()
        near |= {p for s, e in own for o in range(-64, 65) for p in ((s + o, e), (s, e + o))}
        for length in {"a": (450,), "b": (60, 60, 40)}[place[0]]:
            valid = [(s, e) for s, e in near if s >= 0 and e <= length and 5 <= e - s <= 100]
            want += [(*place, s, e, int(place[1] is not None and (s, e) in own)) for s, e in valid]
    assert sorted(map(repr, (tuple(r)[:5] for r in got.collect()))) == sorted(map(repr, want))
