"""Reading frames, tiles, energy and refinement against plain definitions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from genomeframe.functions.sequence import reverse_complement
from genomeframe.operators import energy, frames, orf, tiles


def scan_orf(text):
    """Codon by codon in each frame; an unknown base ends a run."""
    best = None
    for frame in range(3):
        start = None
        for p in range(frame, len(text) - 2, 3):
            codon = text[p : p + 3]
            if re.search("[^ACGT]", codon):
                start = None
            elif codon == "ATG" and start is None:
                start = p
            elif codon in ("TAA", "TAG", "TGA"):
                if start is not None:
                    key = (p + 3 - start, -start)
                    best = max(best, key) if best else key
                start = None
    return None if best is None else (-best[1], best[0] - best[1])


def test_orf_cases(spark):
    rng = random.Random(2)
    texts = ["ATGATGTAA", "ATGTAAATGTAG", "ATGNAATAA", "ATGAAA", ""]
    texts += ["".join(rng.choice("ACGTATGTAAN") for _ in range(rng.randrange(300))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r.i: r.o and (r.o.start, r.o.stop) for r in df.select("i", orf.longest_orf(F.col("s")).alias("o")).collect()}
    assert [got[i] for i in range(len(texts))] == [scan_orf(t) for t in texts]


@pytest.mark.parametrize("tile", [5, 64, 300])
def test_frames_over_tiles(spark, tile):
    """Frames that cross tiles with and without breaks, unknown bases, ties and short contigs."""
    rng = random.Random(tile)
    texts = ["ATGATGTAA", "ATGTAAATGTAG", "ATGNAATAA", "ATGAAA", "A", "AT", "ATG" + "AAC" * 200 + "TAG", "ATG" + "N" * 90 + "TAG"]
    texts += ["".join(rng.choice("ACGTATGCC" + "TAAN" * (i % 2)) for _ in range(rng.randrange(1, 700))) for i in range(200)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "seqid string, bases string")
    got = {r.seqid: (r.start, r.stop) for r in frames.longest_frames(tiles.tile_contigs(df, tile, min(tile, 98))).collect()}
    assert [got.get(str(i)) for i in range(len(texts))] == [scan_orf(t) for t in texts]


def refine(text, exons):
    size = lambda form: (lambda o: o[1] - o[0] if o else 0)(scan_orf("".join(text[a:b] for a, b in form)))
    while True:
        options = [exons[:i] + [(exons[i][0], exons[i + 1][1])] + exons[i + 2 :] for i in range(len(exons) - 1)]
        best = max(options, key=size, default=None)
        if best is None or size(best) <= size(exons):
            return exons
        exons = best


def test_refinement(spark):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        text = "".join(rng.choice("ACGTATGA") for _ in range(200))
        cuts = sorted(rng.sample(range(200), 2 * rng.randrange(1, 5)))
        rows.append((i, 0, text, [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]))
    schema = "i int, span_start bigint, text string, exons array<struct<start0:bigint,end0:bigint>>"
    got = orf.refine_forms(spark.createDataFrame(rows, schema), ["i"]).collect()
    assert {r.i: [tuple(e) for e in r.exons] for r in got} == {r[0]: refine(r[2], r[3]) for r in rows}


def test_reverse_complement(spark):
    df = spark.createDataFrame([("ACGTN",)], "s string")
    assert df.select(reverse_complement(F.col("s"))).first()[0] == "NACGT"


def test_tiles_from_pieces_equal_cut_tiles(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("ACGTN") for _ in range(40_000))
    cut = tiles.tile_contigs(spark.createDataFrame([("c", text)], "seqid string, bases string"))
    lines = [("c", o, text[o : o + 70]) for o in range(0, len(text), 70)]
    built = tiles.tiles_from_pieces(
        spark.createDataFrame(lines, "seqid string, offset bigint, piece string"),
        spark.createDataFrame([("c", len(text))], "seqid string, length bigint"),
    )
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, built.select(*cut.columns).collect()))


def test_energy_symmetry():
    rng = random.Random(6)
    text = "".join(rng.choice("ACGTN") for _ in range(500))
    other = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert np.allclose(energy._power(text), energy._power(other)[::-1], atol=1e-6)


@pytest.mark.parametrize("hot", [None, 10])
def test_profile_rows_follow_linspace(spark, hot):
    rng = random.Random(1)
    rows = [("c", "+", i * 900, i * 900 + rng.randrange(5, 60)) for i in range(190)]
    df = spark.createDataFrame(rows, "seqid string, strand string, start0 bigint, end0 bigint")
    for bins in (2, 7, 150):
        edges = np.linspace(0, len(rows), bins + 1).astype(np.int64)
        got = energy.rank_rows(df, bins, hot).collect()
        assert sorted(r["rank"] for r in got) == list(range(len(rows)))
        assert all(edges[r["row"]] <= r["rank"] < edges[r["row"] + 1] for r in got)
