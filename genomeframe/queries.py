"""The registered queries: each runs one operator over whole driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genomeframe import driver_views as views
from genomeframe.functions.sequence import (
    PLAIN,
    base_code,
    iupac_reverse_complement,
    is_stop,
    oriented_end,
    oriented_start,
    reverse_complement,
)
from genomeframe.operators import chains as chain_search, controls, energy, features, frames, intervals, motifs, orf, samples
from genomeframe.operators import search, tiles, transcripts
from genomeframe.operators.comparison import alternative_regions, compare_gene_sets
from genomeframe.operators.intervals import PLACE
from genomeframe.operators.transcripts import CHAIN
from genomeframe.session import materialize, shared_folder
from genomeframe.sinks import bedgraph, gff3 as gff3_sink, tables as table_sinks
from genomeframe.sources import bed, fasta, gff3

SPAN_LIMIT = 200_000
DENSE_SPAN, DENSE_INTRON = 400, 250
TRACK_LENGTH = 3_000_000
INTRON_CAP = 2_000


def _round(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Intervals and transcripts ------------------------------------------------


def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge_intervals(views.exons(spark, sf), ["side", *PLACE])


def distinct_intervals(spark, sf):
    return intervals.distinct_intervals(views.exons(spark, sf), ["side", *PLACE])


def _training_rows(spark, sf):
    kind = F.expr(
        "case l_returnflag when 'A' then 'CDS' when 'R' then 'five_prime_UTR' else 'exon' end"
    )
    rows = views.table(spark, sf, "lineitem")
    return rows.select(
        F.expr("cast((l_orderkey div 2) % 16 as string)").alias("seqid"),
        F.expr("if((l_orderkey div 32) % 2 = 0, '+', '-')").alias("strand"),
        F.col("l_orderkey").alias("tid"),
        kind.alias("kind"),
        F.expr("l_partkey * 50 + l_linenumber").alias("start0"),
        F.expr("l_partkey * 50 + l_linenumber + cast(l_quantity as bigint)").alias("end0"),
    )


def training_spans(spark, sf):
    return transcripts.training_spans(_training_rows(spark, sf))


def utr_only_parents(spark, sf):
    return transcripts.parents_without_exons(_training_rows(spark, sf))


def transcript_bounds(spark, sf):
    keys = ["seqid", "strand", "tid"]
    return transcripts.transcript_bounds(transcripts.training_spans(_training_rows(spark, sf)), keys)


def length_caps(spark, sf):
    spans = materialize(transcripts.training_spans(_training_rows(spark, sf)), "spans")
    keys = ["seqid", "strand", "tid"]
    size = F.max(F.col("end0") - F.col("start0"))

    def cap(df, name):
        longest = df.agg(size.alias("longest"))
        return longest.select(
            F.lit(name).alias("pair"),
            "longest",
            F.greatest(F.lit(samples.LOWEST_CAP), "longest").alias("cap"),
        )

    return cap(transcripts.introns_of(spans, keys), "intron").unionByName(
        cap(transcripts.transcript_bounds(spans, keys), "span")
    )


def label_bits(spark, sf):
    spans = materialize(transcripts.training_spans(_training_rows(spark, sf)), "spans")
    keys = ["seqid", "strand", "tid"]
    genes = intervals.distinct_intervals(transcripts.transcript_bounds(spans, keys))
    introns = intervals.distinct_intervals(transcripts.introns_of(spans, keys))
    return samples.boundary_labels(genes, introns)


def chains(spark, sf):
    spans = transcripts.scoring_spans(views.exons(spark, sf))
    return transcripts.distinct_chains(transcripts.chains_of(spans)).drop("hash1", "hash2")


def introns(spark, sf):
    spans = materialize(transcripts.scoring_spans(views.exons(spark, sf)), "spans")
    return transcripts.introns_of(spans).select("side", *PLACE, "start0", "end0").distinct()


def site_keys(spark, sf):
    spans = materialize(transcripts.scoring_spans(views.exons(spark, sf)), "spans")
    return transcripts.site_keys(transcripts.introns_of(spans), transcripts.chains_of(spans))


def bp_overlap(spark, sf):
    return intervals.covered_length(views.exons(spark, sf), "side")


def coverage_envelopes(spark, sf):
    chain_rows = transcripts.chains_of(transcripts.scoring_spans(views.exons(spark, sf)))
    return intervals.merge_intervals(chain_rows, ["side", *PLACE])


def alternative_loci(spark, sf):
    chain_rows = transcripts.chains_of(transcripts.scoring_spans(views.exons(spark, sf)))
    chain_rows = materialize(chain_rows, "chains")
    return alternative_regions(chain_rows)


def overlap_semi(spark, sf):
    chain_rows = transcripts.chains_of(transcripts.scoring_spans(views.exons(spark, sf)))
    chain_rows = materialize(chain_rows.select("side", *CHAIN).distinct(), "chains")
    merged = intervals.merge_intervals(views.regions(spark, sf))
    return intervals.overlapping(chain_rows, merged).drop("hash1", "hash2")


def overlap_anti(spark, sf):
    merged = intervals.merge_intervals(views.exons(spark, sf))
    return intervals.not_overlapping(views.regions(spark, sf), merged)


def accuracy_report(spark, sf):
    return _round(compare_gene_sets(views.exons(spark, sf)), 9, "precision", "recall", "f1")


def accuracy_tsv(spark, sf):
    return table_sinks.metric_lines(compare_gene_sets(views.exons(spark, sf)), "tsv")


def protein_coding_accuracy(spark, sf):
    coding = transcripts.coding_only(views.exons(spark, sf))
    return _round(compare_gene_sets(coding), 9, "precision", "recall", "f1")


def gene_set_summary(spark, sf):
    return transcripts.gene_set_summary(views.exons(spark, sf))


def reciprocal_overlap(spark, sf):
    spans = transcripts.scoring_spans(views.exons(spark, sf))
    spans = materialize(spans, "spans")
    return intervals.reciprocal_overlap(
        spans.filter("side = 0"), spans.filter("side = 1"), ["tid"]
    )


# Sequences ----------------------------------------------------------------


def base_counts(spark, sf):
    """Bases by code: each tile counts its letters, no row per base."""
    core = F.col("core_text")
    found = [
        F.struct(base_code(F.lit(b)).alias("code"), (F.length(core) - F.length(F.replace(core, F.lit(b), F.lit("")))).alias("n"))
        for b in PLAIN
    ]
    others = F.length(F.translate(core, PLAIN, "")).alias("n")
    rest = F.struct(F.lit(-1).alias("code"), others)
    cut = tiles.tile_contigs(views.contigs(spark, sf))
    return (
        cut.select("seqid", tiles.core_bases(cut).alias("core_text"))
        .select("seqid", F.explode(F.array(*found, rest)).alias("c"))
        .groupBy("seqid", "c.code")
        .agg(F.sum("c.n").alias("n"))
        .filter("n > 0")
    )


def revcomp(spark, sf):
    bases = F.col("bases")
    return views.contigs(spark, sf).select(
        "seqid",
        F.md5(reverse_complement(bases)).alias("digest"),
        F.md5(iupac_reverse_complement(bases)).alias("iupac_digest"),
    )


def stop_codons(spark, sf):
    """Stop codons per contig and frame, from the frame's codons."""
    frames = F.explode(F.array(*(F.lit(i) for i in range(3))))
    codons = F.regexp_extract_all(
        F.substring("bases", F.col("frame") + 1, F.length("bases")), F.lit("(...)"), F.lit(1)
    )
    return (
        views.contigs(spark, sf)
        .select("seqid", "bases", frames.alias("frame"))
        .select("seqid", "frame", F.explode(codons).alias("codon"))
        .groupBy("seqid", "frame")
        .agg(F.count_if(is_stop(F.col("codon"))).alias("stops"), F.count("*").alias("codons"))
    )


def contig_tiles(spark, sf):
    cut = tiles.tile_contigs(views.contigs(spark, sf))
    return cut.select("seqid", "tile", "origin", "left", "core", F.md5("bases").alias("digest"))


def longest_orf(spark, sf):
    return frames.longest_frames(tiles.tile_contigs(views.contigs(spark, sf)))


def _forms(spark, sf):
    """Oriented merged exons per transcript of the placed line items, with their text."""
    exons = views.placed_exons(spark, sf)
    key = ["tid", "seqid", "strand"]
    merged = intervals.merge_intervals(exons, key)
    contigs = views.contigs(spark, sf)
    args = F.col("strand"), F.col("start0"), F.col("end0"), F.col("length")
    oriented = merged.join(contigs.select("seqid", "length"), "seqid").select(
        *key, "length", oriented_start(*args).alias("s"), oriented_end(*args).alias("e")
    )
    # A line item's order is one transcript; its merged exons form one array.
    forms = oriented.groupBy(*key, "length").agg(
        F.array_sort(F.collect_list(F.struct(F.col("s").alias("start0"), F.col("e").alias("end0")))).alias("exons")
    )
    # Both strands of a contig are made once, not for each of its transcripts.
    both = F.array(
        F.struct(F.lit("+").alias("strand"), F.col("bases").alias("text")),
        F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("bases")).alias("text")),
    )
    texts = contigs.select("seqid", F.explode(both).alias("t")).select("seqid", "t.*")
    return forms.join(texts, ["seqid", "strand"]).withColumn("span_start", F.lit(0).cast("bigint"))


def _with_orf(forms):
    spliced = orf.splice(F.col("text"), F.col("span_start"), F.col("exons"))
    return forms.select("*", orf.evaluated_once(spliced).alias("spliced")).select(
        "*", orf.evaluated_once(orf.longest_orf(F.col("spliced"))).alias("orf")
    )


def transcript_orfs(spark, sf):
    return _with_orf(_forms(spark, sf)).select(
        "tid",
        F.length("spliced").cast("bigint").alias("spliced_length"),
        F.coalesce(F.col("orf.start"), F.lit(0)).cast("bigint").alias("orf_start"),
        F.coalesce(F.col("orf.stop"), F.lit(0)).cast("bigint").alias("orf_stop"),
    )


def cds_phase(spark, sf):
    parts = orf.coding_parts(_with_orf(_forms(spark, sf)), ["tid"])
    return parts.withColumn("phase", F.coalesce("phase", F.lit(-1)))


def chain_refinement(spark, sf):
    refined = orf.refine_forms(_forms(spark, sf), ["tid", "strand"])
    return refined.select("tid", F.size("exons").alias("exons"), "orf_length")


def motif_sites(spark, sf):
    cut = tiles.tile_contigs(views.contigs(spark, sf))
    return (
        motifs.motif_sites(cut, *motifs.MOTIFS)
        .groupBy("mode", "seqid", "strand", "role")
        .agg(F.count("*").alias("n"), F.sum("pos").alias("total"), F.max("pos").alias("last"))
    )


# Energy -------------------------------------------------------------------


def _tiles(spark, sf):
    return tiles.tile_contigs(views.contigs(spark, sf))


def _doc_intervals(spark, sf):
    return views.placed_exons(spark, sf).select("seqid", "strand", "start0", "end0").distinct()


def energy_per_contig(spark, sf):
    out = energy.energy_summary(tiles.tile_contigs(views.contigs(spark, sf)))
    return _round(out, 5, "mean_power", "max_power")


def energy_quantile(spark, sf):
    rows = energy.energy_rows(energy.energy_tiles(_tiles(spark, sf)))
    return _round(energy.energy_quantile(rows, "power"), 5, "quantile")


def _mean_profile(spark, sf):
    rows, lengths = _doc_intervals(spark, sf), views.contigs(spark, sf)
    return energy.mean_profile(
        energy.boundary_profile(rows, lengths, _tiles(spark, sf), row=None)
    )


def profile_rows(spark, sf):
    ranked = energy.rank_rows(_doc_intervals(spark, sf), 1500)
    return ranked.select("seqid", "strand", "start0", "end0", F.col("rank").cast("bigint").alias("rank"), F.col("row").cast("bigint").alias("row"))


def boundary_profile(spark, sf):
    return _round(_mean_profile(spark, sf), 5, "mean_power").withColumn("offset", F.col("offset").cast("bigint"))


def profile_matrix(spark, sf):
    ranked = materialize(energy.rank_rows(_doc_intervals(spark, sf), 1500), "ranked")
    lengths = views.contigs(spark, sf)
    matrix = energy.profile_matrix(
        energy.boundary_profile(ranked, lengths, _tiles(spark, sf))
    )
    matrix = _round(matrix, 5, "mean_power", "log_power")
    return matrix.withColumns({c: F.col(c).cast("bigint") for c in ("row", "offset")})


def profile_peaks(spark, sf):
    peaks = energy.profile_peaks(_round(_mean_profile(spark, sf), 5, "mean_power"))
    return peaks.withColumn("peak", F.col("peak").cast("bigint"))


def _doc_regions(spark, sf):
    """One region per contig: all of it."""
    return views.contigs(spark, sf).select(
        F.col("seqid").alias("region"),
        "seqid",
        F.when(F.col("ord") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.lit(0).cast("bigint").alias("start0"),
        F.col("length").alias("end0"),
    )


def region_energy(spark, sf):
    out = energy.region_energy(
        _doc_regions(spark, sf), views.contigs(spark, sf), _tiles(spark, sf), flank=energy.FLANK
    )
    return _round(out.select("region", "bin", "mean_power", "log_power"), 5, "mean_power", "log_power")


def landmark_profile(spark, sf):
    rows = views.placed_exons(spark, sf)
    marks = features.transcript_landmarks(rows.filter("kind = 'exon'"), rows.filter("kind = 'CDS'"))
    out = energy.landmark_profile(marks, views.contigs(spark, sf), _tiles(spark, sf))
    return _round(out, 5, "mean_power", "mean_slope").withColumn(
        "offset", F.col("offset").cast("bigint")
    )


# Feature sets -------------------------------------------------------------


def feature_ancestors(spark, sf):
    rows = views.features(spark, sf)
    starts = rows.filter("kind in ('exon', 'CDS')").select(F.explode("parents").alias("node"))
    return features.ancestors(rows, starts)


def _gene_exons(spark, sf, kind="exon"):
    rows = views.features(spark, sf)
    starts = rows.filter("kind in ('exon', 'CDS')").select(F.explode("parents").alias("node"))
    closure = materialize(features.ancestors(rows, starts), "closure")
    return materialize(features.non_rrna_rows(rows, kind, closure), f"rows-{kind}")


def exon_sets(spark, sf):
    return features.exon_sets(_gene_exons(spark, sf))


def kmer_bounds(spark, sf):
    return features.kmer_bounds(_gene_exons(spark, sf), views.contigs(spark, sf))


def exclusion_masks(spark, sf):
    exons = _gene_exons(spark, sf)
    gaps = features.feature_introns(features.transcript_exons(exons))
    repeats = views.repeats(spark, sf)
    masks = {
        "exons": (exons,),
        "exons+introns": (exons, gaps),
        "exons+repeats": (exons, repeats),
        "exons+introns+repeats": (exons, gaps, repeats),
    }
    made = [features.exclusion_mask(*parts).withColumn("mask", F.lit(name)) for name, parts in masks.items()]
    return reduce(DataFrame.unionByName, made)


def splice_site_positions(spark, sf):
    return features.splice_site_positions(_gene_exons(spark, sf), views.contigs(spark, sf))


def _kmers(spark, sf):
    rows = _gene_exons(spark, sf)
    exons = rows.select("seqid", "start0", "end0", "strand").distinct()
    contigs = views.contigs(spark, sf)
    peaks = profile_peaks(spark, sf)
    bounds = features.kmer_bounds(rows, contigs)
    return motifs.kmers_at_peaks(exons, contigs, tiles.tile_contigs(contigs), peaks, bounds)


def kmers(spark, sf):
    return _kmers(spark, sf).select(
        "seqid", "strand", "start0", "end0", "boundary", F.coalesce("kmer", F.lit("")).alias("kmer")
    )


def kmer_information(spark, sf):
    bits = motifs.information_content(_kmers(spark, sf))
    return _round(bits, 6, "bits").withColumn("column", F.col("column").cast("bigint"))


def kmer_fasta(spark, sf):
    return table_sinks.kmer_lines(_kmers(spark, sf)).select("boundary", "fasta", "distance")


def matched_controls(spark, sf):
    exons = _doc_intervals(spark, sf)
    contigs = views.contigs(spark, sf).select("seqid", "length")
    mask = features.exclusion_mask(exons)
    return controls.matched_controls(exons, contigs, mask, seed=42)


def motif_controls(spark, sf):
    """Controls between splice motifs in both modes, one base longer, and twice each."""
    exons = _doc_intervals(spark, sf)
    contigs = views.contigs(spark, sf).select("seqid", "length")
    mask = features.exclusion_mask(exons)
    sites = materialize(motifs.motif_sites(tiles.tile_contigs(views.contigs(spark, sf)), *motifs.MOTIFS), "sites")
    found = None
    for mode, offset, replicates in (("aggt", 0, 1), ("gtag", 0, 2), ("gtag", 1, 1)):
        made = controls.matched_controls(
            exons, contigs, mask, 42, offset, mode, sites.filter(F.col("mode") == mode), replicates
        )
        made = made.withColumns({"mode": F.lit(mode), "offset": F.lit(offset)})
        found = made if found is None else found.unionByName(made)
    return found


def mutated_tiles(spark, sf):
    contigs = views.contigs(spark, sf)
    cut = tiles.tile_contigs(contigs)
    positions = features.splice_site_positions(_gene_exons(spark, sf), contigs)
    changed = controls.mutate_sites(cut, positions, 42, tiles.TILE)
    return changed.select("seqid", "tile", F.md5("bases").alias("digest"))


# Samples and models -------------------------------------------------------


def _orf_genes(spark, sf):
    """The longest reading frame of each contig as a plus-strand gene."""
    found = longest_orf(spark, sf)
    return found.select(
        "seqid", F.lit("+").alias("strand"), F.col("start").alias("start0"), F.col("stop").alias("end0")
    )


def _orf_introns(genes):
    """The middle third of each such gene as an intron."""
    third = F.expr("(end0 - start0) div 3")
    return genes.select(
        "seqid", "strand", (F.col("start0") + third).alias("start0"), (F.col("start0") + third * 2).alias("end0")
    )


def _site_samples(spark, sf):
    contigs = views.contigs(spark, sf).drop("bases")
    genes = materialize(_orf_genes(spark, sf), "genes")
    labels = samples.boundary_labels(genes, _orf_introns(genes))
    total = contigs.agg(F.sum("length")).first()[0]
    return samples.site_samples(contigs, labels, samples.sampling_stride(total), samples.md5_mix)


def site_samples(spark, sf):
    return _site_samples(spark, sf)


def class_weights(spark, sf):
    return _round(samples.class_weights(_site_samples(spark, sf)), 6, "positive_weight")


def pair_samples(spark, sf):
    genes = _orf_genes(spark, sf)
    rows = samples.pair_samples(genes, views.contigs(spark, sf), 1, 10_000)
    return rows.groupBy("seqid", "strand").agg(
        F.count("*").alias("n"),
        F.sum("target").alias("positives"),
        F.sum("start0").alias("starts"),
        F.sum("end0").alias("ends"),
    )


def dense_pair_samples(spark, sf):
    """Pairs around spans that lie close together on both strands, so neighbours' ends are swapped."""
    observed = materialize(views.dense_spans(spark, sf, DENSE_INTRON, 2 * DENSE_INTRON), "observed")
    contigs = observed.select("seqid").distinct().withColumn("length", F.lit(TRACK_LENGTH).cast("bigint"))
    rows = samples.pair_samples(observed, contigs, samples.PAIR_TYPES["IS-IE-pair"], INTRON_CAP)
    return rows.groupBy("seqid", "strand").agg(
        F.count("*").alias("n"),
        F.sum("target").alias("positives"),
        F.sum("start0").alias("starts"),
        F.sum("end0").alias("ends"),
    )


def _windows(spark, sf):
    contigs = views.contigs(spark, sf).select("seqid", "length", "bases")
    rows = _site_samples(spark, sf).join(contigs.select("seqid", "length"), "seqid")
    keep = ["seqid", "strand", "pos", "type", "target", "weight"]
    return samples.site_windows(rows, tiles.tile_contigs(contigs), "pos", keep)


def site_features(spark, sf):
    """Per sample: a digest of the window and the centred log power at its middle."""
    centred = F.get(samples.centred_log_power(F.col("powers")), F.lit(samples.SITE_RADIUS))
    out = _windows(spark, sf).select(
        "seqid", "strand", "pos", "type", F.md5("window").alias("digest"), centred.alias("log_power")
    )
    return _round(out, 4, "log_power")


def encoded_sites(spark, sf):
    from pyspark.ml.functions import vector_to_array

    encoded = samples.encode_sites(_windows(spark, sf)).withColumn("v", vector_to_array("features"))
    letters = F.filter("v", lambda x, i: i % 5 != 4)
    return encoded.select(
        "seqid", "strand", "pos", "type", F.size("v").alias("size"),
        F.aggregate(letters, F.lit(0.0), lambda t, x: t + x).cast("bigint").alias("known"),
    )


def train_site_model(spark, sf):
    """Weights of the gene-start classifier, fitted to its end over all its samples."""
    from genomeframe.operators.training import fit_classifier

    rows = samples.encode_sites(_windows(spark, sf)).filter("type = 0")
    weights = fit_classifier(materialize(rows.select("target", "weight", "features"), "gs"), True)
    made = [("GS", i, float(w)) for i, w in enumerate(weights)]
    return spark.createDataFrame(made, "classifier string, idx int, weight double")


def rule_model():
    """Weights from a rule, so that scoring is reproducible without a training run."""
    import numpy as np

    from genomeframe.sources.model import FEATURES, Model

    weights = {}
    for number, (name, n) in enumerate(FEATURES.items()):
        idx = np.arange(n)
        weights[name] = ((idx * (37 + number)) % 101 - 50) / 250.0
        weights[name][-1] = -3.0 if n == 646 else 0.5
    return Model(weights, 2000, 2000)


def score_sites(spark, sf):
    from genomeframe.operators.scoring import score_sites as score

    found = score(tiles.tile_contigs(views.contigs(spark, sf)), rule_model())
    return found.groupBy("seqid", "strand", "kind").agg(
        F.count("*").alias("n"), F.round(F.sum("logit"), 2).alias("total")
    )


def _rule_prediction(spark, sf):
    from genomeframe.plans.prediction import predict

    contigs = views.contigs(spark, sf)
    cut = materialize(tiles.tile_contigs(contigs), "tiles")
    lengths = materialize(contigs.drop("bases"), "contigs")  # read four times; texts only once
    return predict(lengths, cut, rule_model()), contigs


def predicted_isoforms(spark, sf):
    found, _ = _rule_prediction(spark, sf)
    return found.isoforms.select(
        "gene", "number", "seqid", "strand", "span_start", "span_end", F.size("exons").alias("n_exons")
    )


def predicted_gff3(spark, sf):
    """The predicted genes as a written GFF3 file, read back line by line."""
    found, _ = _rule_prediction(spark, sf)
    path = _folder(spark, "predicted-gff3")
    gff3_sink.write_gff3(found.isoforms, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# Search over scored points -----------------------------------------------


def _length_pair(limit, scale):
    """A pair logit that falls with the length, and its length term."""

    def term(size):
        return (F.lit(1.0) - size / F.lit(float(limit))) * scale

    return term(F.col("end0") - F.col("start0")), term


def _spans(spark, sf):
    rows = materialize(views.points(spark, sf), "points")
    return rows, search.candidate_spans(rows, SPAN_LIMIT, *_length_pair(SPAN_LIMIT, 1.0))


def span_candidates(spark, sf):
    return _round(_spans(spark, sf)[1], 6, "score")


def best_chain(spark, sf):
    """Number of chosen spans and total score per contig strand."""
    chosen = chain_search.best_chain(_spans(spark, sf)[1])
    out = chosen.groupBy(*PLACE).agg(F.sum("score").alias("score"))
    return _round(out, 6, "score")


def _part_pair(limit, scale):
    """A pair logit of both parts and a length term."""
    _, term = _length_pair(limit, scale)
    return F.col("start_part") + F.col("end_part") + term(F.col("end0") - F.col("start0")), term


def _dense_spans(spark, sf):
    rows = materialize(views.dense_points(spark, sf), "points")
    return search.candidate_spans(rows, DENSE_SPAN, *_part_pair(DENSE_SPAN, 1.0))


def dense_span_candidates(spark, sf):
    """Candidates among dense points: number, ends and total score by contig strand."""
    out = _dense_spans(spark, sf).groupBy(*PLACE).agg(
        F.count("*").alias("n"), F.sum("start0").alias("starts"), F.sum("end0").alias("ends"),
        F.sum("score").alias("score"),
    )
    return _round(out, 4, "score")


def dense_best_chain(spark, sf):
    """The best chain where each contig strand is about one island of overlapping candidates."""
    chosen = chain_search.best_chain(_dense_spans(spark, sf))
    return _round(chosen.groupBy(*PLACE).agg(F.sum("score").alias("score")), 4, "score")


def _introns(spark, sf):
    spans = materialize(views.dense_spans(spark, sf, DENSE_INTRON, 2 * DENSE_INTRON), "dense-spans")
    inner = search.sites_in_spans(materialize(views.dense_points(spark, sf), "points"), spans)
    return spans, search.candidate_introns(inner, DENSE_INTRON, *_part_pair(DENSE_INTRON, -0.25))


def intron_candidates(spark, sf):
    return _round(_introns(spark, sf)[1], 9, "score")


def top_chains(spark, sf):
    spans, found = _introns(spark, sf)
    forms = search.ranked_forms(spans, search.top_chains(found, drop=search.SCORE_DROP))
    out = forms.select(
        *search.SPAN, F.col("rank").cast("bigint").alias("rank"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.size("exons").cast("bigint").alias("n_exons"),
    )
    return _round(out, 9, "score")


def bedgraph_rows(spark, sf):
    rows = views.points(spark, sf).withColumn("length", F.lit(2_000_000_000).cast("bigint"))
    return bedgraph.bedgraph_rows(rows)


def bedgraph_roundtrip(spark, sf):
    """Tracks of all kinds and both strands, written and read back, with each row's place in its file."""
    points = views.dense_points(spark, sf).withColumn("length", F.lit(TRACK_LENGTH).cast("bigint"))
    contigs = points.select("seqid", F.col("seqid").cast("int").alias("ord")).distinct()
    path = _folder(spark, "bedgraph")
    bedgraph.write_bedgraph(points, contigs, path)
    field = F.split("value", "\t")
    rows = spark.read.text(path).select(
        "kind", "track", F.get(field, F.lit(0)).alias("seqid"), F.get(field, F.lit(1)).cast("bigint").alias("start0"),
        F.get(field, F.lit(2)).cast("bigint").alias("end0"), F.get(field, F.lit(3)).alias("value"),
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"),
    )
    # within a file rows come by contig order and position
    last = F.lag(F.struct(F.col("seqid").cast("int").alias("ord"), "start0")).over(Window.partitionBy("kind", "track", "file").orderBy("row"))
    here = F.struct(F.col("seqid").cast("int").alias("ord"), "start0")
    return rows.withColumn("sorted", F.coalesce(last <= here, F.lit(True))).drop("file", "row")


def gene_numbers(spark, sf):
    """Genes are the placed transcripts' spans, numbered along contigs and strands."""
    contigs = views.contigs(spark, sf).drop("bases")
    rows = views.placed_exons(spark, sf)
    spans = rows.groupBy("tid", *PLACE).agg(
        F.min("start0").alias("a"), F.max("end0").alias("b"), F.max("length").alias("length")
    )
    args = F.col("strand"), F.col("a"), F.col("b"), F.col("length")
    # The longest transcript of each genomic start stands for the gene.
    genes = spans.groupBy(*PLACE, "length", "a").agg(F.max("b").alias("b")).select(
        *PLACE, oriented_start(*args).alias("span_start"), oriented_end(*args).alias("span_end")
    )
    return search.number_genes(genes, contigs)


# Files --------------------------------------------------------------------


def _folder(spark, name):
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fasta_roundtrip(spark, sf):
    """Write all contigs as FASTA, read them back as tiles."""
    contigs = views.contigs(spark, sf)
    path = _folder(spark, "fasta")
    table_sinks.write_fasta(tiles.tile_contigs(contigs), contigs, path)
    genome = fasta.read_fasta(spark, path)
    core = F.md5(tiles.core_bases(genome.tiles))
    return genome.tiles.join(genome.contigs.select("seqid", "ord"), "seqid").select(
        "seqid", "ord", "tile", "length", core.alias("digest")
    )


def _written_gff3(spark, sf):
    """Line items as GFF3 rows with encoded ids, written and read again."""
    rows = views.table(spark, sf, "lineitem").select(
        F.concat_ws(
            "\t",
            F.concat(F.lit("c"), F.expr("(l_orderkey div 2) % 16")),
            F.lit("t"),
            F.when(F.col("l_returnflag") == "N", "exon").otherwise("CDS"),
            (F.col("l_partkey") * 50 + 1).cast("string"),
            (F.col("l_partkey") * 50 + F.col("l_quantity").cast("bigint")).cast("string"),
            F.lit("."),
            F.lit("+"),
            F.lit("."),
            F.concat(F.lit("ID=x;Parent=a%20b+"), F.col("l_orderkey"), F.lit(",o"), F.col("l_orderkey")),
        ).alias("line")
    )
    path = _folder(spark, "gff3")
    rows.write.text(path)
    return gff3.read_features(spark, path)


def gff3_roundtrip(spark, sf):
    """The scoring view of written line items."""
    return gff3.scoring_view(_written_gff3(spark, sf)).rows


def gff3_training(spark, sf):
    """The training view of written line items; a contig ends with its last one."""
    models = _written_gff3(spark, sf)
    contigs = models.rows.groupBy("seqid").agg(F.max("b").alias("length"))
    return gff3.training_view(models, contigs).rows


def gff3_features(spark, sf):
    """The feature view of written line items."""
    rows = gff3.feature_view(_written_gff3(spark, sf)).rows
    return rows.select(
        "id", F.array_join("parents", "|").alias("parents"), "kind", "seqid", "strand",
        "start0", "end0", "rrna", "repeat",
    )


def bed_roundtrip(spark, sf):
    rows = views.regions(spark, sf)
    path = _folder(spark, "bed")
    rows.select(
        F.concat_ws("\t", "seqid", "start0", "end0", F.lit("r"), F.lit("0"), "strand").alias("line")
    ).write.text(path)
    return bed.read_bed(spark, path)


QUERIES = {
    f.__name__: f
    for f in (
        interval_merge,
        distinct_intervals,
        training_spans,
        utr_only_parents,
        transcript_bounds,
        length_caps,
        label_bits,
        chains,
        introns,
        site_keys,
        bp_overlap,
        coverage_envelopes,
        alternative_loci,
        overlap_semi,
        overlap_anti,
        accuracy_report,
        accuracy_tsv,
        protein_coding_accuracy,
        gene_set_summary,
        reciprocal_overlap,
        base_counts,
        revcomp,
        stop_codons,
        contig_tiles,
        longest_orf,
        transcript_orfs,
        cds_phase,
        chain_refinement,
        motif_sites,
        energy_per_contig,
        energy_quantile,
        profile_rows,
        boundary_profile,
        profile_matrix,
        profile_peaks,
        region_energy,
        landmark_profile,
        feature_ancestors,
        exon_sets,
        kmer_bounds,
        exclusion_masks,
        splice_site_positions,
        kmers,
        kmer_information,
        kmer_fasta,
        matched_controls,
        motif_controls,
        mutated_tiles,
        site_samples,
        class_weights,
        pair_samples,
        dense_pair_samples,
        site_features,
        encoded_sites,
        train_site_model,
        score_sites,
        predicted_isoforms,
        predicted_gff3,
        span_candidates,
        best_chain,
        dense_span_candidates,
        dense_best_chain,
        intron_candidates,
        top_chains,
        bedgraph_rows,
        bedgraph_roundtrip,
        gene_numbers,
        fasta_roundtrip,
        gff3_roundtrip,
        gff3_training,
        gff3_features,
        bed_roundtrip,
    )
}
