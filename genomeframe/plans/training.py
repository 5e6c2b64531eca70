"""Train the six classifiers from a genome and its gene models."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomeframe.functions.sequence import oriented_end, oriented_start
from genomeframe.operators.intervals import distinct_intervals
from genomeframe.operators.samples import (
    PAIR_TYPES,
    SAMPLE_TARGET,
    SITES,
    boundary_labels,
    encode_pairs,
    encode_sites,
    length_cap,
    pair_samples,
    sampling_stride,
    site_samples,
    site_windows,
    spark_mix,
)
from genomeframe.operators.training import MAX_ITERATIONS, fit_classifier, loss
from genomeframe.operators.transcripts import introns_of, training_spans, transcript_bounds
from genomeframe.session import materialize
from genomeframe.sources.model import Model

TRANSCRIPT = ["seqid", "strand", "tid"]


def observed_pairs(exons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct genomic gene spans and introns of the training gene models."""
    spans = materialize(training_spans(exons, TRANSCRIPT), "training-spans")
    genes = distinct_intervals(transcript_bounds(spans, TRANSCRIPT))
    introns = distinct_intervals(introns_of(spans, TRANSCRIPT))
    return materialize(genes, "genes"), materialize(introns, "introns")


def orient(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    joined = pairs.join(contigs.select("seqid", "length"), "seqid")
    args = F.col("strand"), F.col("start0"), F.col("end0"), F.col("length")
    return joined.select(
        "seqid", "strand", oriented_start(*args).alias("start0"), oriented_end(*args).alias("end0")
    )


def site_training_rows(
    contigs, tiles, genes, introns, mix=spark_mix, sample_target: int = SAMPLE_TARGET
) -> DataFrame:
    """Encoded site samples: ``type, target, weight, features``."""
    total = contigs.agg(F.sum("length")).first()[0]
    samples = site_samples(
        contigs, boundary_labels(genes, introns), sampling_stride(total, sample_target), mix
    ).join(contigs.select("seqid", "length"), "seqid")
    return encode_sites(site_windows(samples, tiles, "pos", ["type", "target", "weight"]))


def pair_training_rows(contigs, tiles, observed, pair: str, longest: int) -> DataFrame:
    """Encoded pair samples: ``target, weight, features``."""
    samples = pair_samples(orient(observed, contigs), contigs, PAIR_TYPES[pair], longest)
    lengths = contigs.select("seqid", "length")
    plus = F.col("strand") == "+"
    rows = samples.join(lengths, "seqid").withColumns(
        {
            "at_start": F.when(plus, F.col("start0")).otherwise(F.col("length") - F.col("start0")),
            "at_end": F.when(plus, F.col("end0")).otherwise(F.col("length") - F.col("end0")),
        }
    )
    keep = ["seqid", "strand", "length", "start0", "end0", "at_end", "target", "weight"]
    starts = site_windows(rows, tiles, "at_start", keep, with_power=False)
    starts = starts.withColumnRenamed("window", "window_start")
    keep = ["start0", "end0", "target", "weight", "window_start"]
    both = site_windows(starts, tiles, "at_end", keep, with_power=False)
    return encode_pairs(both.withColumnRenamed("window", "window_end")).select(
        "target", "weight", "features"
    )


def training_sets(
    contigs: DataFrame,
    tiles: DataFrame,
    exons: DataFrame,
    sample_target: int = SAMPLE_TARGET,
    max_span: int | None = None,
    max_intron: int | None = None,
) -> tuple[dict[str, DataFrame], int, int]:
    """Written samples of each classifier (``target, weight, features``), and the longest intron and span.

    Site samples are balanced: each positive weighs as much as negatives over positives.
    """
    genes, introns = observed_pairs(exons)
    size = F.max(F.col("end0") - F.col("start0"))
    max_span = length_cap(genes.agg(size).first()[0], max_span)
    max_intron = length_cap(introns.agg(size).first()[0], max_intron)
    sites = materialize(
        site_training_rows(contigs, tiles, genes, introns, sample_target=sample_target), "site-samples"
    )
    inputs = {name: sites.filter(F.col("type") == n) for n, name in enumerate(SITES)}
    for name, observed, longest in (
        ("IS-IE-pair", introns, max_intron),
        ("GS-GE-pair", genes, max_span),
    ):
        rows = pair_training_rows(contigs, tiles, observed, name, longest)
        inputs[name] = materialize(rows, "pair-samples")
    return inputs, max_intron, max_span


def train_model(
    contigs: DataFrame,
    tiles: DataFrame,
    exons: DataFrame,
    iterations: int = MAX_ITERATIONS,
    sample_target: int = SAMPLE_TARGET,
    max_span: int | None = None,
    max_intron: int | None = None,
) -> Model:
    """Fit all classifiers. ``exons`` is the training view of the gene models.

    Sampled rows are written once. ``sample_target`` bounds the unlabelled positions
    of the site fits; ``max_span`` and ``max_intron`` bound the pairs that are
    learned and later predicted, and default to the longest observed ones.
    """
    inputs, max_intron, max_span = training_sets(contigs, tiles, exons, sample_target, max_span, max_intron)
    return Model(fit_all(inputs, iterations), max_intron, max_span)


def fit_all(inputs: dict[str, DataFrame], iterations: int = MAX_ITERATIONS) -> dict[str, np.ndarray]:
    """Fit the classifiers side by side: their many small jobs share the executors."""

    def fit(name: str) -> np.ndarray:
        return fit_classifier(inputs[name], balanced=name in SITES, iterations=iterations)

    with ThreadPoolExecutor(len(inputs)) as pool:
        return dict(zip(inputs, pool.map(fit, inputs)))


def losses(inputs: dict[str, DataFrame], model: Model) -> DataFrame:
    """(classifier, weights, samples, loss, constant_loss): the mean log-loss, balanced as in the
    fit, of a model on its samples and of the best constant."""
    found = None
    for name, samples in inputs.items():
        made = loss(samples, model.weights[name], balanced=name in SITES).select(
            F.lit(name).alias("classifier"), F.lit(len(model.weights[name])).alias("weights"), "*"
        )
        found = made if found is None else found.unionByName(made)
    return found
