"""From exon rows to transcripts, chains, introns and sites.

Exon rows carry ``side, gid, tid, seqid, strand, kind, start0, end0``. A chain,
the ordered exon list of a transcript, is identified by its span count, its
ends and two 64-bit order-free hash sums: equal chains get equal identities
through partial aggregation, and no transcript is ever collected into an array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomeframe.operators.intervals import interval_gaps, merge_intervals
from genomeframe.operators.scan import BIN_BITS

TRANSCRIPT = ["side", "gid", "tid", "seqid", "strand"]
CHAIN = ["seqid", "strand", "n_spans", "start0", "end0", "hash1", "hash2"]


def _prefer(exons: DataFrame, keys: Sequence[str], kind: str, bins: int | None) -> DataFrame:
    """Keep only ``kind`` rows of a transcript that has any, all rows of the others.

    The flag is aggregated map-side and joined back, so a skew join can split a hot
    transcript; without ``bins`` transcripts are bounded and share the shuffle of
    the merge that follows.
    """
    flag = F.max(F.col("kind") == kind)
    if bins is None:
        flagged = exons.withColumn("_preferred", flag.over(Window.partitionBy(*keys)))
    else:
        flagged = exons.join(exons.groupBy(*keys).agg(flag.alias("_preferred")), list(keys))
    return flagged.filter((F.col("kind") == kind) | ~F.col("_preferred")).drop("_preferred")


def scoring_spans(exons: DataFrame, bins: int | None = BIN_BITS) -> DataFrame:
    """Scored spans per transcript: any CDS hides all exons; merged."""
    wanted = exons.filter(F.col("kind").isin("CDS", "exon"))
    chosen = _prefer(wanted, ["side", "tid"], "CDS", bins)
    return merge_intervals(chosen, TRANSCRIPT, bins)


def _has_cds(cds: Column) -> Column:
    """Whether the row's side of its transcript has CDS; one bit a side is kept over the transcript.

    The order is that of ``linked_spans``, so rows are sorted once.
    """
    bit = F.expr("shiftleft(1L, cast(side as int))")
    by_transcript = Window.partitionBy("tid").orderBy("side", "gid", "seqid", "strand", "start0", "end0")
    whole = by_transcript.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bits = F.bit_or(F.when(cds, bit)).over(whole)
    return F.coalesce(bits.bitwiseAND(bit) != 0, F.lit(False))


def linked_spans(exons: DataFrame) -> DataFrame:
    """``scoring_spans`` with the start of the next span, ``next0``, in one shuffle by transcript.

    Windows with one sort order read a transcript's rows as a stream, which Spark spills if need
    be, and both sides of a transcript stay in one partition. A span starts where no earlier row
    reaches; its end is the reach before the next one. A transcript's first span also has its
    chain (``linked_chains``).
    """
    rows = exons.filter(F.col("kind").isin("CDS", "exon") & F.col("side").isNotNull() & F.col("tid").isNotNull())
    rows = rows.select(*TRANSCRIPT, "start0", "end0", (F.col("kind") == "CDS").alias("_cds"))
    chosen = rows.withColumn("_coding", _has_cds(F.col("_cds"))).filter("_cds or not _coding")
    transcript = Window.partitionBy("tid", "side", "gid", "seqid", "strand").orderBy("start0", "end0")
    earlier = transcript.rowsBetween(Window.unboundedPreceding, -1)
    whole = transcript.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = (
        chosen.filter("start0 is not null and end0 is not null")
        .select(*TRANSCRIPT, F.col("start0").cast("long"), F.col("end0").cast("long"))
        .withColumns({"_reach": F.max("end0").over(earlier), "_last": F.max("end0").over(whole)})
        .filter("_reach is null or start0 > _reach")
    )
    ends = F.coalesce(F.lead("_reach").over(transcript), "_last").alias("end0")
    spans = heads.select(*TRANSCRIPT, "_reach", "_last", "start0", ends, F.lead("start0").over(transcript).alias("next0"))
    first = F.col("_reach").isNull()
    totals = {
        "n_spans": F.count("*").over(whole),
        "hash1": F.bit_xor(F.xxhash64(F.lit(1), "start0", "end0")).over(whole),
        "hash2": F.bit_xor(F.xxhash64(F.lit(2), "start0", "end0")).over(whole),
        "_chain_end": F.col("_last"),
    }
    chain = (F.when(first, F.col(c)).alias(c) for c in totals)
    return spans.withColumns(totals).select("side", "gid", "seqid", "strand", "start0", "end0", "next0", *chain)


def linked_chains(spans: DataFrame) -> DataFrame:
    """The chains of ``linked_spans``: as ``chains_of``, but without ``tid`` and ``bases``, and hashes are joined by XOR."""
    return spans.filter("n_spans is not null").drop("end0", "next0").withColumnRenamed("_chain_end", "end0")


def training_spans(
    exons: DataFrame,
    keys: Sequence[str] = ("seqid", "strand", "tid"),
    bins: int | None = BIN_BITS,
) -> DataFrame:
    """Exons per parent for training: any exon hides the rest, else CDS without UTRs; merged."""
    chosen = _prefer(exons, keys, "exon", bins).filter(F.col("kind").isin("exon", "CDS"))
    return merge_intervals(chosen, keys, bins)


def parents_without_exons(
    exons: DataFrame, keys: Sequence[str] = ("seqid", "strand", "tid")
) -> DataFrame:
    """Parents with UTR rows only: they have no exon to train on and are reported."""
    usable = F.max(F.col("kind").isin("exon", "CDS"))
    return exons.groupBy(*keys).agg(usable.alias("usable")).filter(~F.col("usable")).drop("usable")


def chains_of(spans: DataFrame, keys: Sequence[str] = TRANSCRIPT) -> DataFrame:
    """One row per transcript with the identity of its chain."""

    def hash_sum(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), "start0", "end0").cast("decimal(20,0)"))

    return spans.groupBy(*keys).agg(
        F.count("*").alias("n_spans"),
        F.sum(F.col("end0") - F.col("start0")).alias("bases"),
        hash_sum(1).alias("hash1"),
        hash_sum(2).alias("hash2"),
        F.min("start0").alias("start0"),
        F.max("end0").alias("end0"),
    )


def distinct_chains(chains: DataFrame) -> DataFrame:
    return chains.select("side", *CHAIN, "bases").distinct()


def introns_of(
    spans: DataFrame, keys: Sequence[str] = TRANSCRIPT, bins: int | None = BIN_BITS
) -> DataFrame:
    """Gaps between consecutive spans of each transcript."""
    return interval_gaps(spans, keys, bins)


def transcript_bounds(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    return spans.groupBy(*keys).agg(
        F.min("start0").alias("start0"), F.max("end0").alias("end0")
    )


def alternative_chains(chains: DataFrame) -> DataFrame:
    """Chains of genes that have more than one distinct chain at one place."""
    gene = ["side", "gid", "seqid", "strand"]
    differ = [f(c).alias(f"{f.__name__}_{c}") for c in ("hash1", "hash2") for f in (F.min, F.max)]
    several = chains.groupBy(*gene).agg(*differ).filter("min_hash1 <> max_hash1 or min_hash2 <> max_hash2")
    return chains.join(several.select(*gene), gene, "left_semi").select("side", *CHAIN)


def strand_choice(first: Column, second: Column, forward: bool) -> Column:
    """``first`` on the plus strand and ``second`` on the minus strand, or the reverse."""
    plus, minus = (first, second) if forward else (second, first)
    return F.when(F.col("strand") == "+", plus).otherwise(minus)


def site_keys(introns: DataFrame, chains: DataFrame) -> DataFrame:
    """Donor, acceptor, start and stop sites (1-based), distinct per side."""

    def sites(df: DataFrame, forward: str, backward: str) -> DataFrame:
        low, high = F.col("start0") + 1, F.col("end0")
        pair = F.array(
            F.struct(F.lit(forward).alias("site"), strand_choice(low, high, True).alias("pos")),
            F.struct(F.lit(backward).alias("site"), strand_choice(low, high, False).alias("pos")),
        )
        return df.select("side", "seqid", "strand", F.explode(pair).alias("s")).select(
            "side", "seqid", "strand", "s.*"
        )

    return (
        sites(introns, "donor-site", "acceptor-site")
        .unionByName(sites(chains, "start-site", "stop-site"))
        .distinct()
    )


def coding_only(exons: DataFrame) -> DataFrame:
    """Rows of transcripts that have CDS."""
    named = exons.filter(F.col("side").isNotNull() & F.col("tid").isNotNull())
    return named.withColumn("_coding", _has_cds(F.col("kind") == "CDS")).filter("_coding").drop("_coding")


def gene_set_summary(exons: DataFrame) -> DataFrame:
    """Scored transcripts, transcripts with CDS and contigs per side."""
    per_transcript = (
        exons.filter(F.col("kind").isin("CDS", "exon"))
        .groupBy("side", "tid", "seqid")
        .agg(F.max(F.col("kind") == "CDS").alias("coding"))
    )
    contigs = per_transcript.groupBy("side", "seqid").agg(
        F.count("*").alias("transcripts"), F.sum(F.col("coding").cast("bigint")).alias("coding")
    )
    return contigs.groupBy("side").agg(
        F.sum("transcripts").alias("transcripts_scored"),
        F.sum("coding").alias("transcripts_with_cds"),
        F.count("*").alias("unique_seqids"),
    )
