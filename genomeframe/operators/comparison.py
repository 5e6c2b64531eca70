"""Agreement of two sets of gene models: side 0 is the reference, side 1 the prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomeframe.functions.metrics import with_rates
from genomeframe.operators.intervals import (
    PLACE,
    covered_length,
    merge_intervals,
    overlapping,
)
from genomeframe.operators.scan import BIN_BITS
from genomeframe.operators.transcripts import (
    CHAIN,
    alternative_chains,
    linked_chains,
    linked_spans,
    strand_choice,
)
from genomeframe.session import materialize

# Report order.
METRICS = [
    "nt",
    "exon-segment",
    "intron-segment",
    "donor-site",
    "acceptor-site",
    "start-site",
    "stop-site",
    "transcript-CDS-chain",
    "alternative-isoform",
]

def _places(df: DataFrame, *items: tuple[str, Column, Column | None]) -> DataFrame:
    """Each row as places ``(metric, x, size)`` to compare; ``metric`` is the number in METRICS. Null ``x`` is none."""
    structs = [
        F.struct(
            F.lit(METRICS.index(metric)).cast("tinyint").alias("metric"),
            x.cast("bigint").alias("x"),
            (F.lit(0) if end is None else end - x).cast("bigint").alias("size"),
        )
        for metric, x, end in items
    ]
    exploded = df.select("sides", "seqid", "strand", F.explode(F.array(*structs)).alias("item"))
    return exploded.select("sides", "seqid", "strand", "item.*").filter("x is not null")


def _bit() -> Column:
    """The row's side as a bit: 1 reference, 2 prediction."""
    return F.expr("cast(shiftleft(1, cast(side as int)) as tinyint)").alias("sides")


def exact_counts(found: DataFrame) -> DataFrame:
    """tp/fp/fn by ``metric`` of distinct keys with the bits of the sides that have them."""
    ref, pred = (F.col("sides").bitwiseAND(bit) != 0 for bit in (1, 2))
    return found.groupBy("metric").agg(
        F.count_if(ref & pred).alias("tp"),
        F.count_if(~ref & pred).alias("fp"),
        F.count_if(ref & ~pred).alias("fn"),
    )


def _number(metric: str) -> Column:
    return F.lit(METRICS.index(metric)).cast("tinyint").alias("metric")


def alternative_regions(chains: DataFrame, bins: int | None = BIN_BITS) -> DataFrame:
    """Merged envelopes of the alternative chains of both sides."""
    return merge_intervals(alternative_chains(chains), PLACE, bins)


def compare_gene_sets(exons: DataFrame, bins: int | None = BIN_BITS) -> DataFrame:
    """The nine-metric report of side 1 against side 0.

    Spans and forms feed several branches, so they are written once. Sides are bits, so
    that equal keys of both sides meet before they are shuffled.
    """
    spark = exons.sparkSession
    spans = materialize(linked_spans(exons), "spans")
    chains = linked_chains(spans)
    start0, end0, next0 = F.col("start0"), F.col("end0"), F.col("next0")
    first, last = strand_choice(start0 + 1, end0, True), strand_choice(start0 + 1, end0, False)
    forms = materialize(chains.select(*CHAIN, _bit()).groupBy(*CHAIN).agg(F.bit_or("sides").alias("sides")), "forms")
    alternatives = overlapping(forms, alternative_regions(chains, bins), PLACE)
    gap = next0 > end0
    low, high = F.when(gap, end0 + 1), F.when(gap, next0)
    places = _places(
        spans.withColumn("sides", _bit()),
        ("exon-segment", start0, end0),
        ("intron-segment", F.when(gap, end0), next0),
        ("donor-site", strand_choice(low, high, True), None),
        ("acceptor-site", strand_choice(low, high, False), None),
    ).unionByName(_places(forms, ("start-site", first, None), ("stop-site", last, None)))
    distinct = places.groupBy("metric", "seqid", "strand", "x", "size").agg(F.bit_or("sides").alias("sides"))
    counts = (
        exact_counts(distinct)
        .unionByName(exact_counts(forms.select(_number("transcript-CDS-chain"), "sides")))
        .unionByName(exact_counts(alternatives.select(_number("alternative-isoform"), "sides")))
    )
    bases = covered_length(spans, "side", PLACE).select(
        _number("nt"),
        F.col("shared").alias("tp"),
        (F.col("covered1") - F.col("shared")).alias("fp"),
        (F.col("covered0") - F.col("shared")).alias("fn"),
    )
    order = spark.createDataFrame(list(enumerate(METRICS)), "rank int, metric string")
    counts = counts.unionByName(bases).withColumnRenamed("metric", "rank")
    filled = order.join(F.broadcast(counts), "rank", "left").select(
        "rank", "metric", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn"))
    )
    return with_rates(filled).orderBy("rank").drop("rank")
