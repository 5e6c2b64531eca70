"""Site probabilities as bedGraph tracks, one per kind and strand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomeframe.functions.metrics import sigmoid
from genomeframe.operators.samples import SITES


def six_digits(x: Column) -> Column:
    """A number in (0, 1] with six significant digits, without trailing zeros.

    Below 1e-4 the exponent form is used.
    """
    exponent = F.floor(F.log10(x))
    fixed = F.format_string("%.12f", F.round(x * F.pow(F.lit(10.0), 5 - exponent)) / F.pow(F.lit(10.0), 5 - exponent))
    trimmed = F.regexp_replace(fixed, r"\.?0+$", "")
    mantissa = F.regexp_replace(F.format_string("%.5e", x), r"\.?0*e", "e")
    return F.when(x < 1e-4, mantissa).otherwise(trimmed)


def bedgraph_rows(points: DataFrame) -> DataFrame:
    """``kind, strand, seqid, start0, end0, value`` from strand-oriented points.

    Gene ends are shown on their last base; bases outside the contig are dropped.
    """
    shifted = F.col("pos") - F.when(F.col("kind") == 3, 1).otherwise(0)
    base = F.when(F.col("strand") == "+", shifted).otherwise(F.col("length") - 1 - shifted)
    names = F.array(*(F.lit(s) for s in SITES))
    return (
        points.withColumn("start0", base)
        .filter("start0 >= 0 and start0 < length")
        .select(
            F.get(names, F.col("kind")).alias("kind"),
            "strand",
            "seqid",
            "start0",
            (F.col("start0") + 1).alias("end0"),
            six_digits(sigmoid(F.col("logit").cast("double"))).alias("value"),
        )
    )


def write_bedgraph(points: DataFrame, contigs: DataFrame, path: str) -> None:
    """One folder per kind and strand; rows sorted by contig order and position."""
    rows = bedgraph_rows(points).join(contigs.select("seqid", "ord"), "seqid")
    line = F.concat_ws("\t", "seqid", "start0", "end0", "value")
    track = F.when(F.col("strand") == "+", F.lit("plus")).otherwise(F.lit("minus"))
    (
        rows.withColumn("track", track)
        .repartitionByRange("kind", "track", "ord", "start0")
        .sortWithinPartitions("kind", "track", "ord", "start0")
        .select("kind", "track", line.alias("line"))
        .write.partitionBy("kind", "track")
        .text(path)
    )
