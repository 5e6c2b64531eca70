"""BED files as region rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomeframe.functions.sequence import inside_contig
from genomeframe.sources.text import ordered_lines, require_valid


def read_bed(
    spark: SparkSession, paths: str | list[str], contigs: DataFrame | None = None
) -> DataFrame:
    """Rows ``seqid, start0, end0, strand``; strand from column 6, else ``+``.

    Fewer than three columns, or an interval outside its contig when ``contigs``
    is given, raise ValueError.
    """
    lines = ordered_lines(spark, paths).filter(
        (F.col("value") != "") & ~F.col("value").rlike("^(#|track|browser)")
    )
    f = F.split("value", "\t")
    strand = F.get(f, F.lit(5))
    rows = lines.select(
        F.get(f, F.lit(0)).alias("seqid"),
        F.get(f, F.lit(1)).try_cast("bigint").alias("start0"),
        F.get(f, F.lit(2)).try_cast("bigint").alias("end0"),
        F.when(strand.isin("+", "-"), strand).otherwise(F.lit("+")).alias("strand"),
        "value",
    )
    bad = F.col("start0").isNull() | F.col("end0").isNull()
    checked = rows
    if contigs is not None:
        checked = rows.join(contigs.select("seqid", "length"), "seqid", "left")
        valid = inside_contig(F.col("strand"), F.col("start0"), F.col("end0"), F.col("length"))
        bad = bad | ~F.coalesce(valid, F.lit(False))
    require_valid(
        checked.filter(bad).select(
            F.lit("invalid BED row").alias("problem"), F.col("value").alias("detail")
        )
    )
    return rows.drop("value")
