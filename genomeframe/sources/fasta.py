"""FASTA files as contigs and tiles.

Files are read in byte ranges, also inside lines; headers and offsets are carried
across bins of pieces, and tiles are assembled from them: a contig of any
size, on one line or many, is read by many tasks and never becomes one row. Stores that tasks
can not open by themselves are read by lines.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genomeframe.functions.sequence import clean_bases
from genomeframe.operators.tiles import tiles_from_pieces
from genomeframe.session import materialize
from genomeframe.sources.byte_ranges import RANGE_BYTES, fasta_pieces, without_header_rests
from genomeframe.sources.text import file_window, line_bins, ordered_lines, require_valid


class Genome(NamedTuple):
    """``contigs``: seqid, ord, length; ``tiles``: see the tiling operator."""

    contigs: DataFrame
    tiles: DataFrame
    problems: DataFrame


def read_fasta(
    spark: SparkSession, paths: str | list[str], strict: bool = True, range_bytes: int = RANGE_BYTES
) -> Genome:
    """Read FASTA, plain or gzip-compressed; ``ord`` numbers records in file order.

    An id is the first token after ``>``. Problems: empty or duplicate ids,
    empty sequences, data before the first header, no records. ``strict``
    raises on them.
    """
    pieces = fasta_pieces(spark, paths, range_bytes)
    if pieces is None:
        lines = ordered_lines(spark, paths).withColumn("header", F.col("value").startswith(">"))
    else:
        lines = without_header_rests(materialize(pieces, "fasta-ranges"))
    lines = line_bins(lines).select(
        "file",
        "bin",
        "row",
        "header",
        F.when(F.col("header"), F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"),
        F.when(~F.col("header"), clean_bases(F.col("value"))).alias("bases"),
    )
    size = F.coalesce(F.length("bases"), F.lit(0)).cast("bigint")
    lines = materialize(lines.withColumn("size", size), "fasta-lines")

    # Per bin: its last header and the bases after it; across bins: the record
    # that is open when the bin begins and how many bases it already has.
    heading = F.when(F.col("header"), F.col("row"))
    summary = lines.groupBy("file", "bin").agg(
        F.max(heading).alias("last_header"), F.count_if("header").alias("headers")
    )
    tails = (
        lines.join(summary.select("file", "bin", "last_header"), ["file", "bin"])
        .groupBy("file", "bin")
        .agg(
            F.sum(
                F.when(
                    F.col("last_header").isNull() | (F.col("row") > F.col("last_header")),
                    F.col("size"),
                ).otherwise(0)
            ).alias("tail")
        )
    )
    upto = file_window().rowsBetween(Window.unboundedPreceding, 0)
    earlier = file_window().rowsBetween(Window.unboundedPreceding, -1)
    in_record = (
        Window.partitionBy("file", "record_to").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    )
    state = (
        summary.join(tails, ["file", "bin"])
        .withColumn("record_to", F.sum("headers").over(upto))
        .withColumn("open_size", F.sum("tail").over(in_record))
        .select(
            "file",
            "bin",
            F.coalesce(F.sum("headers").over(earlier), F.lit(0)).alias("records_before"),
            F.coalesce(F.lag("open_size").over(file_window()), F.lit(0)).alias("size_before"),
        )
    )
    inside = Window.partitionBy("file", "bin").orderBy("row")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    here = F.count_if("header").over(so_far)
    numbered = (
        lines.join(state, ["file", "bin"])
        .withColumn("here", here)
        .withColumn("record", F.col("records_before") + F.col("here"))
    )
    in_part = (
        Window.partitionBy("file", "bin", "record")
        .orderBy("row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("size").over(in_part), F.lit(0)) + F.when(
        F.col("here") == 0, F.col("size_before")
    ).otherwise(0)
    placed = materialize(
        numbered.withColumn("offset", offset).select(
            "file", "record", "header", "name", "bases", "size", "offset"
        ),
        "fasta-placed",
    )

    records = placed.groupBy("file", "record").agg(
        F.max(F.when(F.col("header"), F.col("name"))).alias("seqid"),
        F.sum("size").alias("length"),
    )
    records = materialize(records, "fasta-records")
    named = records.filter("record > 0")
    # One row per file and one per record; record numbers are already per file.
    files = named.groupBy("file").agg(F.max("record").alias("n"))
    first = files.select(
        "file",
        F.coalesce(
            F.sum("n").over(
                Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("before"),
    )
    contigs = named.join(first, "file").select(
        "seqid", (F.col("before") + F.col("record") - 1).cast("int").alias("ord"), "length"
    )
    problem = lambda rows, text, detail: rows.select(
        F.lit(text).alias("problem"), detail.cast("string").alias("detail")
    )
    some = contigs.agg(F.count("*").alias("n")).filter("n = 0")
    problems = (
        problem(named.filter("seqid = ''"), "empty sequence id", F.col("file"))
        .unionByName(problem(named.filter("length = 0"), "empty sequence", F.col("seqid")))
        .unionByName(
            problem(
                named.groupBy("seqid").count().filter("count > 1"),
                "duplicate sequence id",
                F.col("seqid"),
            )
        )
        .unionByName(
            problem(
                records.filter("record = 0 and length > 0"),
                "sequence before the first header",
                F.col("file"),
            )
        )
        .unionByName(problem(some, "no records", F.lit("")))
    )
    if strict:
        require_valid(problems)
    chunk = 16384
    pieces = (
        placed.filter("size > 0 and record > 0")
        .join(named.select("file", "record", "seqid"), ["file", "record"])
        .select(
            "seqid",
            "offset",
            F.posexplode(
                F.regexp_extract_all("bases", F.lit(f".{{1,{chunk}}}"), F.lit(0))
            ).alias("i", "piece"),
        )
        .select("seqid", (F.col("offset") + F.col("i") * chunk).alias("offset"), "piece")
    )
    return Genome(contigs, tiles_from_pieces(pieces, contigs), problems)
