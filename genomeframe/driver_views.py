"""Genome-shaped views of the driver tables, used by the registered queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exons(spark: SparkSession, folder: str) -> DataFrame:
    """Two sets of gene models of the same loci: side 1 shifts some ends and drops nothing."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("tid"),
        F.expr("l_orderkey div 2").alias("gid"),
        F.expr("cast((l_orderkey div 2) % 16 as string)").alias("seqid"),
        F.expr("if((l_orderkey div 32) % 2 = 0, '+', '-')").alias("strand"),
        F.expr("if(l_returnflag <> 'N', 'CDS', 'exon')").alias("kind"),
        F.expr("l_partkey * 50 + l_linenumber").alias("start0"),
        F.expr("l_partkey * 50 + l_linenumber + cast(l_quantity as bigint)").alias("end0"),
        F.expr("l_discount >= 0.08").alias("_shifted"),
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col("end0")),
            F.struct(
                F.lit(1).alias("side"),
                (F.col("end0") + F.when(F.col("_shifted"), 3).otherwise(0)).alias("end0"),
            ),
        )
    )
    return rows.select(
        "gid", "tid", "seqid", "strand", "kind", "start0", sides.alias("v")
    ).select("v.side", "gid", "tid", "seqid", "strand", "kind", "start0", "v.end0")


def regions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.expr("cast(o_custkey % 16 as string)").alias("seqid"),
        F.expr("if((o_custkey div 16) % 2 = 0, '+', '-')").alias("strand"),
        F.expr("(o_orderkey * 37) % 100000").alias("start0"),
        F.expr("(o_orderkey * 37) % 100000 + 500").alias("end0"),
    )


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = ("ACGT" * 7)[:26] * 2


#: Letters of a text up to code point 127 and, in the last place, of all beyond; 0 is left out.
_OF_CODE = np.full(129, ord("N"), dtype=np.uint8)
_OF_CODE[[ord(c) for c in LETTERS]] = [ord(c) for c in BASES]
_OF_CODE[[ord(c) for c in " \t\n\r"]] = 0


def _with_bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            made = []
            for text in part.column("text").to_pylist():
                codes = np.minimum(np.frombuffer((text or "").encode("utf-32-le"), dtype="<u4"), 128)
                letters = _OF_CODE[codes]
                made.append(None if text is None else letters[letters != 0].tobytes().decode("ascii"))
            sizes = pa.array([None if m is None else len(m) for m in made], pa.int64())
            columns = [part.column("seqid"), part.column("ord"), pa.array(made, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, ["seqid", "ord", "bases", "length"])


def contigs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sequences: letters become bases cyclically, the rest N; white space is left out."""
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("seqid"), F.col("doc_id").cast("int").alias("ord"), "text"
    )
    return rows.mapInArrow(_with_bases, "seqid string, ord int, bases string, length bigint").filter("length > 0")


def placed_exons(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as exon and CDS rows on the document contigs; one transcript per order."""
    docs = contigs(spark, folder).select("seqid", "length")
    n_docs = table(spark, folder, "documents").count()
    rows = table(spark, folder, "lineitem").select(
        F.concat(F.lit("t"), F.col("l_orderkey")).alias("tid"),
        (F.col("l_orderkey") % n_docs).cast("string").alias("seqid"),
        F.expr(f"if((l_orderkey div {n_docs}) % 2 = 0, '+', '-')").alias("strand"),
        F.expr("if(l_returnflag = 'A', 'CDS', 'exon')").alias("kind"),
        F.expr("l_partkey * 37 + l_linenumber * 11").alias("at"),
        F.expr("cast(l_quantity as bigint) * 3").alias("size"),
    )
    return rows.join(docs, "seqid").select(
        "tid",
        "seqid",
        "strand",
        "kind",
        (F.col("at") % F.col("length")).alias("start0"),
        F.least((F.col("at") % F.col("length")) + F.col("size"), "length").alias("end0"),
        "length",
    )


def repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as repeats of up to 40 bases on the document contigs."""
    docs = contigs(spark, folder).select("seqid", "length")
    n_docs = table(spark, folder, "documents").count()
    rows = table(spark, folder, "orders").select(
        (F.col("o_custkey") % n_docs).cast("string").alias("seqid"), (F.col("o_orderkey") * 31).alias("at")
    )
    start = F.col("at") % F.col("length")
    return rows.join(docs, "seqid").select(
        "seqid", start.alias("start0"), F.least(start + 40, "length").alias("end0")
    )


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Genes (customers), transcripts (orders; low priority ones are rRNA), exons (line items)."""
    parents = lambda c: F.array(F.concat(F.lit(c[0]), F.col(c[1])))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("seqid", "strand")]
    nowhere = [F.lit(None).cast("bigint").alias(c) for c in ("start0", "end0")]
    genes = table(spark, folder, "customer").select(
        F.concat(F.lit("g"), F.col("c_custkey")).alias("id"),
        F.array().cast("array<string>").alias("parents"),
        F.lit("gene").alias("kind"),
        *nothing,
        *nowhere,
        F.lit(False).alias("rrna"),
    )
    transcripts = table(spark, folder, "orders").select(
        F.concat(F.lit("t"), F.col("o_orderkey")).alias("id"),
        parents(("g", "o_custkey")).alias("parents"),
        F.lit("mRNA").alias("kind"),
        *nothing,
        *nowhere,
        (F.col("o_orderpriority") == "5-LOW").alias("rrna"),
    )
    parts = placed_exons(spark, folder).select(
        F.lit("").alias("id"),
        F.array("tid").alias("parents"),
        "kind",
        "seqid",
        "strand",
        "start0",
        "end0",
        F.lit(False).alias("rrna"),
    )
    return genes.unionByName(transcripts).unionByName(parts)


SITE_OF_EVENT = {"signup": 0, "click": 1, "view": 2, "purchase": 3}


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Events as scored points: contig per user, second as position; errors are no sites."""
    kind = F.create_map(*(F.lit(x) for pair in SITE_OF_EVENT.items() for x in pair))
    rows = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("seqid"),
        F.lit("+").alias("strand"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("pos"),
        F.try_element_at(kind, F.col("event_type")).alias("kind"),
        F.when(F.col("value") > 0, F.log(F.col("value") / 50)).alias("logit"),
    )
    return (
        rows.filter("kind is not null and logit >= 0")
        .groupBy("seqid", "strand", "pos", "kind")
        .agg(F.max("logit").alias("logit"))
        .withColumn("part", F.lit(0.0))
    )


def dense_points(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as scored points, close together on both strands of 16 contigs."""
    rows = table(spark, folder, "lineitem").select(
        F.expr("cast(l_orderkey % 16 as string)").alias("seqid"),
        F.expr("if((l_orderkey div 16) % 2 = 0, '+', '-')").alias("strand"),
        F.expr("l_partkey * 10 + l_linenumber").alias("pos"),
        F.expr("cast((l_orderkey + l_linenumber) % 4 as int)").alias("kind"),
        F.expr("(l_quantity + l_discount * 100) / 20 + l_extendedprice / 1000000").alias("logit"),
        F.expr("((l_suppkey % 13) - 8) / 4.0D").alias("part"),
    )
    return rows.groupBy("seqid", "strand", "pos", "kind").agg(
        F.max("logit").alias("logit"), F.max("part").alias("part")
    )


def dense_spans(spark: SparkSession, folder: str, size: int, step: int) -> DataFrame:
    """A span of ``size`` at every ``step`` positions that hold dense points."""
    place = dense_points(spark, folder).select("seqid", "strand", F.expr(f"pos div {step}").alias("n")).distinct()
    start = (F.col("n") * step).cast("bigint")
    return place.select("seqid", "strand", start.alias("start0"), (start + size).alias("end0"))
