"""Mixing sources to target weights by capped water-filling, with seeded repetitions.

Sources share the total size by weight; a source is clamped at ``max_epochs``
times its own size and its excess goes to the others by weight, again until
none is above its cap. Each document is then repeated a whole number of times,
and a seeded part of the source once more so that the taken words come to the
target: documents are ordered by a hash, and the part ends at a hash value per
source, so the decision is one comparison in each row.

Scale: sizes are summed map-side per source and per (source, hash bin); only the
documents of one bin of 4096 in each source are ordered exactly. Nothing but
one row per source meets the documents again.

Cases: a null source is a source of its own; null and empty texts have size 0
and take 0 words; rows with one id are kept or left together; with no words at
all every target is 0; an empty table gives no rows. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomeframe.llm.common import free_name
from genomeframe.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: The cycle of weights in the order of source names.
CYCLE = (5.0, 2.0, 1.0)
BIN_SHIFT = 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A 60-bit number drawn from the seed and the id."""
    key = F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: names with a mark in front, or another mark alone."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """``sources`` (one row each) with ``weight``: the cycle by code point, null last.

    One row per source goes through this ordering, not the documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(CYCLE)
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), at + 1))


def water_fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``.

    Every round shares what is left among the free sources and clamps those above
    their cap; a round is one aggregate over one row per source.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        clamped = F.lit(False) if level is None else F.col("weight") * level > cap
        free, taken = sources.agg(
            F.sum(F.when(~clamped, F.col("weight"))), F.sum(F.when(clamped, cap))
        ).first()
        if not free:
            break
        share = (total - (taken or 0.0)) / free
        if level is not None and share <= level:
            break
        level = share
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn("target", F.least(cap, F.col("weight") * level).cast("double"))


def mix(
    docs: DataFrame,
    weigh=cyclic_weights,
    max_epochs: float = 3.0,
    seed: int = 17,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(sizes of the documents, one row of decisions per source).

    The first has doc_id, source_key, size and draw; the second source_key,
    source_size, target, whole (repetitions of every document) and last_draw (up to
    which a document is taken once more).
    """
    sizes = materialize(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            source_key(F.col(source)).alias("source_key"),
            word_count(F.col(text)).alias("size"),
            draw(F.col(id_column), seed).alias("draw"),
        ),
        "mix-sizes",
    )
    totals = materialize(
        weigh(
            sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
        ),
        "mix-sources",
    )
    goal = water_fill(totals, max_epochs).withColumn(
        "whole",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0)
        .cast("long"),
    )
    goal = goal.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    slot = F.shiftright("draw", BIN_SHIFT)
    before = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        sizes.groupBy("source_key", slot.alias("bin"))
        .agg(F.sum("size").alias("bin_size"))
        .withColumn("below", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
        .join(goal.select("source_key", "part"), "source_key")
        .filter((F.col("below") < F.col("part")) & (F.col("below") + F.col("bin_size") >= F.col("part")))
        .select("source_key", "bin", "below", "part")
    )
    inside = Window.partitionBy("source_key").orderBy("draw").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    last = (
        sizes.withColumn("bin", slot)
        .join(edges, ["source_key", "bin"])
        .withColumn("middle", F.col("below") + F.sum("size").over(inside) - F.col("size") / 2)
        .groupBy("source_key")
        .agg(
            F.max(F.when(F.col("middle") <= F.col("part"), F.col("draw"))).alias("within"),
            F.first(F.shiftleft("bin", BIN_SHIFT) - 1).alias("floor"),
        )
        .select("source_key", F.coalesce("within", "floor").alias("last_draw"))
    )
    decisions = goal.join(last, "source_key", "left").select(
        "source_key",
        "source_size",
        "target",
        "whole",
        F.when(F.col("part") > 0, F.col("last_draw")).alias("last_draw"),
    )
    return sizes, materialize(decisions, "mix-decisions")


def repetitions() -> Column:
    """How often a row with draw, whole and last_draw is taken."""
    extra = F.coalesce(F.col("draw") <= F.col("last_draw"), F.lit(False))
    return F.coalesce(F.col("whole"), F.lit(0)) + extra.cast("long")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source) and taken words."""
    sizes, decisions = mix(docs, **options)
    return sizes.join(decisions, "source_key").select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        (F.col("size") * repetitions()).alias("taken"),
        repetitions().alias("repetitions"),
    )


def mixed(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    _, decisions = mix(docs, seed=seed, **options)
    names = {n: free_name(docs, n) for n in ("source_key", "draw", "whole", "last_draw", "copy")}
    source = options.get("source", "source")
    marked = docs.withColumns(
        {
            names["source_key"]: source_key(F.col(source)),
            names["draw"]: draw(F.col(options.get("id_column", "doc_id")), seed),
        }
    )
    chosen = decisions.select(
        F.col("source_key").alias(names["source_key"]),
        F.col("whole").alias(names["whole"]),
        F.col("last_draw").alias(names["last_draw"]),
    )
    extra = F.coalesce(F.col(names["draw"]) <= F.col(names["last_draw"]), F.lit(False))
    times = (F.col(names["whole"]) + extra.cast("long")).cast("int")
    return (
        marked.join(chosen, names["source_key"])
        .withColumn(names["copy"], F.explode(F.array_repeat(F.lit(True), times)))
        .select(*docs.columns)
    )


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('17-' || doc_id), 1, 15))::BIGINT AS draw
  FROM documents
), s AS (
  SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), fill(step, level) AS (
  SELECT 1, sum(source_size) / sum(weight) FROM s
  UNION ALL
  SELECT step + 1, next FROM (
    SELECT any_value(step) AS step, any_value(level) AS level,
      (sum(source_size) - coalesce(sum(3.0 * source_size) FILTER (WHERE weight * level > 3.0 * source_size), 0))
        / sum(weight) FILTER (WHERE NOT weight * level > 3.0 * source_size) AS next
    FROM fill, s)
  WHERE next > level
), t AS (
  SELECT *, least(3.0 * source_size, weight * (SELECT max(level) FROM fill))::DOUBLE AS target FROM s
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), o AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS part,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw) - d.size / 2 AS middle
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), e AS (
  SELECT *, max(CASE WHEN middle <= part THEN draw END) OVER (PARTITION BY source) AS last_draw FROM o
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * (whole + CASE WHEN part > 0 AND draw <= last_draw THEN 1 ELSE 0 END))::BIGINT AS taken,
  (whole + CASE WHEN part > 0 AND draw <= last_draw THEN 1 ELSE 0 END)::BIGINT AS repetitions
FROM e
"""
