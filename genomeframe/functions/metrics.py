"""Scores and rates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def with_rates(counts):
    """Add reference, prediction, precision, recall and f1 to tp/fp/fn rows.

    Precision without predictions is 0 if there is any reference, else null;
    recall without reference is null; f1 is null when both sides are empty.
    """
    tp, ref, pred = (F.col(c).cast("double") for c in ("tp", "reference", "prediction"))
    return (
        counts.withColumn("reference", F.col("tp") + F.col("fn"))
        .withColumn("prediction", F.col("tp") + F.col("fp"))
        .withColumn(
            "precision",
            F.when(F.col("prediction") > 0, tp / pred).when(F.col("reference") > 0, F.lit(0.0)),
        )
        .withColumn("recall", F.when(F.col("reference") > 0, tp / ref))
        .withColumn(
            "f1",
            F.when(F.col("reference") + F.col("prediction") > 0, 2 * tp / (ref + pred)),
        )
    )
