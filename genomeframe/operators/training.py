"""Weighted, L2-regularised logistic regressions of the six classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

L2 = 1e-5
MAX_ITERATIONS = 1000
#: Relative improvement at which a fit ends.
TOLERANCE = 1e-6


def fit_classifier(
    samples: DataFrame, balanced: bool, iterations: int = MAX_ITERATIONS
) -> np.ndarray:
    """Fit ``features, target, weight`` rows; the intercept is the last weight.

    The loss is the weighted sum of log-losses plus ``L2 / 2`` times the
    population (weights before balancing) times the squared weights. MLlib
    divides the loss by the sum of weights, hence the scaled ``regParam``.
    """
    totals = samples.agg(
        F.sum("weight").alias("population"), F.sum("target").alias("positives"), F.count("*").alias("n")
    ).first()
    positives, count = totals["positives"] or 0, totals["n"]
    if positives == 0 or positives == count:
        raise ValueError("training set lacks positive or negative examples")
    negatives = totals["population"] - positives
    positive_weight = negatives / positives if balanced else 1.0
    weighted = samples.withColumn(
        "weight", F.when(F.col("target") == 1, F.lit(positive_weight)).otherwise(F.col("weight"))
    )
    after = negatives + positives * positive_weight
    fit = LogisticRegression(
        featuresCol="features",
        labelCol="target",
        weightCol="weight",
        standardization=False,
        elasticNetParam=0.0,
        regParam=L2 * totals["population"] / after,
        maxIter=iterations,
        tol=TOLERANCE,
    ).fit(weighted)
    return np.append(fit.coefficients.toArray(), fit.intercept)


def loss(samples: DataFrame, weights: np.ndarray, balanced: bool) -> DataFrame:
    """(samples, loss, constant_loss) of fitted weights: mean log-losses, one row.

    Balanced samples weigh the same in both classes; ``constant_loss`` is what the best constant
    probability reaches. The weights are one literal of a classifier's size.
    """
    values = F.lit([float(w) for w in weights[:-1]])
    products = F.zip_with(vector_to_array("features"), values, lambda x, w: x * w)
    logit = F.aggregate(products, F.lit(float(weights[-1])), lambda total, x: total + x)
    positive = F.col("target") == 1
    margin = F.when(positive, logit).otherwise(-logit)
    stable = F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
    sides = samples.withColumn("one", stable).agg(
        F.count("*").alias("samples"),
        F.sum(F.when(positive, F.col("weight") * F.col("one"))).alias("loss1"),
        F.sum(F.when(~positive, F.col("weight") * F.col("one"))).alias("loss0"),
        F.sum(F.when(positive, F.col("weight"))).alias("w1"),
        F.sum(F.when(~positive, F.col("weight"))).alias("w0"),
    )
    share = F.col("w1") / (F.col("w1") + F.col("w0"))
    if balanced:
        mean, constant = (F.col("loss1") / F.col("w1") + F.col("loss0") / F.col("w0")) / 2, F.log(F.lit(2.0))
    else:
        mean = (F.col("loss1") + F.col("loss0")) / (F.col("w1") + F.col("w0"))
        constant = -(share * F.log(share) + (1 - share) * F.log(1 - share))
    return sides.select("samples", mean.alias("loss"), constant.alias("constant_loss"))
