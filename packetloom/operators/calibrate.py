"""Score calibration fitted by Spark jobs over collapsed scores."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.scaling import sigmoid
from packetloom.operators.metrics import score_counts

# Step lengths of the line search: 1, 1/2, ... down to above 1e-4, all tried in one job.
STEPS = [0.5 ** k for k in range(14)]
DAMPING = 1e-4


def platt_apply(score: Column, slope: float | Column, intercept: float | Column) -> Column:
    """Calibrated probability 1 / (1 + exp(-(slope * score + intercept)))."""
    a = slope if isinstance(slope, Column) else F.lit(float(slope))
    b = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    return sigmoid(a * score + b)


def _clip(p: Column) -> Column:
    return F.greatest(F.lit(1e-15), F.least(F.lit(1.0 - 1e-15), p))


def platt_fit(df: DataFrame, label: str = "label", score: str = "score", max_iter: int = 100,
              tol: float = 1e-6) -> tuple[float, float]:
    """(slope, intercept) of a logistic curve with smoothed targets, by damped Newton steps.

    Each iteration is one aggregate for gradient and curvature and one for the losses of all step
    lengths, both over distinct scores.
    """
    counts = score_counts(df, [], label, score).persist()
    try:
        total = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
        if total.p is None:
            return 1.0, 0.0
        if total.p == 0:
            return 0.0, -10.0
        if total.n == 0:
            return 0.0, 10.0
        high, low = (total.p + 1.0) / (total.p + 2.0), 1.0 / (total.n + 2.0)
        s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
        # weight of a row's score and its summed target
        weight, target = pos + neg, pos * high + neg * low
        a, b = 1.0, math.log((total.p + 1.0) / (total.n + 1.0))

        def loss(slope: float, intercept: float) -> Column:
            f = slope * s + intercept
            p, q = _clip(sigmoid(f)), _clip(sigmoid(-f))
            return -F.sum(target * F.log(p) + (weight - target) * F.log(q))

        for _ in range(max_iter):
            p = _clip(sigmoid(a * s + b))
            w, diff = weight * p * (1.0 - p), weight * p - target
            g = counts.agg(F.sum(diff * s).alias("ga"), F.sum(diff).alias("gb"), F.sum(w * s * s).alias("haa"),
                           F.sum(w * s).alias("hab"), F.sum(w).alias("hbb")).first()
            haa, hbb = g.haa + DAMPING, g.hbb + DAMPING
            det = haa * hbb - g.hab * g.hab
            if abs(det) < 1e-12 or math.hypot(g.ga, g.gb) < tol:
                break
            da, db = (hbb * g.ga - g.hab * g.gb) / det, (haa * g.gb - g.hab * g.ga) / det
            tried = counts.agg(loss(a, b), *[loss(a - t * da, b - t * db) for t in STEPS]).first()
            better = [t for t, value in zip(STEPS, tried[1:]) if value < tried[0]]
            step = better[0] if better else 1e-4
            a, b = a - step * da, b - step * db
        return a, b
    finally:
        counts.unpersist()


def logistic_fit(train: DataFrame, label: str = "label", score: str = "score"):
    """A one-variable logistic regression of the label on the score."""
    rows = VectorAssembler(inputCols=[score], outputCol="_x").transform(
        train.withColumn(label, F.col(label).cast("double")))
    return LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.0, predictionCol="_lp",
                              probabilityCol="_prob", rawPredictionCol="_raw").fit(rows)


def logistic_apply(model, df: DataFrame, score: str = "score") -> DataFrame:
    """Add ``calibrated``; the fitted curve is two numbers, so this is a plain expression."""
    return df.withColumn("calibrated", platt_apply(
        F.col(score), float(model.coefficients[0]), float(model.intercept)))


def logistic_calibrate(train: DataFrame, df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return logistic_apply(logistic_fit(train, label, score), df, score)
