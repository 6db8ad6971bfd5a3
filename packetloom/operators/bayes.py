"""Gaussian naive Bayes in closed form: one aggregate to fit, column arithmetic to score."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordered import materialize, one_row

# Fixed value: the share of the largest variance of any feature that is added to every variance.
SMOOTHING = 1e-9


def fit_gaussian(train: DataFrame, label: str, features: Sequence[str], smoothing: float = SMOOTHING) -> DataFrame:
    """One row per class: name, log_prior, means, variances (smoothed), in the order of ``features``.

    Rows without a label are left out; a missing feature counts in no mean or variance.  Counts, means and variances of
    classes are combined before their shuffle; there may be any number of classes.
    """
    rows = train.filter(F.col(label).isNotNull())
    values = [F.col(f).cast("double") for f in features]
    widest = rows.agg(F.greatest(*[F.var_pop(v) for v in values], F.lit(0.0)).alias("widest"),
                      F.count(F.lit(1)).alias("n"))
    classes = rows.groupBy(F.col(label).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(v) for v in values]).alias("means"),
        F.array(*[F.var_pop(v) for v in values]).alias("variances"))
    whole = one_row(widest)
    return (classes.withColumns({"_widest": whole["widest"], "_all": whole["n"]})
            .select("name", F.log(F.col("n") / F.col("_all")).alias("log_prior"), "means",
                    F.transform("variances", lambda v: v + F.lit(smoothing) * F.col("_widest")).alias("variances")))


def predict_gaussian(df: DataFrame, model: DataFrame, features: Sequence[str], prediction: str = "predicted") -> DataFrame:
    """The likeliest class and ``probabilities`` of all, by class name.

    The model is one value per row of ``df``: no join.  Of equally likely classes the first by name is taken.  A row
    that lacks a feature has no prediction.
    """
    listed = one_row(model.agg(F.sort_array(F.collect_list(
        F.struct("name", "log_prior", "means", "variances"))).alias("classes")))
    point = F.array(*[F.col(f).cast("double") for f in features])

    def likelihood(c: Column) -> Column:
        parts = F.zip_with(F.zip_with(F.col("_x"), c["means"], lambda x, m: (x - m) * (x - m)), c["variances"],
                           lambda d, v: F.log(v * (2 * math.pi)) + d / v)
        return c["log_prior"] - F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p) / 2
    out = df.withColumns({"_x": point, "_m": listed["classes"]})
    out = out.withColumn("_l", F.transform("_m", lambda c: F.struct(likelihood(c).alias("l"), c["name"].alias("name"))))
    top = F.array_max(F.transform("_l", lambda s: s["l"]))
    out = out.withColumn("_top", F.when(F.exists("_l", lambda s: s["l"].isNull() | F.isnan(s["l"])), None).otherwise(top))
    weights = F.transform("_l", lambda s: F.exp(s["l"] - F.col("_top")))
    out = out.withColumn("_w", weights).withColumn("_sum", F.aggregate("_w", F.lit(0.0), lambda acc, w: acc + w))
    first = F.get(F.filter("_l", lambda s: s["l"] == F.col("_top")), F.lit(0))["name"]
    known = F.col("_top").isNotNull()
    return out.withColumns({
        prediction: F.when(known, first),
        "probabilities": F.when(known, F.map_from_arrays(
            F.transform("_l", lambda s: s["name"]), F.transform("_w", lambda w: w / F.col("_sum"))))
    }).drop("_x", "_m", "_l", "_top", "_w", "_sum")


@dataclass
class GaussianBayes:
    """A fitted model in the shape of the other classifiers: ``transform`` adds prediction and probability."""
    model: DataFrame
    features: list[str]

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str], label: str, smoothing: float = SMOOTHING) -> GaussianBayes:
        return cls(materialize(fit_gaussian(train, label, features, smoothing)), list(features))

    def transform(self, df: DataFrame) -> DataFrame:
        out = predict_gaussian(df, self.model, self.features, "prediction")
        by_class = F.transform(F.array_sort(F.map_keys("probabilities")), lambda k: F.col("probabilities")[k])
        return out.withColumn("probability", array_to_vector(by_class)).drop("probabilities")
