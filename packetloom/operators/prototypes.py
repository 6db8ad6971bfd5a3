"""Nearest-centroid classifier and the two-stage cascade built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordered import one_row

SEGMENT_FEATURES = ["mean_size", "max_size", "mean_pkts", "mean_duration", "mean_interarrival", "std_size",
                    "forward_share", "total_span"]
MAX_CLASSES = 1_000


def fit_centroids(train: DataFrame, label: str, features: Sequence[str] = SEGMENT_FEATURES) -> DataFrame:
    """One row: ``scales`` (pooled deviation per feature, 1.0 where tiny) and ``classes`` (name, center).

    The result grows with classes, not rows; more than MAX_CLASSES is refused.
    """
    rows = train.filter(F.col(label).isNotNull())
    centers = rows.groupBy(label).agg(F.array(*[F.avg(f) for f in features]).alias("center"))
    listed = centers.agg(
        F.sort_array(F.collect_list(F.struct(F.col(label).alias("name"), "center"))).alias("classes"),
        F.count(F.lit(1)).alias("_n"))
    many = F.raise_error(F.lit(f"over {MAX_CLASSES} classes to fit centroids for"))
    listed = listed.select(F.when(F.col("_n") > MAX_CLASSES, many.cast(listed.schema["classes"].dataType))
                           .otherwise(F.col("classes")).alias("classes"))
    spread = rows.agg(F.array(*[F.stddev_pop(f) for f in features]).alias("s"))
    scales = F.transform("_s", lambda s: F.when(s > 1e-6, s).otherwise(F.lit(1.0)))
    return listed.withColumn("_s", one_row(spread)["s"]).withColumn("scales", scales).drop("_s")


def predict_centroids(df: DataFrame, model: DataFrame, features: Sequence[str] = SEGMENT_FEATURES,
                      prediction: str = "predicted") -> DataFrame:
    """Nearest class by scaled Euclidean distance, and softmax scores rounded to four places.

    The model is one value per row of ``df``: no join, no pair rows.  Ties go to the first class name.
    """
    point = F.array(*[F.col(f).cast("double") for f in features])

    def distance(center: Column) -> Column:
        parts = F.zip_with(F.zip_with(F.col("_x"), center, lambda a, b: a - b), F.col("_m")["scales"],
                           lambda d, s: (d / s) * (d / s))
        return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v))

    out = df.withColumns({"_x": point, "_m": one_row(model)})
    out = out.withColumn("_d", F.transform(F.col("_m")["classes"], lambda c: F.struct(
        distance(c["center"]).alias("distance"), c["name"].alias("name"))))
    near = F.array_min("_d")
    weights = F.transform("_d", lambda d: F.struct(
        d["name"].alias("name"), F.exp(-F.least(d["distance"] - F.col("_near")["distance"], F.lit(50.0))).alias("w")))
    out = out.withColumn("_near", near).withColumn("_w", weights)
    total = F.aggregate("_w", F.lit(0.0), lambda acc, w: acc + w["w"])
    scores = F.map_from_entries(F.transform("_w", lambda w: F.struct(w["name"], F.bround(w["w"] / F.col("_t"), 4))))
    return (out.withColumn("_t", total)
            .withColumns({prediction: F.col("_near")["name"], "scores": scores,
                          "distance": F.col("_near")["distance"]})
            .drop("_x", "_m", "_d", "_w", "_near", "_t"))


FILTERED = "filtered_by_layer1"


def cascade(stage1: DataFrame, stage2: DataFrame, keys: Sequence[str], forward: str = "doh") -> DataFrame:
    """Join two scored tables in series: only flows stage 1 forwards get the stage-2 verdict.

    Both have ``predicted`` and ``delay_s`` per flow.  Stage 2 is read only for forwarded flows.
    """
    keys = list(keys)
    one = stage1.withColumnsRenamed({"predicted": "l1_predicted", "delay_s": "l1_delay_s"})
    passed = one.filter(F.col("l1_predicted") == forward).select(*keys)
    two = (stage2.select(*keys, F.col("predicted").alias("l2_predicted"), F.col("delay_s").alias("l2_delay_s"))
           .join(passed, keys, "left_semi"))
    out = one.join(two, keys, "left")
    return out.withColumns({"verdict": F.coalesce("l2_predicted", F.lit(FILTERED)),
                            "l2_delay_s": F.coalesce("l2_delay_s", F.lit(0.0))})


def cascade_summary(verdicts: DataFrame, truth: str, tunnel: str, span: str = "span_s",
                    forward: str = "doh") -> DataFrame:
    """Flows, tunnels, tunnels found, their rate, and the mean cut in delay against the flow's span."""
    is_tunnel = F.col(truth) == tunnel
    found = is_tunnel & (F.col("l1_predicted") == forward) & (F.col("verdict") == tunnel)
    cut = F.when(is_tunnel, F.when(F.col(span) > 0, (F.col(span) - F.col("l1_delay_s")) / F.col(span)).otherwise(0.0))
    sums = verdicts.agg(F.count(F.lit(1)).alias("total_flows"), F.count_if(is_tunnel).alias("true_tunnels"),
                        F.count_if(found).alias("detected_tunnels"),
                        F.bround(F.coalesce(F.avg(cut), F.lit(0.0)), 4).alias("mean_delay_reduction"))
    rate = F.when(F.col("true_tunnels") > 0, F.bround(F.col("detected_tunnels") / F.col("true_tunnels"), 4))
    return sums.withColumn("detection_rate", F.coalesce(rate, F.lit(0.0)))
