"""Confusion counts, ranking metrics and thresholds; every operator takes ``by`` group columns.

Scores are collapsed to one row per distinct (group, score) before anything is ordered, and ordered
sums run over score buckets, so one group may hold any share of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.ordered import running, score_bucket

SLACK = 1e-12


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "prediction") -> DataFrame:
    """tn, fp, fn, tp per group; rows whose label or prediction is not 0/1 count nowhere."""
    y, p = F.col(label), F.col(pred)
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return df.groupBy(*by).agg(*[F.count_if((y == a) & (p == b)).alias(n) for n, (a, b) in cells.items()])


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def f1_of(precision: Column, recall: Column) -> Column:
    return _ratio(2.0 * precision * recall, precision + recall)


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Rates from confusion counts; 0 where a rate is not defined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall, specificity = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return counts.withColumns({
        "total": tn + fp + fn + tp, "accuracy": _ratio(tp + tn, tn + fp + fn + tp),
        "precision": precision, "recall": recall, "specificity": specificity,
        "fpr": _ratio(fp, fp + tn), "fnr": _ratio(fn, fn + tp), "f1": f1_of(precision, recall),
        "balanced_accuracy": (recall + specificity) * 0.5})


def class_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label",
                  pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs as label or prediction."""
    by = list(by)
    pairs = df.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("n"))
    n, hit = F.col("n"), F.col(label) == F.col(pred)
    sides = pairs.select(*by, F.explode(F.array(
        F.struct(F.col(label).alias("class"), n.alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(hit, n).otherwise(0).alias("hits")),
        F.struct(F.col(pred).alias("class"), F.lit(0).cast("long").alias("support"), n.alias("predicted"),
                 F.lit(0).cast("long").alias("hits")))).alias("_s")).select(*by, "_s.*")
    sums = sides.groupBy(*by, "class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                                           F.sum("hits").alias("hits"))
    precision, recall = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    return sums.select(*by, "class", "support", precision.alias("precision"), recall.alias("recall"),
                       f1_of(precision, recall).alias("f1"))


def averaged_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label",
                     pred: str = "prediction") -> DataFrame:
    """Macro and support-weighted precision, recall and F1."""
    per_class = class_metrics(df, by, label, pred)
    aggs = []
    for m in ("precision", "recall", "f1"):
        aggs.append(F.avg(m).alias(f"{m}_macro"))
        aggs.append((F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"{m}_weighted"))
    return per_class.groupBy(*by).agg(*aggs)


def score_counts(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """One row per distinct score of a group with its positives and negatives."""
    s = F.col(score).cast("double")
    return (df.filter(F.col(score).isNotNull()).groupBy(*by, s.alias("score"))
            .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")))


def _cumulative(counts: DataFrame, by: Sequence[str], descending: bool) -> DataFrame:
    """Add pos_upto, neg_upto (this score and all before it) and the group totals."""
    direction = -1 if descending else 1
    keyed = counts.withColumns({"_o": F.col("score") * direction,
                                "_bucket": score_bucket(F.col("score")) * direction})
    return running(keyed, by, "_bucket", ["_o"], {"pos_upto": ("sum", F.col("pos"), True),
                                                   "neg_upto": ("sum", F.col("neg"), True)})


def ranking_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC area (ties share their mean rank) and average precision per group.

    ROC area is null when only one class is there; average precision is null without positives and 1
    without negatives.
    """
    by = list(by)
    ranked = _cumulative(score_counts(df, by, label, score), by, descending=True)
    pos, tp, fp = F.col("pos"), F.col("pos_upto"), F.col("neg_upto")
    n_pos, n_neg = F.col("pos_upto_total"), F.col("neg_upto_total")
    # negatives ranked below this score, ties counted half
    beaten = (n_neg - fp).cast("double") + F.col("neg") / 2.0
    sums = ranked.groupBy(*by).agg(
        F.max(n_pos).alias("positives"), F.max(n_neg).alias("negatives"),
        F.sum(pos * beaten).alias("_u"), F.sum(pos * (tp / (tp + fp))).alias("_ap"))
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    roc = F.when((p > 0) & (n > 0), F.col("_u") / (p * n))
    ap = F.when(p > 0, F.when(n == 0, F.lit(1.0)).otherwise(F.col("_ap") / p))
    return sums.select(*by, "positives", "negatives", roc.alias("roc_auc"), ap.alias("pr_auc"))


def select_threshold(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score",
                     target_fpr: float = 0.001, tie: str = "higher") -> DataFrame:
    """Operating threshold per group under a cap on the false-positive rate.

    Candidates are the scores, 0.5, 1.0, just above the largest score, and 0.0 with ``tie="higher"``.
    Among candidates within the cap: most recall, then (``higher``) least false positives and the
    higher threshold, or (``lower``) the lower threshold.  If none is within it: least false positives,
    most recall, same tie rule.  A group without negatives gets 0.5 and ``feasible``; with no groups an
    empty input gives 0.5 and not ``feasible``.
    """
    if tie not in ("higher", "lower"):
        raise ValueError("tie must be 'higher' or 'lower'")
    by = list(by)
    counts = score_counts(df, by, label, score)
    marks = [F.lit(0.5), F.lit(1.0), F.max("score") + 1e-6] + ([F.lit(0.0)] if tie == "higher" else [])
    fixed = (counts.groupBy(*by).agg(F.array_distinct(F.array(*marks)).alias("_m"))
             .select(*by, F.explode(F.array_compact("_m")).alias("score"), F.lit(0).cast("long").alias("pos"),
                     F.lit(0).cast("long").alias("neg")))
    merged = counts.unionByName(fixed).groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranked = _cumulative(merged, by, descending=True)
    n_pos, n_neg = F.col("pos_upto_total"), F.col("neg_upto_total")
    fpr = _ratio(F.col("neg_upto"), n_neg)
    tpr = _ratio(F.col("pos_upto"), n_pos)
    tau = F.col("score")
    side = tau if tie == "higher" else -tau
    feasible = fpr <= target_fpr + SLACK
    inner = F.struct(tpr, -fpr, side) if tie == "higher" else F.struct(tpr, side, -fpr)
    keyed = ranked.withColumns({"_tau": tau, "_fpr": fpr, "_ok": feasible, "_good": inner,
                                "_least": F.struct(-fpr, tpr, side)})
    pick = F.struct("_tau", "_fpr")
    best = keyed.groupBy(*by).agg(
        F.max_by(F.when(F.col("_ok"), pick), F.when(F.col("_ok"), F.col("_good"))).alias("_a"),
        F.max_by(pick, F.col("_least")).alias("_b"), F.max(n_neg).alias("_n"),
        F.max(n_pos + n_neg).alias("_rows"))
    chosen = F.coalesce("_a", "_b")
    none = F.col("_n") == 0
    return best.select(
        *by, F.when(none, F.lit(0.5)).otherwise(chosen["_tau"]).alias("threshold"),
        F.when(none, F.lit(0.0)).otherwise(chosen["_fpr"]).alias("fpr"),
        F.when(F.col("_rows") == 0, F.lit(False)).when(none, F.lit(True))
        .otherwise(F.col("_a").isNotNull()).alias("feasible"))


def apply_threshold(df: DataFrame, thresholds: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """``prediction`` = score >= threshold of the row's group (one short row per group)."""
    if by:
        out = df.join(thresholds.select(*by, "threshold"), list(by), "left")
    else:
        out = df.withColumn("threshold", thresholds.select("threshold").scalar())
    return out.withColumn("prediction", F.when(F.col(score) >= F.col("threshold"), 1).otherwise(0))


def label_metrics(df: DataFrame, positive: str, negative: str, truth: str = "truth", pred: str = "predicted",
                  delay: str = "delay_s", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, rates and delay statistics for text labels, rounded to four places.

    Rows whose true label is neither name count nowhere in the confusion counts.
    """
    from packetloom.operators.delay import summary_columns
    y = F.when(F.col(truth) == positive, 1).when(F.col(truth) == negative, 0)
    coded = df.withColumns({"_y": y, "_p": F.when(F.col(pred) == positive, 1).otherwise(0)})
    counts = binary_metrics(confusion(coded, by, "_y", "_p"))
    keys = list(by) or ["_all"]
    stats = summary_columns(coded.withColumn("_all", F.lit(0)), delay, keys)
    counts = counts if by else counts.withColumn("_all", F.lit(0))
    joined = counts.join(stats, keys)
    round4 = lambda c, name: F.bround(F.col(c), 4).alias(name)
    return joined.select(
        *by, "tp", "fp", "tn", "fn", F.col("total").alias("total_evaluated"),
        *[round4(c, c) for c in ("accuracy", "precision", "recall")], round4("f1", "f1_score"),
        round4("fpr", "false_positive_rate"),
        *[round4(f"{s}_seconds", f"{s}_segment_duration") for s in ("mean", "median", "min", "max")])


def error_breakdown(df: DataFrame, by: Sequence[str], label: str = "label", pred: str = "prediction") -> DataFrame:
    """Hits, false alarms, misses and right rejections per group, as columns."""
    return confusion(df, by, label, pred).select(
        *by, F.col("fp").alias("false_positives"), F.col("fn").alias("misses"),
        F.col("tp").alias("hits"), F.col("tn").alias("rejections"))


def confusion_table(df: DataFrame, by: Sequence[str], label: str = "label", pred: str = "prediction") -> DataFrame:
    """Two rows per group, one per true class, with a column per predicted class."""
    counts = confusion(df, by, label, pred)
    rows = F.array(F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_0"), F.col("fp").alias("predicted_1")),
                   F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_0"), F.col("tp").alias("predicted_1")))
    return counts.select(*by, F.inline(rows))
