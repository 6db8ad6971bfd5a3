"""Classifiers, their scores, feature importance and ablations, on Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.names import FEATURE_GROUPS, feature_group
from packetloom.functions.scaling import PADDING
from packetloom.operators.bayes import GaussianBayes
from packetloom.operators.calibrate import logistic_apply, logistic_fit
from packetloom.operators.forest import Forest, rules_for
from packetloom.operators.metrics import (apply_threshold, averaged_metrics, binary_metrics, confusion,
                                          ranking_metrics, select_threshold)
from packetloom.operators.ordered import materialize
from packetloom.operators.tabular import vector_stages
from packetloom.session import ensure_checkpoint_dir

# The names of the compared models.
MODELS = ["random_forest", "decision_tree", "gaussian_nb", "linear_svm", "hist_gradient_boosting"]


# The deepest tree Spark can grow; the compared trees have no limit.
DEEPEST = 30
# Penalty of the linear model, as the weight of the summed loss.
SVM_C = 1.0
# Rows of a task while the linear model is fitted: a step over fewer costs less than starting another task for it.
SVM_ROWS_PER_TASK = 400_000
# Rows times trees up to which Spark ML grows trees, all of whose nodes the driver holds; of more it holds the tops only.
TREE_ROWS = 2_000_000


def tree_settings(name: str, seed: int, settings: dict) -> dict:
    # The settings of the compared models.
    fixed = {"random_forest": {"numTrees": 100, "impurity": "gini", "maxDepth": DEEPEST, "seed": seed, "cacheNodeIds": True},
             "decision_tree": {"impurity": "entropy", "maxDepth": DEEPEST, "seed": seed}}
    return fixed[name] | settings


def classifier(name: str, seed: int = 42, label: str = "target", **settings):
    """An unfitted classifier of Spark ML by name."""
    common = {"featuresCol": "features", "labelCol": label}
    makers = {
        "random_forest": lambda: RandomForestClassifier(**tree_settings(name, seed, settings), **common),
        "decision_tree": lambda: DecisionTreeClassifier(**tree_settings(name, seed, settings), **common),
        "linear_svm": lambda: LinearSVC(**({"maxIter": 2_000} | settings), **common),
        "hist_gradient_boosting": lambda: GBTClassifier(
            **({"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "seed": seed} | settings), **common),
    }
    if name not in makers:
        raise ValueError(f"unknown model {name!r}; expected one of {sorted(makers)}")
    return makers[name]()


def fit_tabular(train: DataFrame, names: list[str], model: str, label: str = "target", seed: int = 42,
                **settings) -> PipelineModel | GaussianBayes | Forest:
    """Vector assembly (scaled for the linear model) and the classifier, fitted on ``train``.

    A forest keeps the node each row has reached in every tree, so that a pass does not walk down from the roots; what
    is kept is cut from its lineage in ``spark.checkpoint.dir``.  Trees of two classes 0 and 1 over more than TREE_ROWS rows
    (times trees) are a ``Forest``, most of which is a written table.  The linear model takes hundreds of short passes; rows
    are put into few partitions for them.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; expected one of {MODELS}")
    if model == "gaussian_nb":
        return GaussianBayes.fit(train, names, label, **settings)
    stages = vector_stages(names, scaled=model == "linear_svm")
    typed = train.withColumn(label, F.col(label).cast("double"))
    ensure_checkpoint_dir(train.sparkSession)
    if model in ("random_forest", "decision_tree"):
        rules = rules_for(model, len(names), seed, tree_settings(model, seed, settings))
        two = F.coalesce(F.col(label).cast("double").isin(0.0, 1.0), F.lit(False))
        seen = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(two).alias("two")).first()
        if rules and seen.n * rules.trees > TREE_ROWS and seen.n == seen.two:
            return Forest.fit(train, names, label, rules)
    if model == "linear_svm":
        n = max(1, train.count())
        settings = {"regParam": 1.0 / (SVM_C * n)} | settings
        typed = typed.coalesce(-(-n // SVM_ROWS_PER_TASK))
    return Pipeline(stages=[*stages, classifier(model, seed, label, **settings)]).fit(typed)


def score_rows(model, df: DataFrame) -> DataFrame:
    """``prediction`` and ``score``: class-1 probability, else the decision value, else null."""
    out = model.transform(df)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    elif "rawPrediction" in out.columns:
        score = vector_to_array("rawPrediction")[1]
    else:
        score = F.lit(None).cast("double")
    extra = [c for c in ("features", "_vector", "rawPrediction", "probability", "_array") if c in out.columns
             and c not in df.columns]
    return out.withColumns({"score": score, "prediction": F.col("prediction").cast("int")}).drop(*extra)


def settle(rows: DataFrame) -> DataFrame:
    """Scores or metric rows as a written table, so that what follows does not score again."""
    return materialize(rows)


def evaluate(scored: DataFrame, label: str = "target", by: list[str] = ()) -> DataFrame:
    """All metrics of scored rows in one row per group."""
    keys = list(by) or ["_all"]
    rows = scored if by else scored.withColumn("_all", F.lit(0))
    parts = [binary_metrics(confusion(rows, keys, label)), averaged_metrics(rows, keys, label),
             ranking_metrics(rows, keys, label).drop("positives", "negatives")]
    out = reduce(lambda a, b: a.join(b, keys, "left"), parts)
    return out if by else out.drop("_all")


def calibrated_rows(val: DataFrame, test: DataFrame, label: str = "target", target_fpr: float = 0.001,
                    tie: str = "lower") -> tuple[DataFrame, DataFrame]:
    """Scores calibrated on validation, the threshold chosen there, and test predictions under it."""
    fitted = logistic_fit(val, label)
    threshold = settle(select_threshold(logistic_apply(fitted, val), [], label, "calibrated", target_fpr, tie))
    return threshold, apply_threshold(logistic_apply(fitted, test), threshold, score="calibrated")


def compare_models(train: DataFrame, test: DataFrame, names: list[str], models: list[str] = MODELS,
                   val: DataFrame | None = None, label: str = "target", seed: int = 42,
                   target_fpr: float = 0.001, settings: dict | None = None) -> DataFrame:
    """One metric row per model; with ``val`` also its calibrated threshold and the metrics under it."""
    rows = []
    for model in models:
        fitted = fit_tabular(train, names, model, label, seed, **(settings or {}).get(model, {}))
        scored = score_rows(fitted, test).select(label, "prediction", "score").persist()
        row = evaluate(scored, label).withColumn("model", F.lit(model))
        if val is not None:
            on_val = settle(score_rows(fitted, val).select(label, "prediction", "score"))
            threshold, tuned = calibrated_rows(on_val, scored, label, target_fpr)
            after = evaluate(tuned.select(label, "prediction", F.col("calibrated").alias("score")), label)
            row = row.join(F.broadcast(settle(threshold).select(
                F.lit(model).alias("model"), F.col("threshold").alias("selected_threshold"))), "model")
            row = row.join(F.broadcast(settle(after).select(
                F.lit(model).alias("model"), F.col("f1_macro").alias("calibrated_macro_f1"),
                F.col("fpr").alias("calibrated_test_fpr"), F.col("recall").alias("calibrated_recall"))), "model")
        rows.append(settle(row))
        scored.unpersist()
    return reduce(DataFrame.unionByName, rows)


def feature_importance(spark: SparkSession, model: PipelineModel | Forest, names: list[str]) -> DataFrame:
    """Importance per feature of a fitted tree model, most important first."""
    values = model.importances() if isinstance(model, Forest) else model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]  # one row per column
    return (spark.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.desc("importance"), "feature"))


def group_of(spark: SparkSession, names: list[str]) -> dict[str, str | None]:
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", feature_group(F.col("name")))
    return {r[0]: r[1] for r in rows.collect()}


def group_ablation(train: DataFrame, test: DataFrame, names: list[str], model: str = "random_forest",
                   label: str = "target", seed: int = 42, **settings) -> DataFrame:
    """Refit without each feature group; a group that has no column keeps its name and the full result."""
    groups = group_of(train.sparkSession, names)

    def run(kept: list[str], removed: str) -> DataFrame:
        fitted = fit_tabular(train, kept, model, label, seed, **settings)
        scored = settle(score_rows(fitted, test).select(label, "prediction", "score"))  # metrics read it several times
        return settle(evaluate(scored, label)).withColumns(
            {"removed_group": F.lit(removed), "features_left": F.lit(len(kept))})

    rows = [run(names, "none")]
    for group in FEATURE_GROUPS:
        kept = [n for n in names if groups[n] != group]
        if not kept:
            continue
        rows.append(run(kept, group) if len(kept) < len(names)
                    else rows[0].withColumn("removed_group", F.lit(group)))
    return reduce(DataFrame.unionByName, rows)


# --- windows ------------------------------------------------------------------------------------

def flat_windows(samples: DataFrame, drop_field: int | None = None) -> DataFrame:
    """Windows as one vector per row: all steps, with padding steps at zero, and per-field means over
    the real steps.  ``drop_field`` zeroes one of the five numbers (field ablation)."""
    fields = len(PADDING)
    real = F.aggregate("mask", F.lit(0.0), lambda a, m: a + m)
    step = F.zip_with("features", "mask", lambda f, m: F.transform(
        f, lambda x, i: F.when((m == 0) | (i == (-1 if drop_field is None else drop_field)), F.lit(0.0)).otherwise(x)))
    out = samples.withColumn("_steps", step)

    def mean_of(i: int):
        return F.aggregate("_steps", F.lit(0.0), lambda a, s: a + s[i]) / F.greatest(real, F.lit(1.0))

    means = [mean_of(i) for i in range(fields)]
    return out.withColumn("features", array_to_vector(F.concat(F.flatten("_steps"), F.array(*means)))).drop("_steps")


def fit_windows(samples: DataFrame, length: int, kind: str = "perceptron", label: str = "label",
                seed: int = 42, max_iter: int = 100, drop_field: int | None = None,
                weight: str | None = None):
    """A classifier of windows: a small feed-forward net, or logistic regression with row weights."""
    rows = flat_windows(samples, drop_field).withColumn(label, F.col(label).cast("double"))
    if kind == "perceptron":
        net = [5 * length + 5, 6 * length, 2 * length, 2]
        return MultilayerPerceptronClassifier(layers=net, labelCol=label, seed=seed, maxIter=max_iter).fit(rows)
    if kind == "logistic":
        extra = {"weightCol": weight} if weight else {}
        return LogisticRegression(labelCol=label, maxIter=max_iter, **extra).fit(rows)
    raise ValueError(f"unknown window classifier {kind!r}")


def score_windows(model, samples: DataFrame, drop_field: int | None = None) -> DataFrame:
    """Batch scores of windows; the feature arrays are not carried along."""
    keep = [c for c in samples.columns if c not in ("features", "mask")]
    flat = flat_windows(samples, drop_field)
    return score_rows(model, flat).select(*keep, "prediction", "score")


def training_history(spark: SparkSession, model) -> DataFrame:
    """Loss per training iteration."""
    history = model.summary().objectiveHistory if callable(model.summary) else model.summary.objectiveHistory
    return spark.createDataFrame(list(enumerate(float(x) for x in history)), "iteration int, loss double")


def field_ablation(train: DataFrame, test: DataFrame, length: int, label: str = "label", **options) -> DataFrame:
    """Metrics of the window classifier with each of the five clump numbers zeroed in turn."""
    from packetloom.schema import VECTOR_FIELDS
    rows = []
    for i, name in [(None, "none"), *enumerate(VECTOR_FIELDS)]:
        fitted = fit_windows(train, length, label=label, drop_field=i, **options)
        scored = settle(score_windows(fitted, test, i).select(label, "prediction", "score"))
        rows.append(settle(evaluate(scored, label)).withColumn("removed_field", F.lit(name)))
    return reduce(DataFrame.unionByName, rows)
