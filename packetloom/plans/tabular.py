"""A ready flow-statistics table to metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.names import find_label
from packetloom.operators import labels as A
from packetloom.operators import models as M
from packetloom.operators import splits as S
from packetloom.operators import tabular as T
from packetloom.operators.ordered import materialize


def prepare(df: DataFrame, task: str, label: str | None = None, ident: str | None = None) -> tuple[DataFrame, list[str]]:
    """Labelled, numeric, complete rows with a ``sample_id``, and the feature names.

    Label names the task does not know are an error.  Without an ``ident`` column rows are numbered and
    written once, so that later steps agree on the numbers; pass one to get the same split on every run.
    """
    df = T.trim_names(df)
    label = find_label(df.columns, label)
    unknown = [r.label for r in A.unknown_labels(df, label, task).orderBy("label").limit(20).collect()]
    if unknown:
        raise ValueError(f"labels not known to task {task}: {unknown}")
    rows = A.map_labels(df, label, task)
    keep = ["target"] + ([ident] if ident else [])
    clean, names = T.clean_features(rows, label, keep)
    clean = T.as_float32(T.drop_incomplete(clean, names), names)
    if ident:
        return clean.select(F.col(ident).alias("sample_id"), "target", *names), names
    numbered = clean.withColumn("sample_id", F.monotonically_increasing_id().cast("string"))
    return materialize(numbered.select("sample_id", "target", *names)), names


def run(df: DataFrame, task: str, label: str | None = None, ident: str | None = None, models: list[str] = M.MODELS,
        per_class: int | None = None, seed: int = 42, target_fpr: float = 0.001, ablation: bool = False,
        settings: dict | None = None) -> dict[str, DataFrame]:
    """Metrics per model (60/20/20, calibrated threshold), class counts, and the group ablation if asked."""
    rows, names = prepare(df, task, label, ident)
    rows = rows if ident is None else materialize(rows)
    A.require_classes(rows, "target", 2, 5)
    if per_class is not None:
        rows = A.sample_per_class(rows, "target", "sample_id", per_class, seed)
    parts = materialize(S.split_nested(rows, "target", "sample_id", seed))
    part = lambda name: parts.filter(F.col("split") == name)
    out = {"metrics": M.compare_models(part("train"), part("test"), names, models, part("val"), seed=seed,
                                       target_fpr=target_fpr, settings=settings),
           "classes": parts.groupBy("split", "target").count()}
    if ablation:
        first = models[0]
        out["ablation"] = M.group_ablation(part("train"), part("test"), names, first, seed=seed,
                                           **(settings or {}).get(first, {}))
    return out
