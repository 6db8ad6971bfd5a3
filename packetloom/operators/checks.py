"""Data-quality rules over metric and delay tables: one row out per broken rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of tasks, fields, models, splits and statistics in the files that are checked.
TASKS = ["l1", "l2"]
SEQUENCE_TASKS = ["l1", "l2", "both", "layer1_doh_vs_nondoh", "layer2_benign_vs_malicious"]
EVIDENCE_METRICS = ["default_macro_f1", "f1_macro", "default_positive_f1", "f1_positive_class", "accuracy",
                    "roc_auc", "pr_auc"]
EVIDENCE_RATES = ["default_macro_f1", "f1_macro", "default_fpr", "false_positive_rate", "roc_auc", "pr_auc"]
SEQUENCE_RATES = ["precision", "recall", "f1_score", "f1", "fpr", "roc_auc", "pr_auc", "accuracy"]
DELAY_MODELS = ["paper_v4", "improved_bidi_gru"]
DELAY_SPLITS = ["session_scenario_disjoint", "paper_flow_random", "paper_flow_random_80_20"]
DELAY_PARTS = ["traffic_collection_delay", "preprocessing_latency", "inference_latency", "end_to_end_latency"]
DELAY_STATS = ["mean", "median", "p50", "p95", "p99", "min", "max", "std"]


def check(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Keys and name of every rule that a row breaks; a rule that comes out null is broken."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def _in_range(column: str) -> Column:
    return F.col(column).isNull() | F.col(column).between(0.0, 1.0001)


def _version() -> Column:
    return F.col("manifest_version").startswith("1.")


def check_evidence(df: DataFrame, keys: list[str]) -> DataFrame:
    """Tabular evidence, one row per model: version 1.x, a known task, a known metric, rates in 0..1."""
    known = [F.col(c).isNotNull() for c in EVIDENCE_METRICS if c in df.columns]
    rules = {"manifest_version": _version(), "task": F.col("task").isin(TASKS),
             "known_metric": reduce(lambda a, b: a | b, known, F.lit(False))}
    rules |= {f"range_{c}": _in_range(c) for c in EVIDENCE_RATES if c in df.columns}
    return check(df, keys, rules)


def check_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sequence runs: version 1.x, a known task, a length from 1 to 10, rates in 0..1."""
    rules = {"manifest_version": _version(), "task": F.col("task").isin(SEQUENCE_TASKS),
             "window_size": F.col("window_size").between(1, 10)}
    rules |= {f"range_{c}": _in_range(c) for c in SEQUENCE_RATES if c in df.columns}
    return check(df, keys, rules)


def _said(column: str) -> Column:
    return F.length(F.trim(column)) > 0


def check_delays(df: DataFrame, keys: list[str]) -> DataFrame:
    """Delay benchmarks: names, counts, finite statistics in order, a positive throughput.

    Each component is a struct with ``count`` and the statistics in seconds and ms.
    """
    rules = {
        "manifest_version": _version(), "generated_at_utc": _said("generated_at_utc"),
        "claim_boundary": _said("claim_boundary"),
        "task": F.col("task").isin(TASKS), "model": F.col("model").isin(DELAY_MODELS),
        "window_size": F.col("window_size").between(1, 10), "split_protocol": F.col("split_protocol").isin(DELAY_SPLITS),
        "sample_count": F.col("sample_count") > 0, "batch_size": F.col("batch_size") == 1,
        "device": _said("device"), "device_name": _said("device_name"),
        "warmup_iterations": F.col("warmup_iterations").isNull() | (F.col("warmup_iterations") >= 0),
        "throughput": _finite(F.col("inference_latency")["throughput_samples_per_second"])
        & (F.col("inference_latency")["throughput_samples_per_second"] > 0),
    }
    for part in DELAY_PARTS:
        s = F.col(part)
        rules[f"count_{part}"] = s["count"] == F.col("sample_count")
        cells = [s[f"{stat}_{unit}"] for unit in ("seconds", "ms") for stat in DELAY_STATS]
        rules[f"finite_{part}"] = F.forall(F.array(*cells), lambda x: _finite(x) & (x >= 0))
        rules[f"order_{part}"] = reduce(lambda a, b: a & b, [_ascending(s, unit) for unit in ("seconds", "ms")])
    rows = df.withColumn("_rows", df.agg(F.count(F.lit(1)).alias("n")).scalar())
    rules["total_benchmarks"] = F.col("total_benchmarks") == F.col("_rows")
    return check(rows, keys, rules)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _ascending(s: Column, unit: str) -> Column:
    """min <= p50 <= p95 <= p99 <= max, each step allowed 1e-9 more."""
    steps = [s[f"{stat}_{unit}"] + i * 1e-9 for i, stat in enumerate(("min", "p50", "p95", "p99", "max"))]
    return reduce(lambda a, b: a & b, [low <= high for low, high in zip(steps, steps[1:])])


def require_clean(faults: DataFrame, what: str) -> None:
    """Raise with a few examples if a check found anything."""
    found = [r.asDict() for r in faults.limit(5).collect()]
    if found:
        raise ValueError(f"{what} breaks its rules: {found}")
