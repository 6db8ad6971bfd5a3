"""Comparison tables over run metrics.

``runs`` has one row per run: run_no (input order), task, model, split_protocol, window_size and metric
columns.  ``baseline`` is a relation of published figures that the caller brings: paradigm, task, model,
window_size, split_protocol, precision, recall, f1_score, fpr, mean_s, median_s.  A figure that is not
known is null, never 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of protocols, models and the order of models in tables.
RANDOM_SPLIT, DISJOINT_SPLIT = "paper_flow_random", "session_scenario_disjoint"
BASE_MODEL, BETTER_MODEL = "paper_v4", "improved_bidi_gru"
TABULAR_MODELS = ["random_forest", "hist_gradient_boosting", "decision_tree", "linear_svm", "gaussian_nb"]
BEST_LENGTH = {"l1": 6, "l2": 3}
TABLE_COLUMNS = ["task", "window_size", "model", "origin", "split_protocol", "precision", "recall", "f1_score",
                 "fpr", "mean_s", "median_s", "status"]


def metric(runs: DataFrame, name: str) -> Column:
    """A metric by name, then by its alias, then inside ``metrics``; 0.0 is a value, null is not."""
    names = [name] + (["f1"] if name == "f1_score" else [])
    found = [F.col(n) for n in names if n in runs.columns]
    if "metrics" in runs.columns:
        inner = runs.schema["metrics"].dataType.names
        found += [F.col("metrics")[n] for n in names if n in inner]
    return F.coalesce(*found).cast("double") if found else F.lit(None).cast("double")


def matching(runs: DataFrame, **wanted) -> DataFrame:
    """Runs equal to every given value (None matches all)."""
    hit = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted.items() if v is not None], F.lit(True))
    return runs.filter(hit)


def find_run(runs: DataFrame, **wanted) -> DataFrame:
    """The first matching run in input order (no row if none matches)."""
    return matching(runs, **wanted).orderBy("run_no").limit(1)


def runs_by_length(runs: DataFrame, **wanted) -> DataFrame:
    """One run per window length; the last match wins."""
    rows = matching(runs, **wanted).filter(F.col("window_size").isNotNull())
    best = rows.groupBy("window_size").agg(F.max_by(F.struct(*rows.columns), "run_no").alias("_r"))
    return best.select("_r.*")


def _with_origin(runs: DataFrame) -> DataFrame:
    improved = F.lower("model").contains("improved")
    disjoint = F.lower(F.coalesce("split_protocol", F.lit(RANDOM_SPLIT))).contains("disjoint")
    origin = (F.when(improved, "project_improved").when(disjoint, "project_disjoint")
              .otherwise("project_random"))
    return runs.withColumn("origin", origin)


def _as_table(rows: DataFrame, status: str) -> DataFrame:
    names = {"precision", "recall", "f1_score", "fpr"}
    cells = []
    for c in TABLE_COLUMNS:
        if c in names:
            cells.append(metric(rows, c).alias(c))
        elif c == "status":
            cells.append(F.lit(status).alias(c))
        elif c in rows.columns:
            cells.append(F.col(c))
        else:
            cells.append(F.lit(None).cast("double" if c.endswith("_s") else "string").alias(c))
    return rows.select(*cells)


def sweep_table(baseline: DataFrame, runs: DataFrame) -> DataFrame:
    """Published rows per task and length, each beside the project run of that length.

    Runs are taken from the base model under the random split, then under the disjoint split, then the
    base model under any split; other models count only for a task without base-model runs.  Within a
    level the last run wins.  A length without a run stays as an ``unavailable`` row.
    """
    base = F.col("model") == BASE_MODEL
    level = (F.when(base & (F.col("split_protocol") == RANDOM_SPLIT), 1)
             .when(base & (F.col("split_protocol") == DISJOINT_SPLIT), 2).when(base, 3).otherwise(4))
    ranked = runs.withColumn("_level", level)
    have_base = ranked.filter(base).select("task").distinct().withColumn("_base", F.lit(True))
    ranked = ranked.join(have_base, "task", "left").filter((F.col("_level") < 4) | F.col("_base").isNull())
    row = F.struct(*runs.columns)
    chosen = ranked.groupBy("task", "window_size").agg(
        F.max_by(row, F.struct(-F.col("_level"), F.col("run_no"))).alias("_r")).select("_r.*")
    wanted = baseline.filter("paradigm = 'sequence'")
    published = _as_table(wanted.withColumn("origin", F.lit("published")), "published")
    slots = wanted.select("task", "window_size").distinct()
    done = _as_table(_with_origin(chosen).join(slots, ["task", "window_size"], "left_semi"), "completed")
    empty = slots.join(chosen, ["task", "window_size"], "left_anti").withColumns(
        {"origin": F.lit("unavailable"), "split_protocol": F.lit(DISJOINT_SPLIT)})
    return published.unionByName(done).unionByName(_as_table(empty, "unavailable"))


def _tabular_rows(evidence: DataFrame) -> DataFrame:
    """Tabular evidence (one row per task and model) in table form."""
    have = set(evidence.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None)).cast("double")
    return evidence.filter(F.col("model").isin(TABULAR_MODELS)).select(
        "task", F.lit(None).cast("int").alias("window_size"), "model",
        F.lit("project_statistical").alias("origin"), F.lit(RANDOM_SPLIT).alias("split_protocol"),
        pick("precision_macro", "precision_positive_class").alias("precision"),
        pick("recall_macro", "recall_positive_class").alias("recall"),
        pick("default_macro_f1", "f1_macro").alias("f1_score"),
        pick("default_fpr", "false_positive_rate").alias("fpr"),
        (pick("inference_latency_per_sample_ms") / 1000.0).alias("median_s"))


def statistical_table(baseline: DataFrame, evidence: DataFrame) -> DataFrame:
    """Published flow-statistics rows, project rows, and a calibrated row where both its figures exist."""
    published = _as_table(baseline.filter("paradigm = 'statistical'").withColumn("origin", F.lit("published")),
                          "published")
    rows = _as_table(_tabular_rows(evidence), "completed")
    tuned = evidence.filter(F.col("model").isin(TABULAR_MODELS) & F.col("calibrated_macro_f1").isNotNull()
                            & F.col("calibrated_test_fpr").isNotNull())
    tuned = tuned.select(
        "task", F.lit(None).cast("int").alias("window_size"), "model",
        F.lit("project_calibrated").alias("origin"), F.lit(RANDOM_SPLIT).alias("split_protocol"),
        F.col("calibrated_macro_f1").alias("f1_score"), F.col("calibrated_test_fpr").alias("fpr"))
    tasks = baseline.select("task").distinct()
    absent = tasks.join(evidence.select("task").distinct(), "task", "left_anti").select(
        "task", F.lit(None).cast("int").alias("window_size"), F.lit("tabular").alias("model"),
        F.lit("unavailable").alias("origin"), F.lit(RANDOM_SPLIT).alias("split_protocol"))
    parts = [published, rows, _as_table(tuned, "completed"), _as_table(absent, "unavailable")]
    return reduce(DataFrame.unionByName, parts)


def _first_per_task(runs: DataFrame, prefer_model: str | None = None) -> DataFrame:
    """The first run per task at its best length; the preferred model goes before any other."""
    length = F.lit(None).cast("int")
    for task, n in BEST_LENGTH.items():
        length = F.when(F.col("task") == task, n).otherwise(length)
    rows = runs.filter(F.col("window_size") == length)
    order = F.struct(F.when(F.col("model") == prefer_model, 0).otherwise(1) if prefer_model else F.lit(0), "run_no")
    first = rows.groupBy("task").agg(F.min_by(F.struct(*runs.columns), order).alias("_r"))
    return first.select("_r.*")


def head_to_head_table(baseline: DataFrame, runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Published best figures against project figures: random forest, and the sequence model at l=6 / l=3."""
    length = F.lit(None).cast("int")
    for task, n in BEST_LENGTH.items():
        length = F.when(F.col("task") == task, n).otherwise(length)
    best = baseline.filter((F.col("paradigm") == "statistical") & (F.col("model") == "random_forest")
                           | (F.col("paradigm") == "sequence") & (F.col("window_size") == length))
    published = _as_table(best.withColumn("origin", F.lit("published")), "published")
    forest = _as_table(_tabular_rows(evidence.filter(F.col("model") == "random_forest")), "completed")
    sequence = _as_table(_with_origin(_first_per_task(runs, BASE_MODEL)), "completed")
    done = forest.unionByName(sequence)
    slots = best.select("task", F.col("paradigm")).distinct()
    have = done.select("task", F.when(F.col("window_size").isNull(), "statistical").otherwise("sequence")
                       .alias("paradigm"))
    absent = slots.join(have, ["task", "paradigm"], "left_anti").select(
        "task", F.lit(None).cast("int").alias("window_size"), F.col("paradigm").alias("model"),
        F.lit("unavailable").alias("origin"), F.lit(DISJOINT_SPLIT).alias("split_protocol"))
    return published.unionByName(done).unionByName(_as_table(absent, "unavailable"))


def split_impact_table(runs: DataFrame) -> DataFrame:
    """Per task at its best length: each metric under the random and the disjoint split, and the change."""
    parts = []
    for short, protocol in (("random", RANDOM_SPLIT), ("disjoint", DISJOINT_SPLIT)):
        rows = _first_per_task(matching(runs, split_protocol=protocol))
        names = ["precision", "recall", "f1_score", "fpr"]
        parts.append(rows.select("task", *[metric(rows, m).alias(f"{m}_{short}") for m in names]))
    wide = parts[0].join(parts[1], "task", "full")
    return wide.withColumns({f"{m}_change": F.col(f"{m}_disjoint") - F.col(f"{m}_random")
                             for m in ("precision", "recall", "f1_score", "fpr")})


# component, whether its delay can be set against the flow's own length
DELAY_PARTS = [("traffic_collection_delay", "collection", True), ("preprocessing_latency", "prep", False),
               ("inference_latency", "infer", False), ("end_to_end_latency", "e2e", True)]


def delay_tradeoff_table(benchmarks: DataFrame, runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Four component rows per session-disjoint benchmark with the cut in delay against whole flows.

    ``benchmarks`` has task, model, window_size, split_protocol, sample_count and mean/median seconds of
    each component (``collection_mean_s``, ...).  The cut is 1 - delay / baseline, never below 0, for
    collection and end-to-end delay only.
    """
    whole = (baseline.filter((F.col("paradigm") == "statistical") & (F.col("model") == "random_forest"))
             .select("task", F.col("mean_s").alias("_whole")))
    rows = benchmarks.filter(F.col("split_protocol") == DISJOINT_SPLIT)
    first = matching(runs, split_protocol=DISJOINT_SPLIT).groupBy("task", "model", "window_size").agg(
        F.min_by(metric(runs, "f1_score"), "run_no").alias("f1_score"))
    cells = [F.struct(F.lit(i).alias("part_no"), F.lit(name).alias("component"),
                      F.col(f"{short}_mean_s").alias("mean_s"), F.col(f"{short}_median_s").alias("median_s"),
                      F.lit(compared).alias("_compared"))
             for i, (name, short, compared) in enumerate(DELAY_PARTS)]
    long = rows.select("task", "model", "window_size", "sample_count", F.inline(F.array(*cells)))
    cut = F.when(F.col("_compared") & (F.col("mean_s") > 0),
                 F.greatest(F.lit(0.0), 1.0 - F.col("mean_s") / F.col("_whole")))
    return (long.join(first, ["task", "model", "window_size"], "left").join(whole, "task", "left")
            .select("task", "window_size", "model", "part_no", "component", "sample_count", "f1_score",
                    "mean_s", "median_s", cut.alias("reduction"))
            .orderBy("task", "window_size", "model", "part_no"))


def best_f1_change(runs: DataFrame) -> DataFrame:
    """Best disjoint-split F1 of both models per task, the change, and a verdict over all tasks."""
    rows = matching(runs, split_protocol=DISJOINT_SPLIT)
    best = (rows.withColumn("_f1", metric(rows, "f1_score")).groupBy("task")
            .pivot("model", [BASE_MODEL, BETTER_MODEL]).agg(F.max("_f1")))
    best = best.filter(F.col(BASE_MODEL).isNotNull() & F.col(BETTER_MODEL).isNotNull())
    best = best.withColumn("change", F.col(BETTER_MODEL) - F.col(BASE_MODEL))
    sure = best.agg((F.coalesce(F.bool_and(F.col("change") > 0), F.lit(False))
                     & (F.count(F.lit(1)) == 2)).alias("v")).scalar()
    verdict = F.when(sure, "verified improvement").otherwise("mixed observed result")
    return best.select("task", F.col(BASE_MODEL).alias("base_f1"), F.col(BETTER_MODEL).alias("better_f1"),
                       "change", verdict.alias("verdict"))


def all_tables(baseline: DataFrame, runs: DataFrame, evidence: DataFrame,
               benchmarks: DataFrame) -> dict[str, DataFrame]:
    """Every comparison table by name."""
    return {"statistical": statistical_table(baseline, evidence), "window_sweep": sweep_table(baseline, runs),
            "head_to_head": head_to_head_table(baseline, runs, evidence),
            "split_impact": split_impact_table(runs),
            "delay_tradeoff": delay_tradeoff_table(benchmarks, runs, baseline),
            "best_f1_change": best_f1_change(runs)}
