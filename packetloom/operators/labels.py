"""Flow labels, quotas, caps, samples and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.names import L1_NAMES, clean_label, label_number
from packetloom.operators.ordered import class_counts, first_n, hash_cut, one_row


def label_flows(flows: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """Add ``l1_label`` (resolver match) and ``l2_label`` (tunnel or not; null when unknown).

    ``flows`` has ``is_doh``.  With ``captures`` (source_id, category, is_malicious) the capture decides
    l2; a flow without a capture row falls back to the start of its ``scenario_id``.
    """
    l1 = F.when(F.col("is_doh"), 1).otherwise(0)
    scenario = F.col("scenario_id")
    by_scenario = F.when(scenario.startswith("malicious"), 1).when(scenario.startswith("benign"), 0)
    if captures is None:
        return flows.withColumns({"l1_label": l1, "l2_label": F.when(l1 == 1, by_scenario)})
    sides = captures.select("source_id", F.col("category").alias("_cat"), F.col("is_malicious").alias("_bad"),
                            F.lit(True).alias("_known"))
    by_capture = (F.when(F.coalesce("_bad", F.lit(False)) | (F.col("_cat") == "malicious_doh"), 1)
                  .when(F.col("_cat") == "benign_doh", 0))
    l2 = F.when(F.col("_known"), by_capture).otherwise(by_scenario)
    return (flows.join(sides, "source_id", "left")
            .withColumns({"l1_label": l1, "l2_label": F.when(l1 == 1, l2)}).drop("_cat", "_bad", "_known"))


def flow_class() -> Column:
    """non_doh, malicious_doh or benign_doh; a DoH flow of unknown kind counts as benign."""
    return (F.when(F.col("l1_label") == 0, F.lit("non_doh"))
            .when(F.col("l2_label") == 1, F.lit("malicious_doh")).otherwise(F.lit("benign_doh")))


def cap_flows_per_capture(flows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """At most n flows per capture, first in ``order``."""
    return first_n(flows, ["source_id"], order, n, few_groups=True)


def cap_flows_per_class(flows: DataFrame, n: int, order: list[str], task: str = "both") -> DataFrame:
    """At most n flows per quota class, first in ``order``.

    Task l1 pools both DoH classes; l2 leaves non-DoH flows out.  With a capture cap too, use ``cap_flows``.
    """
    rows = flows.withColumn("_quota", quota_class(task))
    if task == "l2":
        rows = rows.filter(F.col("_quota") != "non_doh")
    return first_n(rows, ["_quota"], order, n, few_groups=True).drop("_quota")


def cap_flows(flows: DataFrame, per_capture: int | None, per_class: int | None, order: list[str],
              task: str = "both") -> DataFrame:
    """Both quotas as if flows were read in ``order``: a flow of a full class is passed over and does not count
    towards its capture's cap.

    ``order`` starts with source_id.  Up to the first place at which a class fills, only the capture cap cuts.  So:
    apply the cap, find that place, leave the class out behind it, and start again; one round per class at most.
    """
    if per_capture is None or per_class is None:
        if per_capture is not None:
            flows = cap_flows_per_capture(flows, per_capture, order)
        return flows if per_class is None else cap_flows_per_class(flows, per_class, order, task)
    rows = flows.withColumn("_quota", quota_class(task))
    if task == "l2":
        rows = rows.filter(F.col("_quota") != "non_doh")
    place, full = F.struct(*order), {}
    while True:
        open_ = F.lit(True)
        for name, last in full.items():
            end = F.struct(*[F.lit(v).cast(flows.schema[c].dataType).alias(c) for c, v in zip(order, last)])
            open_ = open_ & ((F.col("_quota") != name) | (place <= end))
        kept = cap_flows_per_capture(rows.filter(open_), per_capture, order)
        firsts = first_n(kept.filter(~F.col("_quota").isin(list(full))), ["_quota"], order, per_class, few_groups=True)
        ends = (firsts.groupBy("_quota").agg(F.count(F.lit(1)).alias("n"), F.max(place).alias("last"))
                .filter(F.col("n") == per_class).orderBy("last").limit(1).collect())
        if not ends:
            return kept.drop("_quota")
        full[ends[0]["_quota"]] = tuple(ends[0]["last"])


def quota_class(task: str = "both") -> Column:
    """The class a flow counts for: task l1 pools both DoH classes."""
    if task == "l1":
        return F.when(flow_class() == "non_doh", "non_doh").otherwise("doh")
    return flow_class()


def drop_flows_without_clumps(flows: DataFrame, clumps: DataFrame, keys: list[str]) -> DataFrame:
    """Flows that have a first clump."""
    return flows.join(clumps.filter(F.col("clump_no") == 0).select(*keys), keys, "left_semi")


def cap_windows_per_class(samples: DataFrame, n: int, order: list[str]) -> DataFrame:
    return first_n(samples, ["label"], order, n, few_groups=True)


def cap_overflow(samples: DataFrame, kept: DataFrame, by: list[str] = ("label",)) -> DataFrame:
    """Windows offered, kept and dropped per class, or per flow with ``by`` the columns that name it."""
    by = list(by)
    have = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("offered"))
    left = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("kept"))
    return (have.join(left, by, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
            .withColumn("dropped", F.col("offered") - F.col("kept")))


def sample_per_class(df: DataFrame, label: str, ident: str, n: int, seed: int = 42) -> DataFrame:
    """At most n random rows per class, without replacement and the same on every run."""
    take = {name: min(n, count) for name, count in class_counts(df, label).items() if name is not None}
    return hash_cut(df, label, ident, seed, take, "_take").filter("_take").drop("_take")


def require_classes(df: DataFrame, label: str, least: int = 2, rows_each: int = 1) -> dict:
    """Row counts per class; raises when a job could not train on them."""
    counts = class_counts(df, label)
    if len(counts) < least:
        raise ValueError(f"needs at least {least} classes in {label!r}, found {sorted(map(str, counts))}")
    small = {k: v for k, v in counts.items() if v < rows_each}
    if small:
        raise ValueError(f"needs at least {rows_each} rows in each class of {label!r}, found {small}")
    return counts


def ingest_counters(raw: DataFrame, flows: DataFrame, kept: DataFrame, quota: int | None = None) -> DataFrame:
    """One row of totals: raw and accepted packets and bytes, flows seen, cut and kept, per class.

    ``raw`` has ``frame_bytes``, ``length`` and ``accepted``; flows have ``truncated`` and labels.
    """
    total = raw.agg(
        F.count(F.lit(1)).alias("raw_packets"), F.coalesce(F.sum("frame_bytes"), F.lit(0)).alias("raw_bytes"),
        F.count_if("accepted").alias("accepted_packets"),
        F.coalesce(F.sum(F.when(F.col("accepted"), F.col("length"))), F.lit(0)).alias("accepted_bytes"))
    seen = flows.agg(F.count(F.lit(1)).alias("flows_seen"), F.count_if("truncated").alias("flows_truncated"))
    classes = ["non_doh", "benign_doh", "malicious_doh"]
    stay = kept.withColumn("_class", flow_class()).agg(
        F.count(F.lit(1)).alias("flows_kept"),
        *[F.count_if(F.col("_class") == c).alias(f"kept_{c}") for c in classes])
    parts = [("_flows", seen), ("_kept", stay)]
    out = total.withColumns({name: one_row(part) for name, part in parts}).select("*", "_flows.*", "_kept.*")
    out = out.drop("_flows", "_kept")
    if quota is None:
        return out
    full = F.lit(True)
    for c in classes:
        full = full & (F.col(f"kept_{c}") >= quota)
    return out.withColumn("quotas_satisfied", full)


def audit_captures(captures: DataFrame, max_members: int | None = None) -> DataFrame:
    """Captures and bytes by category, scenario, session and in all, from one pass.

    ``capped`` on the total row tells whether the member cap was reached.
    """
    sets = captures.groupingSets([["category"], ["scenario_id"], ["session_id"], []],
                                 "category", "scenario_id", "session_id")
    level = (F.when(F.grouping("category") == 0, "category").when(F.grouping("scenario_id") == 0, "scenario")
             .when(F.grouping("session_id") == 0, "session").otherwise("total"))
    out = sets.agg(level.alias("level"), F.count(F.lit(1)).alias("captures"),
                   F.sum("size_bytes").alias("total_bytes"))
    value = F.when(F.col("level") != "total", F.coalesce("category", "scenario_id", "session_id"))
    capped = F.lit(False) if max_members is None else (
        (F.col("level") == "total") & (F.col("captures") >= max_members))
    return out.select("level", value.alias("value"), "captures", "total_bytes", capped.alias("capped"))


def audit_label_column(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Complete counts of a label column: trimmed value, rows, rank by count then value.

    Totals (rows, nulls, distinct values) are on every line.
    """
    text = F.trim(F.col(column).cast("string"))
    counts = df.select(text.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.agg(
        F.sum("rows").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("rows"))), F.lit(0)).alias("null_rows"),
        F.count("value").alias("distinct_values"))
    values = counts.filter(F.col("value").isNotNull())
    if top is not None:
        values = values.orderBy(F.desc("rows"), "value").limit(top)
    return values.withColumn("_t", one_row(totals)).select("value", "rows", "_t.*")


def map_labels(df: DataFrame, column: str, task: str) -> DataFrame:
    """Add ``target``; rows with a null label go, and for l2 the non-DoH rows too."""
    rows = df.filter(F.col(column).isNotNull())
    if task == "l2":
        rows = rows.filter(~clean_label(F.col(column)).isin(L1_NAMES["non_doh"]))
    return rows.withColumn("target", label_number(F.col(column), task))


def unknown_labels(df: DataFrame, column: str, task: str) -> DataFrame:
    """Label names the task does not know, with their row counts."""
    rows = map_labels(df, column, task).filter(F.col("target").isNull())
    return rows.groupBy(clean_label(F.col(column)).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
