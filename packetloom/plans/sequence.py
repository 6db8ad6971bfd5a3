"""Packets to labelled, split, scored windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.endpoints import touches_resolver
from packetloom.functions.scaling import default_label_name, step_mask
from packetloom.operators import calibrate as K
from packetloom.operators import clumps as C
from packetloom.operators import flows as L
from packetloom.operators import labels as A
from packetloom.operators import metrics as M
from packetloom.operators import models
from packetloom.operators import splits as S
from packetloom.operators import windows as W
from packetloom.operators.ordered import materialize
from packetloom.schema import FLOW


def labelled_flows(packets: DataFrame, captures: DataFrame, idle_us: int = L.IDLE_US,
                   max_flow_packets: int | None = None, max_flow_bytes: int | None = None,
                   flows_per_capture: int | None = None, flows_per_class: int | None = None,
                   task: str = "both") -> tuple[DataFrame, DataFrame]:
    """Flow rows with labels, and the packets of the kept flows.

    ``captures`` has source_id, session_id, scenario_id, category and is_malicious.  Quotas fill in (capture, flow
    start, flow id) order; flows of a full class do not count towards the capture cap.
    The numbered packets are written to the checkpoint folder once and read for flows and clumps.
    """
    numbered = materialize(L.split_flows(packets, idle_us))
    kept = L.cap_flow_packets(numbered, max_flow_packets, max_flow_bytes)
    flows = L.summarise_flows(numbered, None if kept is numbered else kept).filter("packet_count > 0")
    flows = flows.withColumns({"flow_id": L.flow_id(), "client_ip": _ip("client"), "server_ip": _ip("server")})
    flows = flows.withColumn("is_doh", touches_resolver("client_ip", "server_ip"))
    sides = captures.select("source_id", "session_id", "scenario_id", F.col("source_id").alias("source_file"))
    flows = A.label_flows(flows.join(sides, "source_id", "left"), captures)
    order = ["source_id", "start_us", "flow_id"]
    if flows_per_capture is not None or flows_per_class is not None:
        flows = A.cap_flows(materialize(flows), flows_per_capture, flows_per_class, order, task)
    return flows, kept.join(flows.select(*FLOW), FLOW, "left_semi")


def _ip(column: str):
    return F.regexp_extract(column, r"^(.*):\d+$", 1)


def task_samples(clumps: DataFrame, flows: DataFrame, task: str, lengths: list[int],
                 windows_per_flow: int | None = None, windows_per_class: int | None = None) -> DataFrame:
    """Samples of one task for several window lengths from one pass over the clumps."""
    label = "l1_label" if task == "l1" else "l2_label"
    known = flows.filter(F.col(label).isNotNull()).select(
        *FLOW, "flow_id", "session_id", "scenario_id", F.col(label).alias("label"), "start_us", "end_us", "source_file")
    windows = W.window_sweep(clumps, lengths, windows_per_flow)
    layer = 1 if task == "l1" else 2
    out = windows.join(known, FLOW).withColumns({
        "sample_id": F.concat("flow_id", F.lit("_w"), F.col("window_index").cast("string")),
        "layer": F.lit(layer), "label_name": default_label_name(F.lit(layer), F.col("label")),
        "mask": step_mask(F.col("features"))})
    if windows_per_class is None:
        return out
    capped = [A.cap_windows_per_class(out.filter(F.col("window_size") == n), windows_per_class,
                                      ["source_id", "start_us", "flow_id", "window_index"]) for n in lengths]
    return reduce(DataFrame.unionByName, capped)


def window_run(samples: DataFrame, length: int, protocol: str, kind: str = "perceptron", seed: int = 42,
               target_fpr: float = 0.001, max_iter: int = 100) -> DataFrame:
    """One metric row: split, fit on train, calibrate and choose the threshold on validation, test.

    A protocol without a validation part takes one from train, stratified.
    """
    parts = S.split_samples(samples, protocol, seed=seed)
    if protocol == "paper_flow_random":
        inner = S.split_stratified(parts.filter("split = 'train'").drop("split"), train=0.85, seed=seed + 1)
        inner = inner.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
        parts = inner.unionByName(parts.filter("split = 'test'"))
    parts = materialize(parts)
    part = lambda name: parts.filter(F.col("split") == name)
    model = models.fit_windows(part("train"), length, kind, seed=seed, max_iter=max_iter)
    on_val, on_test = (models.score_windows(model, part(p)).select("label", "score") for p in ("val", "test"))
    slope, intercept = K.platt_fit(on_val)
    curve = lambda df: df.withColumn("score", K.platt_apply(F.col("score"), slope, intercept))
    threshold = models.settle(M.select_threshold(curve(on_val), target_fpr=target_fpr))
    tau = threshold.first()
    tested = M.apply_threshold(curve(on_test), threshold).select("label", "prediction", "score")
    return models.settle(models.evaluate(tested, "label")).withColumns({
        "window_size": F.lit(length), "split_protocol": F.lit(protocol), "model": F.lit(kind),
        "threshold": F.lit(tau.threshold), "val_fpr": F.lit(tau.fpr), "threshold_feasible": F.lit(tau.feasible)})


def sweep(clumps: DataFrame, flows: DataFrame, tasks: list[str] = ("l1", "l2"), lengths: list[int] = (3, 6),
          protocols: list[str] = ("paper_flow_random", "session_scenario_disjoint"), kinds: list[str] = ("perceptron",),
          evidence_status: str = "observed", windows_per_class: int | None = None, **options) -> DataFrame:
    """One metric row per task, length, split and model; a split the data cannot give is left out."""
    rows = []
    for task in tasks:
        samples = materialize(task_samples(clumps, flows, task, list(lengths), windows_per_class=windows_per_class))
        for length in lengths:
            mine = samples.filter(F.col("window_size") == length)
            for protocol in protocols:
                for kind in kinds:
                    try:
                        run = window_run(mine, length, protocol, kind, **options)
                    except S.ImpossibleSplit:
                        continue
                    rows.append(run.withColumns({"task": F.lit(task), "evidence_status": F.lit(evidence_status)}))
    if not rows:
        raise S.ImpossibleSplit("no task and split has enough classes and sessions")
    return reduce(DataFrame.unionByName, rows)


def quota_ladder(packets: DataFrame, captures: DataFrame, steps: list[tuple[int, int]] = ((25, 500), (250, 5000)),
                 **options) -> DataFrame:
    """``sweep`` under growing (flows per capture, flows per class) quotas."""
    rows = []
    for per_capture, per_class in steps:
        flows, kept = labelled_flows(packets, captures, flows_per_capture=per_capture, flows_per_class=per_class)
        run = sweep(materialize(C.clump(kept)), materialize(flows), **options)
        rows.append(run.withColumns({"flows_per_capture": F.lit(per_capture), "flows_per_class": F.lit(per_class)}))
    return reduce(DataFrame.unionByName, rows)
