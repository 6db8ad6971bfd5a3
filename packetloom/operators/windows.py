"""Sliding windows over the clumps of a flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.scaling import (PADDING, clump_vector, default_label_name, step_mask,
                                          vector_of)
from packetloom.operators.delay import summary_columns
from packetloom.schema import FLOW

# Clumps of one flow per task; longer flows are cut, and each piece borrows the next l-1 clumps.
CLUMPS_PER_PIECE = 1_000_000


def _pieces(clumps: DataFrame, group: list[str], reach: int, per_piece: int) -> DataFrame:
    """Add ``_piece``; the first ``reach`` clumps of a piece also appear, marked, in the piece before."""
    own = F.floor(F.col("clump_no") / per_piece).cast("long")
    copies = F.when((F.col("clump_no") >= per_piece) & (F.col("clump_no") % per_piece < reach),
                    F.array(own, own - 1)).otherwise(F.array(own))
    return (clumps.withColumn("_piece", F.explode(copies))
            .withColumn("_borrowed", F.col("_piece") != own))


def _steps(value: Column, length: int, group: list[str]) -> list[Column]:
    """The value at this clump and at the next length-1 clumps of the flow (null past the end)."""
    order = Window.partitionBy(*group, "_piece").orderBy("clump_no")
    return [value] + [F.lead(value, k).over(order) for k in range(1, length)]


def _is_full(last: Column, stride: int) -> Column:
    return last.isNotNull() & (F.col("clump_no") % stride == 0)


def _is_short(last: Column) -> Column:
    """First clump of a flow that has fewer clumps than the window."""
    return last.isNull() & (F.col("clump_no") == 0)


def window_steps(clumps: DataFrame, length: int, step: Column, padding: Column, stride: int = 1,
                 pad: bool = True, max_windows: int | None = None, group: list[str] = FLOW,
                 clumps_per_piece: int = CLUMPS_PER_PIECE) -> DataFrame:
    """Windows of ``length`` steps: ``window_index``, ``features``, ``is_padded``, ``pad_count``.

    A flow shorter than the window gives one padded window, or none with ``pad=False``.
    """
    if length <= 0 or stride <= 0:
        raise ValueError("length and stride must be positive")
    cut = _pieces(clumps, group, length - 1, clumps_per_piece)
    steps = _steps(step, length, group)
    cut = cut.withColumns({f"_s{k}": s for k, s in enumerate(steps)}).filter(~F.col("_borrowed"))
    last = F.col(f"_s{length - 1}")
    wanted = _is_full(last, stride)
    if pad and length > 1:
        wanted = wanted | _is_short(last)
    cells = [F.col(f"_s{k}") for k in range(length)]
    missing = sum((c.isNull().cast("int") for c in cells), F.lit(0))
    out = (cut.filter(wanted)
           .withColumn("window_index", F.floor(F.col("clump_no") / stride).cast("long"))
           .withColumn("pad_count", missing)
           .withColumn("is_padded", F.col("pad_count") > 0)
           .withColumn("features", F.array(*[F.coalesce(c, padding) for c in cells])))
    if max_windows is not None:
        out = out.filter(F.col("window_index") < max_windows)
    return out.select(*group, "window_index", "is_padded", "pad_count", "features")


def raw_windows(clumps: DataFrame, length: int, stride: int = 1, pad: bool = True,
                **options) -> DataFrame:
    """Windows of clump structs; short flows are filled with all-zero clumps."""
    fields = ["size", "pkt_count", "direction", "duration_us", "interarrival_us"]
    step = F.struct(*[F.col(f).cast("long").alias(f) for f in fields])
    zero = F.struct(*[F.lit(0).cast("long").alias(f) for f in fields])
    return window_steps(clumps, length, step, zero, stride, pad, **options)


def scaled_windows(clumps: DataFrame, length: int, stride: int = 1, pad: bool = True,
                   max_windows: int | None = None, scaled: bool = True, **options) -> DataFrame:
    """Windows of five-number vectors; short flows are filled with the padding vector."""
    return window_steps(clumps, length, clump_vector(scaled), vector_of(PADDING), stride, pad,
                        max_windows, **options)


def window_sweep(clumps: DataFrame, lengths: list[int], max_windows: int | None = None,
                 scaled: bool = True, clumps_per_piece: int = CLUMPS_PER_PIECE) -> DataFrame:
    """Scaled stride-1 windows of several lengths from one window pass, keyed by ``window_size``."""
    longest = max(lengths)
    cut = _pieces(clumps, FLOW, longest - 1, clumps_per_piece)
    steps = _steps(clump_vector(scaled), longest, FLOW)
    cut = cut.withColumns({f"_s{k}": s for k, s in enumerate(steps)}).filter(~F.col("_borrowed"))
    choices = []
    for length in lengths:
        cells = [F.col(f"_s{k}") for k in range(length)]
        missing = sum((c.isNull().cast("int") for c in cells), F.lit(0))
        padded = F.array(*[F.coalesce(c, vector_of(PADDING)) for c in cells])
        keep = cells[-1].isNotNull() | ((F.col("clump_no") == 0) & F.lit(length > 1))
        choices.append(F.when(keep, F.struct(F.lit(length).alias("window_size"),
                                             missing.alias("pad_count"), padded.alias("features"))))
    out = (cut.withColumn("_w", F.explode(F.array_compact(F.array(*choices))))
           .select(*FLOW, F.col("clump_no").alias("window_index"), "_w.*")
           .withColumn("is_padded", F.col("pad_count") > 0))
    return out if max_windows is None else out.filter(F.col("window_index") < max_windows)


def sequence_samples(windows: DataFrame, flows: DataFrame, layer: int, window_size: int,
                     stride: int = 1) -> DataFrame:
    """Windows joined with their flow's label and provenance: one model sample per window.

    ``flows`` has FLOW, flow_id, session_id, scenario_id, l1_label, l2_label, start_us, end_us and
    source_file.  Layer 2 keeps flows whose second label is known.
    """
    label = F.col("l1_label") if layer == 1 else F.col("l2_label")
    labelled = flows.withColumn("label", label)
    if layer == 2:
        labelled = labelled.filter(F.col("label").isNotNull())
    labelled = labelled.select(*FLOW, "flow_id", "session_id", "scenario_id", "label", "start_us",
                               "end_us", "source_file")
    return (windows.join(labelled, FLOW)
            .withColumns({
                "sample_id": F.concat(F.col("flow_id"), F.lit("_w"), F.col("window_index").cast("string")),
                "layer": F.lit(layer), "window_size": F.lit(window_size), "stride": F.lit(stride),
                "label_name": default_label_name(F.lit(layer), F.col("label")),
                "mask": step_mask(F.col("features"))}))


def first_windows(windows: DataFrame, n: int | None = None, order: str = "flow_id") -> DataFrame:
    """The first window of each flow; with ``n``, of the first n flows by id."""
    first = windows.filter(F.col("window_index") == 0)
    return first if n is None else first.orderBy(order).limit(n)


def segment_features(clumps: DataFrame, length: int, group: list[str] = FLOW, first_only: bool = False,
                     clumps_per_piece: int = CLUMPS_PER_PIECE) -> DataFrame:
    """Eight summary numbers per zero-padded, stride-1 window of raw clumps.

    Sums over a row frame, so no window is ever held as an array.  A filled step counts as a forward
    clump of size 0.
    """
    cut = _pieces(clumps, group, length - 1, clumps_per_piece)
    if first_only:
        cut = cut.filter(F.col("clump_no") < length)
    order = Window.partitionBy(*group, "_piece").orderBy("clump_no")
    frame = order.rowsBetween(0, length - 1)
    size = F.col("size").cast("double")
    sums = {
        "_n": F.count(F.lit(1)).over(frame),
        "_size": F.sum(size).over(frame), "_square": F.sum(size * size).over(frame),
        "max_size": F.max(size).over(frame), "_pkts": F.sum("pkt_count").over(frame),
        "_span": F.sum("duration_us").over(frame), "_gap": F.sum("interarrival_us").over(frame),
        "_fwd": F.sum(F.when(F.col("direction") == 0, 1).otherwise(0)).over(frame),
    }
    cut = cut.withColumns(sums).filter(~F.col("_borrowed"))
    cut = cut.filter((F.col("_n") == length) | (F.col("clump_no") == 0))
    if first_only:
        cut = cut.filter(F.col("clump_no") == 0)
    return cut.select(*group, F.col("clump_no").alias("window_index"), *segment_columns(
        length, F.col("_n"), F.col("_size"), F.col("_square"), F.col("max_size"), F.col("_pkts"), F.col("_span"),
        F.col("_gap"), F.col("_fwd")))


def segment_columns(length: int, n: Column, size: Column, square: Column, largest: Column, packets: Column,
                    span: Column, gap: Column, forward: Column) -> list[Column]:
    """The eight segment features from sums over the ``n`` clumps of a window of ``length``."""
    m = float(length)
    spread = F.greatest(F.lit(0.0), m * square - size * size)
    return [(size / m).alias("mean_size"), largest.alias("max_size"), (packets / m).alias("mean_pkts"),
            (span / 1e6 / m).alias("mean_duration"), (gap / 1e6 / m).alias("mean_interarrival"),
            (F.sqrt(spread) / m).alias("std_size"), ((forward + (m - n)) / m).alias("forward_share"),
            ((span + gap) / 1e6).alias("total_span")]


def collection_delay(clumps: DataFrame, length: int, group: list[str] = FLOW) -> DataFrame:
    """Time a sensor waits for the first ``length`` clumps of a flow: durations plus gaps."""
    return (clumps.filter(F.col("clump_no") < length).groupBy(*group)
            .agg(F.sum(F.col("duration_us") + F.col("interarrival_us")).alias("delay_us")))


def detection_delay(clumps: DataFrame, length: int, group: list[str] = FLOW) -> DataFrame:
    """Last packet of clump ``length`` minus first packet of the flow; equals ``collection_delay``
    while the first gap is 0."""
    return (clumps.filter(F.col("clump_no") < length).groupBy(*group)
            .agg((F.max("end_us") - F.min("start_us")).alias("delay_us")))


def delay_by_length(clumps: DataFrame, lengths: list[int], group: list[str] = FLOW) -> DataFrame:
    """``collection_delay`` of several lengths at once, then its summary per length."""
    options = [F.when(F.col("clump_no") < n, F.lit(n)) for n in lengths]
    wide = clumps.withColumn("window_size", F.explode(F.array_compact(F.array(*options))))
    per_flow = wide.groupBy(*group, "window_size").agg(
        F.sum(F.col("duration_us") + F.col("interarrival_us")).alias("delay_us"))
    return summary_columns(per_flow, "delay_us", ["window_size"], unit=1e6)
