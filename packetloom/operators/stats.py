"""Whole-flow statistics: bytes and rates each way, and the shape of three series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.clumps import TIME_ORDER, _time_pieces
from packetloom.operators.delay import quantiles
from packetloom.operators.flows import IDLE_US, split_flows_busy, split_flows_ordinary
from packetloom.operators.ordered import ROWS_PER_PIECE, by_heat, materialize, running
from packetloom.schema import FLOW, STREAM

# The column names of a flow-statistics table.  Each series below gives eight columns.
SERIES = {"PacketLength": ("length", 1.0), "PacketTime": ("_gap", 1e6), "ResponseTimeTime": ("_reply", 1e6)}
SHAPE = ["Variance", "StandardDeviation", "Mean", "Median", "Mode", "SkewFromMedian", "SkewFromMode",
         "CoefficientofVariation"]
FEATURES = ["Duration", "FlowBytesSent", "FlowSentRate", "FlowBytesReceived", "FlowReceivedRate"] + [
    series + shape for series in SERIES for shape in SHAPE]


def _add_series(rows: DataFrame, prev_ts: Column, prev_direction: Column) -> DataFrame:
    """Packet time: gap to the packet before.  Response time: that gap where a request turns to a reply."""
    gap = F.col("ts_us") - prev_ts
    turns = (F.col("direction") == 1) & (prev_direction == 0)
    return rows.withColumns({"_gap": gap, "_reply": F.when(turns, gap)})


def _base_aggregates() -> list[Column]:
    sent = F.sum(F.when(F.col("direction") == 0, F.col("length")).otherwise(0))
    received = F.sum(F.when(F.col("direction") == 1, F.col("length")).otherwise(0))
    aggs = [F.count(F.lit(1)).alias("_packets"), (F.max("ts_us") - F.min("ts_us")).alias("_span"),
            sent.cast("double").alias("FlowBytesSent"), received.cast("double").alias("FlowBytesReceived")]
    for name, (column, _) in SERIES.items():
        aggs += [F.avg(column).alias(f"_{name}_mean"), F.var_pop(column).alias(f"_{name}_var")]
    return aggs


def _shape_columns(flows: DataFrame, min_packets: int) -> DataFrame:
    """The 29 named columns; ratios are null where they are not defined."""
    seconds = F.col("_span") / 1e6
    rate = lambda total: F.when(seconds > 0, F.col(total) / seconds)
    out = {"Duration": seconds, "FlowBytesSent": F.col("FlowBytesSent"), "FlowSentRate": rate("FlowBytesSent"),
           "FlowBytesReceived": F.col("FlowBytesReceived"), "FlowReceivedRate": rate("FlowBytesReceived")}
    for name, (_, unit) in SERIES.items():
        mean, var = F.col(f"_{name}_mean"), F.col(f"_{name}_var")
        median, mode = F.col(f"_{name}_median"), F.col(f"_{name}_mode").cast("double")
        sd = F.sqrt(var)
        out[name + "Variance"] = var / (unit * unit)
        out[name + "StandardDeviation"] = sd / unit
        out[name + "Mean"] = mean / unit
        out[name + "Median"] = median / unit
        out[name + "Mode"] = mode / unit
        out[name + "SkewFromMedian"] = F.when(sd > 0, 3.0 * (mean - median) / sd)
        out[name + "SkewFromMode"] = F.when(sd > 0, (mean - mode) / sd)
        out[name + "CoefficientofVariation"] = F.when(mean != 0, sd / mean)
    return (flows.filter(F.col("_packets") >= min_packets)
            .select(*FLOW, *[out[c].alias(c) for c in FEATURES]))


def _statistics_ordinary(flow_packets: DataFrame, min_packets: int) -> DataFrame:
    order = Window.partitionBy(*FLOW).orderBy(*TIME_ORDER)
    rows = _add_series(flow_packets, F.lag("ts_us").over(order), F.lag("direction").over(order))
    aggs = _base_aggregates()
    for name, (column, _) in SERIES.items():
        aggs += [F.median(column).alias(f"_{name}_median"), F.mode(column, True).alias(f"_{name}_mode")]
    return _shape_columns(rows.groupBy(*FLOW).agg(*aggs), min_packets)


def _statistics_busy(flow_packets: DataFrame, min_packets: int, rows_per_piece: int) -> DataFrame:
    """Order statistics from value counts, so no flow is gathered in one place."""
    cut = _time_pieces(flow_packets, FLOW, rows_per_piece)
    before = F.struct("ts_us", "direction")
    rows = running(cut, FLOW, "_piece", TIME_ORDER, {"_before": ("last", before, False)})
    rows = materialize(_add_series(rows, F.col("_before.ts_us"), F.col("_before.direction")))
    parts = [rows.groupBy(*FLOW).agg(*_base_aggregates())]
    for name, (column, _) in SERIES.items():
        middle = quantiles(rows, column, FLOW, [0.5], rows_per_piece)
        counts = rows.filter(F.col(column).isNotNull()).groupBy(*FLOW, column).count()
        modes = counts.groupBy(*FLOW).agg(
            F.max_by(column, F.struct("count", -F.col(column))).alias(f"_{name}_mode"))
        parts += [middle.withColumnRenamed("q0", f"_{name}_median"), modes]
    return _shape_columns(reduce(lambda a, b: a.join(b, FLOW, "left"), parts), min_packets)


def flow_statistics(packets: DataFrame, idle_us: int = IDLE_US, min_packets: int = 3,
                    rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Packets to one row of 29 numbers per flow; flows under ``min_packets`` packets are left out.

    Ties of the mode go to the smallest value.  Ordinary keys need one exchange for flows and statistics.
    """
    return by_heat(
        packets, STREAM,
        lambda p: _statistics_ordinary(split_flows_ordinary(p, idle_us), min_packets),
        lambda p: _statistics_busy(split_flows_busy(p, idle_us, rows_per_piece), min_packets, rows_per_piece),
        rows_per_piece)
