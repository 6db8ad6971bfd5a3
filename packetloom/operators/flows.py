"""Packets to two-way flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.ordered import ROWS_PER_PIECE, by_heat, first_n, materialize, running
from packetloom.schema import FLOW, MICROS, STREAM

IDLE_US = 40 * MICROS


def accept_packets(decoded: DataFrame, min_app_bytes: int = 40) -> DataFrame:
    """Decoded packets -> ``packets``: data packets only, with ``key``, ``sender`` and ``length``."""
    from packetloom.functions.endpoints import endpoint, keeps_application_data, two_way_key
    return (decoded.filter(keeps_application_data("flags", "app_bytes", min_app_bytes))
            .select("source_id", "packet_no", "ts_us", F.col("app_bytes").alias("length"),
                    two_way_key("src_ip", "src_port", "dst_ip", "dst_port").alias("key"),
                    endpoint("src_ip", "src_port").alias("sender"),
                    endpoint("dst_ip", "dst_port").alias("receiver")))


def _starts_flow(seen: Column, idle_us: int) -> Column:
    return F.when(seen.isNull() | (F.col("ts_us") - seen > idle_us), 1).otherwise(0)


def _face_client(packets: DataFrame, client: Column) -> DataFrame:
    """Direction 0 from the flow's first sender, else 1."""
    return packets.withColumn("direction", F.when(F.col("sender") == client, 0).otherwise(1))


def split_flows_ordinary(packets: DataFrame, idle_us: int = IDLE_US) -> DataFrame:
    """``split_flows`` by plain windows: one exchange by (source, key), one key in one task."""
    order = Window.partitionBy(*STREAM).orderBy("packet_no")
    seen = F.max("ts_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    out = packets.withColumn("_start", _starts_flow(seen, idle_us))
    out = out.withColumn("flow_no", (F.sum("_start").over(upto) - 1).cast("long"))
    if "sender" in packets.columns:
        client = F.last(F.when(F.col("_start") == 1, F.col("sender")), ignorenulls=True).over(upto)
        out = _face_client(out, client)
    return out.drop("_start")


def split_flows_busy(packets: DataFrame, idle_us: int = IDLE_US,
                     rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """``split_flows`` for keys too large for one task, in pieces of the capture order."""
    cut = packets.withColumn("_piece", F.floor(F.col("packet_no") / rows_per_piece).cast("long"))
    cut = running(cut, STREAM, "_piece", ["packet_no"], {"_seen": ("max", F.col("ts_us"), False)})
    cut = materialize(cut.withColumn("_start", _starts_flow(F.col("_seen"), idle_us)))
    specs = {"_nth": ("sum", F.col("_start"), True)}
    if "sender" in packets.columns:
        specs["_client"] = ("last", F.when(F.col("_start") == 1, F.col("sender")), True)
    out = running(cut, STREAM, "_piece", ["packet_no"], specs)
    out = out.withColumn("flow_no", (F.col("_nth") - 1).cast("long"))
    if "sender" in packets.columns:
        out = _face_client(out, F.col("_client"))
    columns = [c for c in packets.columns if c != "direction"]
    return materialize(out.select(*columns, "flow_no", "direction"))


def split_flows(packets: DataFrame, idle_us: int = IDLE_US,
                rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Number the flows of each (source_id, key): a new one when idle for more than ``idle_us``.

    Idle time runs from the latest time seen in the key so far, in capture order, so a late packet
    stays in the open flow.  With a ``sender`` column the direction is set from the flow's first
    sender; without one, a ``direction`` column must be there already.
    """
    columns = [c for c in packets.columns if c != "direction"] + ["flow_no", "direction"]
    return by_heat(
        packets, STREAM,
        lambda p: split_flows_ordinary(p, idle_us).select(*columns),
        lambda p: split_flows_busy(p, idle_us, rows_per_piece).select(*columns),
        rows_per_piece)


def flow_id() -> Column:
    return F.concat_ws("|", "source_id", "key", F.col("flow_no").cast("string"))


def summarise_flows(flow_packets: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """One row per flow: times, size, client and the truncation mark.

    ``accepted`` is what ``cap_flow_packets`` kept.  A refused packet still moves the end time.
    """
    by_no = F.col("packet_no")
    aggs = [F.min_by("ts_us", by_no).alias("start_us"), F.max("ts_us").alias("end_us"),
            F.count(F.lit(1)).alias("packet_count"), F.sum("length").alias("byte_count")]
    if "sender" in flow_packets.columns:
        aggs += [F.min_by("sender", by_no).alias("client"), F.min_by("receiver", by_no).alias("server")]
    flows = flow_packets.groupBy(*FLOW).agg(*aggs)
    if accepted is not None:
        kept = accepted.groupBy(*FLOW).agg(F.count(F.lit(1)).alias("_n"), F.sum("length").alias("_b"))
        flows = (flows.join(kept, FLOW, "left")
                 .withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("_b", F.coalesce("_b", F.lit(0)))
                 .withColumn("truncated", F.col("_n") < F.col("packet_count"))
                 .withColumn("packet_count", F.col("_n")).withColumn("byte_count", F.col("_b"))
                 .drop("_n", "_b"))
    else:
        flows = flows.withColumn("truncated", F.lit(False))
    return flows.withColumn("duration_us", F.greatest(F.lit(0), F.col("end_us") - F.col("start_us")))


# --- caps ---------------------------------------------------------------------------------------

def cap_captures(packets: DataFrame, max_packets: int | None = None, max_bytes: int | None = None,
                 size: str = "length", rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Each source's rows up to the first one over a packet or byte cap.

    Used on raw packets (``size="frame_bytes"``) before filtering, and on accepted packets after it.
    Sizes are not negative, so the rows within both running totals are exactly that prefix.
    """
    if max_packets is None and max_bytes is None:
        return packets
    columns = packets.columns
    cut = packets.withColumn("_piece", F.floor(F.col("packet_no") / rows_per_piece).cast("long"))
    cut = running(cut, ["source_id"], "_piece", ["packet_no"], {
        "_n": ("sum", F.lit(1), True), "_b": ("sum", F.col(size), True)})
    if max_packets is not None:
        cut = cut.filter(F.col("_n") <= max_packets)
    if max_bytes is not None:
        cut = cut.filter(F.col("_b") <= max_bytes)
    return cut.select(*columns)


def cap_flow_packets(flow_packets: DataFrame, max_packets: int | None = None, max_bytes: int | None = None,
                     rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Packets a flow keeps under its caps, in capture order.

    A packet is refused when the flow is full, or when its own length would pass the byte cap; a
    later, smaller packet may still fit.  Once a length is refused, every later packet of at least
    that length is refused too, so of each length v only the first ``max_bytes / v`` packets can be
    kept.  That prunes every flow to a size set by the caps before the ordered pass.
    """
    if max_bytes is None:
        if max_packets is None:
            return flow_packets
        return first_n(flow_packets, FLOW, ["packet_no"], max_packets, rows_per_piece=rows_per_piece)
    most = F.when(F.col("length") > 0, F.floor(F.lit(max_bytes) / F.col("length"))).otherwise(
        F.lit(max_packets if max_packets is not None else 2**62))
    if max_packets is not None:
        most = F.least(most, F.lit(max_packets))
    candidates = first_n(flow_packets, FLOW + ["length"], ["packet_no"], most, rows_per_piece=rows_per_piece)
    ordered = candidates.repartition(*FLOW).sortWithinPartitions(*FLOW, "packet_no")
    return ordered.mapInPandas(_greedy_fill(max_packets, max_bytes), ordered.schema)


def _greedy_fill(max_packets: int | None, max_bytes: int):
    """Take packets while they fit; state is two counters for the flow at hand."""
    def fill(batches):
        flow, count, total = None, 0, 0
        for rows in batches:
            keep = []
            for source, key, no, length in zip(rows["source_id"], rows["key"], rows["flow_no"], rows["length"]):
                if (source, key, no) != flow:
                    flow, count, total = (source, key, no), 0, 0
                fits = (max_packets is None or count < max_packets) and total + length <= max_bytes
                if fits:
                    count, total = count + 1, total + length
                keep.append(fits)
            yield rows[keep]
    return fill


def packet_faults(packets: DataFrame, by: Sequence[str] = ("source_id", "key"),
                  rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """One row per broken packet rule: a negative length, a direction other than 0/1, time going back."""
    by = list(by)

    def mark(rows: DataFrame, previous: Column) -> DataFrame:
        faults = F.array_compact(F.array(
            F.when(F.col("length") < 0, F.lit("negative_length")),
            F.when(~F.col("direction").isin(0, 1), F.lit("bad_direction")),
            F.when(F.col("ts_us") < previous, F.lit("time_goes_back"))))
        return rows.select(*by, "packet_no", F.explode(faults).alias("fault"))

    def ordinary(rows):
        order = Window.partitionBy(*by).orderBy("packet_no")
        rows = rows.withColumn("_prev", F.lag("ts_us").over(order))
        return mark(rows, F.col("_prev"))

    def busy(rows):
        cut = rows.withColumn("_piece", F.floor(F.col("packet_no") / rows_per_piece).cast("long"))
        cut = running(cut, by, "_piece", ["packet_no"], {"_prev": ("last", F.col("ts_us"), False)})
        return mark(cut, F.col("_prev"))

    return by_heat(packets, by, ordinary, busy, rows_per_piece)
