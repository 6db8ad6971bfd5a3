"""Flow packets to clumps: bursts of packets of one direction without a long gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.flows import IDLE_US, split_flows_busy, split_flows_ordinary
from packetloom.operators.ordered import MAX_LISTED, ROWS_PER_PIECE, by_heat, materialize, running
from packetloom.schema import CLUMP, FLOW, STREAM

TIMEOUT_US = 1_000
TIME_ORDER = ["ts_us", "packet_no"]


def _breaks(prev_ts: Column, prev_direction: Column, timeout: Column) -> Column:
    """A clump ends where the direction turns or the gap is over the timeout."""
    return (F.col("direction") != prev_direction) | (F.col("ts_us") - prev_ts > timeout)


def _collapse(marked: DataFrame, group: list[str], first_gap_us: int) -> DataFrame:
    """Packets with ``clump_no`` and ``_gap`` (set on the first packet of a clump) -> clumps."""
    return (marked.groupBy(*group, "clump_no")
            .agg(F.sum("length").alias("size"), F.count(F.lit(1)).alias("pkt_count"),
                 F.max("direction").alias("direction"),
                 F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
                 F.max("_gap").alias("_gap"))
            .withColumn("duration_us", F.col("end_us") - F.col("start_us"))
            .withColumn("interarrival_us", F.coalesce("_gap", F.lit(first_gap_us)).cast("long"))
            .select(*group, "clump_no", "size", "pkt_count", "direction", "start_us", "end_us",
                    "duration_us", "interarrival_us"))


def clump_ordinary(flow_packets: DataFrame, timeout_us: int | Column = TIMEOUT_US, first_gap_us: int = 0,
                   group: list[str] = FLOW) -> DataFrame:
    """``clump`` by plain windows; needs no exchange of its own after ``split_flows_ordinary``."""
    timeout = timeout_us if isinstance(timeout_us, Column) else F.lit(timeout_us)
    order = Window.partitionBy(*group).orderBy(*TIME_ORDER)
    prev_ts, prev_direction = F.lag("ts_us").over(order), F.lag("direction").over(order)
    marked = flow_packets.withColumns({"_pt": prev_ts, "_pd": prev_direction})
    marked = marked.withColumn("_new", F.coalesce(_breaks(F.col("_pt"), F.col("_pd"), timeout), F.lit(True)))
    marked = marked.withColumn("_gap", F.when(F.col("_new"), F.col("ts_us") - F.col("_pt")))
    nth = F.sum(F.col("_new").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return _collapse(marked.withColumn("clump_no", nth - 1), group, first_gap_us)


def _time_pieces(flow_packets: DataFrame, group: list[str], rows_per_piece: int) -> DataFrame:
    """Add ``_piece``: 0 for ordinary flows, equal slices of time for a flow above the limit."""
    size = flow_packets.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts_us").alias("_lo"), F.max("ts_us").alias("_hi"))
    large = size.filter(F.col("_n") > rows_per_piece).limit(MAX_LISTED + 1).collect()
    if not large:
        return flow_packets.withColumn("_piece", F.lit(0).cast("long"))
    if len(large) <= MAX_LISTED:
        large = F.broadcast(flow_packets.sparkSession.createDataFrame(large, size.schema))
    else:
        large = size.filter(F.col("_n") > rows_per_piece)
    width = (F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") / rows_per_piece)
    piece = F.coalesce(F.floor((F.col("ts_us") - F.col("_lo")) / width).cast("long"), F.lit(0).cast("long"))
    return flow_packets.join(large, group, "left").withColumn("_piece", piece).drop("_n", "_lo", "_hi")


def clump_busy(flow_packets: DataFrame, timeout_us: int | Column = TIMEOUT_US, first_gap_us: int = 0,
               rows_per_piece: int = ROWS_PER_PIECE, group: list[str] = FLOW) -> DataFrame:
    """``clump`` for flows too large for one task, in slices of time.

    Each slice counts its own breaks and keeps its first and last packet; a window over the slices
    settles whether a slice opens a clump and how many clumps came before it.
    """
    timeout = timeout_us if isinstance(timeout_us, Column) else F.lit(timeout_us)
    cut = _time_pieces(flow_packets, group, rows_per_piece)
    piece = group + ["_piece"]
    order = Window.partitionBy(*piece).orderBy(*TIME_ORDER)
    cut = cut.withColumns({"_pt": F.lag("ts_us").over(order), "_pd": F.lag("direction").over(order)})
    inner = F.coalesce(_breaks(F.col("_pt"), F.col("_pd"), timeout), F.lit(False))
    cut = materialize(cut.withColumn("_in", inner.cast("long")))
    edge = F.struct("ts_us", "packet_no", "direction")
    extra = [] if not isinstance(timeout_us, Column) else [F.max(timeout).alias("_timeout")]
    pieces = cut.groupBy(*piece).agg(
        F.min(edge).alias("_first"), F.max(edge).alias("_last"), F.sum("_in").alias("_inner"), *extra)
    along = Window.partitionBy(*group).orderBy("_piece")
    pieces = pieces.withColumn("_back", F.lag("_last").over(along))
    limit = F.col("_timeout") if extra else timeout
    opens = F.coalesce(
        (F.col("_first.direction") != F.col("_back.direction"))
        | (F.col("_first.ts_us") - F.col("_back.ts_us") > limit), F.lit(True)).cast("long")
    pieces = pieces.withColumn("_opens", opens)
    earlier = F.sum(F.col("_opens") + F.col("_inner")).over(
        along.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(*piece, "_opens", F.coalesce(earlier, F.lit(0)).alias("_base"),
                           F.col("_back.ts_us").alias("_back_ts"))
    joined = cut.join(pieces, piece)
    # The first packet of a slice has no _pt: whether it opens a clump was settled above.
    new = F.when(F.col("_pt").isNull(), F.col("_opens")).otherwise(F.col("_in"))
    joined = joined.withColumn("_new", new)
    nth = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = joined.withColumn("clump_no", F.col("_base") + nth - 1)
    gap = F.when(F.col("_new") == 1, F.col("ts_us") - F.coalesce("_pt", "_back_ts"))
    return _collapse(joined.withColumn("_gap", gap), group, first_gap_us)


def clump(flow_packets: DataFrame, timeout_us: int | Column = TIMEOUT_US, first_gap_us: int = 0,
          rows_per_piece: int = ROWS_PER_PIECE, group: list[str] = FLOW) -> DataFrame:
    """Clumps of each flow: packets in time order, a new clump when the direction turns or the gap is
    over ``timeout_us`` (a gap equal to it stays).  ``interarrival_us`` runs from the previous clump's
    end; the first clump of a flow takes ``first_gap_us``.
    """
    return by_heat(flow_packets, group,
                   lambda p: clump_ordinary(p, timeout_us, first_gap_us, group),
                   lambda p: clump_busy(p, timeout_us, first_gap_us, rows_per_piece, group),
                   rows_per_piece)


def packets_to_clumps(packets: DataFrame, idle_us: int = IDLE_US, timeout_us: int = TIMEOUT_US,
                      rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """``split_flows`` then ``clump``.  For ordinary keys both share one exchange by (source, key)."""
    return by_heat(
        packets, STREAM,
        lambda p: clump_ordinary(split_flows_ordinary(p, idle_us), timeout_us),
        lambda p: clump_busy(split_flows_busy(p, idle_us, rows_per_piece), timeout_us,
                             rows_per_piece=rows_per_piece),
        rows_per_piece)


def timeout_sweep(flow_packets: DataFrame, timeouts_us: list[int],
                  rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Clumps under several timeouts, keyed by ``timeout_us``.

    Clumps of a longer timeout are runs of neighbouring clumps of a shorter one, so packets are read and dealt out
    once, for the shortest; the others are merged from its clumps where those stand.
    """
    base = materialize(clump(flow_packets, min(timeouts_us), rows_per_piece=rows_per_piece))
    return by_heat(base, FLOW, lambda c: _merge_ordinary(c, timeouts_us),
                   lambda c: _merge_busy(c, timeouts_us, rows_per_piece), rows_per_piece)


def _opens(timeout: int, end: str, direction: str) -> Column:
    broken = (F.col("direction") != F.col(direction)) | (F.col("start_us") - F.col(end) > timeout)
    return F.coalesce(broken, F.lit(True)).cast("long")


def _merge_ordinary(clumps: DataFrame, timeouts_us: list[int]) -> DataFrame:
    order = Window.partitionBy(*FLOW).orderBy("clump_no")
    marked = clumps.withColumns({"_end": F.lag("end_us").over(order), "_dir": F.lag("direction").over(order)})
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return _merge(marked.withColumns({f"_no_{i}": F.sum(_opens(t, "_end", "_dir")).over(so_far)
                                      for i, t in enumerate(timeouts_us)}), timeouts_us)


def _merge_busy(clumps: DataFrame, timeouts_us: list[int], rows_per_piece: int) -> DataFrame:
    cut = materialize(clumps.withColumn("_piece", F.floor(F.col("clump_no") / rows_per_piece)))
    marked = materialize(running(cut, FLOW, "_piece", ["clump_no"], {
        "_end": ("last", F.col("end_us"), False), "_dir": ("last", F.col("direction"), False)}))
    return _merge(running(marked, FLOW, "_piece", ["clump_no"], {
        f"_no_{i}": ("sum", _opens(t, "_end", "_dir"), True) for i, t in enumerate(timeouts_us)}), timeouts_us)


def _merge(numbered: DataFrame, timeouts_us: list[int]) -> DataFrame:
    choices = F.array(*[F.struct(F.lit(t).cast("long").alias("timeout_us"), (F.col(f"_no_{i}") - 1).alias("no"))
                        for i, t in enumerate(timeouts_us)])
    wide = numbered.select(*FLOW, "clump_no", "size", "pkt_count", "direction", "start_us", "end_us", "interarrival_us",
                           F.explode(choices).alias("_t"))
    return (wide.groupBy(*FLOW, F.col("_t.timeout_us").alias("timeout_us"), F.col("_t.no").alias("no"))
            .agg(F.sum("size").alias("size"), F.sum("pkt_count").alias("pkt_count"), F.max("direction").alias("direction"),
                 F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
                 F.min_by("interarrival_us", "clump_no").alias("interarrival_us"))
            .select(*FLOW, "timeout_us", F.col("no").alias("clump_no"), "size", "pkt_count", "direction", "start_us",
                    "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "interarrival_us"))


def add_clump_seconds(clumps: DataFrame) -> DataFrame:
    """``duration`` and ``interarrival`` in seconds beside the microsecond columns."""
    return clumps.withColumns({"duration": F.col("duration_us") / 1e6,
                               "interarrival": F.col("interarrival_us") / 1e6})
