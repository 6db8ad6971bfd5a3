"""Live flows and clumps with watermarks.

Packets need an event-time column ``ts`` (timestamp) beside the batch columns.  A packet is used once
the watermark has passed it, so packets may arrive out of order within the watermark's delay; later
ones are dropped and counted (``late_rows``).  State per key is one open flow, one open clump, the last clumps of a
window and that short buffer; it is gone when the flow's idle time has passed.  A flow is therefore known by its start,
and ``numbered`` gives the numbers of the batch form to finished flows.

Keys are handled by the bucket: its keys share one value of state and one timer, so a batch costs a call to the state
store for each bucket and not several for each key.  A restarted query must keep its number of buckets.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from packetloom.operators.clumps import TIMEOUT_US
from packetloom.operators.flows import IDLE_US
from packetloom.operators.prototypes import FILTERED, predict_centroids
from packetloom.operators.windows import segment_columns

CLUMP_OUT = ("source_id string, key string, flow_start_us long, clump_no long, size long, pkt_count long, direction int, "
             "start_us long, end_us long, interarrival_us long, delay_us long")
FLOW_OUT = ("source_id string, key string, client string, start_us long, end_us long, "
            "packet_count long, byte_count long, clump_count long")
WINDOW_OUT = "source_id string, key string, flow_start_us long, window_index long, steps array<array<bigint>>"
OUTPUTS = {"clumps": CLUMP_OUT, "flows": FLOW_OUT, "windows": WINDOW_OUT}
STEP = "size long, pkt_count long, direction long, duration_us long, interarrival_us long"
OPEN = ("client", "start_us", "last_us", "packets", "bytes", "clump_no", "size", "pkt_count", "direction", "clump_start",
        "clump_end", "gap")
# Rows of 64-bit numbers, in which texts are places in ``names``: packets (source, key, ts_us, packet_no, length, sender),
# open flows (source, key, OPEN), clumps of a window (source, key, STEP).
STATE = "names array<string>, waiting binary, flows binary, steps binary, wake long"
COLUMNS = ["source_id", "key", "ts_us", "packet_no", "length", "sender"]

BUCKETS = 4_096


def _rows(raw: bytes, width: int) -> list[list[int]]:
    return np.frombuffer(raw, np.int64).reshape(-1, width).tolist()


def _raw(rows: list[tuple]) -> bytes:
    return np.array(rows, np.int64).tobytes()


class FlowProcessor(StatefulProcessor):
    """Feeds packets in time order to one open flow per key; emits closed clumps, closed flows, or windows of clumps.

    A window is emitted with each clump that closes once there are ``longest``; a flow that ends before gives one
    window of the clumps it has.  Groups are buckets of keys.
    """

    def __init__(self, emit: str, idle_us: int, timeout_us: int, longest: int = 1):
        self.emit, self.idle_us, self.timeout_us, self.longest = emit, idle_us, timeout_us, longest

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("keys", STATE)

    def handleInputRows(self, key, rows, timerValues):
        fresh = []
        for part in rows:
            fresh += zip(*[part[c].tolist() for c in COLUMNS])
        yield from self._advance(fresh, timerValues.getCurrentWatermarkInMs() * 1000, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance([], timerValues.getCurrentWatermarkInMs() * 1000, expiredTimerInfo.getExpiryTimeInMs())

    def close(self):
        pass

    def _advance(self, fresh, watermark_us, expired):
        """Output of all keys of a bucket up to the watermark; ``expired`` is a timer that Spark deletes by itself."""
        packets, flows, rings, set_to = self._held()
        ready, later = defaultdict(list), []
        for packet in [*packets, *fresh]:
            if packet[2] <= watermark_us:
                ready[packet[:2]].append(packet[2:])
            else:
                later.append(packet)
        out, still = [], {}
        for key in {**flows, **ready}:
            flow, self.steps = flows.get(key), rings.get(key, [])
            for packet in sorted(ready.get(key, ())):
                flow = self._feed(key, flow, packet, out)
            if flow and watermark_us - flow["last_us"] > self.idle_us:
                self._close_flow(key, flow, out)
                flow = None
            if flow:
                still[key], rings[key] = flow, self.steps
        self._hold(later, still, rings, set_to, expired)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUTS[self.emit].split(", ")])

    def _held(self):
        held = self.state.get()
        if held is None:
            return [], {}, {}, None
        names, waiting, flows, steps, wake = held
        packets = [(names[s], names[k], ts, no, length, names[who])
                   for s, k, ts, no, length, who in _rows(waiting, len(COLUMNS))]
        found, rings = {}, defaultdict(list)
        for s, k, client, *rest in _rows(flows, 2 + len(OPEN)):
            found[names[s], names[k]] = dict(zip(OPEN, (names[client], *rest)))
        for s, k, *step in _rows(steps, 2 + len(STEP.split(", "))):
            rings[names[s], names[k]].append(tuple(step))
        return packets, found, rings, wake

    def _hold(self, later, flows, rings, set_to, expired):
        due = [p[2] // 1000 + 1 for p in later] + [(f["last_us"] + self.idle_us) // 1000 + 1 for f in flows.values()]
        wake = min(due, default=None)
        if wake != set_to:
            if set_to is not None and set_to != expired:
                self.handle.deleteTimer(set_to)
            if wake is not None:
                self.handle.registerTimer(wake)
        if wake is None:
            self.state.clear()
            return
        names = {}

        def at(name):
            return names.setdefault(name, len(names))
        waiting = [(at(s), at(k), ts, no, length, at(who)) for s, k, ts, no, length, who in later]
        held = [(at(s), at(k), at(f["client"]), *[f[c] for c in OPEN[1:]]) for (s, k), f in flows.items()]
        steps = [(at(key[0]), at(key[1]), *step) for key in flows for step in rings[key]]
        self.state.update((list(names), _raw(waiting), _raw(held), _raw(steps), wake))

    def _feed(self, key, flow, packet, out):
        ts, _, length, sender = packet
        if flow and ts - flow["last_us"] > self.idle_us:
            self._close_flow(key, flow, out)
            flow = None
        if flow is None:
            return dict(client=sender, start_us=ts, last_us=ts, packets=1, bytes=length, clump_no=0, size=length,
                        pkt_count=1, direction=0, clump_start=ts, clump_end=ts, gap=0)
        direction = 0 if sender == flow["client"] else 1
        if direction != flow["direction"] or ts - flow["clump_end"] > self.timeout_us:
            self._close_clump(key, flow, out)
            flow.update(clump_no=flow["clump_no"] + 1, size=0, pkt_count=0, direction=direction, clump_start=ts,
                        gap=ts - flow["clump_end"])
        flow.update(size=flow["size"] + length, pkt_count=flow["pkt_count"] + 1, clump_end=ts, last_us=ts,
                    packets=flow["packets"] + 1, bytes=flow["bytes"] + length)
        return flow

    def _close_clump(self, key, flow, out):
        if self.emit == "clumps":
            out.append((*key, flow["start_us"], flow["clump_no"], flow["size"], flow["pkt_count"], flow["direction"],
                        flow["clump_start"], flow["clump_end"], flow["gap"], flow["clump_end"] - flow["start_us"]))
        elif self.emit == "windows":
            self.steps.append((flow["size"], flow["pkt_count"], flow["direction"],
                               flow["clump_end"] - flow["clump_start"], flow["gap"]))
            if len(self.steps) == self.longest:
                out.append((*key, flow["start_us"], flow["clump_no"] + 1 - self.longest, list(map(list, self.steps))))
                self.steps.pop(0)

    def _close_flow(self, key, flow, out):
        self._close_clump(key, flow, out)
        if self.emit == "flows":
            out.append((*key, flow["client"], flow["start_us"], flow["last_us"], flow["packets"], flow["bytes"],
                        flow["clump_no"] + 1))
        elif self.emit == "windows" and flow["clump_no"] + 1 < self.longest:
            out.append((*key, flow["start_us"], 0, list(map(list, self.steps))))
        self.steps = []


def _keyed(packets: DataFrame, delay: str):
    rows = packets.withWatermark("ts", delay).select(
        "source_id", "key", "packet_no", F.col("ts_us").cast("long").alias("ts_us"), F.col("length").cast("long").alias("length"),
        "sender", "ts", F.pmod(F.xxhash64("source_id", "key"), F.lit(BUCKETS)).alias("bucket"))
    return rows.groupBy("bucket")


def stream_flows(packets: DataFrame, delay: str = "10 seconds", idle_us: int = IDLE_US) -> DataFrame:
    """A row per flow, once its idle time has passed in event time."""
    return _keyed(packets, delay).transformWithStateInPandas(
        FlowProcessor("flows", idle_us, TIMEOUT_US), FLOW_OUT, "append", "EventTime")


def stream_clumps(packets: DataFrame, delay: str = "10 seconds", idle_us: int = IDLE_US,
                  timeout_us: int = TIMEOUT_US) -> DataFrame:
    """A row per clump as soon as it is closed, with the time since the flow began as ``delay_us``."""
    return _keyed(packets, delay).transformWithStateInPandas(
        FlowProcessor("clumps", idle_us, timeout_us), CLUMP_OUT, "append", "EventTime")


def early_decisions(clumps: DataFrame, length: int) -> DataFrame:
    """The moment a flow has its first ``length`` clumps: enough for a first verdict."""
    return clumps.filter(F.col("clump_no") == length - 1).select(
        "source_id", "key", "flow_start_us", F.lit(length).alias("window_size"), "delay_us")


def stream_windows(packets: DataFrame, longest: int, delay: str = "10 seconds", idle_us: int = IDLE_US,
                   timeout_us: int = TIMEOUT_US) -> DataFrame:
    """A row per window of ``longest`` clumps as soon as its last clump is closed.

    ``steps`` are [size, packets, direction, duration, gap] of its clumps; fewer than ``longest`` only in window 0 of a
    flow that ended before.
    """
    return _keyed(packets, delay).transformWithStateInPandas(
        FlowProcessor("windows", idle_us, timeout_us, longest), WINDOW_OUT, "append", "EventTime")


def window_segments(windows: DataFrame, length: int) -> DataFrame:
    """``windows`` with the eight segment features of their first ``length`` steps."""
    steps = F.slice("steps", 1, length)

    def total(of):
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, s: acc + of(s))
    size = lambda s: s[0]
    return windows.select("*", *segment_columns(
        length, n=F.size(steps), size=total(size), square=total(lambda s: s[0] * s[0]),
        largest=F.array_max(F.transform(steps, size)).cast("double"), packets=total(lambda s: s[1]),
        span=total(lambda s: s[3]), gap=total(lambda s: s[4]),
        forward=total(lambda s: F.when(s[2] == 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))))


def stream_verdicts(packets: DataFrame, stage1: DataFrame, stage2: DataFrame, lengths: tuple[int, int] = (6, 3),
                    forward: str = "doh", **options) -> DataFrame:
    """Verdicts on live flows: the cascade over each window as it fills.

    ``stage1`` and ``stage2`` are centroid models for ``lengths`` clumps.  Windows that stage 1 does not ``forward`` are
    filtered; the others get the verdict of stage 2 on their first clumps.
    """
    rows = stream_windows(packets, max(lengths), **options)
    keys = ["source_id", "key", "flow_start_us", "window_index"]
    one = predict_centroids(window_segments(rows, lengths[0]), stage1).select(
        *keys, "steps", F.col("predicted").alias("l1_predicted"), F.col("total_span").alias("l1_delay_s"))
    two = predict_centroids(window_segments(one, lengths[1]), stage2)
    passed = F.col("l1_predicted") == forward
    return two.select(*keys, "l1_predicted", "l1_delay_s",
                      F.when(passed, F.col("predicted")).otherwise(FILTERED).alias("verdict"),
                      F.when(passed, F.col("total_span")).otherwise(0.0).alias("l2_delay_s"))


def numbered(rows: DataFrame, start: str = "flow_start_us") -> DataFrame:
    """``flow_no`` of finished flows, or of their clumps: flows of a key counted by their start."""
    order = Window.partitionBy("source_id", "key").orderBy(start)
    return rows.withColumn("flow_no", F.dense_rank().over(order).cast("long") - 1)


def late_rows(query: StreamingQuery) -> int:
    """Packets that a query has dropped since the watermark had passed them, over the progress it still remembers."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """Rows of state after the last batch of a query."""
    return sum(int(op["numRowsTotal"]) for op in query.lastProgress["stateOperators"])


def stream_sessions(packets: DataFrame, delay: str = "10 seconds", idle: str = "40 seconds") -> DataFrame:
    """Flow summaries by built-in session windows: no packets in state, merged before the shuffle."""
    return (packets.withWatermark("ts", delay).groupBy("source_id", "key", F.session_window("ts", idle).alias("w"))
            .agg(F.count(F.lit(1)).alias("packet_count"), F.sum("length").alias("byte_count"),
                 F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
            .drop("w"))


def stream_rates(packets: DataFrame, width: str, slide: str | None = None, delay: str = "10 seconds",
                 by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Packets and bytes per tumbling or sliding window."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (packets.withWatermark("ts", delay).groupBy(*by, span.alias("w"))
            .agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"))
            .select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "packets", "bytes"))
