"""Flow assembly, clumps, windows and delays over ``events``."""

from pyspark.sql import functions as F

from catalog.registry import Registry
from catalog.tables import (CLUMPS_SQL, FLOWS_SQL, IDLE_US, PACKETS_SQL, TIMEOUT_US, event_packets, load,
                            micros)
from packetloom.functions import endpoints, scaling
from packetloom.operators import clumps as C
from packetloom.operators import delay as D
from packetloom.operators import flows as L
from packetloom.operators import windows as W
from packetloom.operators.stats import flow_statistics
from packetloom.schema import CLUMP, FLOW

REGISTRY = Registry()
query = REGISTRY.query


def flow_packets(spark, sf):
    return L.split_flows(event_packets(spark, sf), IDLE_US)


def event_clumps(spark, sf):
    return C.packets_to_clumps(event_packets(spark, sf), IDLE_US, TIMEOUT_US)


FLOW_COLS = "source_id, key, flow_no"


@query(f"WITH {FLOWS_SQL} SELECT {FLOW_COLS}, packet_no, ts_us, length, direction FROM flow_packets")
def flows_idle_split(spark, sf):
    return flow_packets(spark, sf).select(*FLOW, "packet_no", "ts_us", "length", "direction")


@query(f"""WITH {FLOWS_SQL}
SELECT {FLOW_COLS}, arg_min(ts_us, packet_no) AS start_us, max(ts_us) AS end_us, count(*) AS packet_count,
       CAST(sum(length) AS BIGINT) AS byte_count, false AS truncated,
       greatest(0, max(ts_us) - arg_min(ts_us, packet_no)) AS duration_us
FROM flow_packets GROUP BY 1, 2, 3""")
def flow_summary(spark, sf):
    return L.summarise_flows(flow_packets(spark, sf))


def endpoint_events(spark, sf):
    """Events between 50 low and 50 high endpoints; errors carry a reset flag."""
    e = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.lit("events").alias("source_id"), F.col("event_id").alias("packet_no"),
        micros("ts").alias("ts_us"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")).alias("src_ip"),
        (F.col("user_id") % 3 + 1000).cast("int").alias("src_port"),
        F.concat(F.lit("10.0.0."), (k % 50).cast("string")).alias("dst_ip"),
        (k % 3 + 1000).alias("dst_port"),
        F.when(F.col("event_type") == "error", 4).otherwise(16).alias("flags"),
        F.round(F.col("value") * 100).cast("long").alias("app_bytes"))


ENDPOINT_SQL = """
raw AS (
  SELECT event_id AS packet_no, epoch_us(ts) AS ts_us, event_type,
         CAST(round(value * 100) AS BIGINT) AS length,
         '10.0.0.' || CAST(user_id % 50 AS VARCHAR) AS src_ip, CAST(user_id % 3 + 1000 AS INTEGER) AS src_port,
         '10.0.0.' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 50 AS VARCHAR) AS dst_ip,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 + 1000 AS INTEGER) AS dst_port
  FROM events),
ends AS (
  SELECT packet_no, ts_us, length, src_ip || ':' || src_port AS sender, dst_ip || ':' || dst_port AS receiver,
         (src_ip < dst_ip) OR (src_ip = dst_ip AND src_port <= dst_port) AS low_first
  FROM raw WHERE event_type <> 'error' AND length >= 40),
keyed AS (
  SELECT packet_no, ts_us, length, sender,
         CASE WHEN low_first THEN sender || '|' || receiver ELSE receiver || '|' || sender END AS key
  FROM ends),
marked AS (
  SELECT *, CASE WHEN coalesce(ts_us - max(ts_us) OVER (PARTITION BY key ORDER BY packet_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > IDLE, true) THEN 1 ELSE 0 END AS opens FROM keyed),
counted AS (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY key ORDER BY packet_no) - 1 AS BIGINT) AS flow_no FROM marked)
""".replace("IDLE", str(400_000 * 1_000_000))


@query(f"""WITH {ENDPOINT_SQL}
SELECT 'events' AS source_id, key, flow_no, packet_no, length,
       CASE WHEN sender = first_value(sender) OVER (PARTITION BY key, flow_no ORDER BY packet_no)
            THEN 0 ELSE 1 END AS direction
FROM counted""")
def flows_bidirectional_key(spark, sf):
    packets = L.accept_packets(endpoint_events(spark, sf))
    flows = L.split_flows(packets, 400_000 * 1_000_000)
    return flows.select(*FLOW, "packet_no", "length", "direction")


@query("""WITH raw AS (
  SELECT event_id AS packet_no, event_type, CAST(round(value * 100) AS BIGINT) AS length,
         user_id % 7 AS up, CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS kp FROM events)
SELECT packet_no, CASE WHEN up = 0 THEN 443 ELSE 1000 + up END AS src_port,
       CASE WHEN kp = 0 THEN 443 ELSE 1000 + kp END AS dst_port, length AS payload_bytes
FROM raw WHERE event_type NOT IN ('error', 'signup') AND length > 0 AND length + 40 > 66 AND (up = 0 OR kp = 0)""")
def strict_packets(spark, sf):
    e = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 7
    port = lambda x: F.when(x == 0, F.lit(443)).otherwise(x + 1000).cast("long")
    length = F.round(F.col("value") * 100).cast("long")
    flags = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "signup", 17).otherwise(16)
    packets = e.select(F.col("event_id").alias("packet_no"), port(F.col("user_id") % 7).alias("src_port"),
                       port(k).alias("dst_port"), length.alias("payload_bytes"),
                       (length + 40).alias("frame_bytes"), flags.alias("flags"))
    kept = packets.filter(endpoints.strict_packet_filter(
        "flags", "payload_bytes", "frame_bytes", "src_port", "dst_port"))
    return kept.select("packet_no", "src_port", "dst_port", "payload_bytes")


@query(f"""WITH {PACKETS_SQL}, sized AS (
  SELECT *, sum(length) OVER (PARTITION BY source_id ORDER BY packet_no) AS upto,
         row_number() OVER (PARTITION BY source_id ORDER BY packet_no) AS n,
         (SELECT count(*) FROM packets) AS total, (SELECT sum(length) FROM packets) AS bytes FROM packets)
SELECT source_id, key, packet_no, length FROM sized WHERE n <= 9000 AND upto <= 40000000""")
def packet_caps(spark, sf):
    capped = L.cap_captures(event_packets(spark, sf), max_packets=9_000, max_bytes=40_000_000)
    return capped.select("source_id", "key", "packet_no", "length")


@query(f"""WITH {FLOWS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, key, flow_no ORDER BY packet_no) AS n FROM flow_packets)
SELECT {FLOW_COLS}, packet_no, length FROM ranked WHERE n <= 4""")
def flow_packet_cap(spark, sf):
    return L.cap_flow_packets(flow_packets(spark, sf), max_packets=4).select(*FLOW, "packet_no", "length")


@query(f"""WITH RECURSIVE {FLOWS_SQL}, ranked AS (
  SELECT source_id, key, flow_no, packet_no, length,
         row_number() OVER (PARTITION BY source_id, key, flow_no ORDER BY packet_no) AS n FROM flow_packets),
fold AS (
  SELECT source_id, key, flow_no, packet_no, length, n, length <= 9000 AS fits,
         CASE WHEN length <= 9000 THEN length ELSE 0 END AS used,
         CASE WHEN length <= 9000 THEN 1 ELSE 0 END AS kept FROM ranked WHERE n = 1
  UNION ALL
  SELECT r.source_id, r.key, r.flow_no, r.packet_no, r.length, r.n,
         f.kept < 6 AND f.used + r.length <= 9000,
         CASE WHEN f.kept < 6 AND f.used + r.length <= 9000 THEN f.used + r.length ELSE f.used END,
         CASE WHEN f.kept < 6 AND f.used + r.length <= 9000 THEN f.kept + 1 ELSE f.kept END
  FROM fold f JOIN ranked r ON r.key = f.key AND r.flow_no = f.flow_no AND r.n = f.n + 1)
SELECT {FLOW_COLS}, packet_no, length FROM fold WHERE fits""")
def flow_byte_cap(spark, sf):
    kept = L.cap_flow_packets(flow_packets(spark, sf), max_packets=6, max_bytes=9_000)
    return kept.select(*FLOW, "packet_no", "length")


@query(f"""WITH {CLUMPS_SQL}
SELECT {FLOW_COLS}, clump_no, size, pkt_count, direction, start_us, end_us, duration_us, interarrival_us
FROM clumps""")
def clumps(spark, sf):
    return event_clumps(spark, sf)


@query(f"""WITH {CLUMPS_SQL}
SELECT {FLOW_COLS}, clump_no, round(duration_us / 1e6, 6) AS duration,
       round(interarrival_us / 1e6, 6) AS interarrival FROM clumps""")
def clump_gaps(spark, sf):
    seconds = C.add_clump_seconds(event_clumps(spark, sf))
    return seconds.select(*CLUMP, F.round("duration", 6).alias("duration"),
                          F.round("interarrival", 6).alias("interarrival"))


SWEEP_US = [3_600_000_000, 21_600_000_000, 86_400_000_000]


@query(f"""WITH {FLOWS_SQL},
timeouts AS (SELECT unnest([{', '.join(map(str, SWEEP_US))}]) AS timeout_us),
lagged AS (
  SELECT f.*, t.timeout_us, lag(ts_us) OVER w AS prev_ts, lag(direction) OVER w AS prev_dir
  FROM flow_packets f CROSS JOIN timeouts t
  WINDOW w AS (PARTITION BY source_id, key, flow_no, timeout_us ORDER BY ts_us, packet_no)),
opened AS (
  SELECT *, prev_ts IS NULL OR direction <> prev_dir OR ts_us - prev_ts > timeout_us AS opens FROM lagged)
SELECT CAST(timeout_us AS BIGINT) AS timeout_us, count(*) FILTER (opens) AS clumps,
       count(DISTINCT key || '|' || flow_no) AS flows, count(*) AS packets FROM opened GROUP BY 1""")
def clump_timeout_sweep(spark, sf):
    swept = C.timeout_sweep(flow_packets(spark, sf), SWEEP_US)
    return swept.groupBy("timeout_us").agg(
        F.count(F.lit(1)).alias("clumps"), F.sum(F.when(F.col("clump_no") == 0, 1).otherwise(0)).alias("flows"),
        F.sum("pkt_count").alias("packets"))


def text_of(features):
    """Windows as text, so two engines compare them as one value."""
    step = lambda s: F.array_join(F.transform(s, lambda x: F.round(x.cast("double"), 6).cast("decimal(20,6)").cast("string")), ",")
    return F.array_join(F.transform(features, step), ";")


STRUCT_TEXT = "array_join(transform(features, s -> concat_ws(',', s.size, s.pkt_count, s.direction, s.duration_us, s.interarrival_us)), ';')"
RAW_STEP = "concat_ws(',', size, pkt_count, direction, duration_us, interarrival_us)"


def windows_sql(length, step, pad, extra="", padded=True, stride=1):
    """Windows from a list over a forward frame; short flows are filled with ``pad``."""
    short = f"OR (len(steps) < {length} AND clump_no = 0)" if padded else ""
    return f"""WITH {CLUMPS_SQL}, framed AS (
  SELECT *, list({step}) OVER (PARTITION BY source_id, key, flow_no ORDER BY clump_no
                               ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING) AS steps FROM clumps),
kept AS (SELECT * FROM framed WHERE (len(steps) = {length} AND clump_no % {stride} = 0) {short})
SELECT {FLOW_COLS}, CAST(clump_no // {stride} AS BIGINT) AS window_index, len(steps) < {length} AS is_padded,
       CAST({length} - len(steps) AS INTEGER) AS pad_count,
       array_to_string(list_concat(steps, list_transform(range({length} - len(steps)), lambda i: '{pad}')), ';') AS features
       {extra} FROM kept"""


@query(windows_sql(3, RAW_STEP, "0,0,0,0,0", padded=False))
def raw_windows_l3(spark, sf):
    return W.raw_windows(event_clumps(spark, sf), 3, pad=False).withColumn("features", F.expr(STRUCT_TEXT))


@query(windows_sql(6, RAW_STEP, "0,0,0,0,0", stride=2))
def raw_windows_padded_l6(spark, sf):
    return W.raw_windows(event_clumps(spark, sf), 6, stride=2).withColumn("features", F.expr(STRUCT_TEXT))


def six(x):
    return f"CAST(CAST(round({x}, 6) AS DECIMAL(20,6)) AS VARCHAR)"


SCALED_STEP = "concat_ws(',', " + ", ".join(map(six, [
    "(log10(greatest(1e-12, interarrival_us / 1e6)) + 12.0) / 10.0",
    "(log10(greatest(1e-12, duration_us / 1e6)) + 12.0) / 10.0",
    "(log10(least(1e4, greatest(1e-12, CAST(size AS DOUBLE)))) - 0.5) / 3.5",
    "log2(CAST(least(256, greatest(1, pkt_count)) AS DOUBLE)) / 8.0",
    "CASE direction WHEN 0 THEN 1.0 ELSE -1.0 END"])) + ")"
PAD_TEXT = "-1.000000,-1.000000,-1.000000,-1.000000,0.000000"


@query(windows_sql(6, SCALED_STEP, PAD_TEXT))
def scaled_windows_l6(spark, sf):
    out = W.scaled_windows(event_clumps(spark, sf), 6)
    return out.withColumn("features", text_of(F.col("features")))


@query(f"""WITH base AS ({windows_sql(6, SCALED_STEP, PAD_TEXT)})
SELECT {FLOW_COLS}, window_index,
       repeat('1', 6 - pad_count) || repeat('0', pad_count) AS mask FROM base""")
def window_mask(spark, sf):
    out = W.scaled_windows(event_clumps(spark, sf), 6)
    mask = F.transform(scaling.step_mask(F.col("features")), lambda m: m.cast("int").cast("string"))
    return out.select(*FLOW, "window_index", F.array_join(mask, "").alias("mask"))


@query(f"""WITH {CLUMPS_SQL}, sizes AS (SELECT source_id, key, flow_no, count(*) AS n FROM clumps GROUP BY 1, 2, 3)
SELECT CAST(l AS INTEGER) AS window_size, CAST(sum(greatest(n - l + 1, 1)) AS BIGINT) AS windows,
       count(*) FILTER (n < l) AS padded, CAST(sum(greatest(l - n, 0)) AS BIGINT) AS pad_steps
FROM sizes CROSS JOIN (SELECT unnest(range(1, 11)) AS l) GROUP BY 1""")
def window_sweep(spark, sf):
    swept = W.window_sweep(event_clumps(spark, sf), list(range(1, 11)))
    return swept.groupBy("window_size").agg(
        F.count(F.lit(1)).alias("windows"), F.sum(F.col("is_padded").cast("long")).alias("padded"),
        F.sum("pad_count").alias("pad_steps"))


@query(f"""WITH {CLUMPS_SQL}, framed AS (
  SELECT *, count(*) OVER f AS n, sum(size) OVER f AS ss, max(size) OVER f AS mx, sum(pkt_count) OVER f AS sp,
         sum(duration_us) OVER f AS sd, sum(interarrival_us) OVER f AS sg,
         sum(size * size) OVER f AS sq, sum(CASE WHEN direction = 0 THEN 1 ELSE 0 END) OVER f AS fw
  FROM clumps WINDOW f AS (PARTITION BY source_id, key, flow_no ORDER BY clump_no
                           ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
SELECT {FLOW_COLS}, clump_no AS window_index, round(ss / 6.0, 8) AS mean_size, CAST(mx AS DOUBLE) AS max_size,
       round(sp / 6.0, 8) AS mean_pkts, round(sd / 6e6, 8) AS mean_duration, round(sg / 6e6, 8) AS mean_interarrival,
       round(sqrt(CAST(6 * sq - ss * ss AS DOUBLE)) / 6, 8) AS std_size, round((fw + 6 - n) / 6.0, 8) AS forward_share,
       round((sd + sg) / 1e6, 8) AS total_span
FROM framed WHERE n = 6 OR clump_no = 0""")
def segment_features(spark, sf):
    out = W.segment_features(event_clumps(spark, sf), 6)
    places = {c: 8 for c in out.columns if c not in FLOW + ["window_index", "max_size"]}
    return out.withColumns({c: F.round(c, p) for c, p in places.items()})


@query(f"""WITH {CLUMPS_SQL}
SELECT {FLOW_COLS}, CAST(sum(duration_us + interarrival_us) AS BIGINT) AS delay_us
FROM clumps WHERE clump_no < 6 GROUP BY 1, 2, 3""")
def collection_delay(spark, sf):
    return W.collection_delay(event_clumps(spark, sf), 6)


@query(f"""WITH {CLUMPS_SQL}
SELECT {FLOW_COLS}, max(end_us) - min(start_us) AS delay_us FROM clumps WHERE clump_no < 6 GROUP BY 1, 2, 3""")
def detection_delay_check(spark, sf):
    return W.detection_delay(event_clumps(spark, sf), 6)


@query(f"""WITH base AS ({windows_sql(6, SCALED_STEP, PAD_TEXT)})
SELECT source_id || '|' || key || '|' || flow_no AS flow_id, pad_count, features
FROM base WHERE window_index = 0 ORDER BY flow_id LIMIT 500""")
def first_window_per_flow(spark, sf):
    out = W.scaled_windows(event_clumps(spark, sf), 6).withColumn("flow_id", L.flow_id())
    out = W.first_windows(out, 500)
    return out.select("flow_id", "pad_count", text_of(F.col("features")).alias("features"))


def stats_sql(value, unit, places=6):
    cell = lambda x, n: f"round(coalesce({x} / {unit}, 0.0), {places}) AS {n}_seconds, round(coalesce({x} / {unit}, 0.0) * 1000.0, {places - 3}) AS {n}_ms"
    return ", ".join([
        f"count({value}) AS count", cell(f"avg({value})", "mean"), cell(f"quantile_cont({value}, 0.5)", "median"),
        cell(f"quantile_cont({value}, 0.5)", "p50"), cell(f"quantile_cont({value}, 0.95)", "p95"),
        cell(f"quantile_cont({value}, 0.99)", "p99"), cell(f"min({value})", "min"), cell(f"max({value})", "max"),
        cell(f"stddev_pop({value})", "std")])


def round_stats(df, places=6):
    return df.select(*[F.round(c, places if c.endswith("_seconds") else places - 3).alias(c)
                       if c.endswith(("_seconds", "_ms")) else F.col(c) for c in df.columns])


@query(f"""WITH {CLUMPS_SQL}, options AS (SELECT unnest([3, 6, 10]) AS window_size),
delays AS (SELECT source_id, key, flow_no, window_size, CAST(sum(duration_us + interarrival_us) AS DOUBLE) AS d
           FROM clumps, options WHERE clump_no < window_size GROUP BY 1, 2, 3, 4)
SELECT window_size, {stats_sql('d', '1e6', 4)} FROM delays GROUP BY 1""")
def delay_summary(spark, sf):
    return round_stats(W.delay_by_length(event_clumps(spark, sf), [3, 6, 10]), 4)


def timed_rows(spark, sf):
    """Per-sample times: collection from clumps, the other two from the flow's own numbers."""
    c = event_clumps(spark, sf)
    return (c.filter(F.col("clump_no") < 6).groupBy(*FLOW)
            .agg((F.sum(F.col("duration_us") + F.col("interarrival_us")) / 1e6).alias("collection_s"),
                 (F.sum("pkt_count") / 1e4).alias("prep_s"), (F.sum("size") / 1e6).alias("infer_s"))
            .withColumn("model", F.when(F.col("key").cast("long") % 2 == 0, "even").otherwise("odd")))


TIMED_SQL = CLUMPS_SQL + """, timed AS (
  SELECT sum(duration_us + interarrival_us) / 1e6 AS collection_s, sum(pkt_count) / 1e4 AS prep_s,
         sum(size) / 1e6 AS infer_s, CASE WHEN CAST(key AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS model
  FROM clumps WHERE clump_no < 6 GROUP BY source_id, key, flow_no)"""


@query(f"""WITH {TIMED_SQL}
SELECT model, count(*) AS sample_count, round(count(*) / sum(infer_s), 2) AS infer_throughput_samples_per_second
FROM timed GROUP BY 1""")
def throughput(spark, sf):
    return D.throughput(timed_rows(spark, sf), ["model"])


def bench_sql():
    out = []
    for name, value, unit, scale in [("collection", "collection_s", "seconds", 1), ("prep", "prep_s", "ms", 1000),
                                     ("infer", "infer_s", "ms", 1000),
                                     ("e2e", "collection_s + prep_s + infer_s", "seconds", 1)]:
        for stat, agg in [("mean", "avg({})"), ("median", "quantile_cont({}, 0.5)"), ("p50", "quantile_cont({}, 0.5)"),
                          ("p95", "quantile_cont({}, 0.95)"), ("p99", "quantile_cont({}, 0.99)"), ("min", "min({})"),
                          ("max", "max({})"), ("std", "stddev_pop({})")]:
            out.append(f"round({agg.format(value)} * {scale}.0, 3) AS {name}_{stat}_{unit}")
    return ", ".join(out)


@query(f"""WITH {TIMED_SQL}
SELECT model, count(*) AS sample_count, round(count(*) / sum(infer_s), 2) AS infer_throughput_samples_per_second,
       {bench_sql()}, 1 AS batch_size FROM timed GROUP BY 1""")
def delay_benchmark(spark, sf):
    flat = D.delay_benchmark(timed_rows(spark, sf), ["model"])
    return flat.select(*[F.round(c, 3).alias(c) if c.endswith(("_seconds", "_ms")) else F.col(c)
                         for c in flat.columns])


@query(f"""WITH {PACKETS_SQL}, odd AS (
  SELECT source_id, key, packet_no, ts_us - CASE WHEN packet_no % 17 = 0 THEN 200000000000 ELSE 0 END AS ts_us,
         CASE WHEN packet_no % 31 = 0 THEN -length ELSE length END AS length,
         CASE WHEN packet_no % 29 = 0 THEN 7 ELSE direction END AS direction FROM packets),
lagged AS (SELECT *, lag(ts_us) OVER (PARTITION BY source_id, key ORDER BY packet_no) AS prev FROM odd)
SELECT source_id, key, packet_no, 'negative_length' AS fault FROM lagged WHERE length < 0
UNION ALL SELECT source_id, key, packet_no, 'bad_direction' FROM lagged WHERE direction NOT IN (0, 1)
UNION ALL SELECT source_id, key, packet_no, 'time_goes_back' FROM lagged WHERE ts_us < prev""")
def packet_checks(spark, sf):
    odd = event_packets(spark, sf).withColumns({
        "ts_us": F.col("ts_us") - F.when(F.col("packet_no") % 17 == 0, F.lit(200_000_000_000)).otherwise(F.lit(0)),
        "length": F.when(F.col("packet_no") % 31 == 0, -F.col("length")).otherwise(F.col("length")),
        "direction": F.when(F.col("packet_no") % 29 == 0, 7).otherwise(F.col("direction"))})
    return L.packet_faults(odd)


# Added before rounding, so that exact halves fall the same way in both engines.
NUDGE = {6: 1.3e-9, 1: 0.00137}

SHAPES = [("PacketLength", "length", "1.0"), ("PacketTime", "gap", "1e6"), ("ResponseTimeTime", "reply", "1e6")]


def shape_sql(name, x, unit):
    mean, med, sd = f"avg({x}) / {unit}", f"quantile_cont({x}, 0.5) / {unit}", f"nullif(stddev_pop({x}), 0) / {unit}"
    r = lambda e, p=6: f"round({e} + {NUDGE[p]}, {p})"
    mode = f"any_value({x}_mode) / {unit}"
    return ", ".join([
        f"{r(f'var_pop({x}) / ({unit} * {unit})', 1)} AS {name}Variance",
        f"{r(f'stddev_pop({x}) / {unit}')} AS {name}StandardDeviation", f"{r(mean)} AS {name}Mean",
        f"{r(med)} AS {name}Median", f"{r(mode)} AS {name}Mode",
        f"{r(f'3.0 * ({mean} - {med}) / ({sd})')} AS {name}SkewFromMedian",
        f"{r(f'({mean} - {mode}) / ({sd})')} AS {name}SkewFromMode",
        f"{r(f'stddev_pop({x}) / nullif(avg({x}), 0)')} AS {name}CoefficientofVariation"])


def mode_sql(x):
    return f"""{x}_modes AS (
  SELECT source_id, key, flow_no, {x} AS {x}_mode FROM (
    SELECT source_id, key, flow_no, {x}, row_number() OVER (PARTITION BY source_id, key, flow_no
           ORDER BY count(*) DESC, {x}) AS r
    FROM timed WHERE {x} IS NOT NULL GROUP BY source_id, key, flow_no, {x}) WHERE r = 1)"""


@query(f"""WITH {FLOWS_SQL}, timed AS (
  SELECT *, ts_us - lag(ts_us) OVER w AS gap,
         CASE WHEN direction = 1 AND lag(direction) OVER w = 0 THEN ts_us - lag(ts_us) OVER w END AS reply
  FROM flow_packets WINDOW w AS (PARTITION BY source_id, key, flow_no ORDER BY ts_us, packet_no)),
{mode_sql('length')}, {mode_sql('gap')}, {mode_sql('reply')},
full_rows AS (
  SELECT t.*, lm.length_mode, gm.gap_mode, rm.reply_mode FROM timed t
  LEFT JOIN length_modes lm USING (source_id, key, flow_no) LEFT JOIN gap_modes gm USING (source_id, key, flow_no)
  LEFT JOIN reply_modes rm USING (source_id, key, flow_no))
SELECT {FLOW_COLS}, round((max(ts_us) - min(ts_us)) / 1e6, 6) AS Duration,
  CAST(sum(CASE WHEN direction = 0 THEN length ELSE 0 END) AS DOUBLE) AS FlowBytesSent,
  round(sum(CASE WHEN direction = 0 THEN length ELSE 0 END) / nullif((max(ts_us) - min(ts_us)) / 1e6, 0), 6) AS FlowSentRate,
  CAST(sum(CASE WHEN direction = 1 THEN length ELSE 0 END) AS DOUBLE) AS FlowBytesReceived,
  round(sum(CASE WHEN direction = 1 THEN length ELSE 0 END) / nullif((max(ts_us) - min(ts_us)) / 1e6, 0), 6) AS FlowReceivedRate,
  {', '.join(shape_sql(*s) for s in SHAPES)}
FROM full_rows GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def flow_statistics_28(spark, sf):
    out = flow_statistics(event_packets(spark, sf), IDLE_US)
    def tidy(c):
        if c in FLOW or c in ("FlowBytesSent", "FlowBytesReceived"):
            return F.col(c)
        if c.endswith("Variance"):
            return F.round(F.col(c) + NUDGE[1], 1).alias(c)
        if c in ("Duration", "FlowSentRate", "FlowReceivedRate"):
            return F.round(c, 6).alias(c)
        return F.round(F.col(c) + NUDGE[6], 6).alias(c)
    return out.select(*[tidy(c) for c in out.columns])
