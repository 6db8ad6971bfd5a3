"""Frames decoded from bytes, and streaming queries over ``events``."""

import uuid

from pyspark.sql import functions as F

from catalog.registry import Registry
from catalog.scoring import flow_truth, stage_sql
from catalog.sequence import event_clumps
from catalog.tables import CLUMPS_SQL, FLOWS_SQL, IDLE_US, PACKETS_SQL, TIMEOUT_US, load, micros
from packetloom.operators import prototypes as P
from packetloom.operators import windows as W
from packetloom.operators.ordered import materialize
from packetloom.schema import PACKETS
from packetloom.session import ensure_checkpoint_dir
from packetloom.sources.captures import decode_frames as decode
from packetloom.streaming import flows as R

REGISTRY = Registry()
query = REGISTRY.query


# The largest 16-bit length.
MOST = (1 << 16) - 1


def event_frames(spark, sf):
    """Each event as an Ethernet/IPv4/TCP frame with its TLS records, built byte by byte in Spark.

    What has no room in 16 bits is told as on a host that leaves cutting to its network card: the IPv4 length is 0, and
    the data are announced in equal records, of which the last breaks off so that the frame keeps its size.
    """
    e = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    size = F.round(F.col("value") * 100).cast("long")
    hexed = lambda x, digits: F.lpad(F.hex(x.cast("long")), digits, "0")
    flags = F.when(F.col("event_type") == "error", F.lit("04")).otherwise(F.lit("18"))
    n_records = F.greatest(F.ceil(size / MOST), F.lit(1)).cast("long")
    each = F.floor(size / n_records).cast("long")
    last = size - each * (n_records - 1)
    body = lambda n: F.repeat(F.lit("AB"), n.cast("int"))
    record = lambda n, held: F.concat(F.lit("170303"), hexed(n, 4), body(held))
    records = F.concat(F.repeat(record(each, each), (n_records - 1).cast("int")), record(last, last - 5 * (n_records - 1)))
    total = F.when(size + 45 <= MOST, size + 45).otherwise(0)
    text = F.concat(
        F.lit("020000000001020000000002" + "0800" + "4500"), hexed(total, 4), F.lit("00010000" + "4006" + "0000" + "0A0000"),
        hexed(F.col("user_id") % 50, 2), F.lit("0A0000"), hexed(k % 50, 2), hexed(F.col("user_id") % 3 + 1000, 4),
        hexed(k % 3 + 1000, 4), F.lit("00000001" + "00000001" + "50"), flags, F.lit("0400" + "0000" + "0000"),
        records)
    return e.select(F.lit("events").alias("source_id"), F.col("event_id").alias("packet_no"), micros("ts").alias("ts_us"),
                    F.unhex(text).alias("frame"))


@query("""WITH e AS (SELECT event_id, epoch_us(ts) AS ts_us, user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    event_type, CAST(round(value * 100) AS BIGINT) AS n FROM events)
SELECT 'events' AS source_id, event_id AS packet_no, ts_us, '10.0.0.' || (u % 50) AS src_ip, CAST(u % 3 + 1000 AS INTEGER) AS src_port,
  '10.0.0.' || (k % 50) AS dst_ip, CAST(k % 3 + 1000 AS INTEGER) AS dst_port, CASE WHEN event_type = 'error' THEN 4 ELSE 24 END AS flags,
  n + 59 AS frame_bytes, n + 5 AS payload_bytes, CASE WHEN n >= 40 THEN n END AS app_bytes FROM e""")
def decode_frames(spark, sf):
    return decode(event_frames(spark, sf)).select(*PACKETS.names)


def event_stream(spark, sf):
    """``events`` as a live stream of packets."""
    batch = spark.read.parquet(f"{sf}/events.parquet")
    return live_packets(spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def live_packets(events):
    return events.select(
        F.lit("events").alias("source_id"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("packet_no"),
        micros("ts").alias("ts_us"), F.round(F.col("value") * 100).cast("long").alias("length"),
        F.when(F.col("event_type").isin("click", "purchase", "signup"), "client").otherwise("server").alias("sender"),
        F.timestamp_micros(micros("ts")).alias("ts"))


def drain(spark, out):
    """Run a stream over what there is now, into files, and read those back."""
    path = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    done = (out.writeStream.format("parquet").option("path", f"{path}/data")
            .option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start())
    done.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/data")


DELAY_US = 10 * 1_000_000
# A batch over all rows leaves the watermark at the latest time (whole milliseconds) less the delay.
MARK = f"(SELECT max(ts_us) // 1000 * 1000 - {DELAY_US} FROM packets)"
SESSIONS_SQL = f"""{PACKETS_SQL},
gaps AS (SELECT *, CASE WHEN coalesce(ts_us - lag(ts_us) OVER (PARTITION BY key ORDER BY ts_us, packet_no) > {IDLE_US}, true)
         THEN 1 ELSE 0 END AS opens FROM packets WHERE ts_us <= {{upto}}),
flows AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY key ORDER BY ts_us, packet_no) - 1 AS BIGINT) AS flow_no FROM gaps)"""


@query(f"""WITH {SESSIONS_SQL.format(upto='(SELECT max(ts_us) FROM packets)')}
SELECT source_id, key, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count, min(ts_us) AS start_us, max(ts_us) AS end_us
FROM flows GROUP BY source_id, key, flow_no HAVING max(ts_us) + {IDLE_US} <= {MARK}""")
def stream_sessions(spark, sf):
    return drain(spark, R.stream_sessions(event_stream(spark, sf), idle="40000 seconds"))


def _state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query(f"""WITH {SESSIONS_SQL.format(upto=MARK)}
SELECT source_id, key, flow_no, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count, min(ts_us) AS start_us, max(ts_us) AS end_us
FROM flows GROUP BY source_id, key, flow_no HAVING (max(ts_us) + {IDLE_US}) // 1000 * 1000 + 1000 <= {MARK}""")
def stream_flows(spark, sf):
    _state_store(spark)
    out = R.numbered(drain(spark, R.stream_flows(event_stream(spark, sf), idle_us=IDLE_US)), "start_us")
    return out.select("source_id", "key", "flow_no", "packet_count", "byte_count", "start_us", "end_us")


@query(f"""WITH {PACKETS_SQL}, d AS (SELECT source_id, ts_us // 86400000000 AS day, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY 1, 2)
SELECT source_id, day, packets, bytes FROM d WHERE (day + 1) * 86400000000 <= {MARK}""")
def stream_rates(spark, sf):
    out = drain(spark, R.stream_rates(event_stream(spark, sf), "1 day"))
    day = F.floor(F.unix_micros("window_start") / 86_400_000_000).cast("long")
    return out.select("source_id", day.alias("day"), "packets", "bytes")


ARRIVALS = 3


def arrivals(spark, sf):
    """``events`` with the batch each arrives in: thirds of time, some rows one batch late."""
    rows = load(spark, sf, "events").withColumn("_us", micros("ts"))
    ends = rows.agg(F.min("_us").alias("lo"), F.max("_us").alias("hi")).first()
    third = F.expr(f"int((_us - {ends.lo}) * {ARRIVALS} div ({ends.hi} - {ends.lo} + 1))")
    held = (F.col("event_id") % 97 == 0).cast("int")
    return rows.withColumn("_batch", F.least(third + held, F.lit(ARRIVALS - 1))).drop("_us")


@query(f"""WITH {PACKETS_SQL},
ends AS (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM packets),
arrived AS (SELECT p.*, least((ts_us - lo) * {ARRIVALS} // (hi - lo + 1) + CASE WHEN packet_no % 97 = 0 THEN 1 ELSE 0 END, {ARRIVALS - 1}) AS batch
  FROM packets p, ends),
marks AS (SELECT b AS batch, max(ts_us) // 1000 * 1000 - {DELAY_US} AS mark FROM arrived, unnest(range(1, {ARRIVALS})) AS u(b) WHERE batch < b GROUP BY 1),
timely AS (SELECT a.*, coalesce(ts_us <= mark, false) AS late FROM arrived a LEFT JOIN marks USING (batch)),
gaps AS (SELECT *, CASE WHEN coalesce(ts_us - lag(ts_us) OVER (PARTITION BY key ORDER BY ts_us, packet_no) > {IDLE_US}, true)
         THEN 1 ELSE 0 END AS opens FROM timely WHERE NOT late AND ts_us <= {MARK}),
flows AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY key ORDER BY ts_us, packet_no) - 1 AS BIGINT) AS flow_no FROM gaps)
SELECT source_id, key, flow_no, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count, min(ts_us) AS start_us, max(ts_us) AS end_us,
  (SELECT count(*) FROM timely WHERE late) AS late_packets
FROM flows GROUP BY source_id, key, flow_no HAVING (max(ts_us) + {IDLE_US}) // 1000 * 1000 + 1000 <= {MARK}""")
def stream_replay(spark, sf):
    """Flows of a stream that arrives in three batches, and how many packets came too late; restarted between them."""
    _state_store(spark)
    path, late = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}", 0
    rows = materialize(arrivals(spark, sf))
    for batch in range(ARRIVALS):
        rows.filter(F.col("_batch") == batch).drop("_batch").write.mode("append").parquet(f"{path}/in")
        live = live_packets(spark.readStream.schema(rows.drop("_batch").schema).parquet(f"{path}/in"))
        out = R.stream_flows(live, idle_us=IDLE_US)
        done = (out.writeStream.format("parquet").option("path", f"{path}/data")
                .option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start())
        done.awaitTermination()
        late += R.late_rows(done)
    flows = R.numbered(spark.read.schema(out.schema).parquet(f"{path}/data"), "start_us")
    return flows.select("source_id", "key", "flow_no", "packet_count", "byte_count", "start_us", "end_us",
                        F.lit(late).cast("long").alias("late_packets"))


LENGTHS = (6, 3)


def live_rows_sql(name, length):
    """Window rows of ``stage_sql`` over the live clumps."""
    return stage_sql(name, length, "truth", "").split(f",\n{name}_train")[0].replace("FROM clumps)", "FROM live_clumps)")


def nearest_sql(rows, model):
    cols = P.SEGMENT_FEATURES
    return f"""(SELECT source_id, key, flow_no, clump_no, any_value(total_span) AS delay_s,
    arg_min(cls, sqrt({' + '.join(f'(({c} - m_{c}) / s_{c}) ** 2' for c in cols)})) AS predicted
    FROM {rows}, {model}_center, {model}_scale WHERE CAST(key AS BIGINT) % 5 >= 3 GROUP BY 1, 2, 3, 4)"""


# The clump steps of CLUMPS_SQL over the packets that a stream has used by its end.
LIVE_CLUMPS_SQL = CLUMPS_SQL[len(FLOWS_SQL):]
for step in ("lagged", "numbered", "bursts", "clumps"):
    LIVE_CLUMPS_SQL = LIVE_CLUMPS_SQL.replace(f"\n{step} AS", f"\nlive_{step} AS").replace(f"FROM {step}", f"FROM live_{step}")
LIVE_CLUMPS_SQL = LIVE_CLUMPS_SQL.replace("FROM flow_packets", "FROM live_flows")


@query(f"""WITH {CLUMPS_SQL},
{stage_sql('one', LENGTHS[0], "CASE WHEN truth = 'non_doh' THEN truth ELSE 'doh' END", '')},
{stage_sql('two', LENGTHS[1], 'truth', "AND truth <> 'non_doh'")},
live_gaps AS (SELECT *, CASE WHEN coalesce(ts_us - lag(ts_us) OVER (PARTITION BY key ORDER BY ts_us, packet_no) > {IDLE_US}, true)
         THEN 1 ELSE 0 END AS opens FROM packets WHERE ts_us <= {MARK}),
live_turned AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY key ORDER BY ts_us, packet_no) - 1 AS BIGINT) AS flow_no FROM live_gaps),
live_flows AS (SELECT t.* REPLACE (CASE WHEN direction = first_value(direction) OVER (PARTITION BY key, flow_no ORDER BY ts_us, packet_no)
         THEN 0 ELSE 1 END AS direction) FROM live_turned t){LIVE_CLUMPS_SQL},
{live_rows_sql('six', LENGTHS[0])},
{live_rows_sql('three', LENGTHS[1])},
ended AS (SELECT key, flow_no, min(start_us) AS flow_start_us, count(*) AS clumps,
    (max(end_us) + {IDLE_US}) // 1000 * 1000 + 1000 <= {MARK} AS over FROM live_clumps GROUP BY 1, 2)
SELECT a.source_id, a.key, flow_start_us, a.clump_no AS window_index, a.predicted AS l1_predicted, round(a.delay_s, 6) AS l1_delay_s,
  CASE WHEN a.predicted = 'doh' THEN b.predicted ELSE 'filtered_by_layer1' END AS verdict,
  round(CASE WHEN a.predicted = 'doh' THEN b.delay_s ELSE 0 END, 6) AS l2_delay_s
FROM {nearest_sql('six_rows', 'one')} a JOIN {nearest_sql('three_rows', 'two')} b USING (source_id, key, flow_no, clump_no)
JOIN ended e USING (key, flow_no)
WHERE a.clump_no + {LENGTHS[0]} <= CASE WHEN over THEN clumps ELSE clumps - 1 END OR (over AND clumps < {LENGTHS[0]} AND a.clump_no = 0)""")
def stream_verdicts(spark, sf):
    """Cascade verdicts on every full window of live flows, with models fitted on the clumps of other users."""
    _state_store(spark)
    clumps, models = materialize(event_clumps(spark, sf)), []
    user = F.col("key").cast("long")
    for length in LENGTHS:
        rows = W.segment_features(clumps, length).withColumn("truth", flow_truth()).filter(user % 5 < 3)
        if length == LENGTHS[0]:
            rows = rows.withColumn("truth", F.when(F.col("truth") == "non_doh", "non_doh").otherwise("doh"))
        else:
            rows = rows.filter("truth <> 'non_doh'")
        models.append(materialize(P.fit_centroids(rows, "truth")))
    live = R.stream_verdicts(event_stream(spark, sf).filter(user % 5 >= 3), *models, lengths=LENGTHS, idle_us=IDLE_US,
                             timeout_us=TIMEOUT_US)
    fields = ["source_id", "key", "flow_start_us", "window_index", "l1_predicted", "verdict"]
    return drain(spark, live).select(*fields, *[F.round(c, 6).alias(c) for c in ("l1_delay_s", "l2_delay_s")])
