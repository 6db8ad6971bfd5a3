"""The test tables seen as packets, flows, sessions and scores."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDLE_US = 40_000 * 1_000_000
TIMEOUT_US = 21_600 * 1_000_000


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    day = F.unix_date(F.to_date(column)).cast("long") * F.lit(86_400_000_000)
    clock = (F.hour(column) * 3600 + F.minute(column) * 60).cast("long") * F.lit(1_000_000)
    return day + clock + (F.extract(F.lit("SECOND"), F.col(column)) * 1_000_000).cast("long")


def event_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Events as packets of one capture; the user is the flow key."""
    return load(spark, sf, "events").select(
        F.lit("events").alias("source_id"), F.col("user_id").cast("string").alias("key"),
        F.col("event_id").alias("packet_no"),
        micros("ts").alias("ts_us"),
        F.round(F.col("value") * 100).cast("long").alias("length"),
        F.when(F.col("event_type").isin("click", "purchase", "signup"), 0).otherwise(1).alias("direction"))


PACKETS_SQL = """
packets AS (
  SELECT 'events' AS source_id, CAST(user_id AS VARCHAR) AS key, event_id AS packet_no,
         epoch_us(ts) AS ts_us, CAST(round(value * 100) AS BIGINT) AS length,
         CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 0 ELSE 1 END AS direction
  FROM events)"""

FLOWS_SQL = PACKETS_SQL + f""",
seen AS (
  SELECT *, max(ts_us) OVER (PARTITION BY source_id, key ORDER BY packet_no
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_us
  FROM packets),
flow_packets AS (
  SELECT source_id, key, packet_no, ts_us, length, direction,
         CAST(sum(CASE WHEN seen_us IS NULL OR ts_us - seen_us > {IDLE_US} THEN 1 ELSE 0 END)
              OVER (PARTITION BY source_id, key ORDER BY packet_no) - 1 AS BIGINT) AS flow_no
  FROM seen)"""

CLUMPS_SQL = FLOWS_SQL + f""",
lagged AS (
  SELECT *, lag(ts_us) OVER w AS prev_ts, lag(direction) OVER w AS prev_dir
  FROM flow_packets WINDOW w AS (PARTITION BY source_id, key, flow_no ORDER BY ts_us, packet_no)),
numbered AS (
  SELECT *, CAST(sum(CASE WHEN prev_ts IS NULL OR direction <> prev_dir OR ts_us - prev_ts > {TIMEOUT_US}
                          THEN 1 ELSE 0 END)
                 OVER (PARTITION BY source_id, key, flow_no ORDER BY ts_us, packet_no) - 1 AS BIGINT) AS clump_no
  FROM lagged),
bursts AS (
  SELECT source_id, key, flow_no, clump_no, CAST(sum(length) AS BIGINT) AS size, count(*) AS pkt_count,
         max(direction) AS direction, min(ts_us) AS start_us, max(ts_us) AS end_us
  FROM numbered GROUP BY 1, 2, 3, 4),
clumps AS (
  SELECT *, end_us - start_us AS duration_us,
         coalesce(start_us - lag(end_us) OVER (PARTITION BY source_id, key, flow_no ORDER BY clump_no), 0)
           AS interarrival_us
  FROM bursts)"""
