"""Column contracts shared by the operators."""

from pyspark.sql import types as T

# One row per frame of a capture: ``packet_no`` is the capture order (unique per source).  Endpoints, flags and byte
# counts are null for frames that are not TCP over IPv4; ``app_bytes`` also where a payload holds no TLS data.
PACKETS = T.StructType([
    T.StructField("source_id", T.StringType(), False),
    T.StructField("packet_no", T.LongType(), False),
    T.StructField("ts_us", T.LongType(), False),
    T.StructField("src_ip", T.StringType(), True),
    T.StructField("src_port", T.IntegerType(), True),
    T.StructField("dst_ip", T.StringType(), True),
    T.StructField("dst_port", T.IntegerType(), True),
    T.StructField("flags", T.IntegerType(), True),
    T.StructField("frame_bytes", T.LongType(), True),
    T.StructField("payload_bytes", T.LongType(), True),
    T.StructField("app_bytes", T.LongType(), True),
])

STREAM = ["source_id", "key"]
FLOW = STREAM + ["flow_no"]
CLUMP = FLOW + ["clump_no"]

# Order of a clump's five numbers in a feature vector.
VECTOR_FIELDS = ["interarrival", "duration", "size", "pkt_count", "direction"]

MICROS = 1_000_000
