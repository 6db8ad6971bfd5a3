"""Splits, leakage, weights and scaling."""

from pyspark.sql import functions as F

from catalog.registry import Registry
from catalog.sequence import event_clumps
from catalog.tables import CLUMPS_SQL, load
from packetloom.operators import splits as S
from packetloom.operators import windows as W
from packetloom.schema import FLOW

REGISTRY = Registry()
query = REGISTRY.query


def events_labelled(spark, sf):
    """Events as samples: the user is the session, signups are the positive class."""
    return load(spark, sf, "events").select(
        F.col("event_id").alias("sample_id"), F.col("user_id").cast("string").alias("session_id"),
        (F.col("event_type") == "signup").cast("int").alias("label"), "ts")


EVENTS_SQL = """samples AS (
  SELECT event_id AS sample_id, CAST(user_id AS VARCHAR) AS session_id,
         CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS label, ts FROM events)"""


def stratified_sql(source, seed, share, name="split", test="test", train="train"):
    """Lowest hashes train; the test part is max(1, half-even round of n * share)."""
    return f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY label
      ORDER BY md5('{seed}|' || CAST(sample_id AS VARCHAR)), CAST(sample_id AS VARCHAR))
      <= n - least(n - 1, greatest(1, CAST(round_even(n * {share}, 0) AS BIGINT))) THEN '{train}' ELSE '{test}' END AS {name}
  FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM {source})"""


@query(f"WITH {EVENTS_SQL}, s AS ({stratified_sql('samples', 42, '(1.0 - 0.8)')}) SELECT sample_id, label, split FROM s")
def split_stratified(spark, sf):
    return S.split_stratified(events_labelled(spark, sf)).select("sample_id", "label", "split")


@query(f"""WITH {EVENTS_SQL}, o AS ({stratified_sql('samples', 42, '(1.0 - 0.8)', 'part')}),
r AS (SELECT sample_id, label FROM o WHERE part = 'train'),
i AS ({stratified_sql('r', 43, '(1.0 - 0.75)', 'part', 'val')})
SELECT sample_id, label, part AS split FROM i
UNION ALL SELECT sample_id, label, part FROM o WHERE part = 'test'""")
def split_nested(spark, sf):
    return S.split_nested(events_labelled(spark, sf)).select("sample_id", "label", "split")


def best_sessions(taken):
    where = f"WHERE session_id NOT IN ({taken})" if taken else ""
    return f"""SELECT DISTINCT session_id FROM (SELECT session_id, row_number() OVER (
      PARTITION BY label ORDER BY other, size DESC, session_id) AS k FROM offers {where}) WHERE k = 1"""


@query(f"""WITH {EVENTS_SQL},
held AS (SELECT session_id, label, count(*) AS n FROM samples GROUP BY ALL),
sizes AS (SELECT session_id, sum(n) AS size FROM held GROUP BY 1),
reach AS (SELECT label, count(*) AS r FROM held GROUP BY 1),
rarest AS (SELECT session_id, arg_min(label, [r, label]) AS rare FROM held JOIN reach USING (label) GROUP BY 1),
offers AS (SELECT session_id, label, size, label <> rare AS other
           FROM held JOIN rarest USING (session_id) JOIN sizes USING (session_id)),
p1 AS ({best_sessions("")}),
p2 AS ({best_sessions("SELECT session_id FROM p1")}),
p3 AS ({best_sessions("SELECT session_id FROM p1 UNION ALL SELECT session_id FROM p2")}),
cover AS (SELECT session_id, 'train' AS split FROM p1 UNION ALL SELECT session_id, 'val' FROM p2
          UNION ALL SELECT session_id, 'test' FROM p3),
full_size AS (SELECT sum(size)::DOUBLE AS t FROM sizes),
lack AS (SELECT greatest(0, 0.70::DOUBLE * t - a) AS q1, greatest(0, 0.15::DOUBLE * t - b) AS q2,
                greatest(0, 0.15::DOUBLE * t - c) AS q3 FROM full_size, (
         SELECT sum(size) FILTER (split = 'train') AS a, sum(size) FILTER (split = 'val') AS b,
                sum(size) FILTER (split = 'test') AS c FROM cover JOIN sizes USING (session_id))),
rest AS (SELECT session_id, (sum(size) OVER (ORDER BY md5('42|' || session_id), session_id) - size / 2::DOUBLE)
                * (q1 + q2 + q3) / sum(size) OVER () AS spot, q1, q2
         FROM sizes, lack WHERE session_id NOT IN (SELECT session_id FROM cover)),
placed AS (SELECT session_id, CASE WHEN spot < q1 THEN 'train' WHEN spot < q1 + q2 THEN 'val' ELSE 'test' END AS split
           FROM rest UNION ALL SELECT session_id, split FROM cover)
SELECT sample_id, session_id, label, split FROM samples JOIN placed USING (session_id)""")
def split_session_disjoint(spark, sf):
    out = S.require_disjoint(S.split_session_disjoint(events_labelled(spark, sf)))
    return out.select("sample_id", "session_id", "label", "split")


@query("""WITH held AS (SELECT l_partkey AS label, l_suppkey AS session_id, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT label, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS rows, count(*) >= 3 AS enough FROM held GROUP BY label""")
def class_reach(spark, sf):
    return S.class_reach(load(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("label"), F.col("l_suppkey").alias("session_id")))


HASH_PART = """CASE WHEN ('0x' || substr(md5('42|' || session_id), 1, 8))::BIGINT % 10000 < 7000 THEN 'train'
  WHEN ('0x' || substr(md5('42|' || session_id), 1, 8))::BIGINT % 10000 < 8500 THEN 'val' ELSE 'test' END"""


@query(f"WITH {EVENTS_SQL} SELECT sample_id, session_id, label, {HASH_PART} AS split FROM samples")
def split_session_hash(spark, sf):
    out = S.split_session_hash(events_labelled(spark, sf))
    return out.select("sample_id", "session_id", "label", "split")


def repair_round(source):
    """One gap of each class filled, for sessions of one class: its first free session goes to its first missing part."""
    return f"""SELECT session_id, label, moved OR r = 1 AS moved, CASE WHEN r = 1 THEN gap ELSE split END AS split
  FROM (SELECT *, CASE WHEN gap IS NOT NULL AND free THEN row_number() OVER (
          PARTITION BY label, free ORDER BY md5('42|' || session_id), session_id) ELSE 0 END AS r
    FROM (SELECT *, NOT moved AND count(*) OVER (PARTITION BY label, split) > 1 AS free,
            CASE WHEN count(*) FILTER (split = 'train') OVER (PARTITION BY label) = 0 THEN 'train'
                 WHEN count(*) FILTER (split = 'val') OVER (PARTITION BY label) = 0 THEN 'val'
                 WHEN count(*) FILTER (split = 'test') OVER (PARTITION BY label) = 0 THEN 'test' END AS gap
          FROM {source}))"""


@query(f"""WITH held AS (SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_custkey AS label FROM orders
  QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 3),
r0 AS (SELECT session_id, label, false AS moved, {HASH_PART} AS split FROM held),
r1 AS ({repair_round("r0")}),
r2 AS ({repair_round("r1")})
SELECT session_id, label, split, moved FROM r2""")
def split_rare_classes(spark, sf):
    """Customers as classes, their orders as sessions: many classes that hashing alone leaves out of a part."""
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"),
                                              F.col("o_custkey").alias("label"))
    enough = S.class_reach(orders).filter("enough").select("label")
    kept = orders.join(enough, "label")
    spot = F.conv(F.substring(F.md5(F.concat(F.lit("42|"), "session_id")), 1, 8), 16, 10).cast("long") % 10_000
    before = F.when(spot < 7000, "train").when(spot < 8500, "val").otherwise("test")
    return S.split_session_hash(kept).select("session_id", "label", "split", (F.col("split") != before).alias("moved"))


@query(f"""WITH {EVENTS_SQL}, starts AS (SELECT session_id, epoch_us(min(ts)) AS s FROM samples GROUP BY 1),
cut AS (SELECT quantile_cont(s, 0.8) AS q FROM starts)
SELECT sample_id, session_id, CASE WHEN s > q THEN 'test' ELSE 'train' END AS split
FROM samples JOIN starts USING (session_id), cut""")
def split_time_holdout(spark, sf):
    from catalog.tables import micros
    rows = events_labelled(spark, sf).withColumn("start_us", micros("ts"))
    return S.split_time_holdout(rows, "start_us").select("sample_id", "session_id", "split")


@query("""SELECT doc_id, source, CASE WHEN source IN (SELECT source FROM documents WHERE lang = 'de' AND n_chars > 20000)
       THEN 'test' ELSE 'train' END AS split FROM documents""")
def split_scenarios(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "source", "lang")
    chosen = docs.filter((F.col("lang") == "de") & (F.col("n_chars") > 20000)).select("source")
    return S.split_scenarios(docs, chosen, "source").select("doc_id", "source", "split")


@query(f"""WITH {EVENTS_SQL}, s AS ({stratified_sql('samples', 42, '(1.0 - 0.8)')}),
p AS (SELECT session_id FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT a AS part_a, b AS part_b, CASE WHEN a = 'train' AND b = 'test' THEN (SELECT count(*) FROM p) ELSE 0 END AS shared_sessions,
       a = 'train' AND b = 'test' AND (SELECT count(*) FROM p) > 0 AS leaks,
       CASE WHEN a = 'train' AND b = 'test' AND (SELECT count(*) FROM p) > 0 THEN 'sessions appear on both sides'
            ELSE 'no session in common' END AS note
FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) v(a, b)""")
def split_leakage(spark, sf):
    return S.leakage_report(S.split_stratified(events_labelled(spark, sf)))


@query(f"""WITH {EVENTS_SQL}, s AS ({stratified_sql('samples', 42, '(1.0 - 0.8)')})
SELECT 'train' AS part_a, 'test' AS part_b, session_id FROM s GROUP BY session_id HAVING count(DISTINCT split) > 1""")
def split_shared_sessions(spark, sf):
    return S.shared_sessions(S.split_stratified(events_labelled(spark, sf)))


@query(f"""WITH {EVENTS_SQL}, s AS ({stratified_sql('samples', 42, '(1.0 - 0.8)')}),
t AS (SELECT label, count(*) AS c FROM s WHERE split = 'train' GROUP BY 1)
SELECT split, label, count(*) AS rows, count(DISTINCT session_id) AS sessions,
       round((SELECT sum(c) FROM t) / ((SELECT count(*) FROM t) * any_value(c)), 9) AS weight
FROM s JOIN t USING (label) GROUP BY split, label""")
def split_manifest(spark, sf):
    out = S.split_manifest(S.split_stratified(events_labelled(spark, sf)))
    return out.withColumn("weight", F.round("weight", 9))


@query(f"""WITH {EVENTS_SQL}, s AS ({stratified_sql('samples', 42, '(1.0 - 0.8)')}),
ids AS (SELECT DISTINCT split, unnest([{{'kind': 'sample_id', 'id': CAST(sample_id AS VARCHAR)}}, {{'kind': 'session_id', 'id': CAST(session_id AS VARCHAR)}}]) AS i FROM s),
summed AS (SELECT split, i.kind AS kind, substr(md5(i.id), 1, 3) AS prefix, count(*) AS n,
    sum(CAST('0x' || substr(md5(i.id), 4, 15) AS BIGINT)) AS total FROM ids GROUP BY 1, 2, 3)
SELECT split, kind, CAST(sum(n) AS BIGINT) AS ids, sha256(string_agg(prefix || ':' || n || ':' || total, ',' ORDER BY prefix)) AS digest
FROM summed GROUP BY 1, 2""")
def split_id_sets(spark, sf):
    """Digests of the sample and session ids of each part."""
    return S.split_digests(S.split_stratified(events_labelled(spark, sf)), ["sample_id", "session_id"])


@query("""SELECT event_type AS label, count(*) AS rows,
  round((SELECT count(*) FROM events) / ((SELECT count(DISTINCT event_type) FROM events) * count(*)), 9) AS weight
FROM events GROUP BY 1""")
def class_weights(spark, sf):
    events = load(spark, sf, "events").select(F.col("event_type").alias("label"))
    return S.class_weights(events).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {EVENTS_SQL} SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
  round(count(*) FILTER (label = 0) / count(*) FILTER (label = 1), 9) AS pos_weight FROM samples""")
def pos_weight(spark, sf):
    return S.pos_weight(events_labelled(spark, sf)).withColumn("pos_weight", F.round("pos_weight", 9))


VEC = ["(log10(greatest(1e-12, interarrival_us / 1e6)) + 12.0) / 10.0",
       "(log10(greatest(1e-12, duration_us / 1e6)) + 12.0) / 10.0",
       "(log10(least(1e4, greatest(1e-12, CAST(size AS DOUBLE)))) - 0.5) / 3.5",
       "log2(CAST(least(256, greatest(1, pkt_count)) AS DOUBLE)) / 8.0",
       "CASE direction WHEN 0 THEN 1.0 ELSE -1.0 END"]
# Training windows of length 3 come from even users; each clump counts once per window that holds it.
TRAIN_STEPS = f"""{CLUMPS_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY key, flow_no) AS n FROM clumps),
steps AS (SELECT s.*, {', '.join(f'{e} AS v{i}' for i, e in enumerate(VEC))} FROM sized s),
uses AS (SELECT *, CASE WHEN n <= 3 THEN 1 ELSE least(clump_no, n - 3) - greatest(0, clump_no - 2) + 1 END AS times FROM steps),
fit AS (SELECT u.* FROM uses u, range(3) r(i) WHERE i < times AND CAST(key AS BIGINT) % 2 = 0)"""


def scaled(spark, sf):
    return W.scaled_windows(event_clumps(spark, sf), 3)


@query("WITH " + TRAIN_STEPS + " " + " UNION ALL ".join(
    f"SELECT {i} AS feature, round(avg(v{i}), 8) AS mean, round(stddev_pop(v{i}), 8) AS std FROM fit" for i in range(5)))
def scaler_fit(spark, sf):
    out = S.fit_scaler(scaled(spark, sf).filter(F.col("key").cast("long") % 2 == 0))
    return out.select("feature", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


@query("WITH " + TRAIN_STEPS + ", m AS (SELECT " + ", ".join(
    f"avg(v{i}) AS m{i}, stddev_pop(v{i}) AS s{i}" for i in range(5)) + """ FROM fit)
SELECT source_id, key, flow_no, clump_no AS window_index, """ + ", ".join(
    f"round((v{i} - m{i}) / s{i}, 6) AS first_{i}" for i in range(5)) + """
FROM steps, m WHERE clump_no + 3 <= n OR (n < 3 AND clump_no = 0)""")
def scaler_apply(spark, sf):
    windows = scaled(spark, sf)
    fitted = S.fit_scaler(windows.filter(F.col("key").cast("long") % 2 == 0))
    out = S.apply_scaler(windows, fitted)
    return out.select(*FLOW, "window_index", *[F.round(F.col("features")[0][i], 6).alias(f"first_{i}") for i in range(5)])
