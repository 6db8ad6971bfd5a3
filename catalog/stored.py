"""Tables written and read back, and checks that end in rows."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.comparisons import RUN_KEYS, RUNS_SQL, runs
from catalog.labelling import RESOLVERS_SQL, labelled_flows
from catalog.registry import Registry
from catalog.sequence import event_clumps
from catalog.splitting import EVENTS_SQL, HASH_PART, events_labelled
from catalog.tables import CLUMPS_SQL, load, micros
from catalog.tabular import dirty_lineitem
from packetloom.functions import names as N
from packetloom.operators import labels as A
from packetloom.operators import splits as S
from packetloom.operators import tabular as T
from packetloom.schema import FLOW
from packetloom.session import ensure_checkpoint_dir
from packetloom.sources import artifacts as W
from packetloom.sources import tabular as R

REGISTRY = Registry()
query = REGISTRY.query


def folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/packetloom/stored-{uuid.uuid4().hex}"


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag AS "Label" FROM lineitem""")
def stored_csv_table(spark, sf):
    """Line items written as CSV with a padded column name and read back by suffix."""
    path = f"{folder(spark)}/lineitem.csv"
    W.write_table(load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col("l_returnflag").alias("Label")), path, "csv")
    return R.read_table(spark, path).select(
        F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("double"), "Label")


@query("SELECT c_custkey, c_acctbal, true AS refused FROM customer")
def guarded_write(spark, sf):
    """Customers written once; a second write to the same place is refused and changes nothing."""
    path, rows = folder(spark), load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    W.write_tables({"customer": rows}, path)
    try:
        W.write_tables({"other": rows, "customer": rows.limit(0)}, path)
        refused = False
    except FileExistsError:
        try:
            spark.read.parquet(f"{path}/other")
            refused = False
        except AnalysisException:
            refused = True
    return spark.read.parquet(f"{path}/customer").withColumn("refused", F.lit(refused))


@query(f"""WITH {RUNS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY run_no) - 1 AS spot FROM runs)
SELECT spot AS run_no, task, model, split_protocol, window_size, round(precision, 8) AS precision, round(f1_score, 8) AS f1_score
FROM n""")
def stored_runs(spark, sf):
    """Run metrics written as one JSON file of runs and read back in file order."""
    path = folder(spark)
    fields = [*RUN_KEYS, "precision", "recall", "f1_score", "fpr"]
    listed = F.array_sort(F.collect_list(F.struct("run_no", *fields)))
    file = runs(spark, sf).agg(listed.alias("r")).select(
        F.lit("1.0.0").alias("manifest_version"), F.lit("l1").alias("task"),
        F.transform("r", lambda r: F.struct(*[r[c].alias(c) for c in fields])).alias("runs"))
    W.write_table(file, path, "json")
    return W.read_runs(spark, path).select("run_no", "task", "model", "split_protocol", "window_size",
                                           F.round("precision", 8).alias("precision"),
                                           F.round("f1_score", 8).alias("f1_score"))


@query(f"""WITH {RUNS_SQL} SELECT model || '/' || task || '/' || split_protocol || '/' || window_size AS model,
  '1.0.0' AS manifest_version, round(f1_score, 8) AS f1_macro, round(fpr, 8) AS default_fpr FROM runs""")
def stored_evidence(spark, sf):
    """Metrics written as an evidence file (one object per model) and read back."""
    path = folder(spark)
    name = F.concat_ws("/", "model", "task", "split_protocol", F.col("window_size").cast("string"))
    pairs = F.collect_list(F.struct(name, F.struct(F.col("f1_score").alias("f1_macro"), F.col("fpr").alias("default_fpr"))))
    file = runs(spark, sf).agg(F.map_from_entries(pairs).alias("models")).select(
        F.lit("1.0.0").alias("manifest_version"), F.lit("l1").alias("task"), "models")
    W.write_table(file, path, "json")
    return W.read_evidence(spark, path).select("model", "manifest_version", F.round("f1_macro", 8).alias("f1_macro"),
                                               F.round("default_fpr", 8).alias("default_fpr"))


@query("""SELECT 'm' || (user_id % 5) AS model, CAST(user_id % 7 + 1 AS INTEGER) AS window_size, 35 AS total_benchmarks,
  count(*) AS count, round(avg(value), 8) AS mean_seconds, round(max(value), 8) AS max_seconds FROM events GROUP BY 1, 2""")
def stored_delays(spark, sf):
    """Delay summaries written as a benchmark file and read back."""
    path = folder(spark)
    rows = load(spark, sf, "events").groupBy(
        F.concat(F.lit("m"), F.col("user_id") % 5).alias("model"), (F.col("user_id") % 7 + 1).cast("int").alias("window_size")
    ).agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean_seconds"), F.max("value").alias("max_seconds"))
    delay = F.struct("count", "mean_seconds", "max_seconds").alias("end_to_end_latency")
    file = rows.agg(F.collect_list(F.struct("model", "window_size", delay)).alias("benchmarks")).select(
        F.lit("1.0.0").alias("manifest_version"), F.size("benchmarks").alias("total_benchmarks"), "benchmarks")
    W.write_table(file, path, "json")
    end = F.col("end_to_end_latency")
    return W.read_delays(spark, path).select(
        "model", "window_size", "total_benchmarks", end["count"].alias("count"),
        F.round(end["mean_seconds"], 8).alias("mean_seconds"), F.round(end["max_seconds"], 8).alias("max_seconds"))


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT label, count(*) AS rows FROM samples GROUP BY 1)
SELECT '1.0.0' AS manifest_version, '42' AS seed, '3,6' AS lengths, (SELECT count(*) FROM samples) AS samples,
       (SELECT CAST(max(rows) AS BIGINT) FROM c) AS largest_class, (SELECT count(*) FROM c) AS classes""")
def stored_manifest(spark, sf):
    """The description of a run: settings, counters and classes, written and read back."""
    rows, path = events_labelled(spark, sf), folder(spark)
    counters = rows.agg(F.count(F.lit(1)).alias("samples"))
    classes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    manifest = W.experiment_manifest(counters, classes, {"seed": 42, "lengths": "3,6"})
    W.write_table(manifest, path, "json")
    return spark.read.schema(manifest.schema).json(path).select(
        "manifest_version", F.col("settings")["seed"].alias("seed"), F.col("settings")["lengths"].alias("lengths"),
        "counters.samples", F.array_max(F.col("classes.rows")).alias("largest_class"),
        F.size("classes").cast("long").alias("classes"))


@query("""SELECT 'Label' AS label_column, l_returnflag AS value, count(*) AS rows FROM lineitem GROUP BY 2""")
def label_column(spark, sf):
    """The label column of a messy table, found by name."""
    rows = dirty_lineitem(spark, sf)
    found = N.find_label(rows.columns)
    return rows.groupBy(F.col(found).alias("value")).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(found).alias("label_column"), "value", "rows")


@query(f"""WITH {CLUMPS_SQL}, {RESOLVERS_SQL}
SELECT key, flow_no, class FROM classed WHERE EXISTS (
  SELECT 1 FROM clumps c WHERE c.key = classed.key AND c.flow_no = classed.flow_no AND clump_no = 0 AND size > 5000)""")
def flows_with_clumps(spark, sf):
    """Flows that have a first clump, where small first clumps are taken for none."""
    clumps = event_clumps(spark, sf).filter((F.col("clump_no") > 0) | (F.col("size") > 5000))
    flows = labelled_flows(spark, sf)
    return A.drop_flows_without_clumps(flows, clumps, ["key", "flow_no"]).select(
        "key", "flow_no", A.flow_class().alias("class"))


@query("""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_extendedprice) AS mp,
  stddev_samp(l_extendedprice) AS sp FROM lineitem WHERE l_linenumber < 4)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS qty, round((l_extendedprice - mp) / sp, 6) AS price
FROM lineitem, s""")
def standard_scaler(spark, sf):
    """Two features centred and scaled on the training rows, applied to all."""
    rows = load(spark, sf, "lineitem")
    model = Pipeline(stages=T.vector_stages(["l_quantity", "l_extendedprice"], scaled=True)).fit(
        rows.filter("l_linenumber < 4"))
    out = model.transform(rows).withColumn("v", vector_to_array("features"))
    return out.select("l_orderkey", "l_linenumber", F.round(F.col("v")[0], 6).alias("qty"),
                      F.round(F.col("v")[1], 6).alias("price"))


@query(f"""WITH {EVENTS_SQL}, starts AS (SELECT session_id, epoch_us(min(ts)) AS s FROM samples GROUP BY 1),
cut AS (SELECT quantile_cont(s, 0.7) AS q FROM starts)
SELECT sample_id, CASE WHEN s > q THEN 'test' ELSE 'train' END AS split FROM samples JOIN starts USING (session_id), cut""")
def split_by_name(spark, sf):
    rows = events_labelled(spark, sf).withColumn("start_us", micros("ts"))
    return S.split_samples(rows, "time_holdout", start="start_us", test=0.3).select("sample_id", "split")


@query(f"WITH {EVENTS_SQL} SELECT sample_id, session_id, {HASH_PART} AS split FROM samples")
def disjoint_rows(spark, sf):
    """A split passed on after the check that no session is in two parts."""
    return S.require_disjoint(S.split_session_hash(events_labelled(spark, sf))).select("sample_id", "session_id", "split")


@query(f"""WITH {CLUMPS_SQL}, sized AS (SELECT source_id, key, flow_no, count(*) AS offered FROM clumps GROUP BY ALL)
SELECT source_id, key, flow_no, offered, least(offered, 2) AS kept, greatest(0, offered - 2) AS dropped FROM sized""")
def overflow_by_flow(spark, sf):
    """Clumps offered, kept and dropped per flow under a cap of two."""
    rows = event_clumps(spark, sf)
    return A.cap_overflow(rows, rows.filter("clump_no < 2"), FLOW)


@query("""SELECT c_custkey, c_nationkey, n_name, 'sets' AS seen FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def published_set(spark, sf):
    """Two tables published as one set; a second set that fails halfway leaves readers with the first."""
    path = folder(spark)
    customers, nations = load(spark, sf, "customer").select("c_custkey", "c_nationkey"), load(spark, sf, "nation").select("n_nationkey", "n_name")
    W.publish({"customer": customers, "nation": nations}, path)
    broken = nations.withColumn("n_name", F.raise_error(F.lit("this table cannot be written")).cast("string"))
    try:
        W.publish({"customer": customers.limit(0), "nation": broken}, path, force=True)
        seen = "new"
    except Exception as problem:
        if "cannot be written" not in str(problem):
            raise
        seen = "sets"
    found = W.read_published(spark, path)
    return (found["customer"].join(found["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "c_nationkey", "n_name", F.lit(seen).alias("seen")))
