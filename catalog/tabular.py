"""The flow-statistics path: cleaning, imputation, feature groups and models."""

from pyspark.sql import functions as F

from catalog.registry import Registry
from catalog.sequence import event_clumps
from catalog.tables import IDLE_US, event_packets, load
from packetloom.functions import names as N
from packetloom.functions.scaling import step_mask
from packetloom.operators import bayes as B
from packetloom.operators import models as M
from packetloom.operators import splits as S
from packetloom.operators import tabular as T
from packetloom.operators import windows as W
from packetloom.operators.ordered import materialize
from packetloom.operators.stats import FEATURES, flow_statistics
from packetloom.sources import tabular as R

REGISTRY = Registry()
query = REGISTRY.query


def dirty_lineitem(spark, sf):
    """Line items as a messy feature table: text cells, infinities, nulls, an empty and two id columns."""
    li = load(spark, sf, "lineitem")
    qty = F.when(F.col("l_quantity") == 7, "n/a").when(F.col("l_quantity") == 8, "Infinity").otherwise(
        F.col("l_quantity").cast("string"))
    return T.trim_names(li.select(
        F.col("l_orderkey").alias("Flow ID"), F.col("l_suppkey").alias("src-port"), F.col("l_linenumber").alias("row_no"),
        qty.alias(" FlowBytesSent "), F.nullif("l_discount", F.lit(0.0)).alias("PacketTimeMean"),
        F.col("l_extendedprice").alias("Duration"), F.lit(None).cast("string").alias("Empty"),
        F.col("l_returnflag").alias("Label")))


@query("""SELECT l_returnflag AS "Label", CAST(l_linenumber AS DOUBLE) AS row_no,
  CASE WHEN l_quantity NOT IN (7, 8) THEN l_quantity END AS "FlowBytesSent",
  nullif(l_discount, 0.0) AS "PacketTimeMean", l_extendedprice AS "Duration" FROM lineitem""")
def clean_features(spark, sf):
    return T.clean_features(dirty_lineitem(spark, sf), "Label")[0]


@query("""SELECT l_returnflag AS "Label", l_quantity AS "FlowBytesSent", l_discount AS "PacketTimeMean",
  l_extendedprice AS "Duration" FROM lineitem WHERE l_quantity NOT IN (7, 8) AND l_discount <> 0""")
def complete_rows(spark, sf):
    rows, _ = T.clean_features(dirty_lineitem(spark, sf).drop("row_no"), "Label")
    return T.drop_incomplete(rows, ["FlowBytesSent", "PacketTimeMean", "Duration"])


@query("""WITH m AS (SELECT median(CASE WHEN l_quantity NOT IN (7, 8) THEN l_quantity END) AS q, median(nullif(l_discount, 0.0)) AS d
  FROM lineitem WHERE l_linenumber < 4)
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity NOT IN (7, 8) THEN l_quantity ELSE q END AS qty,
  coalesce(nullif(l_discount, 0.0), d) AS disc FROM lineitem, m""")
def median_impute(spark, sf):
    li = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(~F.col("l_quantity").isin(7, 8), F.col("l_quantity")).alias("qty"),
        F.nullif("l_discount", F.lit(0.0)).alias("disc"))
    medians = T.fit_medians(li.filter("l_linenumber < 4"), ["qty", "disc"])
    return T.impute(li, medians, ["qty", "disc"])


PREFIXES = ["Flow_Bytes", "Packet Length", "packettime", "ResponseTimeTime", "flow", "Dur", "xPacketLength"]


@query(f"""WITH n AS (SELECT event_id, list_extract([{', '.join(repr(p) for p in PREFIXES)}], CAST(event_id % {len(PREFIXES)} + 1 AS INTEGER))
    || CASE WHEN event_id % 2 = 0 THEN ' rate' ELSE 'ation' END AS name FROM events),
l AS (SELECT event_id, name, lower(replace(replace(name, ' ', ''), '_', '')) AS t FROM n)
SELECT event_id, name, CASE WHEN t = 'duration' OR starts_with(t, 'flowbytes') OR (starts_with(t, 'flow') AND suffix(t, 'rate')) THEN 'flow_volume'
  WHEN starts_with(t, 'packetlength') THEN 'packet_length' WHEN starts_with(t, 'packettime') THEN 'packet_timing'
  WHEN starts_with(t, 'responsetime') THEN 'response_timing' END AS feature_group FROM l""")
def feature_groups(spark, sf):
    pick = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col("event_id") % len(PREFIXES) + 1).cast("int"))
    name = F.concat(pick, F.when(F.col("event_id") % 2 == 0, " rate").otherwise("ation"))
    rows = load(spark, sf, "events").select("event_id", name.alias("name"))
    return rows.withColumn("feature_group", N.feature_group(F.col("name")))


@query()
def file_inventory(spark, sf):
    """Size, hash, rows and columns of every table file."""
    return R.file_inventory(spark, sf)


def flow_table(spark, sf):
    """Flow statistics of ``events`` as a labelled feature table, split 80/20."""
    flows = flow_statistics(event_packets(spark, sf), IDLE_US).drop("source_id")
    target = (F.col("FlowBytesSent") > F.col("FlowBytesReceived")).cast("int")
    flows = flows.select(F.concat_ws("_", "key", "flow_no").alias("sample_id"), target.alias("target"), *FEATURES)
    # A rate over no time is unbounded; such cells and other gaps count as missing and become 0.
    cells = {c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in FEATURES}
    return materialize(S.split_stratified(materialize(flows.withColumns(cells).na.fill(0.0)), "target", "sample_id"))


@query()
def tabular_models(spark, sf):
    parts = materialize(S.split_nested(flow_table(spark, sf).drop("split"), "target", "sample_id"))
    part = lambda name: parts.filter(F.col("split") == name)
    return M.compare_models(part("train"), part("test"), list(FEATURES), val=part("val"))


@query()
def feature_importance(spark, sf):
    rows = flow_table(spark, sf)
    model = M.fit_tabular(rows.filter("split = 'train'"), list(FEATURES), "random_forest")
    return M.feature_importance(spark, model, list(FEATURES))


@query()
def group_ablation(spark, sf):
    rows = flow_table(spark, sf)
    return M.group_ablation(rows.filter("split = 'train'"), rows.filter("split = 'test'"), list(FEATURES), "decision_tree")


def window_samples(spark, sf):
    rows = W.scaled_windows(event_clumps(spark, sf), 3)
    user = F.col("key").cast("long")
    rows = rows.select(F.concat_ws("_", "key", "flow_no", "window_index").alias("sample_id"), "features",
                       (user % 4 == 0).cast("int").alias("label"), user.alias("user"))
    return rows.withColumn("mask", step_mask(F.col("features")))


@query()
def window_classifier(spark, sf):
    rows = materialize(window_samples(spark, sf))
    model = M.fit_windows(rows.filter("user % 5 < 4"), 3)
    return M.score_windows(model, rows.filter("user % 5 = 4")).select("sample_id", "label", "prediction", "score")


@query()
def field_ablation(spark, sf):
    rows = materialize(window_samples(spark, sf))
    return M.field_ablation(rows.filter("user % 5 < 4"), rows.filter("user % 5 = 4"), 3, kind="logistic")


@query()
def training_history(spark, sf):
    model = M.fit_windows(materialize(window_samples(spark, sf)), 3, kind="logistic")
    return M.training_history(spark, model)


BAYES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LOGS = " + ".join(f"(ln(2 * pi() * (v_{c} + 1e-9 * widest)) + (CAST({c} AS DOUBLE) - m_{c}) ** 2 / (v_{c} + 1e-9 * widest))" for c in BAYES)


@query(f"""WITH train AS (SELECT * FROM lineitem WHERE l_orderkey % 5 < 4),
whole AS (SELECT count(*) AS total, greatest({', '.join(f'var_pop(CAST({c} AS DOUBLE))' for c in BAYES)}) AS widest FROM train),
classes AS (SELECT l_returnflag AS name, count(*) AS n, {', '.join(f'avg(CAST({c} AS DOUBLE)) AS m_{c}, var_pop(CAST({c} AS DOUBLE)) AS v_{c}' for c in BAYES)}
  FROM train GROUP BY 1),
others AS (SELECT *, row_number() OVER () AS spot FROM lineitem WHERE l_orderkey % 5 = 4),
scored AS (SELECT spot, l_orderkey, l_linenumber, name, ln(n / total::DOUBLE) - ({_LOGS}) / 2 AS l FROM others, classes, whole),
best AS (SELECT *, max(l) OVER (PARTITION BY spot) AS top FROM scored)
SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, arg_max(name, l) AS predicted,
  round(1 / sum(exp(l - top)), 6) AS probability FROM best GROUP BY spot""")
def gaussian_bayes(spark, sf):
    """Gaussian naive Bayes fitted on four orders in five and applied to the others."""
    rows = load(spark, sf, "lineitem")
    model = materialize(B.fit_gaussian(rows.filter("l_orderkey % 5 < 4"), "l_returnflag", BAYES))
    out = B.predict_gaussian(rows.filter("l_orderkey % 5 = 4"), model, BAYES)
    return out.select("l_orderkey", "l_linenumber", "predicted",
                      F.round(F.col("probabilities")[F.col("predicted")], 6).alias("probability"))
