"""Confusion counts, ranking metrics, thresholds, calibration, centroids and the cascade."""

from pyspark.sql import functions as F

from catalog.registry import Registry
from catalog.sequence import event_clumps
from catalog.tables import CLUMPS_SQL, load
from packetloom.operators import calibrate as K
from packetloom.operators import metrics as M
from packetloom.operators import prototypes as P
from packetloom.operators import windows as W
from packetloom.operators.ordered import materialize
from packetloom.schema import FLOW

REGISTRY = Registry()
query = REGISTRY.query


def scored_docs(spark, sf):
    """Labelled documents with their length as a score (ties occur)."""
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return load(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("label"),
        (F.col("n_chars") / (F.col("n_chars") + 1_000.0)).alias("score"))


DOCS_SQL = """scored AS (SELECT doc_id, lang, source, quality AS label, n_chars / (n_chars + 1000.0::DOUBLE) AS score
  FROM labels JOIN documents USING (doc_id))"""


def scored_events(spark, sf):
    """Events with their value as a score of three 'models'; many ties."""
    return load(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 3).alias("model"), "event_type",
        (F.col("event_type").isin("signup", "purchase")).cast("int").alias("label"),
        (F.round(F.col("value"), 0) / (F.round(F.col("value"), 0) + 100.0)).alias("score"))


EVENTS_SQL = """scored AS (SELECT event_id, user_id % 3 AS model, event_type,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 0 END AS label,
  round(value, 0) / (round(value, 0) + 100.0::DOUBLE) AS score FROM events)"""

PRED_SQL = EVENTS_SQL + ", preds AS (SELECT *, CASE WHEN score >= 0.3 THEN 1 ELSE 0 END AS prediction FROM scored)"


def predicted(spark, sf):
    return scored_events(spark, sf).withColumn("prediction", F.when(F.col("score") >= 0.3, 1).otherwise(0))


COUNTS = """count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp"""


@query(f"WITH {PRED_SQL} SELECT model, {COUNTS} FROM preds GROUP BY 1")
def confusion(spark, sf):
    return M.confusion(predicted(spark, sf), ["model"])


@query(f"""WITH {PRED_SQL}, c AS (SELECT model, {COUNTS} FROM preds GROUP BY 1)
SELECT model, 0 AS actual, tn AS predicted_0, fp AS predicted_1 FROM c UNION ALL SELECT model, 1, fn, tp FROM c""")
def confusion_table(spark, sf):
    return M.confusion_table(predicted(spark, sf), ["model"])


RATES = ["accuracy", "precision", "recall", "specificity", "fpr", "fnr", "f1", "balanced_accuracy"]


@query(f"""WITH {PRED_SQL}, c AS (SELECT model, {COUNTS} FROM preds GROUP BY 1),
r AS (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r, tn / (tn + fp)::DOUBLE AS s FROM c)
SELECT model, tn, fp, fn, tp, tn + fp + fn + tp AS total, round((tp + tn) / (tn + fp + fn + tp)::DOUBLE, 9) AS accuracy,
  round(p, 9) AS precision, round(r, 9) AS recall, round(s, 9) AS specificity, round(fp / (fp + tn)::DOUBLE, 9) AS fpr,
  round(fn / (fn + tp)::DOUBLE, 9) AS fnr, round(2 * p * r / (p + r), 9) AS f1, round((r + s) / 2, 9) AS balanced_accuracy
FROM r""")
def binary_metrics(spark, sf):
    out = M.binary_metrics(M.confusion(predicted(spark, sf), ["model"]))
    return out.withColumns({c: F.round(c, 9) for c in RATES})


@query(f"""WITH {PRED_SQL}, k AS (SELECT unnest([0, 1]) AS class),
c AS (SELECT model, class, count(*) FILTER (label = class) AS n, count(*) FILTER (prediction = class) AS m,
             count(*) FILTER (label = class AND prediction = class) AS h FROM preds, k GROUP BY 1, 2),
r AS (SELECT *, h / m::DOUBLE AS p, h / n::DOUBLE AS q, 2 * (h / m::DOUBLE) * (h / n::DOUBLE) / (h / m::DOUBLE + h / n::DOUBLE) AS f FROM c)
SELECT model, round(avg(p), 9) AS precision_macro, round(sum(p * n) / sum(n), 9) AS precision_weighted,
  round(avg(q), 9) AS recall_macro, round(sum(q * n) / sum(n), 9) AS recall_weighted,
  round(avg(f), 9) AS f1_macro, round(sum(f * n) / sum(n), 9) AS f1_weighted FROM r GROUP BY 1""")
def macro_weighted_metrics(spark, sf):
    out = M.averaged_metrics(predicted(spark, sf), ["model"])
    return out.select("model", *[F.round(c, 9).alias(c) for c in out.columns if c != "model"])


AUC_SQL = """ranked AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score)
         + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0::DOUBLE AS r FROM scored),
sums AS (SELECT {by}, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n,
                sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS rs FROM ranked GROUP BY 1)"""


@query(f"""WITH {EVENTS_SQL}, {AUC_SQL.format(by='model')}
SELECT model, p AS positives, n AS negatives, round((rs - p * (p + 1) / 2.0) / (p * n), 9) AS roc_auc FROM sums""")
def roc_auc(spark, sf):
    out = M.ranking_metrics(scored_events(spark, sf), ["model"])
    return out.select("model", "positives", "negatives", F.round("roc_auc", 9).alias("roc_auc"))


@query(f"""WITH {DOCS_SQL}, {AUC_SQL.format(by='lang')}
SELECT lang, round(CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2.0) / (p * n) END, 9) AS roc_auc FROM sums""")
def roc_auc_documents(spark, sf):
    out = M.ranking_metrics(scored_docs(spark, sf), ["lang"])
    return out.select("lang", F.round("roc_auc", 9).alias("roc_auc"))


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT model, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
  FROM scored GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY model) AS total
      FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC))
SELECT model, round(sum(p / total::DOUBLE * (tp / (tp + fp)::DOUBLE)), 9) AS pr_auc FROM c GROUP BY 1""")
def pr_auc(spark, sf):
    out = M.ranking_metrics(scored_events(spark, sf), ["model"])
    return out.select("model", F.round("pr_auc", 9).alias("pr_auc"))


def threshold_sql(constants, feasible_order, least_order, cap):
    consts = " UNION ".join(f"SELECT model, {c} FROM scored GROUP BY 1" for c in constants)
    return f"""WITH {EVENTS_SQL}, cand AS (SELECT model, score AS tau FROM scored UNION {consts}),
per AS (SELECT model, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY 1, 2),
tot AS (SELECT model, sum(p) AS tp, sum(n) AS tn FROM per GROUP BY 1),
ev AS (SELECT c.model, c.tau, coalesce(sum(p.n), 0) / any_value(t.tn)::DOUBLE AS fpr, coalesce(sum(p.p), 0) / any_value(t.tp)::DOUBLE AS tpr
  FROM cand c JOIN tot t ON t.model = c.model LEFT JOIN per p ON p.model = c.model AND p.score >= c.tau GROUP BY 1, 2),
r AS (SELECT *, fpr <= {cap} + 1e-12 AS ok, row_number() OVER (PARTITION BY model, fpr <= {cap} + 1e-12 ORDER BY {feasible_order}) AS a,
      row_number() OVER (PARTITION BY model ORDER BY {least_order}) AS b,
      count(*) FILTER (fpr <= {cap} + 1e-12) OVER (PARTITION BY model) AS oks FROM ev)
SELECT model, round(tau, 9) AS threshold, round(fpr, 9) AS fpr, ok AS feasible FROM r
WHERE (oks > 0 AND ok AND a = 1) OR (oks = 0 AND b = 1)"""


def tidy_threshold(df):
    return df.withColumns({"threshold": F.round("threshold", 9), "fpr": F.round("fpr", 9)})


@query(threshold_sql(["0.0", "0.5", "1.0", "max(score) + 1e-6"], "tpr DESC, fpr, tau DESC", "fpr, tpr DESC, tau DESC", 0.05))
def threshold_fpr_high(spark, sf):
    return tidy_threshold(M.select_threshold(scored_events(spark, sf), ["model"], target_fpr=0.05))


@query(threshold_sql(["0.5", "1.0", "max(score) + 1e-6"], "tpr DESC, tau", "fpr, tpr DESC, tau", 0.05))
def threshold_fpr_low(spark, sf):
    return tidy_threshold(M.select_threshold(scored_events(spark, sf), ["model"], target_fpr=0.05, tie="lower"))


@query(f"""WITH thresholds AS ({threshold_sql(["0.0", "0.5", "1.0", "max(score) + 1e-6"], "tpr DESC, fpr, tau DESC",
                                              "fpr, tpr DESC, tau DESC", 0.05)}), {EVENTS_SQL}
SELECT s.model, CAST(sum(CASE WHEN score >= threshold - 1e-10 THEN 1 ELSE 0 END) AS BIGINT) AS flagged, count(*) AS rows
FROM scored s JOIN thresholds t ON t.model = s.model GROUP BY 1""")
def threshold_apply(spark, sf):
    rows = scored_events(spark, sf)
    chosen = M.select_threshold(rows, ["model"], target_fpr=0.05)
    out = M.apply_threshold(rows, chosen, ["model"])
    return out.groupBy("model").agg(F.sum("prediction").alias("flagged"), F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {PRED_SQL} SELECT event_type, count(*) FILTER (label = 0 AND prediction = 1) AS false_positives,
  count(*) FILTER (label = 1 AND prediction = 0) AS misses, count(*) FILTER (label = 1 AND prediction = 1) AS hits,
  count(*) FILTER (label = 0 AND prediction = 0) AS rejections FROM preds GROUP BY 1""")
def error_breakdown(spark, sf):
    return M.error_breakdown(predicted(spark, sf), ["event_type"])


@query(f"WITH {EVENTS_SQL} SELECT event_id, round(1 / (1 + exp(-(4.5 * score - 1.25))), 9) AS calibrated FROM scored")
def platt_apply(spark, sf):
    return scored_events(spark, sf).select(
        "event_id", F.round(K.platt_apply(F.col("score"), 4.5, -1.25), 9).alias("calibrated"))


@query()
def platt_fit(spark, sf):
    """Fitted on two documents in three, applied to the third."""
    rows = scored_docs(spark, sf)
    a, b = K.platt_fit(rows.filter("doc_id % 3 > 0"))
    return rows.filter("doc_id % 3 = 0").select("doc_id", K.platt_apply(F.col("score"), a, b).alias("calibrated"))


@query()
def logistic_calibration(spark, sf):
    rows = scored_docs(spark, sf)
    fitted, other = rows.filter("doc_id % 3 > 0"), rows.filter("doc_id % 3 = 0")
    return K.logistic_calibrate(fitted, other).select("doc_id", "calibrated")


def text_labelled(spark, sf):
    """Events with text labels and a delay; views are neither class."""
    truth = F.when(F.col("event_type") == "signup", "tunnel_like").when(
        F.col("event_type") == "view", "other").otherwise("benign_doh")
    return load(spark, sf, "events").select(
        truth.alias("truth"), F.when(F.col("value") > 60, "tunnel_like").otherwise("benign_doh").alias("predicted"),
        F.col("value").alias("delay_s"))


@query("""WITH t AS (SELECT event_type = 'signup' AS y, event_type <> 'view' AS known, value > 60 AS p, value FROM events),
c AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND known AND p) AS fp,
  count(*) FILTER (NOT y AND known AND NOT p) AS tn, count(*) FILTER (y AND NOT p) AS fn, avg(value) AS m,
  quantile_cont(value, 0.5) AS md, min(value) AS lo, max(value) AS hi FROM t)
SELECT tp, fp, tn, fn, tp + fp + tn + fn AS total_evaluated, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 4) AS accuracy,
  round(tp / (tp + fp)::DOUBLE, 4) AS precision, round(tp / (tp + fn)::DOUBLE, 4) AS recall,
  round(2.0 * tp / (2 * tp + fp + fn)::DOUBLE, 4) AS f1_score, round(fp / (fp + tn)::DOUBLE, 4) AS false_positive_rate,
  round(m, 4) AS mean_segment_duration, round(md, 4) AS median_segment_duration, round(lo, 4) AS min_segment_duration,
  round(hi, 4) AS max_segment_duration FROM c""")
def label_metrics(spark, sf):
    return M.label_metrics(text_labelled(spark, sf), "tunnel_like", "benign_doh")


VECTOR = [f"x{i}" for i in range(64)]


def vectors(spark, sf):
    """Embeddings: their numbers are the features, the class is the label."""
    return load(spark, sf, "embeddings").select(
        "vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("name"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(VECTOR)])


@query("""WITH v AS (SELECT vec_id, 'c' || label AS name, """ + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(64)) + """ FROM embeddings),
sc AS (SELECT """ + ", ".join(f"CASE WHEN stddev_pop(x{i}) > 1e-6 THEN stddev_pop(x{i}) ELSE 1 END AS s{i}" for i in range(64)) + """ FROM v),
ce AS (SELECT name, """ + ", ".join(f"avg(x{i}) AS m{i}" for i in range(64)) + """ FROM v GROUP BY 1),
d AS (SELECT vec_id, ce.name, sqrt(""" + " + ".join(f"((x{i} - m{i}) / s{i}) ** 2" for i in range(64)) + """) AS dist FROM v, ce, sc),
e AS (SELECT *, min(dist) OVER (PARTITION BY vec_id) AS near FROM d),
w AS (SELECT *, exp(-least(dist - near, 50)) AS w FROM e)
SELECT vec_id, arg_min(name, dist) AS predicted, round(min(dist), 6) AS distance, round(1 / sum(w), 4) AS score FROM w GROUP BY 1""")
def centroid_predict(spark, sf):
    rows = vectors(spark, sf)
    out = P.predict_centroids(rows, P.fit_centroids(rows, "name", VECTOR), VECTOR)
    return out.select("vec_id", "predicted", F.round("distance", 6).alias("distance"),
                      F.col("scores")[F.col("predicted")].alias("score"))


def flow_truth():
    user = F.col("key").cast("long")
    return F.when(user % 3 == 0, "tunnel_like").when(user % 3 == 1, "benign_doh").otherwise("non_doh")


def two_stages(spark, sf):
    """Both stages fitted on three users in five and applied to the others' first windows."""
    clumps = materialize(event_clumps(spark, sf))
    scored = []
    for length, stage in ((6, 1), (3, 2)):
        rows = materialize(W.segment_features(clumps, length)).withColumn("truth", flow_truth())
        if stage == 1:
            rows = rows.withColumn("truth1", F.when(F.col("truth") == "non_doh", "non_doh").otherwise("doh"))
            train, label = rows, "truth1"
        else:
            train, label = rows.filter("truth <> 'non_doh'"), "truth"
        model = P.fit_centroids(train.filter(F.col("key").cast("long") % 5 < 3), label)
        test = rows.filter((F.col("key").cast("long") % 5 >= 3) & (F.col("window_index") == 0))
        scored.append(P.predict_centroids(test, model).select(
            *FLOW, "truth", "predicted", F.col("total_span").alias("delay_s")))
    span = clumps.groupBy(*FLOW).agg(((F.max("end_us") - F.min("start_us")) / 1e6).alias("span_s"))
    return P.cascade(scored[0], scored[1], FLOW).join(span, FLOW)


def stage_sql(name, length, label, train):
    f = f"(PARTITION BY source_id, key, flow_no ORDER BY clump_no ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING)"
    cols = ["mean_size", "max_size", "mean_pkts", "mean_duration", "mean_interarrival", "std_size", "forward_share", "total_span"]
    return f"""{name}_raw AS (SELECT source_id, key, flow_no, clump_no, count(*) OVER {f} AS n,
    sum(size) OVER {f} AS ss, max(size) OVER {f} AS mx, sum(pkt_count) OVER {f} AS sp, sum(duration_us) OVER {f} AS sd,
    sum(interarrival_us) OVER {f} AS sg, sum(size * size) OVER {f} AS sq,
    sum(CASE WHEN direction = 0 THEN 1 ELSE 0 END) OVER {f} AS fw FROM clumps),
{name}_rows AS (SELECT source_id, key, flow_no, clump_no, CASE CAST(key AS BIGINT) % 3 WHEN 0 THEN 'tunnel_like' WHEN 1 THEN 'benign_doh' ELSE 'non_doh' END AS truth,
    ss / {length}.0 AS mean_size, CAST(mx AS DOUBLE) AS max_size, sp / {length}.0 AS mean_pkts, sd / 1e6 / {length} AS mean_duration,
    sg / 1e6 / {length} AS mean_interarrival, sqrt(CAST({length} * sq - ss * ss AS DOUBLE)) / {length} AS std_size,
    (fw + {length} - n) / {length}.0 AS forward_share, (sd + sg) / 1e6 AS total_span
    FROM {name}_raw WHERE n = {length} OR clump_no = 0),
{name}_train AS (SELECT *, {label} AS cls FROM {name}_rows WHERE CAST(key AS BIGINT) % 5 < 3 {train}),
{name}_scale AS (SELECT {', '.join(f'CASE WHEN stddev_pop({c}) > 1e-6 THEN stddev_pop({c}) ELSE 1 END AS s_{c}' for c in cols)} FROM {name}_train),
{name}_center AS (SELECT cls, {', '.join(f'avg({c}) AS m_{c}' for c in cols)} FROM {name}_train GROUP BY 1),
{name} AS (SELECT source_id, key, flow_no, any_value(truth) AS truth, any_value(total_span) AS delay_s,
    arg_min(cls, sqrt({' + '.join(f'(({c} - m_{c}) / s_{c}) ** 2' for c in cols)})) AS predicted
    FROM {name}_rows, {name}_center, {name}_scale WHERE CAST(key AS BIGINT) % 5 >= 3 AND clump_no = 0 GROUP BY 1, 2, 3)"""


CASCADE_SQL = f"""{CLUMPS_SQL},
{stage_sql('one', 6, "CASE WHEN truth = 'non_doh' THEN truth ELSE 'doh' END", '')},
{stage_sql('two', 3, 'truth', "AND truth <> 'non_doh'")},
spans AS (SELECT source_id, key, flow_no, (max(end_us) - min(start_us)) / 1e6 AS span_s FROM clumps GROUP BY 1, 2, 3),
verdicts AS (SELECT a.source_id, a.key, a.flow_no, a.truth, a.predicted AS l1_predicted, a.delay_s AS l1_delay_s,
    CASE WHEN a.predicted = 'doh' THEN b.predicted ELSE 'filtered_by_layer1' END AS verdict,
    CASE WHEN a.predicted = 'doh' THEN b.delay_s ELSE 0 END AS l2_delay_s, span_s
  FROM one a JOIN two b USING (source_id, key, flow_no) JOIN spans USING (source_id, key, flow_no))"""


@query(f"""WITH {CASCADE_SQL} SELECT source_id, key, flow_no, truth, l1_predicted, verdict, round(l1_delay_s, 6) AS l1_delay_s,
  round(l2_delay_s, 6) AS l2_delay_s FROM verdicts""")
def cascade(spark, sf):
    return two_stages(spark, sf).select(*FLOW, "truth", "l1_predicted", "verdict",
                                        F.round("l1_delay_s", 6).alias("l1_delay_s"),
                                        F.round("l2_delay_s", 6).alias("l2_delay_s"))


@query(f"""WITH {CASCADE_SQL} SELECT count(*) AS total_flows, count(*) FILTER (truth = 'tunnel_like') AS true_tunnels,
  count(*) FILTER (truth = 'tunnel_like' AND verdict = 'tunnel_like') AS detected_tunnels,
  round(coalesce(avg(CASE WHEN span_s > 0 THEN (span_s - l1_delay_s) / span_s ELSE 0 END) FILTER (truth = 'tunnel_like'), 0), 4) AS mean_delay_reduction,
  round(count(*) FILTER (truth = 'tunnel_like' AND verdict = 'tunnel_like') / count(*) FILTER (truth = 'tunnel_like')::DOUBLE, 4) AS detection_rate
FROM verdicts""")
def cascade_summary(spark, sf):
    return P.cascade_summary(two_stages(spark, sf), "truth", "tunnel_like")
