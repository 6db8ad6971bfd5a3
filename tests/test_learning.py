"""Labels, splits, metrics, calibration, models and comparison tables on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from packetloom.functions import names as N
from packetloom.functions import paths as P
from packetloom.operators import bayes as B
from packetloom.operators import calibrate as K
from packetloom.operators import compare as T
from packetloom.operators import forest as X_forest
from packetloom.operators import labels as A
from packetloom.operators import metrics as M
from packetloom.operators import models as X
from packetloom.operators import prototypes as Q
from packetloom.operators import splits as S
from packetloom.operators.ordered import first_n, hash_cut, running, score_bucket
from packetloom.plans import sequence as plan
from packetloom.plans import tabular as tabular_plan


def scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, map(float, scores))), "label int, score double")


@pytest.mark.parametrize("path, category, scenario, session", [
    ("raw/NonDoH/chrome_https_01.pcap", "non_doh", "non_doh_chrome", "chrome_https_01"),
    ("BenignDoH_NonDoH-Firefox-CloudFlare/session_01.pcap", "benign_doh", "benign_doh_firefox", "session_01"),
    ("MaliciousDoH/iodine_tunnel_test.pcap", "malicious_doh", "malicious_doh_iodine", "iodine_tunnel_test"),
    ("a/b.pcap.gz", "non_doh", "non_doh_unknown", "a_b"), ("benigndoh/x y.cap", "benign_doh", "benign_doh_browsing", "benigndoh_x_y"),
    (r"win\DoH\quad9-long.pcapng", "benign_doh", "benign_doh_quad9", "quad9-long"), ("v.pcap", "non_doh", "non_doh_unknown", "v")])
def test_paths(spark, path, category, scenario, session):
    r = spark.createDataFrame([(path,)], "p string").select(P.path_metadata(F.col("p")).alias("m"), P.session_id(F.col("p")).alias("s")).first()
    assert (r.m.category, r.m.scenario_id, r.s) == (category, scenario, session)


def test_names():
    assert N.find_label(["x", "Label"]) == "Label" and N.find_label(["x", "my_class"]) == "my_class"
    assert N.find_label(["a", "B"], " b ") == "B"
    for columns in (["x"], ["target_a", "class_b"]):
        with pytest.raises(ValueError):
            N.find_label(columns)
    assert N.feature_columns(["Flow-ID", "SourceIP", "Duration", "__t", "Label", "TimeStamp"], "Label") == ["Duration"]


def test_running_and_first_n_match_plain_python(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randrange(10)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, v long").withColumn("b", F.floor(F.col("i") / 17))
    out = running(df, ["g"], "b", ["i"], {"s": ("sum", F.col("v"), True), "m": ("max", F.col("v"), False),
                                          "l": ("last", F.when(F.col("v") > 6, F.col("i")), True)})
    seen = {}
    for r in out.orderBy("i").collect():
        old = seen.setdefault(r.g, [0, None, None])
        assert r.m == old[1]
        old[0] += r.v
        old[1] = r.v if old[1] is None else max(old[1], r.v)
        old[2] = r.i if r.v > 6 else old[2]
        assert (r.s, r.l) == (old[0], old[2])
        assert r.s_total == sum(v for g, _, v in rows if g == r.g)
    for few in (True, False):
        got = sorted(tuple(r)[:2] for r in first_n(df, ["g"], ["i"], 9, few, rows_per_piece=50).collect())
        assert got == sorted((g, i) for k in "ab" for g, i in [(g, i) for g, i, _ in rows if g == k][:9])


def test_score_bucket_never_decreases(spark):
    values = sorted([-50.0, -1.0, -1e-9, 0.0, 1e-300, 1e-9, 0.1, 0.5, 0.9, 1 - 1e-12, 1.0, 1.5, 900.0] + [i / 997 for i in range(997)])
    df = spark.createDataFrame([(v,) for v in values], "s double").select("s", score_bucket(F.col("s")).alias("b"))
    buckets = [r.b for r in sorted(df.collect(), key=lambda r: r.s)]
    assert buckets == sorted(buckets) and len(set(buckets)) > 300


@pytest.mark.parametrize("labels, scores, roc, ap", [
    ([0, 0, 1, 1], [.1, .2, .8, .9], 1.0, 1.0), ([1, 1, 0, 0], [.1, .2, .8, .9], 0.0, None), ([0, 1], [.5, .5], 0.5, 0.5),
    ([1, 1], [.1, .2], None, 1.0), ([0, 0], [.1, .2], None, None)])
def test_ranking(spark, labels, scores, roc, ap):
    r = M.ranking_metrics(scored(spark, labels, scores)).first()
    assert r.roc_auc == roc
    if ap is not None or 1 not in labels:
        assert r.pr_auc == ap


def brute_threshold(labels, scores, cap, tie):
    n_neg, n_pos = labels.count(0), labels.count(1)
    options = set(scores) | {0.5, 1.0, max(scores) + 1e-6} | ({0.0} if tie == "higher" else set())
    best = []
    for tau in options:
        fpr = sum(1 for y, s in zip(labels, scores) if s >= tau and y == 0) / n_neg
        tpr = sum(1 for y, s in zip(labels, scores) if s >= tau and y == 1) / n_pos if n_pos else 0.0
        best.append((fpr, tpr, tau))
    ok = [b for b in best if b[0] <= cap + 1e-12]
    if tie == "higher":
        pick = max(ok, key=lambda b: (b[1], -b[0], b[2])) if ok else max(best, key=lambda b: (-b[0], b[1], b[2]))
    else:
        pick = max(ok, key=lambda b: (b[1], -b[2])) if ok else max(best, key=lambda b: (-b[0], b[1], -b[2]))
    return pick[2], pick[0], bool(ok)


@pytest.mark.parametrize("tie", ["higher", "lower"])
@pytest.mark.parametrize("cap", [0.0, 0.1, -1.0])
def test_thresholds_match_brute_force(spark, tie, cap):
    rng = random.Random(11)
    labels = [rng.randrange(2) for _ in range(80)]
    scores = [round(min(1.2, max(-0.2, rng.gauss(0.4 + 0.3 * y, 0.3))), 2) for y in labels]
    r = M.select_threshold(scored(spark, labels, scores), target_fpr=cap, tie=tie).first()
    want = brute_threshold(labels, scores, cap, tie)
    assert (r.threshold, r.feasible) == (pytest.approx(want[0], abs=1e-12), want[2]) and r.fpr == pytest.approx(want[1])


def test_threshold_cases(spark):
    assert M.select_threshold(scored(spark, [0, 0, 1, 1], [.1, .2, .6, .8]), target_fpr=.01).first().threshold >= 0.6
    r = M.select_threshold(scored(spark, [0, 1], [.9, .9]), target_fpr=0.0).first()
    assert r.threshold > 0.9 and r.fpr == 0.0
    assert tuple(M.select_threshold(scored(spark, [1, 1], [.3, .9])).first()) == (0.5, 0.0, True)
    empty = M.select_threshold(scored(spark, [], []))
    assert tuple(empty.first()) == (0.5, 0.0, False)


def test_platt(spark):
    rng = random.Random(2)
    labels = [rng.randrange(2) for _ in range(200)]
    scores = [rng.gauss(2.0 * y - 1.0, 1.0) for y in labels]
    a, b = K.platt_fit(scored(spark, labels, scores))
    n1, n0 = sum(labels), len(labels) - sum(labels)
    targets = [(n1 + 1) / (n1 + 2) if y else 1 / (n0 + 2) for y in labels]
    residual = [1 / (1 + math.exp(-(a * s + b))) - t for s, t in zip(scores, targets)]
    assert abs(sum(residual)) < 1e-3 and abs(sum(r * s for r, s in zip(residual, scores))) < 1e-3 and a > 0
    assert K.platt_fit(scored(spark, [], [])) == (1.0, 0.0)
    assert K.platt_fit(scored(spark, [0, 0], [1, 2])) == (0.0, -10.0) and K.platt_fit(scored(spark, [1], [1])) == (0.0, 10.0)
    far = spark.range(1).select(K.platt_apply(F.lit(-900.0), 1.0, 0.0), K.platt_apply(F.lit(900.0), 1.0, 0.0)).first()
    assert tuple(far) == (0.0, 1.0)


def samples(spark, sessions=12, per=20, seed=4):
    rng = random.Random(seed)
    rows = [(f"x{s}_{i}", f"s{s:02d}", int(rng.random() < 0.2 + 0.05 * (s % 7))) for s in range(sessions) for i in range(per + s)]
    return spark.createDataFrame(rows, "sample_id string, session_id string, label int")


def test_hash_cut_is_exact_and_repeatable(spark):
    df = samples(spark)
    counts = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    for take in ({0: 7, 1: 3}, {0: counts[0], 1: 0}):
        first = hash_cut(df, "label", "sample_id", 1, take, "t").filter("t")
        assert {r.label: r["count"] for r in first.groupBy("label").count().collect()} == {k: v for k, v in take.items() if v}
        again = hash_cut(df.repartition(7), "label", "sample_id", 1, take, "t").filter("t")
        assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


def test_splits(spark):
    df = samples(spark)
    out = S.split_stratified(df)
    for r in out.groupBy("label").agg(F.count_if(F.col("split") == "test").alias("t"), F.count("*").alias("n")).collect():
        assert r.t == round(r.n * (1 - 0.8))
    nested = S.split_nested(df).groupBy("split").count().collect()
    assert {r.split for r in nested} == {"train", "val", "test"} and sum(r["count"] for r in nested) == df.count()
    for disjoint in (S.split_session_disjoint(df), S.split_session_disjoint(df.repartition(5)), S.split_session_hash(df, seed=9)):
        assert disjoint.count() == df.count() and S.shared_sessions(disjoint).count() == 0
        assert disjoint.select("split", "label").distinct().count() == 6
    sizes = {r.split: r["count"] / df.count() for r in S.split_session_disjoint(df).groupBy("split").count().collect()}
    assert abs(sizes["train"] - 0.7) < 0.12
    whole = S.split_stratified(df.withColumn("label", (F.col("session_id") > "s05").cast("int")), unit="session_id")
    assert S.shared_sessions(whole).count() == 0
    assert S.leakage_report(out).filter("leaks").count() == 1


def test_session_placement_follows_the_rule(spark):
    sizes = {"a": 50, "b": 30, "c": 20, "d": 10, "e": 5}
    rows = [(f"{s}{i}", s, i % 2) for s, n in sizes.items() for i in range(n)]
    out = S.split_session_disjoint(spark.createDataFrame(rows, "sample_id string, session_id string, label int"))
    got = {r.session_id: r.split for r in out.select("session_id", "split").distinct().collect()}
    # a, b, c cover both classes in train, val, test; only train then lacks rows for d and e
    assert got == {"a": "train", "b": "val", "c": "test", "d": "train", "e": "train"}


def test_session_split_of_many_classes(spark):
    rows = spark.range(40_200).select(
        F.col("id").cast("string").alias("sample_id"), (F.col("id") % 4).cast("string").alias("session_id"),
        (F.col("id") % 10_050).alias("label"))
    reach = S.class_reach(rows)
    assert reach.count() == 10_050 and reach.filter("enough").count() == 0
    with pytest.raises(S.ImpossibleSplit, match="10050 classes"):
        S.split_session_disjoint(rows)


def test_both_quotas_fill_in_reading_order(spark):
    flows = [("a", k, 1) for k in range(3)] + [("b", k, 1) for k in range(2)] + [("b", k, 0) for k in range(2, 4)]
    df = spark.createDataFrame([(s, k, f"{s}{k}", 1, bad) for s, k, bad in flows],
                               "source_id string, start_us long, flow_id string, l1_label int, l2_label int")
    order = ["source_id", "start_us", "flow_id"]
    kept = {r.flow_id for r in A.cap_flows(df, 2, 2, order).collect()}
    assert kept == {"a0", "a1", "b2", "b3"}
    rng, rows = random.Random(1), []
    for k in range(120):
        rows.append((f"s{k // 15:02d}", k, f"f{k:03d}", int(rng.random() < 0.7), int(rng.random() < 0.5)))
    full = spark.createDataFrame(rows, df.schema)
    for cap, quota in ((4, 9), (6, 3), (15, 30)):
        want, per_class, per_capture = set(), {}, {}
        for source, _, name, l1, l2 in rows:
            cls = "non" if l1 == 0 else l2
            if per_class.get(cls, 0) < quota and per_capture.get(source, 0) < cap:
                want.add(name)
                per_class[cls] = per_class.get(cls, 0) + 1
                per_capture[source] = per_capture.get(source, 0) + 1
        assert {r.flow_id for r in A.cap_flows(full, cap, quota, order).collect()} == want


def hash_part(name, seed):
    import hashlib
    spot = int(hashlib.md5(f"{seed}|{name}".encode()).hexdigest()[:8], 16) % 10_000
    return "train" if spot < 7000 else "val" if spot < 8500 else "test"


def placed(spark, held, seed=42):
    rows = spark.createDataFrame([(f"{s}/{c}", s, c) for s, cs in held.items() for c in cs],
                                 "sample_id string, session_id string, label int")
    got = S.split_session_hash(rows, seed=seed).collect()
    parts = {r.session_id: r.split for r in got}
    assert len(got) == rows.count() and all(parts[r.session_id] == r.split for r in got)
    return parts


def test_repair_of_hash_splits_over_all_sessions(spark):
    # Class 1 has no session in val; all of its sessions but the last in hash order are needed where they are.
    import hashlib
    train = sorted((f"s{i}" for i in range(400) if hash_part(f"s{i}", 42) == "train"),
                   key=lambda s: hashlib.md5(f"42|{s}".encode()).hexdigest())[:32]
    others = {p: [f"s{i}" for i in range(400) if hash_part(f"s{i}", 42) == p][:2] for p in ("val", "test")}
    held = {s: [1, 10 + k] for k, s in enumerate(train[:-1])}  # each is the only one in train with its own class
    held |= {s: list(range(10, 10 + len(train) - 1)) for s in others["val"] + others["test"]}
    held[others["test"][0]].append(1)
    held[train[-1]] = [1]
    parts = placed(spark, held)
    assert {s for s in held if parts[s] != hash_part(s, 42)} == {train[-1]} and parts[train[-1]] == "val"
    del held[train[-1]]
    with pytest.raises(S.ImpossibleSplit, match="1 into val"):
        placed(spark, held)


def test_repair_of_hash_splits_on_random_sessions(spark):
    rng = random.Random(6)
    for seed in (1, 2):
        held = {f"s{i}": sorted({0, 1 + i % 12, rng.randrange(13)}) for i in range(70)}
        parts = placed(spark, held, seed)
        assert {(parts[s], c) for s, cs in held.items() for c in cs} == {(p, c) for p in S.PARTS for c in range(13)}
        gaps = {(p, c) for p in S.PARTS for c in range(13)} - {(hash_part(s, seed), c) for s, cs in held.items() for c in cs}
        assert sum(parts[s] != hash_part(s, seed) for s in held) <= len(gaps)


def test_impossible_splits(spark):
    schema = "sample_id string, session_id string, label int"
    two = spark.createDataFrame([("1", "s", 0), ("2", "t", 1), ("3", "s", 1), ("4", "t", 0)], schema)
    for bad in (lambda: S.split_session_disjoint(two), lambda: S.split_stratified(two.filter("label = 0")),
                lambda: S.split_stratified(two.limit(0)), lambda: S.split_stratified(two.filter("sample_id < '3'"))):
        with pytest.raises(S.ImpossibleSplit):
            bad()
    with pytest.raises(ValueError):
        S.split_session_disjoint(two, train=0.9)
    with pytest.raises(ValueError):
        S.split_session_disjoint(two.withColumn("session_id", F.lit("")))
    with pytest.raises(ValueError):
        S.split_samples(two, "no such protocol")


def test_quota_and_labels(spark):
    flows = spark.createDataFrame([("c1", i, d, s) for i, (d, s) in enumerate(
        [(True, "malicious_x"), (True, "benign_y"), (True, "other"), (False, "benign_y")])],
        "source_id string, i int, is_doh boolean, scenario_id string")
    got = {r.i: (r.l1_label, r.l2_label) for r in A.label_flows(flows).collect()}
    assert got == {0: (1, 1), 1: (1, 0), 2: (1, None), 3: (0, None)}
    caps = spark.createDataFrame([("c1", "benign_doh", False)], "source_id string, category string, is_malicious boolean")
    assert {r.l2_label for r in A.label_flows(flows, caps).filter("is_doh").collect()} == {0}
    assert A.cap_flows_per_class(A.label_flows(flows), 1, ["i"], "l1").count() == 2
    assert A.cap_flows_per_class(A.label_flows(flows), 1, ["i"], "l2").count() == 2
    with pytest.raises(ValueError):
        A.require_classes(flows, "source_id")


def test_centroids(spark):
    rows = [("a", 0.0 + i, 5.0) for i in range(3)] + [("b", 10.0 + i, 5.0) for i in range(3)]
    df = spark.createDataFrame(rows, "name string, x double, y double")
    model = Q.fit_centroids(df, "name", ["x", "y"])
    out = Q.predict_centroids(df, model, ["x", "y"]).collect()
    assert [r.predicted for r in out] == ["a"] * 3 + ["b"] * 3
    assert all(abs(sum(r.scores.values()) - 1) < 2e-4 for r in out) and model.first().scales[1] == 1.0


def test_cascade(spark):
    one = spark.createDataFrame([("f", "doh", 1.0, "tunnel_like", 4.0), ("g", "non_doh", 2.0, "tunnel_like", 4.0)],
                                "k string, predicted string, delay_s double, truth string, span_s double")
    two = spark.createDataFrame([("f", "tunnel_like", 0.5), ("g", "tunnel_like", 0.5)], "k string, predicted string, delay_s double")
    out = Q.cascade(one, two, ["k"])
    assert {r.k: r.verdict for r in out.collect()} == {"f": "tunnel_like", "g": "filtered_by_layer1"}
    assert tuple(Q.cascade_summary(out, "truth", "tunnel_like").first()) == (2, 2, 1, 0.625, 0.5)


def test_scaler_sees_real_training_steps_only(spark):
    pad = [-1.0, -1.0, -1.0, -1.0, 0.0]
    df = spark.createDataFrame([([[1.0] * 5, pad],), ([[3.0] * 5, pad],)], "features array<array<double>>")
    fitted = S.fit_scaler(df)
    assert [(r.mean, r.std) for r in fitted.orderBy("feature").collect()] == [(2.0, 1.0)] * 5
    out = [r.features for r in S.apply_scaler(df, fitted).collect()]
    assert out[0] == [[-1.0] * 5, pad] and out[1] == [[1.0] * 5, pad]


def run_rows(spark, rows):
    return spark.createDataFrame(rows, "run_no long, task string, model string, split_protocol string, window_size int, f1_score double, fpr double")


def test_run_tables(spark):
    runs = run_rows(spark, [(0, "l1", "paper_v4", "session_scenario_disjoint", 6, 0.5, 0.0), (1, "l1", "paper_v4", "paper_flow_random", 6, 0.8, 0.1),
                            (2, "l1", "improved_bidi_gru", "session_scenario_disjoint", 6, 0.7, None), (3, "l1", "paper_v4", "paper_flow_random", 6, 0.9, 0.0)])
    assert T.find_run(runs, task="l1", split_protocol="paper_flow_random").first().run_no == 1
    assert T.runs_by_length(runs, split_protocol="paper_flow_random").first().run_no == 3
    base = spark.createDataFrame([("sequence", "l1", "lstm", 6, "paper_flow_random", .99, .99, .99, None, .5, .05),
                                  ("sequence", "l1", "lstm", 7, "paper_flow_random", .99, .99, .99, None, .5, .05)],
                                 "paradigm string, task string, model string, window_size int, split_protocol string, precision double, "
                                 "recall double, f1_score double, fpr double, mean_s double, median_s double")
    got = {(r.window_size, r.status): r.f1_score for r in T.sweep_table(base, runs).collect()}
    assert got == {(6, "published"): .99, (7, "published"): .99, (6, "completed"): .9, (7, "unavailable"): None}
    impact = T.split_impact_table(runs).first()
    assert impact.f1_score_change == pytest.approx(-0.3) and impact.fpr_disjoint == 0.0
    change = T.best_f1_change(runs).first()
    assert change.change == pytest.approx(0.2) and change.verdict == "mixed observed result"


def test_models_learn_separable_rows(spark):
    rng = random.Random(8)
    rows = [(i, rng.gauss(3.0 * (i % 2) - 1.5, 0.7), rng.gauss(0, 1), "Malicious" if i % 2 else "nondoh") for i in range(160)]
    df = spark.createDataFrame(rows, "`Flow ID` int, Duration double, `PacketLengthMean ` double, Label string")
    out = tabular_plan.run(df, "l1", models=["decision_tree", "linear_svm"], settings={"decision_tree": {"maxDepth": 3}, "linear_svm": {"maxIter": 10}})
    for r in out["metrics"].collect():
        assert r.f1_macro > 0.85 and r.roc_auc > 0.85 and 0 <= r.selected_threshold <= 1.01
    assert out["classes"].agg(F.sum("count")).first()[0] == 160
    with pytest.raises(ValueError, match="not known"):
        tabular_plan.run(df.withColumn("Label", F.lit("strange")), "l1")


def test_packets_to_sweep(spark):
    rng, rows, n = random.Random(6), [], 0
    for s in range(9):
        kind = ("non", "benign", "malicious")[s % 3]
        server = "1.1.1.1" if kind != "non" else "10.9.9.9"
        for flow in range(3):
            t = flow * 10**9
            for i in range(14):
                t += 2000 if kind == "malicious" else rng.randrange(100_000, 900_000)
                a, b = ("10.0.0.2:%d" % (1000 + flow), server + ":443")
                rows.append((f"cap{s}", "k%d" % flow, n, t, 60 if kind == "malicious" else rng.randrange(100, 1500), *((a, b) if i % 2 == 0 else (b, a))))
                n += 1
    packets = spark.createDataFrame(rows, "source_id string, key string, packet_no long, ts_us long, length long, sender string, receiver string")
    captures = spark.createDataFrame([(f"cap{s}", f"sess{s}", ("non_doh", "benign_doh", "malicious_doh")[s % 3] + "_x",
                                       ("non_doh", "benign_doh", "malicious_doh")[s % 3], s % 3 == 2) for s in range(9)],
                                     "source_id string, session_id string, scenario_id string, category string, is_malicious boolean")
    flows, kept = plan.labelled_flows(packets, captures, flows_per_capture=3, flows_per_class=9)
    assert flows.count() == 27 and kept.count() == len(rows)
    from packetloom.operators.clumps import clump
    out = plan.sweep(clump(kept), flows, tasks=["l2"], lengths=[3], kinds=["logistic"], max_iter=15)
    got = {r.split_protocol: r for r in out.collect()}
    assert set(got) == {"paper_flow_random", "session_scenario_disjoint"} and got["paper_flow_random"].roc_auc > 0.8


def test_gaussian_bayes_equals_plain_arithmetic(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    n = 300
    label = rng.integers(0, 7, n)
    values = np.c_[rng.normal(label, 1), rng.normal(0, 100, n), np.where(label == 3, 5.0, rng.normal(size=n))]
    rows = [(int(y), *map(float, v)) for y, v in zip(label, values)]
    df = spark.createDataFrame(rows + [(None, 1.0, 2.0, 3.0)], "y int, a double, b double, c double")
    model = B.fit_gaussian(df, "y", ["a", "b", "c"])
    got = {r.name: r for r in model.collect()}
    extra = 1e-9 * values.var(axis=0).max()
    logs = np.empty((n, 7))
    for k in range(7):
        own = values[label == k]
        mean, var = own.mean(axis=0), own.var(axis=0) + extra
        np.testing.assert_allclose(got[k].means, mean, rtol=1e-9)
        np.testing.assert_allclose(got[k].variances, var, rtol=1e-9)
        logs[:, k] = np.log(len(own) / n) - 0.5 * (np.log(2 * np.pi * var) + (values - mean) ** 2 / var).sum(axis=1)
    out = B.predict_gaussian(df.filter("y IS NOT NULL").coalesce(1), model, ["a", "b", "c"]).collect()
    share = np.exp(logs - logs.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    assert [r.predicted for r in out] == list(logs.argmax(axis=1))
    np.testing.assert_allclose([[r.probabilities[k] for k in range(7)] for r in out], share, atol=1e-9)
    unknown = B.predict_gaussian(df.select("y", "a", "b", F.lit(None).cast("double").alias("c")), model, ["a", "b", "c"])
    assert unknown.filter("predicted IS NOT NULL").count() == 0
    assert B.predict_gaussian(df, B.fit_gaussian(df.limit(0), "y", ["a"]), ["a"]).filter("predicted IS NOT NULL").count() == 0


def test_gaussian_bayes_among_the_models(spark):
    rows = [(i % 2, float(i % 2) + (i % 5) / 10, float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "target int, a double, b double")
    scored = X.score_rows(X.fit_tabular(df, ["a", "b"], "gaussian_nb"), df)
    assert scored.filter("prediction = target").count() == 60 and scored.filter("score > 0.5").count() == 30


def test_digests_of_id_sets(spark):
    rows = [(f"s{i}", f"x{i % 7}", "train" if i % 3 else "test") for i in range(200)]
    schema = "sample_id string, session_id string, split string"
    digests = lambda r: {(d.split, d.kind): (d.ids, d.digest) for d in S.split_digests(
        spark.createDataFrame(r, schema), ["sample_id", "session_id"]).collect()}
    base = digests(rows)
    assert base == digests(rows[::-1] + rows[:5]) and base["train", "session_id"][0] == 7
    moved = digests([(*rows[0][:2], "train"), *rows[1:]])
    assert {k for k in base if base[k] != moved[k]} == {("train", "sample_id"), ("test", "sample_id")}
    named = S.split_ids(spark.createDataFrame(rows, schema), ["sample_id"])
    assert sorted(map(tuple, named.collect())) == sorted((s, "sample_id", i) for i, _, s in rows)


def test_passes_of_the_compared_models(spark):
    """The linear model steps over few partitions; a forest that keeps nodes is the forest that does not."""
    rows = spark.range(0, 400, 1, 8).select(
        (F.col("id") % 37).cast("double").alias("a"), (F.col("id") * 7 % 11).cast("double").alias("b"),
        ((F.col("id") % 37 + F.col("id") * 7 % 11) % 5 < 2).cast("int").alias("target"))
    spark.sparkContext.setJobGroup("svm passes", "")
    X.fit_tabular(rows, ["a", "b"], "linear_svm", maxIter=5)
    spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    last = tracker.getJobInfo(max(tracker.getJobIdsForGroup("svm passes")))
    assert [tracker.getStageInfo(i).numTasks for i in last.stageIds] == [1]
    kept, walked = [X.fit_tabular(rows, ["a", "b"], "random_forest", numTrees=5, **more).stages[-1]
                    for more in ({}, {"cacheNodeIds": False})]
    assert kept.getCacheNodeIds() and kept.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]


def _mixed_rows(spark, n=3000):
    rows = spark.range(0, n, 1, 5).select(
        "id", (F.col("id") % 29).cast("double").alias("a"), (F.col("id") * 7 % 11).cast("double").alias("b"),
        (F.xxhash64("id") % 17).cast("double").alias("c"))
    return rows.withColumn("target", ((F.col("a") + F.col("b") + (F.xxhash64("id", F.lit(3)) % 9 == 0).cast("int") * 9) % 13 < 6).cast("int"))


def test_forest_in_parts_is_the_whole_one(spark, monkeypatch):
    """A tree split in passes and finished in tasks is the tree grown in one task, with the gains of Spark ML's."""
    rows, names = _mixed_rows(spark), ["a", "b", "c"]
    gains = []
    for tops, size in ((False, 1 << 16), (True, 150)):
        monkeypatch.setattr(X_forest, "ROWS_PER_NODE", size)
        monkeypatch.setattr(X_forest, "NODES_AT_ONCE", 7)
        monkeypatch.setattr(X, "TREE_ROWS", 100)
        tree = X.fit_tabular(rows, names, "decision_tree")
        assert isinstance(tree, X_forest.Forest) and (len(tree.tops[0]) > 10) == tops
        assert tree.subtrees.agg(F.max(F.length("nodes"))).first()[0] < (1 << 16 if not tops else 300 * 40)
        gains.append(tree.importances())
    monkeypatch.setattr(X, "TREE_ROWS", 1 << 40)
    gains.append(X.fit_tabular(rows, names, "decision_tree").stages[-1].featureImportances.toArray())
    assert gains[1] == pytest.approx(gains[0], abs=1e-9) and gains[2] == pytest.approx(gains[0], abs=0.03)
    listed = X.feature_importance(spark, tree, names).collect()
    assert [r.importance for r in listed] == sorted(gains[1], reverse=True)


def test_driver_holds_no_deep_forest(spark, monkeypatch):
    """Nodes grow with the rows; those on the driver are far fewer, and a run repeats."""
    monkeypatch.setattr(X, "TREE_ROWS", 100)
    monkeypatch.setattr(X_forest, "ROWS_PER_NODE", 400)
    monkeypatch.setattr(X_forest, "ROWS_PER_ROUND", 20_000)
    rows = _mixed_rows(spark).localCheckpoint()
    first, again = [X.fit_tabular(rows, ["a", "b", "c"], "random_forest", numTrees=12) for _ in range(2)]
    deep = first.subtrees.agg(F.sum("n_nodes")).first()[0]
    assert deep > 10 * sum(map(len, first.tops)) and len({t.tobytes() for t in first.tops}) == 12
    assert first.importances() == pytest.approx(again.importances(), abs=1e-12)
    assert first.importances().sum() == pytest.approx(1) and first.importances()[2] < 0.3
    sparks = RandomForestClassifier(numTrees=12, maxDepth=30, labelCol="target", seed=1).fit(
        VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows))
    assert first.importances() == pytest.approx(sparks.featureImportances.toArray(), abs=0.08)


def test_forest_scores_where_its_trees_are(spark, monkeypatch):
    """Scores summed over tasks are those of whole trees, for every row: repeated ones and ones without values too."""
    monkeypatch.setattr(X, "TREE_ROWS", 100)
    for name, size in (("ROWS_PER_NODE", 300), ("ROWS_PER_ROUND", 9_000), ("ROWS_PER_BLOCK", 200)):
        monkeypatch.setattr(X_forest, name, size)
    rows, names = _mixed_rows(spark).localCheckpoint(), ["a", "b", "c"]
    model = X.fit_tabular(rows, names, "random_forest", numTrees=10)
    odd = rows.limit(40).withColumns({"a": F.lit(float("nan")), "b": F.lit(None).cast("double")})
    some = rows.filter("id % 3 = 0").unionByName(rows.filter("id < 50")).unionByName(odd)
    got = X.score_rows(model, some).collect()
    assert len(got) == 1000 + 50 + 40 and set(got[0].asDict()) == {"id", *names, "target", "prediction", "score"}
    nodes = {(r.tree, r.node): np.frombuffer(r.nodes, X_forest.NODE) for r in model.subtrees.collect()}
    bins = np.array([[np.searchsorted(e, np.nan if r[c] is None else r[c]) for c, e in zip(names, model.edges)] for r in got], np.uint8)
    wanted = np.zeros(len(got))
    for tree, top in enumerate(model.tops):
        for i, at in enumerate(X_forest.walk(top, bins).tolist()):
            below = top[at:at + 1] if top["feature"][at] == X_forest.LEAF else nodes[tree, at]
            wanted[i] += X_forest.share(below["n"])[X_forest.walk(below, bins[i:i + 1])[0]] / 10
    assert [r.score for r in got] == pytest.approx(wanted.tolist(), abs=1e-12)
    assert [r.prediction for r in got] == [int(w > 0.5 + 1e-12) for w in wanted]
    assert sum(r.prediction == r.target for r in got) > 850
    assert X.score_rows(model, rows.limit(0)).count() == 0
    metrics = X.compare_models(rows, rows, names, ["random_forest", "decision_tree"], val=rows, settings={"random_forest": {"numTrees": 4}})
    assert {r.model: r.total for r in metrics.collect() if r.roc_auc > 0.9} == {"random_forest": 3000, "decision_tree": 3000}


def test_ablation_scores_once(spark, monkeypatch):
    """Metrics, which read scores several times, get them from a written table."""
    rows = spark.range(200).select((F.col("id") % 37).cast("double").alias("Duration"), (F.col("id") % 3).cast("double").alias("PacketTimeMean"),
                                   (F.col("id") % 5 < 2).cast("int").alias("target"))
    seen, plain = [], X.evaluate
    monkeypatch.setattr(X, "evaluate", lambda scored, *more: seen.append(scored.inputFiles()) or plain(scored, *more))
    out = X.group_ablation(rows, rows, ["Duration", "PacketTimeMean"], "decision_tree")
    assert out.count() == 5 and len(seen) == 3 and all(seen)
