"""Flows, clumps and windows: fixed cases, invariants, and busy keys against plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.functions import scaling as S
from packetloom.operators import clumps as C
from packetloom.operators import delay as D
from packetloom.operators import flows as L
from packetloom.operators import windows as W
from packetloom.operators.stats import flow_statistics
from packetloom.schema import FLOW

FLOW_PACKETS = "source_id string, key string, flow_no long, packet_no long, ts_us long, length long, direction int"


def flow_packets(spark, rows):
    return spark.createDataFrame([("s", "k", 0, i, t, n, d) for i, (t, n, d) in enumerate(rows)], FLOW_PACKETS)


def clump_rows(df):
    return [(r.size, r.pkt_count, r.direction, r.duration_us, r.interarrival_us)
            for r in df.orderBy("clump_no").collect()]


@pytest.mark.parametrize("packets, timeout, expected", [
    ([(0, 100, 0), (500, 200, 0), (900, 300, 0)], 1000, [(600, 3, 0, 900, 0)]),
    ([(0, 150, 0), (100, 250, 1), (200, 180, 0), (300, 320, 1)], 1000,
     [(150, 1, 0, 0, 0), (250, 1, 1, 0, 100), (180, 1, 0, 0, 100), (320, 1, 1, 0, 100)]),
    ([(1_000_000, 100, 0), (1_001_000, 200, 0)], 1000, [(300, 2, 0, 1000, 0)]),
    ([(1_000_000, 100, 0), (1_001_001, 200, 0)], 1000, [(100, 1, 0, 0, 0), (200, 1, 0, 0, 1001)]),
    ([(0, 1, 0), (20_000, 1, 0), (80_000, 1, 0)], 50_000, [(2, 2, 0, 20_000, 0), (1, 1, 0, 0, 60_000)]),
    ([(5, 450, 1)], 1000, [(450, 1, 1, 0, 0)]),
    ([], 1000, []),
])
def test_clump_cases(spark, packets, timeout, expected):
    assert clump_rows(C.clump(flow_packets(spark, packets), timeout)) == expected


def random_packets(spark, keys=3, n=1500, seed=7):
    """One heavy key, late packets, equal times and both directions."""
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 0, 3, 40, 900, 2500])
        key = 0 if rng.random() < 0.7 else rng.randrange(keys)
        late = rng.choice([0, 0, 0, 0, 700, 4000])
        ends = ("a:1", "b:2") if rng.random() < 0.5 else ("b:2", "a:1")
        rows.append(("s", str(key), i, max(0, t - late), rng.choice([40, 60, 100, 1500]), *ends))
    return spark.createDataFrame(
        rows, "source_id string, key string, packet_no long, ts_us long, length long, sender string, receiver string")


def brute_flows(packets, idle):
    """Reference results by a plain loop over a small table."""
    open_, out = {}, []
    for p in sorted(packets.collect(), key=lambda r: r.packet_no):
        state = open_.get(p.key)
        if state is None or p.ts_us - state["last"] > idle:
            state = {"no": 0 if state is None else state["no"] + 1, "last": p.ts_us, "client": p.sender}
            open_[p.key] = state
        state["last"] = max(state["last"], p.ts_us)
        out.append((p.key, state["no"], p.packet_no, 0 if p.sender == state["client"] else 1, p.ts_us, p.length))
    return out


def brute_clumps(flows, timeout):
    groups = {}
    for key, no, pno, d, ts, length in flows:
        groups.setdefault((key, no), []).append((ts, pno, d, length))
    out = []
    for (key, no), rows in groups.items():
        rows.sort()
        k, prev, clumps = -1, None, []
        for ts, _, d, length in rows:
            if prev is None or d != prev[1] or ts - prev[0] > timeout:
                clumps.append([length, 1, d, ts, ts, 0 if prev is None else ts - prev[0]])
            else:
                c = clumps[-1]
                c[0], c[1], c[4] = c[0] + length, c[1] + 1, ts
            prev = (ts, d)
        out += [(key, no, k, *c) for k, c in enumerate(clumps)]
    return sorted(out)


@pytest.mark.parametrize("per_piece", [10**6, 100])
def test_flows_and_clumps_match_a_plain_loop(spark, per_piece):
    packets = random_packets(spark)
    want = brute_flows(packets, 5000)
    got = L.split_flows(packets, 5000, per_piece)
    assert sorted((r.key, r.flow_no, r.packet_no, r.direction) for r in got.collect()) == sorted(w[:4] for w in want)
    clumps = brute_clumps(want, 1000)
    for df in (C.clump(got, 1000, rows_per_piece=per_piece), C.packets_to_clumps(packets, 5000, 1000, per_piece)):
        rows = sorted((r.key, r.flow_no, r.clump_no, r.size, r.pkt_count, r.direction, r.start_us, r.end_us,
                       r.interarrival_us) for r in df.collect())
        assert rows == clumps


def test_busy_keys_give_the_same_statistics_and_faults(spark):
    packets = random_packets(spark)
    plain = {r[:3]: r for r in map(tuple, flow_statistics(packets, 5000).collect())}
    cut = {r[:3]: r for r in map(tuple, flow_statistics(packets, 5000, rows_per_piece=100).collect())}
    assert plain.keys() == cut.keys() and len(plain) > 1
    for k, row in plain.items():
        for a, b in zip(row[3:], cut[k][3:]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9))
    odd = packets.withColumn("direction", F.lit(0))
    one = sorted(map(tuple, L.packet_faults(odd).collect()))
    assert one and one == sorted(map(tuple, L.packet_faults(odd, rows_per_piece=50).collect()))


def test_result_does_not_depend_on_partitions(spark):
    packets = random_packets(spark)
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, C.packets_to_clumps(packets.repartition(int(n)), 5000).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_ordinary_keys_need_one_exchange(spark):
    df = C.packets_to_clumps(random_packets(spark), 5000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_idle_split_takes_new_client(spark):
    rows = [("s", "k", 0, 0, 50, "c", "r"), ("s", "k", 1, 45_000_000, 60, "r", "c")]
    packets = spark.createDataFrame(
        rows, "source_id string, key string, packet_no long, ts_us long, length long, sender string, receiver string")
    flows = L.summarise_flows(L.split_flows(packets)).orderBy("flow_no").collect()
    assert [(f.flow_no, f.client, f.packet_count) for f in flows] == [(0, "c", 1), (1, "r", 1)]


@pytest.mark.parametrize("max_packets, max_bytes", [(None, 900), (5, 900), (4, None), (None, 130)])
def test_flow_caps_match_a_plain_loop(spark, max_packets, max_bytes):
    got = L.split_flows(random_packets(spark), 5000)
    state, want = {}, []
    for r in sorted(got.collect(), key=lambda r: r.packet_no):
        n, b = state.get((r.key, r.flow_no), (0, 0))
        if (max_packets is None or n < max_packets) and (max_bytes is None or b + r.length <= max_bytes):
            state[r.key, r.flow_no] = (n + 1, b + r.length)
            want.append((r.key, r.flow_no, r.packet_no))
    for per_piece in (10**6, 20):
        kept = L.cap_flow_packets(got, max_packets, max_bytes, per_piece)
        assert sorted((r.key, r.flow_no, r.packet_no) for r in kept.collect()) == sorted(want)
    flows = L.summarise_flows(got, kept)
    assert flows.filter("truncated").count() > 0
    assert flows.agg(F.sum("packet_count")).first()[0] == len(want)


def test_capture_caps_are_prefixes(spark):
    packets = random_packets(spark)
    rows = sorted(packets.collect(), key=lambda r: r.packet_no)
    total, want = 0, 0
    for i, r in enumerate(rows):
        total += r.length
        if total > 60_000 or i >= 700:
            break
        want += 1
    got = L.cap_captures(packets, 700, 60_000, rows_per_piece=64)
    assert sorted(r.packet_no for r in got.collect()) == [r.packet_no for r in rows[:want]]


def chain(spark, n):
    rows = [("s", "k", 0, i, 100 + i, 1, i % 2, 10 * i, 10 * i + 4, 4, 6 if i else 0) for i in range(n)]
    return spark.createDataFrame(rows, "source_id string, key string, flow_no long, clump_no long, size long, "
                                       "pkt_count long, direction int, start_us long, end_us long, "
                                       "duration_us long, interarrival_us long")


def test_windows(spark):
    short = W.scaled_windows(chain(spark, 2), 6).collect()
    assert len(short) == 1 and short[0].pad_count == 4 and short[0].features[2] == S.PADDING
    full = {r.window_index: r.features for r in W.scaled_windows(chain(spark, 8), 6).collect()}
    assert sorted(full) == [0, 1, 2] and full[1][0] == full[0][1]
    assert W.scaled_windows(chain(spark, 2), 6, pad=False).count() == 0
    one = W.scaled_windows(chain(spark, 1), 4).select(S.step_mask(F.col("features")).alias("m")).first()
    assert one.m == [1.0, 0.0, 0.0, 0.0]
    assert W.scaled_windows(chain(spark, 8), 3, max_windows=2).count() == 2


@pytest.mark.parametrize("stride", [1, 2])
def test_window_pieces_overlap_rightly(spark, stride):
    clumps = chain(spark, 57)
    whole = sorted(map(str, W.raw_windows(clumps, 6, stride).collect()))
    assert whole == sorted(map(str, W.raw_windows(clumps, 6, stride, clumps_per_piece=10).collect()))
    a = sorted(map(tuple, W.segment_features(clumps, 6).collect()))
    assert a == sorted(map(tuple, W.segment_features(clumps, 6, clumps_per_piece=10).collect()))
    swept = W.window_sweep(clumps, [1, 4], clumps_per_piece=10).groupBy("window_size").count().collect()
    assert {r[0]: r[1] for r in swept} == {1: 57, 4: 54}


def test_delays_telescope(spark):
    clumps = C.packets_to_clumps(random_packets(spark), 5000)
    a = {tuple(r)[:3]: r.delay_us for r in W.collection_delay(clumps, 4).collect()}
    assert a == {tuple(r)[:3]: r.delay_us for r in W.detection_delay(clumps, 4).collect()}


def test_sums_survive_clumping(spark):
    packets = random_packets(spark)
    clumps = C.packets_to_clumps(packets, 5000)
    want = packets.agg(F.sum("length"), F.count("*")).first()
    assert tuple(want) == tuple(clumps.agg(F.sum("size"), F.sum("pkt_count")).first())


def scaled(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scaling_points(spark):
    for seconds, want in [(0.0, 0.0), (1e-12, 0.0), (0.001, 0.9), (0.01, 1.0)]:
        assert scaled(spark, S.scale_time(F.lit(seconds))) == pytest.approx(want)
    for size, want in [(10 ** 0.5, 0.0), (1000, 2.5 / 3.5), (10_000, 1.0), (50_000, 1.0)]:
        assert scaled(spark, S.scale_size(F.lit(size))) == pytest.approx(want)
    for count, want in [(1, 0.0), (0, 0.0), (16, 0.5), (256, 1.0), (1000, 1.0)]:
        assert scaled(spark, S.scale_count(F.lit(count))) == pytest.approx(want)
    for d, want in [(0, 1.0), (1, -1.0), (-1, -1.0)]:
        assert scaled(spark, S.direction_sign(F.lit(d))) == want
    with pytest.raises(Exception, match="invalid clump direction"):
        scaled(spark, S.direction_sign(F.lit(99)))
    vector = chain(spark, 1).selectExpr("10000L as size", "256L as pkt_count", "0 as direction",
                                        "10000L as duration_us", "1000L as interarrival_us")
    assert vector.select(S.clump_vector()).first()[0] == pytest.approx([0.9, 1, 1, 1, 1])


def test_tolerant_mask(spark):
    df = spark.createDataFrame([([[-1.00001, -1.0, -1.0, -1.0, 0.00005], [0.1, 0.2, 0.3, 0.4, 1.0]],),
                                ([S.PADDING, S.PADDING],)], "f array<array<double>>")
    assert [r[0] for r in df.select(S.tolerant_mask(F.col("f"))).collect()] == [[0.0, 1.0], [1.0, 1.0]]


def test_quantiles_of_busy_groups(spark):
    rng = random.Random(3)
    rows = [("a", rng.randrange(500)) for _ in range(801)] + [("b", 4), ("b", 9)]
    df = spark.createDataFrame(rows, "g string, v long")
    plain = sorted(map(tuple, D.quantiles(df, "v", ["g"], [0.0, 0.5, 0.95, 1.0]).collect()))
    cut = sorted(map(tuple, D.quantiles(df, "v", ["g"], [0.0, 0.5, 0.95, 1.0], rows_per_piece=50).collect()))
    assert len(plain) == len(cut) == 2
    for a, b in zip(plain, cut):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])
    summary = D.summary_columns(df, "v", ["g"], with_p90=True, rows_per_piece=50).filter("g = 'b'").first()
    assert summary.p50_seconds == 6.5 and summary.p90_seconds == 8.5 and summary.std_ms == 2500.0
    empty = spark.createDataFrame([("z", None)], "g string, v long")
    assert D.summary_columns(empty, "v", ["g"]).first().p99_seconds == 0.0


@pytest.mark.parametrize("rows_per_piece", [4_000_000, 3])
def test_timeout_sweep_equals_clumps_of_each_timeout(spark, rows_per_piece):
    rng, t, rows = random.Random(9), 0, []
    for i in range(300):
        t += rng.choice([0, 1, 10, 11, 100, 101, 5000])
        rows.append(("s", str(rng.randrange(3)), rng.randrange(2), i, t, rng.randrange(40, 90), rng.randrange(2)))
    packets = spark.createDataFrame(rows, "source_id string, key string, flow_no long, packet_no long, ts_us long, length long, direction int")
    timeouts = [100, 10, 4999]
    fields = ["source_id", "key", "flow_no", "clump_no", "size", "pkt_count", "direction", "start_us", "end_us", "duration_us", "interarrival_us"]
    got = C.timeout_sweep(packets, timeouts, rows_per_piece)
    for timeout in timeouts:
        want = sorted(map(tuple, C.clump(packets, timeout).select(*fields).collect()))
        assert sorted(map(tuple, got.filter(F.col("timeout_us") == timeout).select(*fields).collect())) == want
