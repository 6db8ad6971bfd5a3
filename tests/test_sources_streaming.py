"""Capture bytes to packets, inventories, artifacts, and streams against batch results."""

import contextlib
import hashlib
import json
import os
import random
import socket
import struct
import tempfile
import zipfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spec
from packetloom.functions.tls import application_bytes
from packetloom.operators import checks as V
from packetloom.operators import clumps as C
from packetloom.operators import flows as L
from packetloom.operators import prototypes as Q
from packetloom.operators import windows as W
from packetloom.operators.ordered import materialize
from packetloom.sources import artifacts as A
from packetloom.schema import PACKETS
from packetloom.sources import captures as S
from packetloom.sources import ranges as N
from packetloom.sources import tabular as T
from packetloom.streaming import flows as R


def tls(size, kind=23, major=3):
    return bytes([kind, major, 3]) + struct.pack(">H", size) + b"x" * size


def frame(src, sport, dst, dport, payload, flags=0x18, vlan=False):
    tcp = struct.pack(">HHIIBBHHH", sport, dport, 1, 1, 5 << 4, flags, 1024, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 1, 0, 64, 6, 0, socket.inet_aton(src), socket.inet_aton(dst)) + tcp
    tag = b"\x81\x00\x00\x05" if vlan else b""
    return b"\x01" * 12 + tag + b"\x08\x00" + ip


def classic(packets, order="<", nanos=False, link=1):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, link)
    for us, data in packets:
        part = us % 1_000_000 * (1000 if nanos else 1)
        out += struct.pack(order + "IIII", us // 1_000_000, part, len(data), len(data)) + data
    return out


def next_gen(packets, order="<"):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = struct.pack(order + "I", len(body) + 12)
        return struct.pack(order + "I", kind) + size + body + size
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack(order + "HHI", 1, 0, 65535) + struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HH", 0, 0))
    for us, data in packets:
        t = us * 1000
        out += block(6, struct.pack(order + "IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(data), len(data)) + data)
    return out


CLIENT, SERVER = ("192.168.0.2", 5000), ("1.1.1.1", 443)


def sample_packets():
    up = lambda n, **k: frame(*CLIENT, *SERVER, tls(n), **k)
    down = lambda n, **k: frame(*SERVER, *CLIENT, tls(n), **k)
    return [(999_000, up(500, flags=0x02)), (1_000_000, up(50)), (1_000_500, up(60, vlan=True)), (1_001_000, up(20)),
            (1_001_500, b"\x01" * 40), (1_002_000, down(120))]


@pytest.fixture(scope="module")
def root():
    folder = tempfile.mkdtemp(prefix="captures-")
    os.makedirs(f"{folder}/MaliciousDoH")
    open(f"{folder}/MaliciousDoH/iodine_run_one.pcap", "wb").write(classic(sample_packets()))
    open(f"{folder}/benign_doh_two.pcapng", "wb").write(next_gen(sample_packets(), ">"))
    inner = f"{folder}/inner.bin"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/cap_nano.pcap", classic(sample_packets(), ">", nanos=True))
    with zipfile.ZipFile(f"{folder}/NonDoH.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.cap", classic(sample_packets() * 200))
        z.write(inner, "nest.zip")
    os.remove(inner)
    return folder


@pytest.mark.parametrize("payload, want", [
    (tls(39), None), (tls(40), 40), (tls(100, kind=22), None), (tls(50) + tls(60), 110), (b"", None), (None, None),
    (tls(50) + tls(60)[:20], 110), (tls(50, major=2), None), (tls(45) + tls(0) + tls(70), 45), (tls(30) + tls(12), 42)])
def test_tls_bytes(payload, want):
    assert application_bytes(payload) == want


def test_inventory_and_limits(spark, root):
    inv = S.captures(spark, root)
    rows = {r.source_id: r for r in inv.collect()}
    assert sorted(rows) == ["MaliciousDoH/iodine_run_one.pcap", "NonDoH.zip:big.cap", "NonDoH.zip:nest.zip/deep/cap_nano.pcap",
                            "benign_doh_two.pcapng"]
    assert rows["MaliciousDoH/iodine_run_one.pcap"].scenario_id == "malicious_doh_iodine"
    assert rows["NonDoH.zip:big.cap"].category == "non_doh"
    assert rows["NonDoH.zip:big.cap"].session_id == "NonDoH_zip_big"
    assert S.captures(spark, root, 1).first().source_id == "MaliciousDoH/iodine_run_one.pcap"
    assert S.capture_faults(inv, max_ratio=10**6).count() == 0
    total = sum(r.size_bytes for r in rows.values() if r.member)
    faults = sorted(map(tuple, S.capture_faults(inv, max_file=10, max_ratio=2.0, max_total=total - 1).collect()))
    assert ("benign_doh_two.pcapng", "file_too_large") in faults
    assert ("NonDoH.zip:big.cap", "ratio_too_high") in faults
    assert [f for f in faults if f[1] == "expansion_over_budget"] == [("NonDoH.zip:nest.zip/deep/cap_nano.pcap", "expansion_over_budget")]
    assert S.capture_faults(inv.unionByName(inv), max_ratio=10**6).filter("fault = 'duplicate_source_id'").count() == 4
    hashes = {r.source_id: r.sha256 for r in S.capture_hashes(spark, inv).collect()}
    assert hashes["MaliciousDoH/iodine_run_one.pcap"] == sha(classic(sample_packets()))
    assert hashes["NonDoH.zip:big.cap"] == sha(classic(sample_packets() * 200)) and len(hashes) == 4


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("data", [b"", b"\n", b"a", b"a\n", b"\n\n", b"a\nb\r\n\xff\x00" * 300, b"\n" * 999 + b"z"])
def test_hashes_of_files_read_in_ranges(spark, data):
    folder = tempfile.mkdtemp(prefix="hashes-")
    for name in "xy":
        open(f"{folder}/{name}.bin", "wb").write(data + b"tail" + data)
    with files_of(spark, 97):
        got = T.content_hashes(spark, [f"{folder}/x.bin", f"{folder}/y.bin"], value_bytes=0).collect()
    assert [r.sha256 for r in got] == [sha(data + b"tail" + data)] * 2


@contextlib.contextmanager
def files_of(spark, size):
    """Files are split at every ``size`` bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, str(size))
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("range_bytes", [1 << 20, 300])
def test_captures_become_flows(spark, root, range_bytes):
    inv = S.captures(spark, root).filter("source_id <> 'NonDoH.zip:big.cap'")
    with files_of(spark, range_bytes):
        raw = spark.createDataFrame(S.read_packets(inv).collect(), PACKETS)
    assert raw.count() == 18
    numbers = raw.groupBy("source_id").agg(F.sort_array(F.collect_list("packet_no")).alias("n")).collect()
    assert all(r.n == list(range(6)) for r in numbers)
    packets = L.accept_packets(raw)
    clumps = C.packets_to_clumps(packets)
    got = sorted((r.source_id, r.clump_no, r.size, r.direction, r.interarrival_us) for r in clumps.collect())
    for source in ("MaliciousDoH/iodine_run_one.pcap", "NonDoH.zip:nest.zip/deep/cap_nano.pcap", "benign_doh_two.pcapng"):
        assert [g[1:] for g in got if g[0] == source] == [(0, 110, 0, 0), (1, 120, 1, 1500)]
    flows = L.summarise_flows(L.split_flows(packets)).collect()
    assert len(flows) == 3 and all(f.client == "192.168.0.2:5000" and f.packet_count == 3 for f in flows)


def test_broken_captures_end_quietly(spark):
    folder = tempfile.mkdtemp(prefix="captures-")
    open(f"{folder}/cut.pcap", "wb").write(classic(sample_packets())[:-7])
    open(f"{folder}/junk.pcap", "wb").write(b"not a capture")
    open(f"{folder}/broken.zip", "wb").write(b"PK not an archive")
    with zipfile.ZipFile(f"{folder}/half.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("fine.pcap", classic(sample_packets()))
        z.writestr("bad.pcap", classic(sample_packets() * 50))
        z.writestr("odd.zip", b"no archive either")
    raw = bytearray(open(f"{folder}/half.zip", "rb").read())
    at = raw.index(b"bad.pcap") + 60
    raw[at:at + 8] = b"\xff" * 8
    open(f"{folder}/half.zip", "wb").write(raw)
    inv = S.captures(spark, folder)
    got = {r.source_id: r["count"] for r in S.read_packets(inv).groupBy("source_id").count().collect()}
    assert got.pop("cut.pcap") == 5 and got.pop("half.zip:fine.pcap") == 6 and got.pop("half.zip:bad.pcap", 0) < 300 and not got
    assert [r.source_id for r in S.member_faults(inv).collect()] == ["half.zip:bad.pcap"]
    assert sorted(r.path.split("/")[-1] + ":" + str(r.member) for r in S.unreadable_archives(spark, folder).collect()) == [
        "broken.zip:None", "half.zip:odd.zip"]


def fake_records(rng):
    """A payload that is itself a run of records."""
    parts = [(10**9 + i * 1000, b"z" * rng.randrange(60, 90)) for i in range(30)]
    return classic(parts)[24:] if rng.random() < 0.5 else next_gen(parts)


def long_captures():
    rng = random.Random(1)

    def packets(n, fakes):
        out = []
        for i in range(n):
            body = fake_records(rng) if i in fakes else rng.choice([b"\n" * rng.randrange(60), rng.randbytes(rng.randrange(1, 300))])
            out.append((10**12 + i * 1000, frame(*CLIENT, *SERVER, body)))
        return out
    return {"plain.pcap": classic(packets(200, ())), "fakes.pcap": classic(packets(150, (30, 70)), ">", nanos=True),
            "fakes.pcapng": next_gen(packets(150, (30, 70))), "cut.pcap": classic(packets(50, ()))[:-7],
            "two.pcapng": next_gen(packets(80, ()), ">") + next_gen(packets(80, (9,)), "<"), "junk.pcap": b"no capture\n" * 900,
            "feed.pcap": classic([*packets(20, ()), (10**12, b"\n" * 500)]), "empty.pcap": b""}


def test_ranges_give_what_a_plain_walk_gives(spark):
    folder, files = tempfile.mkdtemp(prefix="ranges-"), long_captures()
    for name, data in files.items():
        open(f"{folder}/{name}", "wb").write(data)
    with files_of(spark, 4000):
        found = N.packet_records(spark, [f"{folder}/{n}" for n in files]).collect()
        inv = S.captures(spark, folder).filter("source_id IN ('plain.pcap', 'two.pcapng')")
        assert S.capture_ranges(spark, inv).count() > 10
        only = N.lines(spark, [f"{folder}/{n}" for n in files], F.col("_metadata.file_path").endswith("two.pcapng"))
        assert only.select("uri").distinct().count() == 1
    for name, data in files.items():
        want = [bytes(r[4]) for r in N.Walker().feed(data)]
        got = sorted((r.packet_no, bytes(r.frame)) for r in found if r.uri.endswith("/" + name))
        assert got == list(enumerate(want)), name
    assert {r.ts_us for r in found if r.uri.endswith("fakes.pcapng")} == {10**12 + i * 1000 for i in range(150)}


@pytest.mark.parametrize("size", [2500, 700, 300])
def test_wrong_guesses_are_read_again(size):
    """The stitching alone, on ranges cut as the text reader cuts them."""
    for name, data in long_captures().items():
        want, carried = [bytes(r[4]) for r in N.Walker().feed(data)], {}
        if not data:
            continue
        while True:
            rows, records = [], {}
            for start in range(0, len(data), size):
                end = min(start + size, len(data))
                a = 0 if not start else data.find(b"\n", start) + 1 or len(data)
                b = len(data) if end == len(data) else data.find(b"\n", end) + 1 or len(data)
                if a >= b:
                    continue
                own = N._Range(start, carried.get(start))
                records[start] = [*own.feed(data[a:b].removesuffix(b"\n")), *own.finish(end == len(data))]
                w = own.walker
                rows.append((name, start, len(data), own.n_bytes, own.head, w.held if w else b"", w.seen if w else 0,
                             json.dumps(own.opened), json.dumps(w.state if w else None), bool(w and w.dead), own.joined))
            found = N._stitch(pd.DataFrame(rows, columns=[c.split()[0] for c in N.RANGES.split(", ")]))
            again = found[found["part"] == "again"]
            if not len(again):
                break
            carried[again["start"].iloc[0]] = (json.loads(again["known"].iloc[0]), bytes(again["carried"].iloc[0]))
        got = [(int(r.first_no) + i, bytes(x[4])) for r in found.itertuples() if r.part == "range"
               for i, x in enumerate(records[r.start])]
        got += [(int(r.first_no), bytes(r.frame)) for r in found.itertuples() if r.part == "packet"]
        assert sorted(got) == list(enumerate(want)), name


def test_frames_of_any_value(spark):
    """Events whose frame is longer than an IPv4 or a TLS length can say give the rows of the query's SQL."""
    sizes = [0, 1, 39, 40, 65_489, 65_490, 65_491, 65_535, 65_536, 65_537, 131_070, 131_071, 400_003]
    folder = tempfile.mkdtemp(prefix="frames-")
    pd.DataFrame({"event_id": range(len(sizes)), "ts": pd.Timestamp("2024-01-01 00:00:01.000007").as_unit("us"), "user_id": 7,
                  "event_type": "view", "value": [n / 100 for n in sizes], "props": '{"k": 76}'}).to_parquet(f"{folder}/events.parquet")
    got = spec.queries()["decode_frames"](spark, folder).orderBy("packet_no")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({spec.oracle_sql()['decode_frames']}) ORDER BY packet_no").fetchall()
    assert [tuple(r) for r in got.collect()] == want


def test_tables_and_artifacts(spark):
    folder = tempfile.mkdtemp(prefix="artifacts-")
    open(f"{folder}/t.csv", "w").write(" a , Label\n1,x\n2,y\n")
    df = T.read_table(spark, f"{folder}/t.csv")
    assert df.columns == ["a", "Label"] and T.read_table(spark, f"{folder}/t.csv", rows=1).count() == 1
    info = T.file_inventory(spark, folder).first()
    assert info.rows == 2 and info.label_candidates == ["Label"] and len(info.sha256) == 64
    run = {"task": "l1", "model": "paper_v4", "split_protocol": "paper_flow_random", "window_size": 6, "f1_score": 0.5}
    json.dump({"manifest_version": "1.0", "task": "both", "runs": [run, {**run, "window_size": 3, "f1_score": 7}]},
              open(f"{folder}/m.json", "w"))
    runs = A.read_runs(spark, f"{folder}/m.json")
    assert [(r.run_no, r.window_size) for r in runs.orderBy("run_no").collect()] == [(0, 6), (1, 3)]
    assert [tuple(r) for r in V.check_runs(runs, ["run_no"]).collect()] == [(1, "range_f1_score")]
    json.dump({"manifest_version": "1.1", "task": "l2", "models": {"random_forest": {"f1_macro": 0.9}}}, open(f"{folder}/e.json", "w"))
    evidence = A.read_evidence(spark, f"{folder}/e.json")
    assert evidence.first().model == "random_forest" and V.check_evidence(evidence, ["model"]).count() == 0
    A.write_tables({"runs": runs}, f"{folder}/out", "csv")
    with pytest.raises(FileExistsError):
        A.write_tables({"runs": runs}, f"{folder}/out", "csv")
    A.write_tables({"runs": runs}, f"{folder}/out", "csv", force=True)


def test_inventory_of_files_above_a_value(spark):
    folder = tempfile.mkdtemp(prefix="inventory-")
    pd.DataFrame({" a ": range(4000), "Label": [f"{i}\n" for i in range(4000)]}).to_parquet(f"{folder}/t.parquet")
    open(f"{folder}/t.csv", "w").write(" a , Label\n" + "1,x\n" * 3000)
    open(f"{folder}/no.parquet", "wb").write(b"\nno table\n" * 900 + b"PAR")
    whole = [tuple(r) for r in T.file_inventory(spark, folder).collect()]
    with files_of(spark, 997):
        assert [tuple(r) for r in T.file_inventory(spark, folder, value_bytes=5000).collect()] == whole
    assert [(r[0], r[4]) for r in whole] == [("no.parquet", None), ("t.csv", 3000), ("t.parquet", 4000)]
    assert T.VALUE_BYTES <= 64 << 20  # a task may hold a few copies of a value
    data = open(f"{folder}/t.parquet", "rb").read()
    assert T._footer(data[len(data) // 2:]) == T._footer(data) and T._footer(data[-20:]) is None


def test_experiment_manifest(spark):
    counters = spark.createDataFrame([(10, 4)], "raw_packets long, flows_kept long")
    classes = spark.createDataFrame([("train", 1, 3), ("test", 0, 1)], "split string, label int, rows long")
    row = A.experiment_manifest(counters, classes, {"seed": 42, "max_flow_packets": 5}).first()
    assert row.settings == {"seed": "42", "max_flow_packets": "5"} and row.counters.flows_kept == 4
    assert sorted((c.split, c.rows) for c in row.classes) == [("test", 1), ("train", 3)]


def stream_input(spark, rows, files=3):
    """Rows in several files, read one per trigger."""
    folder = tempfile.mkdtemp(prefix="stream-")
    schema = "source_id string, key string, packet_no long, ts_us long, length long, sender string, receiver string"
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    for i, rest in enumerate([[("s", "end", 10**6, 10**12, 1, "a", "b")], [("s", "end", 10**6 + 1, 10**12 + 10**11, 1, "a", "b")]]):
        spark.createDataFrame(rest, schema).coalesce(1).write.mode("append").parquet(folder)
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
            .withColumn("ts", F.timestamp_micros("ts_us")))


def run_stream(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", tempfile.mkdtemp(prefix="stream-")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).filter("key <> 'end'" if "key" in df.columns else "true")


def stream_rows():
    rng, t, rows = random.Random(5), 10**9, []
    for i in range(120):
        t += rng.choice([200, 300_000, 2_000_000, 50_000_000])
        rows.append(("s", str(rng.randrange(3)), i, t, rng.choice([40, 90]), *rng.choice([("a", "b"), ("b", "a")])))
    return rows


def test_streams_match_batch(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = stream_rows()
    batch = spark.createDataFrame(rows, "source_id string, key string, packet_no long, ts_us long, length long, sender string, receiver string")
    flow_packets = L.split_flows(batch)
    want = sorted((r.key, r.flow_no, r.start_us, r.end_us, r.packet_count, r.byte_count)
                  for r in L.summarise_flows(flow_packets).collect())
    got = R.numbered(run_stream(spark, R.stream_flows(stream_input(spark, rows)), "s_flows"), "start_us")
    assert sorted((r.key, r.flow_no, r.start_us, r.end_us, r.packet_count, r.byte_count) for r in got.collect()) == want
    sessions = run_stream(spark, R.stream_sessions(stream_input(spark, rows)), "s_sessions")
    assert sorted((r.key, r.start_us, r.end_us, r.packet_count, r.byte_count) for r in sessions.collect()) == sorted(
        (w[0], *w[2:]) for w in want)
    clumps = R.numbered(run_stream(spark, R.stream_clumps(stream_input(spark, rows)), "s_clumps"))
    fields = ["key", "flow_no", "clump_no", "size", "pkt_count", "direction", "start_us", "end_us", "interarrival_us"]
    assert sorted(map(tuple, clumps.select(*fields).collect())) == sorted(
        map(tuple, C.clump(flow_packets).select(*fields).collect()))
    early = R.early_decisions(clumps, 2).collect()
    assert len(early) == C.clump(flow_packets).filter("clump_no = 1").count()
    rates = run_stream(spark, R.stream_rates(stream_input(spark, rows), "10 minutes"), "s_rates")
    assert rates.filter("packets > 1").agg(F.sum("packets")).first()[0] <= len(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("files", [1, 4])
def test_live_verdicts_equal_the_batch_cascade(spark, files):
    rows = stream_rows()
    batch = spark.createDataFrame(rows, "source_id string, key string, packet_no long, ts_us long, length long, sender string, receiver string")
    clumps = C.clump(L.split_flows(batch))
    models, stages = [], []
    for length in (3, 2):
        segments = W.segment_features(clumps, length).withColumn("truth", F.when(
            F.col("mean_size") > 65, "doh").otherwise("non_doh"))
        models.append(materialize(Q.fit_centroids(segments, "truth")))
        stages.append(Q.predict_centroids(segments.filter("window_index = 0"), models[-1]).withColumn("delay_s", F.col("total_span")))
    want = Q.cascade(*stages, ["source_id", "key", "flow_no"])
    live = R.stream_verdicts(stream_input(spark, rows, files), *models, lengths=(3, 2))
    got = R.numbered(run_stream(spark, live, f"s_verdicts_{files}"))
    fields = ["key", "flow_no", "l1_predicted", "verdict", F.round("l1_delay_s", 6).alias("a"), F.round("l2_delay_s", 6).alias("b")]
    assert sorted(map(tuple, got.filter("window_index = 0").select(*fields).collect())) == sorted(
        map(tuple, want.select(*fields).collect()))
    windows = W.segment_features(clumps, 3).select("key", "flow_no", "window_index").collect()
    assert sorted(map(tuple, got.select("key", "flow_no", "window_index").collect())) == sorted(map(tuple, windows))


def test_late_packets_are_counted_and_state_ends(spark):
    schema = "source_id string, key string, packet_no long, ts_us long, length long, sender string, receiver string"
    second = 10**6
    batches = [[("s", "k", i, t * second, 10, "a", "b") for i, t in enumerate(times)]
               for times in ([100, 101, 120], [95, 121, 400, 119], [50, 401, 3000])]
    folder, log = tempfile.mkdtemp(prefix="stream-"), tempfile.mkdtemp(prefix="stream-")
    dropped, out = 0, tempfile.mkdtemp(prefix="stream-")
    for rows in [*batches, [("s", "end", 9, 10**13, 1, "a", "b")]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        live = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.timestamp_micros("ts_us"))
        q = R.stream_flows(live, "10 seconds").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += R.late_rows(q)
    flows = sorted((r.start_us // second, r.end_us // second, r.packet_count) for r in
                   spark.read.parquet(out).filter("key = 'k'").collect())
    # After the first batch the watermark is at 110 s, after the second at 390 s: 95 and 50 come too late.
    assert flows == [(100, 121, 5), (400, 401, 2), (3000, 3000, 1)] and dropped == 2
    assert R.state_rows(q) <= 3  # what is left belongs to the packet that has just come


def test_sets_are_published_whole(spark):
    folder = tempfile.mkdtemp(prefix="published-") + "/out"
    one, two = spark.range(3), spark.range(5)
    with pytest.raises(FileNotFoundError):
        A.read_published(spark, folder)
    first = A.publish({"a": one, "b": one}, folder)
    with pytest.raises(FileExistsError):
        A.publish({"a": two}, folder)
    with pytest.raises(Exception, match="halfway"):
        A.publish({"a": two, "b": two.select(F.raise_error(F.lit("halfway")).alias("id"))}, folder, force=True)
    assert {n: t.count() for n, t in A.read_published(spark, folder).items()} == {"a": 3, "b": 3}
    A.publish({"a": two, "c": two}, folder, force=True)
    assert {n: t.count() for n, t in A.read_published(spark, folder).items()} == {"a": 5, "c": 5}
    assert {n: t.count() for n, t in A.read_published(spark, folder, first).items()} == {"a": 3, "b": 3}


@pytest.mark.parametrize("emit", ["flows", "clumps", "windows"])
def test_keys_of_a_bucket_share_state(spark, monkeypatch, emit):
    """One bucket of many keys, null ones too, gives what a bucket for each gives, with one value and timer."""
    schema = "source_id string, key string, packet_no long, ts_us long, length long, sender string, receiver string"
    rows = [(s, k, n, t, size, a, b) for i in range(13) for s, _, n, t, size, a, b in stream_rows() for k in [None if i == 12 else f"{n % 3}-{i}"]]
    rows = [(*r[:2], i, *r[3:]) for i, r in enumerate(sorted(rows, key=lambda r: r[3]))]
    found = {}
    for buckets in (1, 4096):
        monkeypatch.setattr(R, "BUCKETS", buckets)
        folder, name = tempfile.mkdtemp(prefix="stream-"), f"s_shared_{emit}_{buckets}"
        for part in (rows[:700], rows[700:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.timestamp_micros("ts_us"))
        live = {"flows": R.stream_flows, "clumps": R.stream_clumps, "windows": lambda x: R.stream_windows(x, 3)}[emit](live)
        q = live.writeStream.format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="stream-")).start()
        q.processAllAvailable()
        q.stop()
        found[buckets] = sorted(map(str, spark.table(name).collect())), R.state_rows(q)
    assert found[1][0] == found[4096][0] and len(found[1][0]) > 100
    assert 0 < found[1][1] <= 3 < found[4096][1]
