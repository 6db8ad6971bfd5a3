"""Packet captures: inventory, archives, and decoding to packet rows.

Loose captures are read through Spark's own reader in byte ranges (``sources.ranges``), so they may lie in any file
system Spark knows.  An archive is handed to a task as one value; one above ``ARCHIVE_BYTES``, the most such a value can
hold, is opened by its path, which must then be mounted on every node.  What cannot be read gives a fault row and the
rest goes on.
"""

from __future__ import annotations

import hashlib
import io
import json
import socket
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import paths as P
from packetloom.functions.paths import CAPTURE_SUFFIXES
from packetloom.functions.tls import application_bytes
from packetloom.operators.ordered import running
from packetloom.schema import PACKETS
from packetloom.sources.ranges import Walker, packet_records, stitched
from packetloom.sources.tabular import content_hashes, list_files

GB = 1 << 30
ARCHIVE_BYTES = (1 << 31) - 1
CHUNK = 1 << 20
ARCHIVE_SCHEMA = ("path string, member string, nested string, size_bytes long, packed_bytes long, "
                  "nested_bytes long, nested_packed_bytes long, fault string")
# What a damaged, encrypted or oddly packed archive raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, ValueError)


def capture_files(spark: SparkSession, root: str) -> DataFrame:
    """Loose capture files and capture members of archives (one nested level) under ``root``.

    An archive, nested archive or member that cannot be listed is a row with ``fault``; the others are listed.
    """
    empty = [F.lit(None).cast("long").alias(c) for c in ("packed_bytes", "nested_bytes", "nested_packed_bytes")]
    loose = list_files(spark, root, CAPTURE_SUFFIXES).select(
        "path", "uri", F.lit(None).cast("string").alias("member"), F.lit(None).cast("string").alias("nested"),
        "size_bytes", *empty, F.lit(None).cast("string").alias("fault"))
    members = _archives(spark, root).mapInPandas(_list_members, ARCHIVE_SCHEMA)
    return loose.unionByName(members.withColumn("uri", F.lit(None).cast("string")))


def _archives(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of archives; content is null above the size a value can hold."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .filter(F.lower("path").endswith(".zip")))
    return files.filter(F.col("length") <= ARCHIVE_BYTES).select("path", "content").unionByName(
        files.filter(F.col("length") > ARCHIVE_BYTES).select("path", F.lit(None).cast("binary").alias("content")))


def _open_archive(path: str, content: bytes | None) -> zipfile.ZipFile:
    return zipfile.ZipFile(local_path(path) if content is None else io.BytesIO(content))


def local_path(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _is_capture(name: str) -> bool:
    return name.lower().endswith(tuple(CAPTURE_SUFFIXES))


def _list_members(batches):
    """Capture members per archive; only directories of archives are read, nested ones by stream."""
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                with _open_archive(path, content) as outer:
                    for info in outer.infolist():
                        if _is_capture(info.filename):
                            rows.append((path, info.filename, None, info.file_size, info.compress_size, None, None, None))
                        elif info.filename.lower().endswith(".zip"):
                            rows += _list_nested(path, outer, info)
            except UNREADABLE as e:
                rows.append((path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in ARCHIVE_SCHEMA.split(", ")])
        yield out.astype({c: "Int64" for c in out.columns if c.endswith("bytes")})


def _list_nested(path: str, outer: zipfile.ZipFile, info: zipfile.ZipInfo) -> list[tuple]:
    sizes = (info.file_size, info.compress_size)
    try:
        with outer.open(info) as stream, zipfile.ZipFile(stream) as inner:
            return [(path, info.filename, i.filename, i.file_size, i.compress_size, *sizes, None)
                    for i in inner.infolist() if _is_capture(i.filename)]
    except UNREADABLE as e:
        return [(path, info.filename, None, None, None, *sizes, f"{type(e).__name__}: {e}")]


def unreadable_archives(spark: SparkSession, root: str) -> DataFrame:
    """(path, member, fault) of the archives and nested archives that cannot be listed."""
    return capture_files(spark, root).filter(F.col("fault").isNotNull()).select("path", "member", "fault")


def captures(spark: SparkSession, root: str, max_members: int | None = None) -> DataFrame:
    """The inventory: stable source id, metadata from the root-relative path, session, size.

    Ordered by source id; ``max_members`` keeps the first ones.
    """
    files = capture_files(spark, root).filter(F.col("fault").isNull())
    sid = P.source_id(F.col("path"), root, F.col("member"), F.col("nested"))
    rows = files.withColumn("source_id", sid)
    # archive members take the rules on "archive/member/nested"
    rule_path = F.regexp_replace("source_id", ":", "/")
    rows = rows.withColumn("_m", P.path_metadata(rule_path)).select(
        "source_id", "path", "uri", "member", "nested", "_m.*", P.session_id(rule_path).alias("session_id"),
        "size_bytes", "packed_bytes", "nested_bytes", "nested_packed_bytes")
    return rows if max_members is None else rows.orderBy("source_id").limit(max_members)


def capture_faults(inventory: DataFrame, max_file: int = 20 * GB, max_member: int = 10 * GB,
                   max_nested: int = 20 * GB, max_ratio: float = 100.0, max_total: int = 200 * GB) -> DataFrame:
    """One row per broken limit: size, expansion ratio, total expanded bytes, duplicate source id."""
    loose = F.col("member").isNull()
    ratio = lambda size, packed: F.when(F.col(packed) > 0, F.col(size) / F.col(packed) > max_ratio)
    rules = {
        "file_too_large": loose & (F.col("size_bytes") > max_file),
        "member_too_large": ~loose & (F.col("size_bytes") > max_member),
        "nested_archive_too_large": F.col("nested_bytes") > max_nested,
        "ratio_too_high": ratio("size_bytes", "packed_bytes") | F.coalesce(
            ratio("nested_bytes", "nested_packed_bytes"), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    single = inventory.select("source_id", F.explode(broken).alias("fault"))
    # Expanded bytes add up in source-id order; a text prefix never decreases along it.
    members = inventory.filter(~loose).withColumn("_prefix", F.substring("source_id", 1, 12))
    total = running(members, [], "_prefix", ["source_id", "nested"], {"_sum": ("sum", F.col("size_bytes"), True)})
    over = total.filter(F.col("_sum") > max_total).select("source_id", F.lit("expansion_over_budget").alias("fault"))
    twice = inventory.groupBy("source_id").count().filter("count > 1").select(
        "source_id", F.lit("duplicate_source_id").alias("fault"))
    return single.unionByName(over).unionByName(twice)


def capture_hashes(spark: SparkSession, inventory: DataFrame) -> DataFrame:
    """(source_id, sha256) of every capture of an inventory, archive members included, of any size."""
    loose = inventory.filter(F.col("member").isNull()).select("source_id", "path")
    hashed = content_hashes(spark, [r.path for r in loose.select("path").collect()])
    inside = _members(spark, inventory, _member_hashes, "source_id string, sha256 string, fault string")
    return loose.join(hashed, "path").select("source_id", "sha256").unionByName(
        inside.filter(F.col("fault").isNull()).select("source_id", "sha256"))


# --- reading ------------------------------------------------------------------------------------

def _members(spark: SparkSession, inventory: DataFrame, read, schema: str) -> DataFrame:
    """``read`` over the archive members of an inventory; each archive is handled by one task."""
    wanted = inventory.filter(F.col("member").isNotNull()).groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("source_id", "member", "nested"))).alias("members"))
    paths = [r.path for r in wanted.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    archives = spark.read.format("binaryFile").load(paths)
    held = archives.filter(F.col("length") <= ARCHIVE_BYTES).select("path", "content").unionByName(
        archives.filter(F.col("length") > ARCHIVE_BYTES).select("path", F.lit(None).cast("binary").alias("content")))
    return held.join(wanted, "path").mapInPandas(read, schema)


def _opened(batches):
    """(source id, stream or the exception that opening it raised) of each wanted member."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            for m in row.members:
                try:
                    with _open_archive(row.path, row.content) as outer, outer.open(m["member"]) as stream:
                        if m["nested"] is None:
                            yield m["source_id"], stream, None
                        else:
                            with zipfile.ZipFile(stream) as inner, inner.open(m["nested"]) as deep:
                                yield m["source_id"], deep, None
                except UNREADABLE as e:
                    yield m["source_id"], None, f"{type(e).__name__}: {e}"


def _member_hashes(batches):
    for source, stream, fault in _opened(batches):
        digest = hashlib.sha256()
        try:
            while stream and (data := stream.read(CHUNK)):
                digest.update(data)
        except UNREADABLE as e:
            fault = f"{type(e).__name__}: {e}"
        yield pd.DataFrame({"source_id": [source], "sha256": [None if fault else digest.hexdigest()], "fault": [fault]})


MEMBER_SCHEMA = "source_id string, packet_no long, ts_us long, link int, frame binary, fault string"


def _member_records(batches):
    names = [c.split()[0] for c in MEMBER_SCHEMA.split(", ")]
    for source, stream, fault in _opened(batches):
        walker, rows, no = Walker(), [], 0
        try:
            while stream and (data := stream.read(CHUNK)):
                for high, low, interface, known, frame in walker.feed(data):
                    kind, base, links = json.loads(known)
                    link, ticks = ([*base, *links][interface:interface + 1] or [(None, None)])[0]
                    ts = None if link is None else (high * 1_000_000 + low // ticks if kind == "classic"
                                                    else ((high << 32) | low) * 1_000_000 // ticks)
                    rows.append((source, no, ts, link, frame, None))
                    no += 1
                yield _typed(pd.DataFrame(rows, columns=names))
                rows = []
        except UNREADABLE as e:
            fault = f"{type(e).__name__}: {e}"
        rows += [(source, None, None, None, None, fault)] * bool(fault)
        yield _typed(pd.DataFrame(rows, columns=names))


def _typed(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.astype({c: "Int64" for c in ("packet_no", "ts_us", "link")})


def capture_ranges(spark: SparkSession, inventory: DataFrame) -> DataFrame:
    """(source_id, start, first_no): the byte ranges of loose captures and the packet each begins with."""
    loose = inventory.filter(F.col("member").isNull()).select("source_id", "uri", "path")
    found, _ = stitched(spark, [r.path for r in loose.select("path").collect()])
    return found.filter("part = 'range'").join(loose.drop("path"), "uri").select("source_id", "start", "first_no")


def read_packets(inventory: DataFrame) -> DataFrame:
    """One row per raw packet of every capture, in the PACKETS schema; non-TCP frames have null ends.

    Only the files of ``inventory`` are opened: a filter on it (by source id, say) is a filter on files.  Payloads stay
    in the reader: only their length and application bytes come out.  Write the result to a table before using it more
    than once.  A member that breaks off gives the packets before that point (and a row in ``member_faults``).
    """
    spark = inventory.sparkSession
    members = _members(spark, inventory, _member_records, MEMBER_SCHEMA).filter(F.col("fault").isNull()).drop("fault")
    loose = inventory.filter(F.col("member").isNull()).select("source_id", "uri", "path")
    paths = [r.path for r in loose.select("path").collect()]
    frames = members if not paths else members.unionByName(
        packet_records(spark, paths).join(loose.drop("path"), "uri").drop("uri"))
    return decode_frames(frames, link=F.col("link"))


def member_faults(inventory: DataFrame) -> DataFrame:
    """(source_id, fault) of the archive members that cannot be read to their end."""
    return _members(inventory.sparkSession, inventory, _member_records, MEMBER_SCHEMA).filter(
        F.col("fault").isNotNull()).select("source_id", "fault")


def decode_frame(frame: bytes, link: int):
    """(src ip, src port, dst ip, dst port, flags, payload) of a TCP frame, else None."""
    try:
        at = _ip_offset(frame, link)
        version = frame[at] >> 4
        if version == 4:
            head, total = (frame[at] & 15) * 4, struct.unpack(">H", frame[at + 2:at + 4])[0]
            if frame[at + 9] != 6 or struct.unpack(">H", frame[at + 6:at + 8])[0] & 0x1FFF:
                return None
            src, dst = socket.inet_ntoa(frame[at + 12:at + 16]), socket.inet_ntoa(frame[at + 16:at + 20])
            tcp, stop = at + head, at + total if total else len(frame)
        elif version == 6:
            length, proto = struct.unpack(">HB", frame[at + 4:at + 7])
            src = socket.inet_ntop(socket.AF_INET6, frame[at + 8:at + 24])
            dst = socket.inet_ntop(socket.AF_INET6, frame[at + 24:at + 40])
            tcp, stop = at + 40, at + 40 + length
            while proto in (0, 43, 60):  # hop-by-hop, routing and destination headers
                proto, tcp = frame[tcp], tcp + 8 + frame[tcp + 1] * 8
            if proto != 6:
                return None
        else:
            return None
        sport, dport = struct.unpack(">HH", frame[tcp:tcp + 4])
        flags, body = frame[tcp + 13], tcp + (frame[tcp + 12] >> 4) * 4
        return src, sport, dst, dport, flags, frame[body:min(stop, len(frame))]
    except (IndexError, struct.error, ValueError, OSError):
        return None


def _ip_offset(frame: bytes, link: int) -> int:
    if link in (12, 101):
        return 0
    if link == 113:
        return 16
    if link == 276:
        return 20
    at, kind = 12, frame[12:14]
    while kind in (b"\x81\x00", b"\x88\xa8"):  # VLAN tags
        at, kind = at + 4, frame[at + 4:at + 6]
    if kind in (b"\x08\x00", b"\x86\xdd"):
        return at + 2
    return 0 if link != 1 else len(frame)


def _frame_table(rows: list, names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    numbers = [n for n in names if n not in ("source_id", "src_ip", "dst_ip")]
    return out.astype({n: "Int64" for n in numbers})


def decode_frames(frames: DataFrame, frame: str = "frame", link: int | Column = 1) -> DataFrame:
    """Packet columns for frames that are already in a table (``source_id, packet_no, ts_us, frame``)."""
    names = PACKETS.names

    def decode(batches):
        for batch in batches:
            rows = []
            for source, no, ts, data, kind in batch.itertuples(index=False):
                found = None if pd.isna(kind) else decode_frame(data, int(kind))
                src, sport, dst, dport, flags, payload = found or (None,) * 5 + (b"",)
                rows.append((source, no, ts, src, sport, dst, dport, flags, len(data), len(payload),
                             application_bytes(payload)))
            yield _frame_table(rows, names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PACKETS.fields)
    kind = link if isinstance(link, Column) else F.lit(link)
    return frames.select("source_id", "packet_no", "ts_us", F.col(frame).alias("frame"), kind.alias("link")).mapInPandas(
        decode, schema)
