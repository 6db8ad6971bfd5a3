"""Packet records of capture files, found in byte ranges that know nothing of each other.

Files are read by Spark's own reader, so they may lie in any file system it knows, and split where it splits them: the
text reader with a line feed between rows hands each range its bytes, up to the first line feed of the next.  A range
other than the first guesses where a record starts (a chain of plausible headers), reads records from there and keeps
what lies before the first and behind the last whole record.  Ends and starts are then laid side by side, range by
range: bytes between two ranges must be whole records up to the guessed start.  A range that guessed wrong is read
again from what the ranges before it left over.  No task holds more than its range and one record.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.ordered import materialize

# Headers in a row that must look right before a guess is taken; fewer only where the range ends.
CHAIN = 6

# The largest record a guess believes in.  Larger ones are read all the same.
BELIEVED = 1 << 18

# Fixed values of the two formats: first four bytes to (byte order, ticks a microsecond), and block kinds.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1),
           b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
SECTION, SECTION_LITTLE = b"\x0a\x0d\x0d\x0a", b"\x4d\x3c\x2b\x1a"
BLOCK_KINDS = {1, 2, 3, 4, 5, 6, 9, 10, 0x0A0D0D0A}

RECORDS = "uri string, start long, nth long, high long, low long, interface long, known string, frame binary"
RANGES = ("uri string, start long, size long, n_bytes long, head binary, tail binary, records long, opened string, "
          "closed string, dead boolean, joined boolean")
STITCHED = ("uri string, start long, part string, first_no long, base string, carried binary, high long, low long, "
            "interface long, known string, frame binary")


class Walker:
    """Reads records from bytes fed in pieces; ``state`` says what the bytes before told (None: nothing yet).

    ``links`` are the interfaces (link type, ticks a second) met so far.  They follow those in ``base``, or those of the
    bytes before if ``base`` is None.
    """

    def __init__(self, state: dict | None = None, held: bytes = b""):
        self.held, self.dead, self.seen = held, False, 0
        self._enter(state)

    def _enter(self, state: dict | None):
        self.state = state
        self.known = None if state is None else json.dumps([state["kind"], state["base"], state["links"]])

    def feed(self, data: bytes) -> Iterator[tuple]:
        """(high, low, interface, known, frame) of each record that is whole with ``data``.

        For the classic format high and low are seconds and their fraction; else the halves of a tick count.
        """
        data, at = self.held + data if self.held else data, 0
        if self.state is None and not self.dead:
            at = self._open(data)
        while self.state and not self.dead:
            found = (self._classic if self.state["kind"] == "classic" else self._block)(data, at)
            if found is None:
                break
            at, record = found
            if record:
                self.seen += 1
                yield record
        self.held = b"" if self.dead else data[at:]

    def _open(self, data: bytes) -> int:
        if data[:4] in CLASSIC and len(data) >= 24:
            order, parts = CLASSIC[data[:4]]
            link = struct.unpack(order + "I", data[20:24])[0] & 0xFFFF
            self._enter({"kind": "classic", "order": order, "base": [[link, parts]], "links": []})
            return 24
        if data[:4] == SECTION:
            self._enter({"kind": "ng", "order": "<", "base": [], "links": []})
        elif len(data) >= 4 and data[:4] not in CLASSIC:
            self.dead = True
        return 0

    def _classic(self, data: bytes, at: int):
        if len(data) - at < 16:
            return None
        seconds, part, kept, _ = struct.unpack_from(self.state["order"] + "IIII", data, at)
        if len(data) - at < 16 + kept:
            return None
        return at + 16 + kept, (seconds, part, 0, self.known, data[at + 16:at + 16 + kept])

    def _block(self, data: bytes, at: int):
        if len(data) - at < 12:
            return None
        order, section = self.state["order"], data[at:at + 4] == SECTION
        if section:  # a new section sets the byte order and forgets interfaces
            order = "<" if data[at + 8:at + 12] == SECTION_LITTLE else ">"
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12:
            self.dead = True
            return None
        if len(data) - at < size:
            return None
        record = None
        if section:
            self._enter({"kind": "ng", "order": order, "base": [], "links": []})
        elif kind == 1 and size >= 20:
            link = struct.unpack_from(order + "H", data, at + 8)[0]
            found = [link, ticks(data[at + 16:at + size - 4], order)]
            self._enter({**self.state, "links": [*self.state["links"], found]})
        elif kind == 6 and size >= 32:
            interface, high, low, kept = struct.unpack_from(order + "IIII", data, at + 8)
            record = (high, low, interface, self.known, data[at + 28:at + 28 + min(kept, size - 32)])
        return at + size, record


def ticks(options: bytes, order: str) -> int:
    """Clock ticks per second of an interface: option 9, a power of ten or (top bit set) of two."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "HH", options[at:at + 4])
        if code == 9 and size and at + 4 < len(options):
            value = options[at + 4]
            return 2 ** (value & 127) if value & 128 else 10 ** value
        if code == 0:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def guess(data: bytes) -> tuple[int, dict] | None:
    """The first place from which a chain of plausible headers goes on, and the state it implies."""
    for at in range(len(data) - 15):
        for kind, order in (("ng", "<"), ("ng", ">"), ("classic", "<"), ("classic", ">")):
            if _chain(data, at, kind, order):
                return at, {"kind": kind, "order": order, "base": None, "links": []}
    return None


def _chain(data: bytes, at: int, kind: str, order: str) -> bool:
    seconds = None
    for link in range(CHAIN):
        if len(data) - at < 16:
            return link > 0
        if kind == "classic":
            now, part, kept, full = struct.unpack_from(order + "IIII", data, at)
            if part >= 10 ** 9 or kept > full or kept > BELIEVED or full > 4 * BELIEVED or not kept:
                return False
            if seconds is not None and abs(now - seconds) > 7 * 86_400:
                return False
            seconds, size = now, 16 + kept
        else:
            code, size = struct.unpack_from(order + "II", data, at)
            if code not in BLOCK_KINDS or size % 4 or not 12 <= size <= BELIEVED:
                return False
            if at + size <= len(data) and struct.unpack_from(order + "I", data, at + size - 4)[0] != size:
                return False
        at += size
        if at > len(data):
            return link > 0
    return True


class _Range:
    """One range: its walker from the first record on, and what lies before that record.

    ``carried`` is what the ranges before left over: (state, bytes of the record they did not finish).
    """

    def __init__(self, start: int, carried: tuple[dict, bytes] | None):
        self.n_bytes, self.head, self.joined = 0, b"", carried is not None
        self.opened = carried[0] if carried else None
        self.walker = Walker(*carried) if carried else Walker() if not start else None
        self.waiting, self.enough = [], 8 * BELIEVED

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.n_bytes += len(data)
        if self.walker:
            yield from self.walker.feed(data)
            return
        self.waiting.append(data)
        if sum(map(len, self.waiting)) >= self.enough:
            self.enough *= 2
            yield from self._guess()

    def _guess(self) -> Iterator[tuple]:
        data = b"".join(self.waiting)
        found = guess(data)
        if found:
            at, self.opened = found
            self.head, self.walker, self.waiting = data[:at], Walker(self.opened), []
            yield from self.walker.feed(data[at:])

    def finish(self, last: bool) -> Iterator[tuple]:
        if not last:
            yield from self.feed(b"\n")
        if not self.walker:
            yield from self._guess()


def _rows_by_range(batches: Iterator[pa.RecordBatch]):
    """(uri, start, size, last, pieces of bytes) of each range, in turn."""
    at, pieces = None, []
    for batch in batches:
        uris, starts = batch.column(0), batch.column(1).to_pylist()
        cuts = [0, *[i for i in range(1, len(starts)) if starts[i] != starts[i - 1] or uris[i] != uris[i - 1]], len(starts)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            key = (uris[a].as_py(), starts[a])
            if at is None or key != at[:2]:
                if at is not None:
                    yield at, None
                length, size = batch.column(2)[a].as_py(), batch.column(3)[a].as_py()
                at = (*key, size, starts[a] + length >= size)
            yield at, b"\n".join(batch.column(4)[a:b].to_pylist())
    if at is not None:
        yield at, None


def _scan(batches: Iterator[pa.RecordBatch], carried: dict, records: bool) -> Iterator[pa.RecordBatch]:
    """Records of ranges, or a summary of each.  Whether a file's last line has a line feed is not known here: none."""
    schema = _arrow(RECORDS if records else RANGES)
    rows, current, key, behind = [], None, None, b""
    for (uri, start, size, last), data in _rows_by_range(batches):
        if key != (uri, start):
            current, key, behind = _Range(start, carried.get((uri, start))), (uri, start), b""
        for found in current.finish(last) if data is None else current.feed(behind + data):
            if records:
                rows.append((uri, start, current.walker.seen - 1, *found))
            if len(rows) >= 5_000:
                yield _batch(rows, schema)
                rows = []
        behind = b"\n"
        if data is None and not records:
            w = current.walker
            rows.append((uri, start, size, current.n_bytes, current.head, w.held if w else b"", w.seen if w else 0,
                         json.dumps(current.opened), json.dumps(w.state if w else None), bool(w and w.dead),
                         current.joined))
    if rows:
        yield _batch(rows, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _stitch(ranges: pd.DataFrame) -> pd.DataFrame:
    """Lays the ranges of one file side by side.

    Gives a row per range that is known to be right (number of its first packet, interfaces before it), a row per packet
    that lies between ranges, and, where the file's chain breaks, the range to read again and what to carry into it.
    """
    rows, at = [], {c.split()[0]: None for c in STITCHED.split(", ")}
    ranges = ranges.sort_values("start")
    uri, number, base = ranges["uri"].iloc[0], 0, []
    feed = b"\n" if int(ranges["size"].iloc[0]) > int(ranges["n_bytes"].sum()) else b""
    walker, end = Walker(), len(ranges) - 1
    for i, r in enumerate(ranges.itertuples(index=False)):
        if i and not r.joined:
            opened, left = json.loads(r.opened), (walker.held, walker.state)
            between = list(walker.feed(r.head))
            fits = (opened and walker.state and not walker.held
                    and all(opened[k] == walker.state[k] for k in ("kind", "order")))
            if not fits and not walker.dead:
                rows.append(at | {"uri": uri, "start": r.start, "part": "again", "carried": left[0],
                                  "known": json.dumps(_fresh(left[1]))})
                return pd.DataFrame(rows)
            for high, low, interface, known, frame in between:
                rows.append(at | {"uri": uri, "start": r.start, "part": "packet", "first_no": number, "high": high,
                                  "low": low, "base": json.dumps(base), "interface": interface, "known": known,
                                  "frame": frame})
                number += 1
            if walker.dead:
                break
            base = _after(base, walker.state)
        rows.append(at | {"uri": uri, "start": r.start, "part": "range", "first_no": number, "base": json.dumps(base)})
        number += int(r.records)
        closed = json.loads(r.closed)
        base = _after(base, closed)
        walker = Walker(_fresh(closed), bytes(r.tail))
        if r.dead:
            break
        if i == end:
            for high, low, interface, known, frame in walker.feed(feed):
                rows.append(at | {"uri": uri, "start": r.start, "part": "packet", "first_no": number, "high": high,
                                  "low": low, "base": json.dumps(base), "interface": interface, "known": known,
                                  "frame": frame})
                number += 1
    return pd.DataFrame(rows)


def _fresh(state: dict | None) -> dict | None:
    """``state`` for bytes that follow: what it knows of interfaces is kept apart."""
    return state and {**state, "base": None, "links": []}


def _after(base: list, state: dict | None) -> list:
    """The interfaces known once what ``state`` tells has been read behind ``base``."""
    return base if state is None else (base if state["base"] is None else state["base"]) + state["links"]


def lines(spark: SparkSession, paths: list[str], files: Column | None = None) -> DataFrame:
    """(uri, start and length of the range, size of the file, bytes between line feeds) in the order of the file.

    ``files`` is a condition on the file's metadata; files it excludes are not opened.
    """
    read = spark.read.option("lineSep", "\n").text(paths)
    return (read if files is None else read.filter(files)).select(
        F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"), F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("line"))


def _scanned(rows: DataFrame, carried: dict, records: bool) -> DataFrame:
    return rows.mapInArrow(lambda batches: _scan(batches, carried, records), RECORDS if records else RANGES)


def stitched(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, dict]:
    """The ranges of capture files with the number of their first packet, and what is carried into which range.

    One pass over the files that keeps a row per range.  Ranges whose guess does not fit what lies before them are read
    again, the first of each file at a time; only their files are opened then.
    """
    carried, read = {}, lines(spark, paths)
    ranges = materialize(_scanned(read, carried, False))
    while True:
        found = materialize(ranges.groupBy("uri").applyInPandas(_stitch, STITCHED))
        again = {(r.uri, r.start): (json.loads(r.known), bytes(r.carried))
                 for r in found.filter("part = 'again'").select("uri", "start", "known", "carried").collect()}
        if not again:
            return found, carried
        carried |= again
        wrong = F.lit(False)
        for uri, start in again:
            wrong = wrong | ((F.col("uri") == uri) & (F.col("start") == start))
        files = F.col("_metadata.file_path").isin([uri for uri, _ in again])
        redone = _scanned(lines(spark, paths, files).filter(wrong), carried, False)
        ranges = materialize(ranges.filter(~wrong).unionByName(redone))


def packet_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(uri, packet_no, ts_us, link, frame) of every record of the files; link is null for an unknown interface.

    A file that is no capture gives no rows; a record cut short at the end of a file is left out.  Packets are numbered
    from 0 in the order of the file.  The files are read twice: once for the row per range, once for the records.
    """
    found, carried = stitched(spark, paths)
    ranges = found.filter("part = 'range'").select("uri", "start", "first_no", "base")
    inside = (_scanned(lines(spark, paths), carried, True).join(ranges, ["uri", "start"])
              .withColumn("packet_no", F.col("first_no") + F.col("nth")))
    between = found.filter("part = 'packet'").withColumn("packet_no", F.col("first_no"))
    names = ["uri", "packet_no", "base", "high", "low", "interface", "known", "frame"]
    both = inside.select(names).unionByName(between.select(names))
    pairs = "array<array<bigint>>"
    own = F.from_json(F.get_json_object("known", "$[1]"), pairs)
    links = F.concat(F.coalesce(own, F.from_json("base", pairs)), F.from_json(F.get_json_object("known", "$[2]"), pairs))
    link = F.get(links, F.col("interface").cast("int"))
    classic = F.get_json_object("known", "$[0]") == "classic"
    whole = F.col("high").cast("decimal(20,0)") * 4294967296 + F.col("low")
    ts = (F.when(classic, F.expr("high * 1000000 + low div link[1]"))
          .otherwise(F.expr("cast(whole as decimal(26,0)) * 1000000 div cast(link[1] as decimal(20,0))")))
    return (both.withColumn("link", link).withColumn("whole", whole)
            .select("uri", "packet_no", ts.alias("ts_us"), F.get("link", F.lit(0)).cast("int").alias("link"), "frame"))
