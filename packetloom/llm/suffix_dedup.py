"""Removal of byte strings that also start in an earlier document, by sorted suffix buckets.

The plan follows blockwise suffix sorting with a difference cover.  Residues COVER modulo PERIOD have the property
that any two positions have a shift below PERIOD that takes both to cover positions.

1. The cover sample: only positions whose residue is in the cover are named, by the string that starts there and is
   as long as every tie of LENGTH bytes must leave (LENGTH - PERIOD + 1).  Ranges of names are sorted one at a time.
2. Two suffixes can tie for LENGTH bytes only if a cover position within PERIOD of both carries a name that another
   document has too; all other suffixes drop out.
3. The suffixes left are dealt into buckets by the smallest name inside their first LENGTH bytes.  Neighbouring
   suffixes mostly share it, so they travel as one stretch of text; equal stretches of a group travel once, for
   their smallest doc_id.  Each bucket is sorted by itself, by the bytes of its suffixes: eight bytes first, then
   eight more at a time for those that still tie and are not all alike.  Neighbours are compared, and in a run of
   equal suffixes those of all but the smallest doc_id are removed.

Order beyond LENGTH bytes is never needed, so ties end there, the cover sample takes no ranks, and no task holds more
than one bucket.  Names choose candidates and buckets; what is removed rests on bytes alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm import shared_keys
from packetloom.llm.tables import bit_is_set, materialize, small_batches, text_or_empty

LENGTH = 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # each difference modulo 31 but 0 occurs exactly once
NAMED = LENGTH - PERIOD + 1

# Bytes of text for one range of cover names and one bucket of suffixes, and for one group of documents.
BYTES_PER_RANGE = 12_000_000
BYTES_PER_GROUP = 16_000_000

LONGEST = 240  # suffixes in one stretch; their number is sent as a byte

# Bytes of text and suffixes that arrays of numbers are made for at a time; a document or a run of ties may be longer.
BYTES_AT_ONCE = 1 << 19
SUFFIXES_AT_ONCE = 1 << 18

BITMAPS = 4096  # of 32,768 doc_ids each (4 KB), broadcast so that copies are not named

LAST = (1 << 63) - 1  # stands for a null doc_id

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def names(raw: bytes, at: np.ndarray | range, length: int) -> np.ndarray:
    """64-bit names of the ``length`` bytes (at least 8) that start at each position; a range has steps of one."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = np.full(len(at), length, np.uint64)
    for step in [*range(0, length - 8, 8), length - 8]:
        out = (out ^ (words[at.start + step:at.stop + step] if isinstance(at, range) else words[at + step])) * _MIX[0]
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(32))) * _MIX[1]
    out = (out ^ (out >> np.uint64(27))) * _MIX[2]
    return out ^ (out >> np.uint64(31))


def _order(key: np.ndarray) -> np.ndarray:
    """Stable order of 64-bit keys by two sorts of values, each of half a key and a place: faster than a sort of places."""
    half, places = np.uint64(32), np.arange(len(key), dtype=np.uint64)
    low = key << half
    low |= places
    low.sort()
    order = low.astype(np.uint32)  # the places
    del low
    high = key[order]
    high >>= half
    high <<= half
    high |= places
    del places
    high.sort()
    return order[high.astype(np.uint32)]


def byte_order(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the LENGTH-byte strings that start at each of ``at`` in ``raw``, and where a new string begins in it.

    ``raw`` ends in eight bytes of padding.
    """
    words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    key = words[at].astype(np.uint64)
    order = _order(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][:len(at)]
    del key
    heads = np.flatnonzero(new)
    cuts = heads[np.unique(np.searchsorted(heads, np.arange(0, len(at), SUFFIXES_AT_ONCE)).clip(max=len(heads) - 1))]
    for a, b in zip(cuts, np.r_[cuts[1:], len(at)]):  # ties of eight bytes stay together
        _settle_ties(words, at, order[a:b], new[a:b])
    return order, new


def _settle_ties(words: np.ndarray, at: np.ndarray, order: np.ndarray, new: np.ndarray) -> None:
    """Sorts, in place, what ties by its first eight bytes by the bytes after them."""
    for step in [*range(8, LENGTH - 8, 8), LENGTH - 8]:
        key = words[at[order] + step].astype(np.uint64)
        differs = np.r_[False, ~new[1:] & (key[1:] != key[:-1])]
        if not differs.any():
            continue
        group = np.cumsum(new) - 1
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[differs]] = True
        some = np.flatnonzero(mixed[group])
        inside = np.lexsort((key[some], group[some]))
        order[some], key[some] = order[some[inside]], key[some[inside]]
        new[1:] |= key[1:] != key[:-1]


def _joined(texts: list) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All bytes, and start and size of each text."""
    raw = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    return b"".join(raw) + bytes(8), np.cumsum(sizes) - sizes, sizes


def cover_positions(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number and place of every cover position that a name fits at, for documents of LENGTH bytes or more."""
    wanted = np.where(sizes >= LENGTH, np.maximum(sizes - NAMED + 1, 0), 0)
    most = -(-wanted // PERIOD) * len(COVER)
    doc = np.repeat(np.arange(len(sizes)), most)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most)
    place = nth // len(COVER) * PERIOD + np.array(COVER)[nth % len(COVER)]
    keep = place < wanted[doc]
    return doc[keep], place[keep]


def _cover_names(rows: DataFrame, n_ranges: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["doc"].to_numpy(np.int64), batch["text"].tolist()
            for part in shared_keys.slices(texts):
                raw, starts, sizes = _joined(texts[part])
                doc, place = cover_positions(sizes)
                if len(doc):
                    yield shared_keys.pack(names(raw, starts[doc] + place, NAMED), ids[part][doc],
                                           place.astype(np.uint32), n_ranges, width=4)
    return rows.select("doc", "text").mapInPandas(run, shared_keys.PACKED)


def group_of(doc: np.ndarray, n_groups: int) -> np.ndarray:
    """The group of documents that a doc_id belongs to; the arithmetic is repeated in columns by ``_group_column``."""
    return (doc % 1_000_003 * 7919 + doc // 1_000_003 % 1_000_003) % n_groups


def _group_column(n_groups: int) -> Column:
    low = "pmod(doc, 1000003)"
    high = f"pmod((doc - {low}) div 1000003, 1000003)"
    return F.expr(f"cast(({low} * 7919 + {high}) % {n_groups} AS int)")


def _by_group(found: np.ndarray, n_groups: int) -> pd.DataFrame:
    """Entries packed by group of documents."""
    group = group_of(found["doc"], n_groups)
    order = shared_keys.dealing(group, n_groups)
    found, cuts = found[order], np.searchsorted(group[order], np.arange(n_groups + 1))
    held = np.flatnonzero(np.diff(cuts))
    return pd.DataFrame({"g": held.astype(np.int32), "found": [found[cuts[g]:cuts[g + 1]].tobytes() for g in held]})


def _shared_places(packed: DataFrame, n_groups: int) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _by_group(shared_keys.shared_entries(rows, width=4), n_groups)
    return packed.groupBy("range").applyInPandas(run, "g int, found binary")


def candidate_runs(row: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes that can tie for LENGTH bytes, those within PERIOD before a shared cover place: row, first, count.

    ``row`` and ``place`` are in order; ``sizes`` are those of the rows' texts.
    """
    place = place.astype(np.int64)
    first, last = np.maximum(place - PERIOD + 1, 0), np.minimum(place, sizes[row] - LENGTH)
    fits = (first <= last) & (place < sizes[row])
    row, first, last = row[fits], first[fits], last[fits]
    heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)][:len(row)])
    ends = np.r_[heads[1:], len(row)][:len(heads)] - 1
    return row[heads], first[heads], last[ends] - first[heads] + 1


def least_within(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        values, have = np.minimum(values[:-have], values[have:]), 2 * have
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def stretches(raw: bytes, begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes cut where the smallest name in their first LENGTH bytes changes: run, offset in it, count, name.

    ``raw`` holds the runs one after the other, each of ``counts`` suffixes and its last one whole.
    """
    inner = names(raw, range(len(raw) - 7 - (NAMED - 8)), NAMED)
    firsts = np.cumsum(counts) - counts
    run = np.repeat(np.arange(len(counts)), counts)
    least = least_within(inner, LENGTH - NAMED + 1)[np.arange(len(run)) + (begins - firsts)[run]]
    new = np.r_[True, least[1:] != least[:-1]]
    new[firsts] = True
    since = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    first = np.flatnonzero(new | (since % LONGEST == 0))  # repeated text keeps its name for long
    return run[first], first - firsts[run[first]], np.diff(np.r_[first, len(new)]), least[first]


STRETCHES = "range int, docs binary, places binary, counts binary, texts binary, g int, runs binary"
RUN = np.dtype([("doc", "<i8"), ("place", "<u4"), ("count", "<u4")])


def _runs(docs: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.empty(len(docs), RUN)
    out["doc"], out["place"], out["count"] = docs, places, counts
    return out


def _cut_out(texts: pd.DataFrame, places: np.ndarray) -> tuple:
    """Stretches of some documents: doc, place, count and name as arrays, and their texts."""
    raw, starts, sizes = _joined([zlib.decompress(t) for t in texts["packed"]])
    ids = texts["doc"].to_numpy(np.int64)
    own = [places[a:b] for a, b in zip(texts["from"].tolist(), texts["to"].tolist())]
    row, first, count = candidate_runs(np.repeat(np.arange(len(ids)), [len(o) for o in own]), np.concatenate(own), sizes)
    if not len(row):
        return ids[row], first, count, np.zeros(0, np.uint64), []
    only = b"".join([raw[p:p + c + LENGTH - 1] for p, c in zip((starts[row] + first).tolist(), count.tolist())]) + bytes(8)
    begins = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    run, offset, count, name = stretches(only, begins, count)
    pieces = [only[p:p + c + LENGTH - 1] for p, c in zip((begins[run] + offset).tolist(), count.tolist())]
    return ids[row[run]], first[run] + offset, count, name, pieces


def _stretches_of(texts: pd.DataFrame, found: pd.DataFrame, n_ranges: int) -> pd.DataFrame:
    """Stretches of one group of documents."""
    columns = ["range", "docs", "places", "counts", "texts", "g", "runs"]
    group = texts["g"].iloc[0] if len(texts) else 0
    all_ = np.frombuffer(b"".join(found["found"]), shared_keys.ENTRY)
    ids = np.unique(all_["doc"])
    places = np.searchsorted(ids, all_["doc"]).astype(np.uint64) << np.uint64(32) | all_["place"]
    places.sort()
    cuts = np.searchsorted(places, np.arange(len(ids) + 1, dtype=np.uint64) << np.uint64(32))
    places = places.astype(np.uint32)
    texts = texts[texts["first"] & texts["doc"].isin(ids)].sort_values("doc", kind="stable")
    at = np.searchsorted(ids, texts["doc"].to_numpy(np.int64))
    texts = texts.assign(**{"from": cuts[at], "to": cuts[at + 1]})
    out = []
    for part in shared_keys.slices(texts["size"].tolist()):
        held = texts.iloc[part]
        dealt = [_cut_out(held.iloc[some], places) for some in shared_keys.slices(held["size"].tolist(), BYTES_AT_ONCE)]
        doc, place, count, name = (np.concatenate(x) for x in list(zip(*dealt))[:4])
        pieces = [p for x in dealt for p in x[4]]
        if not len(doc):
            continue
        seen: dict[bytes, int] = {}
        for piece, d in zip(pieces, doc.tolist()):  # documents ascend, so the first is the smallest
            seen.setdefault(piece, d)
        later = np.fromiter((seen[p] < d for p, d in zip(pieces, doc.tolist())), bool, len(pieces))
        if later.any():
            out.append((-1 - int(held["doc"].iloc[0]) % 1_000_003, b"", b"", b"", b"", group,
                        _runs(doc[later], place[later], count[later]).tobytes()))
        stay = np.flatnonzero(~later)
        which = ((name[stay] * _MIX[1] >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
        order = shared_keys.dealing(which, n_ranges)
        cuts, stay = np.searchsorted(which[order], np.arange(n_ranges + 1)), stay[order]
        docs = shared_keys.cut_planes(shared_keys.cut_steps(doc[stay], cuts), cuts)
        at = shared_keys.cut_planes(place[stay].astype(np.uint32), cuts)
        counts, ordered = count[stay].astype(np.uint8).tobytes(), [pieces[i] for i in stay.tolist()]
        ends = cuts.tolist()
        out += [(r, docs[r], at[r], counts[a:b], b"".join(ordered[a:b]), -1, b"")
                for r, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
    return pd.DataFrame(out, columns=columns)


def _is_first(texts: pd.DataFrame, side: pd.DataFrame) -> list[bool]:
    """Whether each text of a group is no later copy; ``side`` holds the copies in rows of their own."""
    copies = {(d, v) for docs, versions in zip(side["copies"], side["versions"]) if docs is not None
              for d, v in zip(docs.tolist(), versions.tolist())}
    return [key not in copies for key in zip(texts["doc"].tolist(), texts["version"].tolist())]


def _suffixes(rows: DataFrame, shared: DataFrame, n_ranges: int) -> DataFrame:
    """Stretches of the suffixes left, from first rows of equal texts only.

    A row holds those of one bucket, or, with ``g``, runs of suffixes already known to start earlier as well.  ``shared``
    is ``_with_copies``.
    """
    def run(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return _stretches_of(texts.assign(first=_is_first(texts, found)), found, n_ranges)
    return (rows.select("g", "doc", "version", "size", "packed").groupBy("g").cogroup(shared.groupBy("g"))
            .applyInPandas(run, STRETCHES))


def _whole_later(raw: bytes, begins: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Stretches that are, byte for byte, a stretch of an earlier document: all their suffixes start there as well."""
    pieces = [raw[a:b] for a, b in zip(begins.tolist(), (begins + sizes).tolist())]
    least: dict[bytes, int] = {}
    for piece, doc in zip(pieces, docs.tolist()):
        if least.setdefault(piece, doc) > doc:
            least[piece] = doc
    return np.fromiter((least[p] < d for p, d in zip(pieces, docs.tolist())), bool, len(pieces))


def _ends_named(raw: bytes, at: np.ndarray) -> np.ndarray:
    """64-bit names of the first and last eight of LENGTH bytes, equal where all of them are."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = words[at] * _MIX[0]
    out ^= out >> np.uint64(29)
    out ^= words[at + (LENGTH - 8)]
    out *= _MIX[1]
    return out ^ (out >> np.uint64(32))


def _later_in_bucket(rows: pd.DataFrame, n_groups: int) -> pd.DataFrame:
    """Later starts of one bucket."""
    known = rows[rows["g"] >= 0]
    out = [known[["g", "runs"]]]
    rows = rows[rows["g"] < 0]
    if len(rows):
        docs = np.concatenate([np.cumsum(shared_keys.from_planes(x, "<i8")) for x in rows["docs"]])
        places = np.concatenate([shared_keys.from_planes(x, "<u4") for x in rows["places"]]).astype(np.int64)
        counts = np.frombuffer(b"".join(rows["counts"]), np.uint8).astype(np.int64)
        raw = b"".join(rows["texts"]) + bytes(8)
        sizes = counts + LENGTH - 1
        begins = np.cumsum(sizes) - sizes
        whole = _whole_later(raw, begins, sizes, docs)
        stay = np.flatnonzero(~whole)
        found = [_runs(docs[whole], places[whole], counts[whole])]
        small = np.int32 if len(raw) < 1 << 31 else np.int64  # of the numbers that hold a position
        counts, firsts = counts[stay], np.cumsum(counts[stay]) - counts[stay]
        of = np.repeat(stay.astype(small), counts)
        at = np.repeat((begins[stay] - firsts).astype(small), counts)
        at += np.arange(len(at), dtype=small)
        some = shared_keys.recurring(_ends_named(raw, at))
        of, at = of[some], at[some]
        order, new = byte_order(raw, at)
        rank = np.unique(docs, return_inverse=True)[1]
        owners, starts = rank.astype(small)[of[order]], np.flatnonzero(new)
        later = np.zeros(len(of), bool)
        if len(of):
            lowest = np.repeat(np.minimum.reduceat(owners, starts), np.diff(np.r_[starts, len(order)]))
            later[order[owners > lowest]] = True
            del lowest
        del order, new, owners, starts
        of, at = of[later], at[later]
        if len(at):
            heads = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])])
            lengths, of, at = np.diff(np.r_[heads, len(at)]), of[heads], at[heads]
            found.append(_runs(docs[of], places[of] + at - begins[of], lengths))
        found = np.concatenate(found)
        if len(found):
            group = group_of(found["doc"], n_groups)
            order = np.lexsort((found["place"], found["doc"], group))
            found, cuts = found[order], np.searchsorted(group[order], np.arange(n_groups + 1))
            held = np.flatnonzero(np.diff(cuts))
            out.append(pd.DataFrame({"g": held.astype(np.int32),
                                     "runs": [found[cuts[g]:cuts[g + 1]].tobytes() for g in held]}))
    return pd.concat(out)


def _later_starts(packed: DataFrame, n_groups: int) -> DataFrame:
    """Of each bucket's equal suffixes, those whose document is not the smallest, as runs by group of documents."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _later_in_bucket(rows, n_groups)
    return packed.groupBy("range").applyInPandas(run, "g int, runs binary")


def cut(raw: bytes, places: np.ndarray, counts: np.ndarray) -> tuple[bytes, int]:
    """What is left of ``raw`` without the LENGTH bytes of each of ``counts`` starts from each place; runs removed."""
    if not len(places):
        return raw, 0
    gone = np.zeros(len(raw), bool)
    for place, count in zip(places.tolist(), counts.tolist()):
        gone[place:place + count + LENGTH - 1] = True
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), runs


def _packed_texts(texts: DataFrame, n_groups: int) -> DataFrame:
    """Texts compressed and with their group: what the two later steps deal out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [t.encode() for t in batch["text"]]
            batch["size"], batch["packed"] = [len(r) for r in raw], [zlib.compress(r, 1) for r in raw]
            yield batch[["g", "doc", "no_id", "version", "size", "packed"]]
    return (texts.withColumn("g", _group_column(n_groups)).withColumn("version", F.xxhash64(F.sha2("text", 256)))
            .mapInPandas(run, "g int, doc long, no_id boolean, version long, size int, packed binary"))


def _with_copies(side: DataFrame, column: str, copies: DataFrame, n_groups: int) -> DataFrame:
    """``side``, some ``column`` by group, and the copies of each group, so that texts are not joined with them."""
    ids = copies.groupBy(_group_column(n_groups).alias("g")).agg(
        F.collect_list("doc").alias("copies"), F.collect_list("version").alias("versions"))
    return (side.select("g", column, *[F.lit(None).cast("array<long>").alias(c) for c in ("copies", "versions")])
            .unionByName(ids.withColumn(column, F.expr("X''"))))


def _without_copies(texts: DataFrame, copies: DataFrame, ids: DataFrame) -> DataFrame:
    """``texts`` without most copies: those whose doc_id no other row has, as far as bitmaps of them can be broadcast.

    Copies that stay cost time, not results.
    """
    several = ids.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bits = copies.select("doc").join(several, "doc", "left_anti")
    bits = materialize(bits.groupBy(F.bitmap_bucket_number("doc").alias("_bucket"))
                       .agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc")).alias("_bits")))
    if not 0 < bits.count() <= BITMAPS:
        return texts
    is_copy = F.coalesce(bit_is_set(F.col("_bits"), F.bitmap_bit_position("doc")), F.lit(False))
    return (texts.join(F.broadcast(bits), F.bitmap_bucket_number("doc") == F.col("_bucket"), "left")
            .filter(~is_copy).drop("_bucket", "_bits"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary: the bytes left) of every row of ``docs``.

    A byte goes if it is covered by LENGTH bytes that also start in a document with a smaller doc_id.  A null text
    is empty; texts shorter than LENGTH stay whole.  Rows of one doc_id are one document's versions: they do not
    count as earlier than each other.  A null doc_id is later than all others.  Other columns are ignored; an empty
    table gives no rows.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n_ranges = shared_keys.ranges_for(total, BYTES_PER_RANGE)
    n_groups = shared_keys.ranges_for(total, BYTES_PER_GROUP)
    key = F.coalesce(F.col("doc_id"), F.lit(LAST))
    texts = small_batches(docs).select(
        key.alias("doc"), F.col("doc_id").isNull().alias("no_id"), text_or_empty().alias("text"))
    # Of equal texts only the smallest doc_id can matter to others; the rest is removed as a whole.
    ids = materialize(texts.select("doc", F.unhex(F.sha2("text", 256)).alias("content")))
    equal = ids.groupBy("content").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = ids.join(equal, "content").filter("doc > least")
    version = F.xxhash64(F.lower(F.hex("content")))  # as in _packed_texts
    copies = materialize(copies.select("doc", version.alias("version")).distinct())
    named = _cover_names(_without_copies(texts, copies, ids), n_ranges)
    shared = materialize(_shared_places(named, n_groups))
    rows = _packed_texts(texts, n_groups)
    shared = _with_copies(shared, "found", copies, n_groups)
    later = materialize(_later_starts(_suffixes(rows, shared, n_ranges), n_groups))
    later = _with_copies(later, "runs", copies, n_groups)

    def run(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        all_ = np.frombuffer(b"".join(found["runs"]), RUN)
        all_ = all_[np.argsort(all_["doc"], kind="stable")]
        out = []
        for doc, no_id, first, packed in zip(texts["doc"], texts["no_id"], _is_first(texts, found), texts["packed"]):
            raw = zlib.decompress(packed)
            own = all_[np.searchsorted(all_["doc"], doc):np.searchsorted(all_["doc"], doc, side="right")]
            places, counts = own["place"].astype(np.int64), own["count"].astype(np.int64)
            if not first:
                places, counts = np.zeros(1, np.int64), np.array([len(raw) - LENGTH + 1])
            fits = (counts > 0) & (places + counts + LENGTH - 1 <= len(raw))
            kept, runs = cut(raw, places[fits], counts[fits])
            out.append((doc, no_id, len(raw), len(raw) - len(kept), runs, kept))
        return pd.DataFrame(out, columns=["doc", "no_id", "n_bytes", "n_removed", "n_spans", "kept"])
    done = rows.groupBy("g").cogroup(later.groupBy("g")).applyInPandas(
        run, "doc long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
