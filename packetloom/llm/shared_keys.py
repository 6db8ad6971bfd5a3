"""Finding keys that occur in more than one document, without a row per key.

A worker packs the keys of some megabytes of text into one row per key range, in document order so that documents and
places shrink to small differences.  One task sorts one range at a time; its rows say which entries, per document,
have a key that another document has too.  Keys that recur inside one batch are known to be shared at once and travel
a single time, so a key held by very many documents weighs one entry per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

PACKED = "range int, keys binary, docs binary, counts binary, places binary, known binary, found binary"
COLUMNS = ["range", "keys", "docs", "counts", "places", "known", "found"]

ENTRY = np.dtype([("doc", "<i8"), ("place", "<u4")])

COUNTED = "bucket int, docs binary, places binary, counts binary"
DOCS_PER_BUCKET = 4096

# Text that a worker packs at a time.
BATCH_CHARS = 4 << 20

RECURRING = 1 << 22  # marks for keys that recur, by their low bits


def ranges_for(units: int, per_range: int) -> int:
    """Number of key ranges for about ``per_range`` units of input in each."""
    return max(12, -(-units // per_range))


def slices(texts: list, most: int = BATCH_CHARS) -> Iterator[slice]:
    """Runs of texts, or of their sizes, of about ``most`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += text if isinstance(text, int) else len(text or "")
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def planes(values: np.ndarray) -> bytes:
    """Little-endian integers, all first bytes before all second ones: the high bytes then compress to nothing."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def cut_planes(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """``planes`` of the values between each two neighbouring cuts."""
    turned = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    cuts = cuts.tolist()
    return [turned[:, a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def cut_steps(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Differences of neighbours; after each cut the value itself."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    starts = cuts[:-1][np.diff(cuts) > 0]
    steps[starts] = values[starts]
    return steps


def recurring(keys: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Entries whose key occurs again, or among ``known``, and a few more; values are sorted, which takes a fraction of a
    sort of places."""
    ordered = np.sort(keys if known is None or not len(known) else np.concatenate([keys, known]))
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    mask = keys.dtype.type(RECURRING - 1)
    held = np.zeros(RECURRING, bool)
    held[twice & mask] = True
    return np.flatnonzero(held[keys & mask])


def dealing(which: np.ndarray, n: int) -> np.ndarray:
    """Stable order by a number below ``n``; sixteen bits are sorted by counting."""
    return np.argsort(which.astype(np.uint16) if n <= 1 << 16 else which, kind="stable")


def _groups(keys: np.ndarray, docs: np.ndarray):
    """Of sorted keys: start of each group, its size, and whether it spans two documents."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    several = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)
    return starts, sizes, several


def entries(docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.empty(len(docs), ENTRY)
    out["doc"], out["place"] = docs, places
    return out


def pack(keys: np.ndarray, docs: np.ndarray, places: np.ndarray, n_ranges: int, width: int = 8,
         collapse: bool = True) -> pd.DataFrame:
    """Rows of PACKED from parallel arrays (uint64, int64, uint32) in the order of documents and places.

    ``width`` low bytes of a key are sent beside its range: 8 keep it whole, 4 do for a filter that may pass a few
    keys too many.  With ``collapse``, ``found`` holds the entries already known to be shared, in a row of its own
    with a negative range; without, every entry travels.
    """
    if not len(keys):
        return pd.DataFrame(columns=COLUMNS)
    known, once = np.zeros(len(keys), bool), np.zeros(0, np.int64)
    if collapse:
        some = recurring(keys)
        order = some[np.argsort(keys[some])]
        starts, sizes, several = _groups(keys[order], docs[order])
        known[order] = np.repeat(several, sizes)
        once = order[starts[several]]
    own, cuts = _in_ranges(keys, np.flatnonzero(~known), n_ranges)
    once, known_cuts = _in_ranges(keys, once, n_ranges)
    held, at = docs[own], places[own]
    new = np.r_[True, held[1:] != held[:-1]][:len(own)]
    new[cuts[:-1][np.diff(cuts) > 0]] = True
    heads = np.flatnonzero(new)
    head_cuts = np.searchsorted(heads, cuts)
    rows = pd.DataFrame({
        "range": np.arange(n_ranges, dtype=np.int32),
        "keys": _cut_bytes(low_bytes(keys[own], width), cuts * width),
        "docs": cut_planes(cut_steps(held[heads], head_cuts), head_cuts),
        "counts": cut_planes(np.diff(np.r_[heads, len(own)]).astype(np.uint32), head_cuts),
        "places": cut_planes(cut_steps(at, cuts), cuts),
        "known": _cut_bytes(low_bytes(keys[once], width), known_cuts * width), "found": b""}, columns=COLUMNS)
    rows = rows[(np.diff(cuts) > 0) | (np.diff(known_cuts) > 0)]
    if not len(once):
        return rows
    found = _row(-1 - int(keys[once[0]] >> np.uint64(34))) | {"found": entries(docs[known], places[known]).tobytes()}
    return pd.concat([rows, pd.DataFrame([found], columns=COLUMNS).astype({"range": np.int32})], ignore_index=True)


def _row(name: int) -> dict:
    return dict.fromkeys(COLUMNS, b"") | {"range": name}


def low_bytes(keys: np.ndarray, width: int) -> bytes:
    if width == 4:
        return keys.astype("<u4").tobytes()
    return keys.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def range_of(keys: np.ndarray, n_ranges: int) -> np.ndarray:
    """The range of each key; ranges ascend with keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int32)


def _cut_bytes(raw: bytes, cuts: np.ndarray) -> list[bytes]:
    cuts = cuts.tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _in_ranges(keys: np.ndarray, picked: np.ndarray, n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The picked entries by key range, in their order, and where each range is cut."""
    which = range_of(keys[picked], n_ranges)
    order = dealing(which, n_ranges)
    return picked[order], np.searchsorted(which[order], np.arange(n_ranges + 1))


def _dealt(keys: np.ndarray, picked: np.ndarray, n_ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """The picked entries of each key range, in their order."""
    picked, cuts = _in_ranges(keys, picked, n_ranges)
    for r in np.flatnonzero(np.diff(cuts)):
        yield int(r), picked[cuts[r]:cuts[r + 1]]


def keys_of(raw: bytes, width: int) -> np.ndarray:
    if width == 4:
        return np.frombuffer(raw, "<u4")
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def unpack(rows: pd.DataFrame, width: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents and places of all rows of one range, and the keys known to be shared."""
    keys = keys_of(b"".join(rows["keys"]), width)
    docs, places = np.empty(len(keys), np.int64), np.empty(len(keys), np.uint32)
    at = 0
    for row in rows.itertuples(index=False):
        if row.docs:
            own = np.repeat(np.cumsum(from_planes(row.docs, "<i8")), from_planes(row.counts, "<u4"))
            docs[at:at + len(own)] = own
            places[at:at + len(own)] = np.cumsum(from_planes(row.places, "<u4"), dtype=np.uint32)
            at += len(own)
    return keys, docs, places, keys_of(b"".join(rows["known"]), width)


def shared_entries(rows: pd.DataFrame, width: int = 8) -> np.ndarray:
    """The entries, out of all rows of one range, whose key another document has too."""
    found = np.frombuffer(b"".join(rows["found"]), dtype=ENTRY)
    keys, docs, places, known = unpack(rows, width)
    if not len(keys):
        return found
    some = recurring(keys, known)
    order = some[np.argsort(keys[some])]
    ordered = keys[order]
    starts, sizes, several = _groups(ordered, docs[order])
    if len(known) and len(order):
        known = np.sort(known)
        at = np.minimum(np.searchsorted(known, ordered[starts]), len(known) - 1)
        several |= known[at] == ordered[starts]
    hit = np.zeros(len(keys), bool)  # in the order of documents again, which shrinks better
    hit[order] = np.repeat(several, sizes)
    return np.concatenate([found, entries(docs[hit], places[hit])])


def _tally(docs: np.ndarray, places: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, place) with their summed n."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    starts = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (places[1:] != places[:-1])])
    return docs[starts], places[starts], np.add.reduceat(n[order], starts)


def counted(found: np.ndarray, n_buckets: int) -> pd.DataFrame:
    """Rows of COUNTED: how often each entry is in ``found``, one row per bucket of entries and not one per entry.

    A document has entries in very many ranges; there are never more rows than entries, and mostly thousands of times fewer.
    """
    columns = ["bucket", "docs", "places", "counts"]
    if not len(found):
        return pd.DataFrame(columns=columns)
    docs, places, n = _tally(found["doc"], found["place"], np.ones(len(found), np.uint32))
    spread = (docs.view(np.uint64) ^ (places.astype(np.uint64) << np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
    return pd.DataFrame([
        (r, planes(docs[own]), planes(places[own]), planes(n[own].astype(np.uint32)))
        for r, own in _dealt(spread, np.arange(len(docs)), n_buckets)], columns=columns)


def summed(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, places and summed counts of all COUNTED rows of one bucket."""
    parts = [np.concatenate([from_planes(raw, kind) for raw in rows[name]])
             for name, kind in (("docs", "<i8"), ("places", "<u4"), ("counts", "<u4"))]
    return _tally(parts[0], parts[1], parts[2].astype(np.int64))
