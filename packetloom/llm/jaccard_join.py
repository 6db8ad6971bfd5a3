"""N-gram Jaccard self-join by T-occurrence search.

1. Every document becomes its set of hashed 5-word shingles.  Sorting shingle ranges and adding up packed counts tells
   how many of a document's shingles another one has too; below the threshold share, it has no partner and drops out.
2. Documents of equal sets are one class; from here on a class is its smallest document.
3. Two similar sets share one of their first shingles in any fixed order (prefix filter), here rare ones before common
   ones.  Linking each such shingle's documents to the smallest of them gives blocks that no link leaves.
4. Inside a block, DivideSkip: each set asks the inverted lists of the sets before it; short lists are merged by
   counting, and long ones probed by binary search for the candidates that can reach the overlap.
5. A large block is searched in pieces, each beside the block's most typical sets.  A document of whose shingles other
   components hold too few has then all its links; the others are put into blocks again by prefixes in the order of
   exact counts.  With the copies out of the way, these hold shingles of a few documents, and blocks are small.

Components, not pairs, are the result, so candidates already connected are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm import shared_keys
from packetloom.llm.graph import components
from packetloom.llm.tables import materialize, one_of_each, small_batches

WORDS = 5
THRESHOLD = 75  # percent

# Documents and shingles of a block searched in one piece, and typical sets that go with each piece of a larger block.
PIECE = 1024
GRAMS_PER_PIECE = 1 << 20
TYPICAL = 4

# DivideSkip's share of long lists, and how many steps of a merge a binary search is worth.
MERGED = 0.0085
PROBE = 20

# Searches of what is undecided before what is outside a block's largest component is compared with all of the block.
ROUNDS = 4

# Characters of text for one key range (about a shingle per 6 of them), and those shingled at a time.
CHARS_PER_RANGE = 4_000_000
SHINGLED_CHARS = 1 << 20

# Bytes of a word above which it is hashed by itself.
LONG_WORD = 256

# Bytes of a shingle sent beside its range when counting shared ones: a chance match can only keep a document in.
KEY_BYTES = 4
FILTER_BITS = 1 << 25

# Shingles that occur OFTEN in a batch count as common; at most MOST_COMMON of them, 4 MB, are broadcast.
OFTEN = 4
MOST_COMMON = 1 << 18

# Shingles of a batch of undecided documents that asks for exact counts.
GRAMS_PER_BATCH = 1 << 18

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER, _LOWER)
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


_MIX, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _word_codes(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at ``starts``, eight bytes of all words at a time; ``raw`` has 16 bytes to spare."""
    eights = np.frombuffer(raw, "<u8", len(raw) // 8)
    codes = sizes.astype(np.uint64) * _END
    left = np.flatnonzero(sizes <= LONG_WORD)
    at = 0
    while len(left):
        place, shift = starts[left] + at, (starts[left] + at & 7).astype(np.uint64) << np.uint64(3)
        # Two aligned reads; a shift by 64 is one by 63 and one by 1.
        value = eights[place >> 3] >> shift | eights[(place >> 3) + 1] << (np.uint64(63) - shift) << np.uint64(1)
        value &= _FIRST_BYTES[np.minimum(sizes[left] - at, 8)]
        value = (codes[left] ^ value) * _MIX
        codes[left] = value ^ value >> np.uint64(32)
        at += 8
        left = left[sizes[left] > at]
    for i in np.flatnonzero(sizes > LONG_WORD):
        codes[i] = xxhash.xxh64_intdigest(raw[starts[i]:starts[i] + sizes[i]])
    codes *= _END
    return codes ^ codes >> np.uint64(29)


def _mixed(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ codes[i:len(codes) - n + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    out *= _END
    return out ^ (out >> np.uint64(32))


def _distinct(grams: np.ndarray) -> np.ndarray:
    grams = np.sort(grams)
    first = grams[1:] != grams[:-1]
    return grams if first.all() else grams[np.r_[True, first]]


def _sets(texts: list, words: int) -> list[np.ndarray]:
    texts = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
    raw = b"".join([b" ", b" ".join(texts), b" " * 24]).translate(_FOLD)
    space = _IS_SPACE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    codes = _word_codes(raw, starts, sizes)
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]) + 1).tolist()
    runs = _mixed(codes, words) if len(codes) >= words else None
    sets, first = [], 0
    for end in ends:
        if end - first >= words:
            sets.append(_distinct(runs[first:end - words + 1]))
        else:
            sets.append(_mixed(codes[first:end], end - first) if end > first else np.zeros(0, np.uint64))
        first = end
    return sets


def shingle_sets(texts: list, words: int = WORDS) -> list[np.ndarray]:
    """For each text (or its UTF-8 bytes): sorted distinct 64-bit hashes of the word n-grams.

    All words are one if they are fewer; none without words.  Only the six ASCII white-space bytes part words.
    """
    return [s for part in shared_keys.slices(texts, SHINGLED_CHARS) for s in _sets(texts[part], words)]


def least_overlap(n: int, percent: int) -> int:
    """Shingles that any partner of a set of n must share with it."""
    return -(-percent * n // 100)


_ROW = np.dtype([("doc", "<i8"), ("named", "?"), ("n", "<i8"), ("signature", "S32")])
_SURVEY = pa.schema([("range", pa.int32()), *[(c, pa.binary()) for c in shared_keys.COLUMNS[1:]], ("rows", pa.binary())])


def _survey(docs: DataFrame, words: int, n_ranges: int, n_buckets: int) -> DataFrame:
    """One pass over all texts: doc_id, n_shingles and a signature of the set for every row, in bucket -1.

    In the other buckets are packed counts of the shingles that some other document has too.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            for part in shared_keys.slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                sets = shingle_sets(texts[part].to_pylist(), words)
                rows = np.zeros(len(sets), _ROW)
                rows["doc"] = pc.fill_null(ids[part], 0).to_numpy(zero_copy_only=False)
                rows["named"] = ids[part].is_valid().to_numpy(zero_copy_only=False)
                rows["n"] = [len(s) for s in sets]
                rows["signature"] = [xxhash.xxh128_hexdigest(s.tobytes()).encode() for s in sets]
                named = rows["named"]
                grams = np.concatenate([np.zeros(0, np.uint64), *[s for s, known in zip(sets, named) if known]])
                own = np.repeat(rows["doc"][named], rows["n"][named])
                packed = shared_keys.pack(grams, own, np.zeros(len(own), np.uint32), n_ranges, KEY_BYTES)
                raw = rows.tobytes()
                packed = pd.concat([packed.assign(rows=b""), pd.DataFrame([dict.fromkeys(shared_keys.COLUMNS, b"") | {
                    "range": -1 - (xxhash.xxh32_intdigest(raw) >> 2), "rows": raw}])])
                yield pa.RecordBatch.from_pandas(packed, _SURVEY, preserve_index=False)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(b"".join(rows["rows"]), _ROW)
        parts = shared_keys.counted(shared_keys.shared_entries(rows, KEY_BYTES), n_buckets)
        blank = np.zeros(len(parts), np.int64)
        held = {"signature": [s.decode() for s in own["signature"].tolist()] + [None] * len(parts),
                **{c: [None] * len(own) + parts[c].tolist() for c in ("docs", "places", "counts")}}
        return pd.DataFrame({
            "bucket": np.r_[np.full(len(own), -1), parts["bucket"].to_numpy(np.int64)],
            "doc_id": pd.arrays.IntegerArray(np.r_[own["doc"], blank], np.r_[~own["named"], blank == 0]),
            "n_shingles": np.r_[own["n"], blank],
            **{c: pd.Series(values, dtype=object) for c, values in held.items()}})
    packed = docs.select("doc_id", "text").mapInArrow(pack, shared_keys.PACKED + ", rows binary")
    return packed.groupBy("range").applyInPandas(count, "bucket int, doc_id long, n_shingles long, signature string, "
                                                        "docs binary, places binary, counts binary")


def _shared_counts(counts: DataFrame) -> DataFrame:
    """doc_id and how many of its shingles some other document has."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, _, n = shared_keys.summed(rows)
        return pd.DataFrame({"doc_id": ids, "n_shared": n})
    return counts.groupBy("bucket").applyInPandas(run, "doc_id long, n_shared long")


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, share, n_shingles, text of the chosen documents: a text is half the size of its set, which is quickly made again.

    Most other texts are held back before the shuffle by a bitmap of FILTER_BITS hashed ids, 4 MB at any size.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = (chosen.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits")))
    held = docs.select("doc_id", "text").withColumn("_slot", slot)
    held = held.join(F.broadcast(materialize(bits)), F.bitmap_bucket_number("_slot") == F.col("_bucket"))
    place = F.bitmap_bit_position("_slot").cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), place % 8 + 1)
    return (held.filter(byte.bitwiseAND(bit) > 0).select("doc_id", "text")
            .join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "share", "n_shingles", "text"))


def _common_grams(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to MOST_COMMON shingles that recur in batches of documents, sorted, and their summed counts.

    The prefix filter is exact under any fixed order of shingles; with these last, passages that many unlike
    documents share do not tie them together.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = batch["text"].tolist()
            for part in shared_keys.slices(held):
                grams, n = np.unique(np.concatenate(shingle_sets(held[part], words)), return_counts=True)
                often = n >= OFTEN
                yield pd.DataFrame({"gram": grams[often].view(np.int64), "n": n[often].astype(np.int64)})
    found = (texts.select("text").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "gram").limit(MOST_COMMON).collect())
    grams = np.array([r.gram for r in found], np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.array([r.n for r in found], np.int64)[order]


def prefix(grams: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set of which any partner has at least one: the first in order of count, then hash."""
    length = len(grams) - least_overlap(len(grams), percent) + 1
    if not len(common):
        return grams[:length]
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    rank = np.where(common[at] == grams, counts[at], 0)
    return grams[np.argsort(rank, kind="stable")[:length]]


_EDGES = "a long, b long, range int, keys binary, owners binary"


def _to_least(keys: np.ndarray, own: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Edges (a, b) from each owner of a key to the smallest that has it; the distinct keys and their smallest owners."""
    by_key = np.lexsort((own, keys))
    keys, own = keys[by_key], own[by_key]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    least = np.repeat(own[starts], np.diff(np.r_[starts, len(keys)]))
    return pd.DataFrame({"a": least, "b": own}).query("a != b").drop_duplicates(), keys[starts], own[starts]


def _prefix_edges(ids: np.ndarray, heads: list[np.ndarray], n_ranges: int) -> pd.DataFrame:
    """Rows of _EDGES for some documents with their prefixes.

    Each document has edges to the smallest of them that share a shingle; the shingles and those smallest are packed into a
    row per key range.
    """
    own = np.repeat(ids, [len(h) for h in heads])
    edges, keys, least = _to_least(np.concatenate([np.zeros(0, np.uint64), *heads]), own)
    which = shared_keys.range_of(keys, n_ranges)
    cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True]) if len(keys) else np.zeros(1, np.int64)
    parts = [slice(i, j) for i, j in zip(cuts[:-1], cuts[1:])]
    packed = pd.DataFrame({"a": 0, "b": 0, "range": which[cuts[:-1]] if len(keys) else which,
                           "keys": pd.Series([keys[p].tobytes() for p in parts], dtype=object),
                           "owners": pd.Series([shared_keys.planes(least[p]) for p in parts], dtype=object)})
    return pd.concat([edges.assign(range=-1, keys=b"", owners=b""), packed])


def _across(rows: DataFrame) -> DataFrame:
    """Edges of all documents from those inside batches and the packed shingles, of which each batch has one entry.

    So even a shingle of very many documents is a small group.
    """
    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.concatenate([shared_keys.from_planes(raw, "<i8") for raw in rows["owners"]])
        return _to_least(np.frombuffer(b"".join(rows["keys"]), np.uint64), own)[0]
    across = rows.filter("range >= 0").groupBy("range").applyInPandas(meet, "a long, b long")
    return rows.filter("range < 0").select("a", "b").unionByName(across)


def _block_edges(texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Edges (a, b) that connect all documents sharing a prefix shingle, through the smallest of them."""
    order = texts.sparkSession.sparkContext.broadcast(_common_grams(texts, words))
    n_ranges = shared_keys.ranges_for(6 * (texts.agg(F.sum("n_shingles").alias("n")).first().n or 0), CHARS_PER_RANGE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), words)
            heads = [prefix(s, *order.value, percent) for s in sets]
            yield _prefix_edges(batch["doc_id"].to_numpy(np.int64), heads, n_ranges)
    return _across(materialize(texts.select("doc_id", "text").mapInPandas(run, _EDGES)))


def _component_counts(rows: pd.DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a batch, sorted, and how many of its components hold each."""
    sets = shingle_sets(rows["text"].tolist(), words)
    grams = np.concatenate(sets)
    own = np.repeat(rows["component"].to_numpy(np.int64), [len(s) for s in sets])
    order = np.lexsort((own, grams))
    grams, own = grams[order], own[order]
    first = np.r_[True, grams[1:] != grams[:-1]]
    new = first | np.r_[True, own[1:] != own[:-1]]
    starts = np.flatnonzero(first)
    return grams[starts], np.add.reduceat(new, starts, dtype=np.uint32)


def _rarest_edges(left: DataFrame, percent: int, words: int) -> DataFrame:
    """``_block_edges`` of (doc_id, component, n_shingles, text), with prefixes in order of exact counts.

    Batches ask for the counts of their distinct shingles by key range, so that a shingle of any number of documents is
    one entry per batch, and are answered in the order asked.  A shingle's count is the sum over batches of the components
    that hold it; one that counts once cannot connect two components and makes no edge.
    """
    n = left.agg(F.sum("n_shingles").alias("n")).first().n
    n_ranges, n_batches = shared_keys.ranges_for(6 * n, CHARS_PER_RANGE), -(-n // GRAMS_PER_BATCH)
    dealt = materialize(left.select(F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).alias("batch"),
                                    "doc_id", "component", "text"))

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        grams, counts = _component_counts(rows, words)
        which = shared_keys.range_of(grams, n_ranges)
        cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True])
        parts = [slice(i, j) for i, j in zip(cuts[:-1], cuts[1:])]
        return pd.DataFrame({
            "range": which[cuts[:-1]], "batch": rows["batch"].iloc[0],
            "keys": [shared_keys.low_bytes(grams[p], KEY_BYTES) for p in parts],
            "counts": [shared_keys.planes(counts[p]) for p in parts]})

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys = shared_keys.keys_of(b"".join(rows["keys"]), KEY_BYTES)
        counts = [shared_keys.from_planes(c, "<u4") for c in rows["counts"]]
        _, at = np.unique(keys, return_inverse=True)
        totals = np.bincount(at, np.concatenate(counts))[at].astype(np.uint32)
        parts = np.split(totals, np.cumsum([len(c) for c in counts])[:-1])
        return rows[["batch", "range"]].assign(totals=[shared_keys.planes(p) for p in parts])

    def edges(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets(rows["text"].tolist(), words)
        grams = np.unique(np.concatenate(sets))
        totals = np.concatenate([shared_keys.from_planes(t, "<u4") for t in answers.sort_values("range")["totals"]])
        heads = [prefix(s, grams, totals, percent) for s in sets]
        heads = [h[totals[np.searchsorted(grams, h)] > 1] for h in heads]
        return _prefix_edges(rows["doc_id"].to_numpy(np.int64), heads, n_ranges)
    asked = dealt.select("batch", "component", "text").groupBy("batch").applyInPandas(
        ask, "range int, batch long, keys binary, counts binary")
    answered = asked.groupBy("range").applyInPandas(answer, "batch long, range int, totals binary")
    return _across(materialize(dealt.groupBy("batch").cogroup(answered.groupBy("batch"))
                               .applyInPandas(edges, _EDGES)))


def divide_skip(sets: list[np.ndarray], percent: int = THRESHOLD, known: list | None = None) -> list[tuple[int, int]]:
    """Links between positions of ``sets`` that connect all pairs with Jaccard of at least ``percent``.

    Sets ask the inverted lists of those before them.  The short lists are merged by counting; a document that, with all of
    the long ones, can still reach the overlap is a candidate, and the long lists are probed for the candidates by binary
    search, or merged too where that is less work.  ``known`` may give a group to each position; positions of one group
    count as connected.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    group, first = np.arange(len(sets)), {}
    if known is not None:
        group = np.array([i if k is None else first.setdefault(k, i) for i, k in enumerate(known)], np.int64)
    grams = np.concatenate([np.zeros(0, np.uint64), *sets])
    order = np.argsort(grams, kind="stable")
    lists, grams = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order], grams[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    start = np.repeat(starts, np.diff(np.r_[starts, len(grams)]))
    begin, end = np.empty_like(start), np.empty_like(start)  # of each shingle of each set: its list, up to that set
    begin[order], end[order] = start, np.arange(len(grams))
    places = start * len(sets) + lists  # ascending: by list, then member
    bounds = np.r_[0, np.cumsum(sizes)]
    links = []
    for i in range(len(sets)):
        need = least_overlap(int(sizes[i]), percent)
        b, e = begin[bounds[i]:bounds[i + 1]], end[bounds[i]:bounds[i + 1]]
        held = e > b
        if not sizes[i] or np.count_nonzero(held) < need:
            continue
        other = group[:i] != group[i]
        if not other.any():
            continue
        b, e = b[held], e[held]
        by_size = np.argsort(e - b)
        n_long = int(need / (MERGED * np.log2(e[by_size[-1]] - b[by_size[-1]]) + 1))
        n_long = min(n_long, need - 1)
        short, long = by_size[:len(b) - n_long], by_size[len(b) - n_long:]
        seen = _members(lists, b[short], e[short], i)
        least = np.maximum(need, -(-percent * (sizes[i] + sizes[:i]) // (100 + percent)))
        found = np.flatnonzero(other & (seen + n_long >= least) & (seen > 0))
        if not len(found):
            continue
        if PROBE * len(found) * n_long > (e[long] - b[long]).sum():
            seen = (seen + _members(lists, b[long], e[long], i))[found]
        else:
            wanted = (b[long] * len(sets))[:, None] + found
            at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
            seen = seen[found] + (places[at] == wanted).sum(axis=0)
        similar = found[seen >= least[found]]
        if len(similar):
            joined, which = np.unique(group[similar], return_index=True)
            links += [(int(j), i) for j in similar[which]]
            group[np.isin(group, joined)] = group[i]
    return links


def _members(lists: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """In how many of the lists each of n documents is."""
    sizes = end - begin
    at = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return np.bincount(lists[at], minlength=n)


def _search(members: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Links (a, b) inside each (block, piece); typical sets come first, documents of one component are connected."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["share", "doc_id"], ascending=[False, True]).drop_duplicates("doc_id")
        ids = rows["doc_id"].to_numpy(np.int64)
        known = [None if pd.isna(c) else int(c) for c in rows["component"]]
        links = divide_skip(shingle_sets(rows["text"].tolist(), words), percent, known)
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype=np.int64)
    return (members.select("block", "piece", "doc_id", "component").join(texts, "doc_id")
            .groupBy("block", "piece").applyInPandas(run, "a long, b long"))


def _in_pieces(blocks: DataFrame, texts: DataFrame, percent: int, words: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """One search of ``blocks`` (doc_id, block, component): the links found, and the members of blocks over a piece.

    A block of up to PIECE documents and GRAMS_PER_PIECE shingles is settled; a larger one is searched in pieces dealt by
    ``salt``, each beside the block's most typical sets.
    """
    sized = blocks.join(texts.select("doc_id", "share", "n_shingles"), "doc_id")
    pieces = F.ceil(F.greatest(F.count(F.lit(1)) / PIECE, F.sum("n_shingles") / GRAMS_PER_PIECE))
    large = materialize(sized.groupBy("block").agg(pieces.alias("pieces")).filter("pieces > 1"))
    members = materialize(
        sized.join(large, "block", "left")
        .withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        .withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col("pieces"))))
    in_large = members.filter("pieces > 1")
    rank = F.struct(-F.col("share"), F.col("doc_id"))
    best = in_large.groupBy("block", "piece").agg(F.min(rank).alias("r"))
    typical = best.groupBy("block").agg(F.slice(F.array_sort(F.collect_set("r")), 1, TYPICAL).alias("r"))
    typical = typical.select("block", F.explode("r.doc_id").alias("doc_id"))
    beside = in_large.join(typical, ["block", "doc_id"]).withColumn("piece", _every_piece())
    return materialize(_search(members.unionByName(beside), texts, percent, words)), in_large


def _every_piece() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))


def _undecided(placed: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The rows of ``placed`` (doc_id, block, component) that may still have a partner in another component.

    Both ends of a link hold the overlap asked for, so a document of whose shingles too few are held by other components
    of its block has no link left.  Without it others may fall below the mark too: repeated while it pays.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))

    def pack(batches: Iterator[pd.DataFrame], n_ranges: int) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = batch["text"].tolist()
            for part in shared_keys.slices(held):
                rows = batch[part]
                sets = shingle_sets(rows["text"].tolist(), words)
                own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                mixed = np.concatenate(sets) ^ rows["mix"].to_numpy(np.int64).view(np.uint64)[own]
                yield shared_keys.pack(mixed, rows["component"].to_numpy(np.int64)[own],
                                       rows["slot"].to_numpy(np.int64).astype(np.uint32)[own], n_ranges, KEY_BYTES)

    def count(rows: pd.DataFrame, n_buckets: int) -> pd.DataFrame:
        return shared_keys.counted(shared_keys.shared_entries(rows, KEY_BYTES), n_buckets)

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        found, slots, n = shared_keys.summed(rows)
        return pd.DataFrame({"component": found, "slot": slots.astype(np.int64), "n": n})
    sized = placed.join(texts.select("doc_id", "n_shingles"), "doc_id").withColumn("slot", slot)
    while True:
        sized = materialize(sized)
        held = sized.agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("n")).first()
        if not held.rows:
            break
        n_ranges = shared_keys.ranges_for(6 * held.n, CHARS_PER_RANGE)
        n_buckets = shared_keys.ranges_for(held.rows, shared_keys.DOCS_PER_BUCKET)
        packed = (sized.select("doc_id", "component", "slot", F.xxhash64("block").alias("mix"))
                  .join(texts.select("doc_id", "text"), "doc_id").select("component", "slot", "mix", "text")
                  .mapInPandas(lambda batches: pack(batches, n_ranges), shared_keys.PACKED))
        counts = (packed.groupBy("range").applyInPandas(lambda rows: count(rows, n_buckets), shared_keys.COUNTED)
                  .groupBy("bucket").applyInPandas(total, "component long, slot long, n long"))
        kept = materialize(sized.join(counts, ["component", "slot"])
                           .filter(100 * F.col("n") >= percent * F.col("n_shingles")).select(*sized.columns))
        sized, before = kept, held.rows
        if 10 * kept.count() > 8 * before:
            break
    return sized.select(*placed.columns)


def _links(texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Links that connect all similar sets, by searches inside blocks.

    Who is searched where is settled in narrow tables; the texts themselves travel only to their searches.  After each
    search the members of large blocks that may still lack a link are put into blocks of their own, unless so few are
    outside the largest component (near copies, say) that comparing these with all of the block is no more rows.
    """
    blocks = materialize(components(_block_edges(texts, percent, words))
                         .select(F.col("node").alias("doc_id"), F.col("component").alias("block"))
                         .withColumn("component", F.lit(None).cast("long")))
    links, in_large = _in_pieces(blocks, texts, percent, words, 0)
    for salt in range(1, ROUNDS + 2):
        if in_large.isEmpty():
            return links
        found = components(links).withColumnRenamed("node", "doc_id")
        placed = materialize(in_large.drop("component").join(found, "doc_id", "left")
                             .withColumn("component", F.coalesce("component", "doc_id")))
        counts = placed.groupBy("block", "component").agg(F.count(F.lit(1)).alias("n"))
        main = counts.groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
        outside = materialize(placed.join(main, "block").filter("component <> main").drop("main"))
        rows = outside.agg(F.sum("pieces").alias("n")).first().n
        if not rows:
            return links
        if salt > ROUNDS or rows <= placed.count():
            return links.unionByName(_search(_outside_and_all(placed, outside), texts, percent, words))
        placed = _undecided(placed.select("doc_id", "block", "component"), texts, percent, words)
        if placed.isEmpty():
            return links
        left = texts.join(placed.select("doc_id", "component"), "doc_id")
        within = components(_rarest_edges(left, percent, words)).select(
            F.col("node").alias("doc_id"), F.col("component").alias("block"))
        more, in_large = _in_pieces(materialize(within.join(placed.drop("block"), "doc_id")), texts, percent, words, salt)
        links = materialize(links.unionByName(more))


def _outside_and_all(placed: DataFrame, outside: DataFrame) -> DataFrame:
    """Pieces in which every document outside its block's largest component meets every member of the block.

    One end of each link not found is outside.  What is outside is cut into chunks of a piece's size and each chunk goes
    with each piece, so that a search holds two pieces' documents however many are outside.
    """
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / PIECE, F.sum("n_shingles") / GRAMS_PER_PIECE))
    cut = materialize(outside.groupBy("block").agg(chunks.alias("chunks")))
    members = placed.join(cut, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    others = (outside.join(cut, "block").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")))
              .withColumn("piece", _every_piece()))
    return materialize(members.unionByName(others).withColumn("piece", F.col("piece") * F.col("chunks") + F.col("chunk")))


def similar_documents(docs: DataFrame, percent: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; linked documents have a Jaccard of at least ``percent``.

    ASCII letters are lower-cased and words are runs without white space.  A text of fewer words than a shingle is
    one shingle; a null or empty text has none, is linked with nothing and is its own component.  The component is
    the smallest doc_id reachable by links; rows of equal text (repeated rows too) are linked.  Rows with a null
    doc_id are counted but linked with nothing.  Other columns are ignored; an empty table gives no rows.
    """
    docs = small_batches(docs)
    held = docs.agg(F.sum(F.char_length("text")).alias("chars"), F.count(F.lit(1)).alias("rows")).first()
    survey = materialize(_survey(docs, words, shared_keys.ranges_for(held.chars or 0, CHARS_PER_RANGE),
                                 shared_keys.ranges_for(held.rows, shared_keys.DOCS_PER_BUCKET)))
    rows = survey.filter("bucket < 0").select("doc_id", "n_shingles", "signature")
    shared = _shared_counts(survey.filter("bucket >= 0").select("bucket", "docs", "places", "counts"))
    classes = (rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("signature")
               .agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"),
                    F.count(F.lit(1)).alias("n_rows")))
    classes = materialize(classes.join(shared, "doc_id", "left"))
    share = F.col("n_shared") / F.col("n_shingles")
    chosen = materialize(classes.filter(100 * F.col("n_shared") >= percent * F.col("n_shingles"))
                         .select("doc_id", share.alias("share"), "n_shingles"))
    texts = materialize(_texts(docs, chosen))
    found = components(_links(texts, percent, words)).withColumnRenamed("node", "doc_id")
    named = (classes.join(found, "doc_id", "left")
             .withColumn("component_id", F.coalesce("component", "doc_id"))
             .filter("n_rows > 1 OR component_id <> doc_id").select("signature", "component_id"))
    return (rows.join(named, "signature", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
                    .alias("component_id")))


def keep_one_per_component(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, and those without a doc_id.

    Rows that repeat a doc_id count as one document, of which one row stays.
    """
    kept = materialize(similar_documents(docs, **options).filter("doc_id = component_id")
                       .select(F.col("doc_id").alias("_kept_id")).distinct())
    found = docs.join(kept, docs["doc_id"] == kept["_kept_id"], "left_semi")
    with_id = docs.filter(docs["doc_id"].isNotNull())
    return one_of_each(found, with_id, ["doc_id"]).unionByName(docs.filter(docs["doc_id"].isNull()))
