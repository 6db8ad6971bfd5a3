"""Benchmark decontamination by an FM-index of every training shard.

Documents are read once and written as shards of about a million words, each an FM-index with the table of words it
numbers; the index knows nothing of any benchmark.  A benchmark's phrases are then searched in every shard, a bounded
block of phrases at a time, and the places found are merged to spans of words to be removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.fm_index import FmIndex
from packetloom.llm.tables import materialize, one_of_each, text_or_empty

# Words of a phrase, and so the words by which the parts of a document that is cut overlap.
WINDOW = 10

# Words of a shard; a longer document is cut.
SHARD_WORDS = 1 << 20

# Phrases of a block, on average.
BLOCK_PHRASES = 1 << 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

INDEX = ("zero long, size long, vocabulary binary, before binary, levels binary, marked binary, samples binary, "
         "starts binary, owners binary, offsets binary, rows array<long>, ids array<string>, lengths array<long>")
FOUND = "row long, spans array<struct<start: long, end: long>>, items array<string>"

# Word characters as bytes: digits, letters (folded) and every byte of a character beyond ASCII.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


class _Numbers(dict):
    """Numbers for words, from 1, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


class _Shard:
    def __init__(self):
        self.numbers, self.size = _Numbers(), 0
        self.pieces, self.owners, self.offsets = [], [], []
        self.rows, self.ids, self.lengths = [], [], []

    def add(self, row: int, offset: int, words: list[bytes]):
        self.pieces.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.owners.append(row)
        self.offsets.append(offset)
        self.size += len(words) + 1

    def close(self, row: int, ident: str | None, length: int):
        self.rows.append(row)
        self.ids.append(ident)
        self.lengths.append(length)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        index = FmIndex.build(self.pieces, len(self.numbers))
        starts = np.cumsum([0, *[len(p) + 1 for p in self.pieces]])[:-1]
        row = {"zero": 0, "size": index.size, "vocabulary": b" ".join(self.numbers), **index.pack(),
               "starts": starts.astype("<i8").tobytes(), "owners": np.array(self.owners, "<i8").tobytes(),
               "offsets": np.array(self.offsets, "<i8").tobytes(),
               "rows": self.rows, "ids": self.ids, "lengths": self.lengths}
        return pa.RecordBatch.from_pylist([row], schema=schema)


def _index_batches(batches: Iterator[pa.RecordBatch], shard_words: int, overlap: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64()) for n in ("zero", "size")] + [
        (n, pa.binary()) for n in ("vocabulary", "before", "levels", "marked", "samples", "starts", "owners", "offsets")
    ] + [("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.string())), ("lengths", pa.list_(pa.int64()))])
    row, shard = TaskContext.get().partitionId() << 40, _Shard()
    for batch in batches:
        for ident, text in zip(batch.column(0), batch.column(1)):
            words = text.as_buffer().to_pybytes().translate(_KEPT).split()
            last = max(0, len(words) - overlap)
            for start in range(0, last, shard_words - overlap) if last else [0] * bool(words):
                if shard.size >= shard_words:
                    yield shard.batch(schema)
                    shard = _Shard()
                shard.add(row, start, words[start:start + shard_words])
            shard.close(row, ident.as_py(), len(words))
            row += 1
            if shard.size >= shard_words:
                yield shard.batch(schema)
                shard = _Shard()
    if shard.rows:
        yield shard.batch(schema)


def index(docs: DataFrame, key: Column, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The shards of ``docs`` as a written table, for phrases of up to ``window`` words.

    ``key`` (a string over the input, may be null or repeat) names a row in results; rows stay apart by a number of
    their own.  A null text has no words.
    """
    texts = docs.select(key.cast("string").alias("key"), text_or_empty().alias("text"))
    return materialize(texts.mapInArrow(lambda b: _index_batches(b, shard_words, window - 1), INDEX))


def phrases(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(phrase, item): every run of ``window`` words of each item, or all words of a shorter one; item as text.

    An item without words (or with null text) has no phrase.  An item without an id still has phrases (item null).
    """
    words = F.regexp_extract_all(F.translate(text_or_empty(), UPPER, LOWER), F.lit(f"({WORD})"), 1)
    runs = F.when(F.size("words") > window, F.transform(
        F.sequence(F.lit(1), F.size("words") - window + 1), lambda i: F.slice("words", i, window))
    ).otherwise(F.array("words"))
    return (benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words"))
            .filter(F.size("words") > 0)
            .select("item", F.explode(F.transform(runs, lambda r: F.array_join(r, " "))).alias("phrase")).distinct())


def _blocks(asked: DataFrame, block_phrases: int) -> tuple[DataFrame, int]:
    asked = materialize(asked)
    n_blocks = max(1, -(-asked.count() // block_phrases))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("phrase", "item"), F.lit(n_blocks)))
    return materialize(dealt.groupBy("block").agg(
        F.collect_list("phrase").alias("phrases"),
        F.collect_list(F.coalesce("item", F.lit(""))).alias("items"),
        F.collect_list(F.col("item").isNotNull()).alias("named"))), n_blocks


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for shard in batch.itertuples(index=False):
            found = _search_shard(shard)
            if found is not None:
                yield found


def _search_shard(shard) -> pd.DataFrame | None:
    numbers = {w: i for i, w in enumerate(shard.vocabulary.split(b" "), 1)} if shard.vocabulary else {}
    listed = pd.DataFrame({"phrase": shard.phrases, "item": np.where(shard.named, shard.items, None)})
    distinct, which = np.unique(listed["phrase"].to_numpy(str), return_inverse=True)
    split = [p.encode().split(b" ") for p in distinct]
    lengths = np.array([len(w) for w in split], np.int64)
    table = np.zeros((len(split), int(lengths.max(initial=0))), np.int64)
    for i, words in enumerate(split):
        table[i, :len(words)] = [numbers.get(w, 0) for w in words]
    fm = FmIndex.unpack(shard.size, shard.before, shard.levels, shard.marked, shard.samples)
    possible = np.flatnonzero((table != 0).sum(axis=1) == lengths)
    low, high = fm.find(table[possible], lengths[possible])
    starts, owners, offsets = [np.frombuffer(x, "<i8") for x in (shard.starts, shard.owners, shard.offsets)]
    spans, hits = [], []
    for phrase, place in fm.occurrences(low, high):
        piece = np.searchsorted(starts, place, "right") - 1
        begin = place - starts[piece] + offsets[piece]
        phrase = possible[phrase]
        spans.append(merged(owners[piece], begin, begin + lengths[phrase]))
        hits.append(np.unique(np.stack([owners[piece], phrase]), axis=1))
    if not spans:
        return None
    owner, begin, end = merged(*[np.concatenate(x) for x in zip(*spans)])
    rows, phrase = np.unique(np.concatenate(hits, axis=1), axis=1)
    by_phrase = listed.groupby(which)["item"].agg(lambda s: [x for x in s if x is not None])
    items = pd.DataFrame({"row": rows, "phrase": phrase}).join(by_phrase, on="phrase").groupby("row")["item"].agg(
        lambda lists: sorted({x for own in lists for x in own}))
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    pairs = [{"start": int(b), "end": int(e)} for b, e in zip(begin, end)]
    cuts = np.r_[heads, len(owner)]
    return pd.DataFrame({"row": owner[heads], "spans": [pairs[a:b] for a, b in zip(cuts[:-1], cuts[1:])],
                         "items": [items[r] for r in owner[heads]]})


def merged(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each owner with those that overlap or touch made one, in order."""
    order = np.lexsort([begin, owner])
    owner, begin, end = owner[order], begin[order], end[order]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    level = np.cumsum(np.r_[True, owner[1:] != owner[:-1]]) * (int(end.max(initial=0)) + 1)
    reach = np.maximum.accumulate(end + level)
    first = np.r_[True, (begin + level)[1:] > reach[:-1]]
    first[starts] = True
    heads = np.flatnonzero(first)
    return owner[heads], begin[heads], np.maximum.reduceat(end, heads)


def contamination(shards: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """One row per indexed document: key, n_words, n_hit, spans, items.

    ``spans`` are the runs of words (from 0, end exclusive) that any occurrence of a phrase of ``benchmark`` covers,
    ``n_hit`` their words, ``items`` the items of which a phrase occurs, sorted as text, each once; phrases of items
    without an id count for spans only.  An empty benchmark or table gives no hits or no rows.
    """
    blocks, n_blocks = _blocks(phrases(benchmark, window), block_phrases)
    needed = [c for c in shards.columns if c not in ("rows", "ids", "lengths")]
    found = None
    for b in range(n_blocks):  # a bounded list of phrases against all shards
        block = blocks.filter(F.col("block") == b).select((F.col("block") - b).alias("zero"), "phrases", "items", "named")
        part = shards.select(needed).join(F.broadcast(block), "zero").mapInPandas(_search, FOUND)
        found = part if found is None else found.unionByName(part)
    found = materialize(found)
    by_row = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    runs = (found.select("row", F.inline("spans"))
            .withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
            .withColumn("run", F.sum("new").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"),
                                F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))
    items = (found.select("row", F.explode("items").alias("item")).groupBy("row")
             .agg(F.sort_array(F.collect_set("item")).alias("items")))
    listed = shards.select(F.explode(F.arrays_zip("rows", "ids", "lengths")).alias("doc")).select(
        F.col("doc.rows").alias("row"), F.col("doc.ids").alias("key"), F.col("doc.lengths").alias("n_words"))
    return (listed.join(runs, "row", "left").join(items, "row", "left")
            .select("key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")).alias("spans"),
                    F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with every covered word, and what stands between covered words of one span, cut from the text.

    Rows are known by the digest of their text, so ids may be null or repeat; other columns stay as they are.
    """
    spans = contamination(index(docs, F.sha2(text_or_empty(), 256)), benchmark).filter("n_hit > 0").select(
        F.col("key").alias("_sha"), F.col("spans").alias("_cut"))
    spans = one_of_each(spans, spans, ["_sha"])
    marked = docs.withColumn("_sha", F.sha2(text_or_empty(), 256)).join(spans, "_sha", "left")
    return marked.withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(
        F.pandas_udf(cut_words, "string")("text", "_cut"))).select(*docs.columns)


def cut_words(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the words of their spans; null stays null."""
    def cut(text, runs):
        if text is None or runs is None:
            return text
        raw, out, at = text.encode(), [], 0
        places = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
        for run in runs:
            out.append(raw[at:places[run["start"]][0]])
            at = places[run["end"] - 1][1]
        return b"".join([*out, raw[at:]]).decode()
    return pd.Series([cut(t, s) for t, s in zip(texts, spans)])
