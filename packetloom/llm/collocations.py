"""Phrase collocations from count streams kept in prefix and in suffix order.

Every word of a text starts one window of up to four words.  Sorted by their words, windows are a stream in which
everything that begins alike stands together, so one pass over the stream counts phrases of all lengths.  The frequent
phrases are then read as two streams: in prefix order a phrase comes right after what it begins with, in suffix order
(words reversed) right after what it ends with.  A running last value along either stream gives the counts of all left
and right parts, and the two streams are merged by phrase.  No task holds more than some batches of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.tables import materialize
from packetloom.operators.ordered import first_n, running

# Words of the longest phrase.
LONGEST = 4

# A phrase with fewer occurrences is no candidate.
LEAST = 30

# A candidate that a longer one covers for this share (percent) of its occurrences is dropped.
COVERED = 80

SCALE = 2_000_000

# Words that a worker turns into windows at a time.
BATCH_WORDS = 1 << 20

WINDOWS = "lang string, window string, n long"
COUNTED = "lang string, phrase string, words int, n long, edge boolean"

# A byte that no UTF-8 text has stands for the end of a piece.
GAP = b"\xff"

# Bytes that end a piece become gaps, tabs become spaces, letters are folded.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else GAP[0] if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b
              for b in range(256))


class _Numbers(dict):
    """Numbers for words in the order in which they are first asked for; the gap is number 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _windows_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of some texts, their distinct windows (rows of word numbers, 0 past the end) in order, and counts."""
    numbers, streams = _Numbers({GAP: 0}), []
    for text in texts:
        words = text.translate(_FOLD).replace(GAP, b" \xff ").split()
        streams.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        streams.append(np.zeros(LONGEST, np.int64))
    del numbers[GAP]
    listed = sorted(numbers)
    place = np.zeros(len(listed) + 1, np.int64)
    place[[numbers[w] for w in listed]] = np.arange(1, len(listed) + 1)
    stream = place[np.concatenate(streams)] if streams else np.zeros(0, np.int64)
    starts, width = np.flatnonzero(stream), np.int64(len(listed) + 1)
    parts = [stream[starts]]
    for k in range(1, LONGEST):
        parts.append(np.where(parts[-1] > 0, stream[starts + k], 0))
    heads, first = np.unique(parts[0] * width + parts[1], return_inverse=True)
    tails, second = np.unique(parts[2] * width + parts[3], return_inverse=True)
    pairs, counts = np.unique(first * np.int64(len(tails)) + second, return_counts=True)
    head, tail = (heads[pairs // len(tails)], tails[pairs % len(tails)]) if len(tails) else (heads, tails)
    return listed, np.stack([head // width, head % width, tail // width, tail % width], axis=1), counts


def _window_batches(batches: Iterator[pa.RecordBatch], batch_words: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_buffer().to_pybytes()
            held.setdefault(lang, []).append(raw)
            sizes[lang] = sizes.get(lang, 0) + len(raw)
            # A word and the space behind it are taken as six bytes here; the bound is one of memory alone.
            if sum(sizes.values()) >= 6 * batch_words:
                most = max(sizes, key=sizes.get)
                del sizes[most]
                yield from _rows(most, held.pop(most))
    for lang, texts in held.items():
        yield from _rows(lang, texts)


def _rows(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A window is its words with a space behind each, so what begins alike stands together in byte order."""
    listed, windows, counts = _windows_of(texts)
    spaced = pa.array([b"", *[w + b" " for w in listed]], pa.binary())
    for start in range(0, len(windows), 1 << 17):
        part = windows[start:start + (1 << 17)]
        joined = pc.binary_join_element_wise(*[spaced.take(pa.array(c)) for c in part.T], b"")
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang]).take(pa.array(np.zeros(len(part), np.int8))), joined.cast(pa.string()),
             pa.array(counts[start:start + (1 << 17)])], names=["lang", "window", "n"])


def window_counts(docs: DataFrame, batch_words: int = BATCH_WORDS) -> DataFrame:
    """(lang, window, n): windows of all texts, counted per batch of a task; one window may have several rows."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(lambda b: _window_batches(b, batch_words), WINDOWS)


def _counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Phrases of all lengths from consecutive windows.

    What lies wholly inside a batch is complete and kept if it is frequent; what touches the first or last row may go
    on in a neighbouring batch, so its part is passed on, marked, as are the words of each language.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, window, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        split = pc.split_pattern(window, " ")  # the last part of each is empty
        offsets = split.offsets.to_numpy()
        sizes = np.diff(offsets) - 1
        new = np.r_[True, pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)]
        parts = []
        for length in range(LONGEST + 1):
            if length:
                there = sizes >= length
                words = split.values.take(pa.array(np.where(there, offsets[:-1] + length - 1, 0), mask=~there))
                same = pc.fill_null(pc.equal(words[1:], words[:-1]), False).to_numpy(zero_copy_only=False)
                new = new | np.r_[True, ~same]
            heads = np.flatnonzero(new)
            total = np.add.reduceat(n, heads)
            edge = np.zeros(len(heads), bool)
            edge[[0, -1]] = True
            edge |= length == 0
            own = sizes[heads] >= length
            kept = np.flatnonzero(own & (edge | (total >= least)))
            at = heads[kept]
            texts = [" ".join(w.split(" ")[:length]) for w in window.take(pa.array(at)).to_pylist()]
            parts.append(pa.RecordBatch.from_arrays(
                [lang.take(pa.array(at)), pa.array(texts, pa.string()),
                 pa.array(np.full(len(kept), length, np.int32)), pa.array(total[kept]), pa.array(edge[kept])],
                names=["lang", "phrase", "words", "n", "edge"]))
        yield from parts


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of up to LONGEST words that occur ``least`` times, as a written table.

    The row of no words has the number of all words of a language.  Overlapping occurrences count, none crosses a
    piece.  Null text is empty, null lang is ``und``.
    """
    stream = window_counts(docs).repartitionByRange("lang", "window").sortWithinPartitions("lang", "window")
    counted = materialize(stream.mapInArrow(lambda b: _counted(b, least), COUNTED))
    cut = (counted.filter("edge").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
           .filter((F.col("n") >= least) | (F.col("words") == 0)))
    return materialize(counted.filter("NOT edge").drop("edge").unionByName(cut))


def _stream(counts: DataFrame, key: Column, name: str) -> DataFrame:
    """``counts`` with ``name``_1.. : counts of what a phrase begins with in the order of ``key``, by number of words.

    Along the order a phrase stands behind all it begins with, and nothing of the same length comes between, so the
    last count of each length is the one wanted.
    """
    ranged = materialize(counts.withColumn("key", key).repartitionByRange("lang", "key")
                         .withColumn("range", F.spark_partition_id()))
    parts = {f"{name}_{k}": ("last", F.when(F.col("words") == k, F.col("n")), True) for k in range(1, LONGEST)}
    return running(ranged, ["lang"], "range", ["key"], parts).drop("key", "range")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (phrases of two words or more) with a, l, r, score, and the shares that cover their parts.

    Of the cuts into two parts the lowest score counts, then the fewest words on the left.  Products are taken in
    decimals, since they may pass 64 bits.
    """
    phrases = counts.filter("words > 0")
    left = _stream(phrases, F.concat("phrase", F.lit(" ")), "l")
    reverse = F.concat(F.array_join(F.reverse(F.split("phrase", " ")), " "), F.lit(" "))
    right = _stream(phrases, reverse, "r").select("lang", "phrase", *[f"r_{k}" for k in range(1, LONGEST)])
    both = left.filter("words > 1").join(right.hint("merge"), ["lang", "phrase"])
    rest = F.array(*[f"r_{k}" for k in range(1, LONGEST)])

    for k in range(1, LONGEST):
        both = both.withColumn("part", F.get(rest, F.col("words") - F.lit(k + 1))).withColumn(f"cut_{k}", F.when(F.col("words") > k, F.struct(
            F.expr(f"cast({SCALE} as decimal(7, 0)) * cast(n as decimal(19, 0))"
                   f" div (cast(l_{k} as decimal(19, 0)) + cast(part as decimal(19, 0)))").alias("score"),
            F.lit(k).alias("k"), F.col(f"l_{k}").alias("l"), F.col("part").alias("r"))))
    best = F.least(*[f"cut_{k}" for k in range(1, LONGEST)])
    shorter = [F.get(F.array(*[f"{side}_{k}" for k in range(1, LONGEST)]), F.col("words") - 2) for side in "lr"]
    return (both.withColumn("best", best)
            .select("lang", "phrase", "words", F.col("n").alias("a"), "best.l", "best.r", "best.score",
                    shorter[0].alias("n_start"), shorter[1].alias("n_end")))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int | None = None) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of the candidates that no longer one covers.

    A phrase inside a longer candidate lies in one that has a single word more and occurs as often or more, so only
    those are looked at: a candidate covers what is left without its last word, and without its first.  With ``top``,
    the first of each language by score, a (both descending) and phrase (byte order), with their rank.  A table
    without words gives no rows; columns other than lang and text are ignored.
    """
    counts = phrase_counts(docs, least)
    found = materialize(scored(counts))
    words = F.split("phrase", " ")

    def covers(part: str) -> Column:
        return F.expr(f"100 * cast(a as decimal(19, 0)) >= {covered} * cast({part} as decimal(19, 0))")
    longer = found.filter("words > 2")
    gone = longer.filter(covers("n_start")).select(
        "lang", F.array_join(F.slice(words, 1, F.size(words) - 1), " ").alias("phrase"))
    gone = gone.unionByName(longer.filter(covers("n_end")).select(
        "lang", F.array_join(F.slice(words, 2, F.size(words) - 1), " ").alias("phrase")))
    sizes = counts.filter("words = 0").select("lang", F.col("n").alias("n"))
    kept = found.join(gone.hint("merge"), ["lang", "phrase"], "left_anti").drop("n_start", "n_end").join(sizes, "lang")
    if top is None:
        return kept
    order = [-F.col("score"), -F.col("a"), F.col("phrase")]
    best = first_n(materialize(kept), ["lang"], order, top, few_groups=True)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
