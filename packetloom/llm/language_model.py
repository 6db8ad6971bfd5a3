"""Scoring by cross-entropy difference between a target and a background language model.

Both are bigram models over every word of the corpus, with one order, one smoothing and counts brought to one scale;
they differ only in the documents counted.  A document's score is the mean over its tokens of target loss minus
background loss: the lower, the more it is like the target.

No task holds a model.  Documents are held in batches; a batch asks for the counts of its own words and pairs, which
are combined inside it first, so a common pair is one entry of each batch.  Requests are dealt by hash, summed, and
answered in the order they were asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.tables import with_membership
from packetloom.operators.ordered import materialize

# A batch is closed at so many tokens or documents; a longer text is a batch of its own.
BATCH_TOKENS = 1 << 20
BATCH_DOCUMENTS = 1 << 16
# Requests are dealt into this many buckets at least, and so many more that each has about so many entries.
BUCKET_BITS = 9
BUCKET_ENTRIES = 1 << 20
PAIR_SHARE = 0.7
ADDED = 0.1
WORDS, PAIRS = 0, 1
START = np.uint64(xxhash.xxh3_64_intdigest(b" "))  # no word has white space

BATCH = ("batch long, ids array<string>, lengths binary, target binary, tokens binary, words binary, n_tokens long, "
         "n_target long")
REQUEST = "bucket long, batch long, hashes binary, target binary, every binary"
ANSWER = "batch long, kind int, bucket long, target binary, every binary, entries long"
SCORE = "doc_id string, n_tokens long, target_loss double, background_loss double, difference double"


class _Ids(dict):
    def __missing__(self, word):
        value = self[word] = len(self)
        return value


def _packed(values: np.ndarray) -> bytes:
    """Integers in as few bytes as the largest needs, bytes of one weight together, where most are alike."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :raw[0]] = planes.T
    return out.reshape(-1).view("<u8")


def _batches(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents in batches, as a written table: token numbers and the hashes of the batch's words by number."""
    rows = with_membership(docs.select("doc_id", "text"), "doc_id",
                           labels.filter("quality = 1").select("doc_id"), "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.string())), *[(n, pa.binary()) for n in (
            "lengths", "target", "tokens", "words")], ("n_tokens", pa.int64()), ("n_target", pa.int64())])

        def closed() -> pa.RecordBatch:
            lengths, flags = np.array([len(t) for t in tokens], np.int64), np.array(targets, np.int64)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            row = {"batch": number, "ids": ids, "lengths": _packed(lengths), "target": _packed(flags),
                   "tokens": _packed(np.concatenate(tokens)), "words": hashes.tobytes(),
                   "n_tokens": int(lengths.sum()), "n_target": int(lengths[flags > 0].sum())}
            return pa.RecordBatch.from_pylist([row], schema)
        ids, targets, tokens, words, held = [], [], [], _Ids(), 0
        for batch in batches:
            for doc_id, text, target in zip(*[c.to_pylist() for c in batch.columns]):
                found = (text or "").lower().encode().split()  # bytes are cut at ASCII white space only
                if ids and (held + len(found) > BATCH_TOKENS or len(ids) >= BATCH_DOCUMENTS):
                    yield closed()
                    ids, targets, tokens, words, held, number = [], [], [], _Ids(), 0, number + 1
                ids.append(doc_id)
                targets.append(bool(target))
                tokens.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                held += len(found)
        if ids:
            yield closed()
    return materialize(rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "target")
                       .mapInArrow(run, BATCH))


def _entries(row: dict, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a batch's words or pairs in rising order, and the place of each token's among them."""
    words, tokens = np.frombuffer(row["words"], np.uint64), _unpacked(row["tokens"]).astype(np.int64)
    if kind == WORDS:
        hashes, place = np.unique(words, return_inverse=True)
        return hashes, place[tokens]
    mixed = _before(row, words[tokens], START) * np.uint64(0x9E3779B97F4A7C15) + words[tokens]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(mixed ^ (mixed >> np.uint64(31)), return_inverse=True)


def _before(row: dict, values: np.ndarray, start) -> np.ndarray:
    """For each token the value of the token before it in its text, or ``start``."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    lengths = _unpacked(row["lengths"]).astype(np.int64)
    firsts = (np.cumsum(lengths) - lengths)[lengths > 0]
    out[firsts] = start
    return out


def _answers(table: DataFrame, kind: int, bits: int) -> DataFrame:
    """For each batch and bucket the counts over target and all documents of what the batch asked, in its order.

    ``entries`` is how many different ones all batches together asked of the bucket.
    """
    shift = np.uint64(64 - bits)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, place = _entries(row, kind)
                every = np.bincount(place, minlength=len(hashes))
                flags = np.repeat(_unpacked(row["target"]), _unpacked(row["lengths"]).astype(np.int64)) > 0
                target = np.bincount(place[flags], minlength=len(hashes))
                buckets, starts = np.unique(hashes >> shift, return_index=True)
                ends = [*starts[1:], len(hashes)]
                out = [(int(k), row["batch"], _packed(np.diff(hashes[i:j], prepend=k << shift)), _packed(target[i:j]),
                        _packed(every[i:j])) for k, i, j in zip(buckets, starts, ends)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 2 + [pa.binary()] * 3)],
                        names=["bucket", "batch", "hashes", "target", "every"])

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        start = np.uint64(part["bucket"].iloc[0]) << shift
        asked = [np.cumsum(_unpacked(h)) + start for h in part["hashes"]]
        hashes, place = np.unique(np.concatenate(asked), return_inverse=True)
        ends = np.cumsum([len(a) for a in asked])
        out = part[["batch", "bucket"]].assign(kind=kind, entries=len(hashes))
        for name in ("target", "every"):
            total = np.zeros(len(hashes), np.int64)
            np.add.at(total, place, np.concatenate([_unpacked(n) for n in part[name]]).astype(np.int64))
            out[name] = [_packed(total[p]) for p in np.split(place, ends[:-1])]
        return out[[f.split()[0] for f in ANSWER.split(", ")]]
    return (table.select("batch", "lengths", "target", "tokens", "words").mapInArrow(ask, REQUEST)
            .groupBy("bucket").applyInPandas(answer, ANSWER))


def _losses(row: dict, words: np.ndarray, pairs: np.ndarray, total: float, size: int) -> np.ndarray:
    """Loss of each token in nats: pair and single estimates interpolated, singles with added counts."""
    alone = (words + ADDED) / (total + ADDED * size)
    context = _before(row, words, total)  # a text can begin anywhere
    after = np.minimum(pairs / np.maximum(context, 1e-6), 1.0)
    return -np.log(PAIR_SHARE * after + (1 - PAIR_SHARE) * alone)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means per token, nats) and difference of every row.

    Target documents are those labelled quality 1, the background is all of ``docs``.  A null or empty text has no
    tokens and zero losses.  Without target documents the target model is the smoothing alone.  Repeated rows are
    counted and scored each; null labels are passed over, other columns ignored; an empty table gives no rows.
    """
    table = _batches(docs, labels)
    sums = table.agg(F.sum("n_tokens").alias("every"), F.sum("n_target").alias("target")).first()
    # A batch asks for at most one pair a token.
    bits = max(BUCKET_BITS, ((sums.every or 0) // BUCKET_ENTRIES).bit_length())
    words = materialize(_answers(table, WORDS, bits))
    size = 2 + (words.groupBy("bucket").agg(F.max("entries").alias("n")).agg(F.sum("n")).first()[0] or 0)
    total = float(max(sums.target or 0, 1))
    scale = {"target": 1.0, "every": total / max(sums.every or 0, 1)}

    def run(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("bucket")
        row = batch.iloc[0].to_dict()
        lengths = _unpacked(row["lengths"]).astype(np.int64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        means = {}
        places = [_entries(row, kind)[1] for kind in (WORDS, PAIRS)] if len(doc) else []
        for model, factor in scale.items():
            counts = [np.concatenate([_unpacked(n) for n in answers.loc[answers["kind"] == kind, model]])[place] * factor
                      for kind, place in enumerate(places)]
            lost = _losses(row, *counts, total, size) if counts else np.zeros(0)
            means[model] = np.bincount(doc, lost, len(lengths)) / np.maximum(lengths, 1)
        return pd.DataFrame({"doc_id": list(row["ids"]), "n_tokens": lengths, "target_loss": means["target"],
                             "background_loss": means["every"], "difference": means["target"] - means["every"]})
    answers = words.unionByName(_answers(table, PAIRS, bits)).drop("entries")
    return (table.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(run, SCORE)
            .withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)))
