"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are of two kinds, each hashed to a fixed number of columns: the words themselves (their letters and digits in
lower case), and their layout (shapes of words by case, digits and symbols, pairs of neighbouring shapes, repeats of
the word before).  Document frequencies come from all documents.  A bounded, balanced sample of labelled rows gives a
latent space of each kind (truncated SVD) and the voters; a vector is both latent vectors side by side, words
WORD_LENGTH as long as layout, so likeness is a weighted mean of two cosines.  Voters are broadcast, every document is compared with every voter by
blocked exact products, and its nearest voters vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.tables import small_batches

SHAPES = 1024
WORDS = 2048
COLUMNS = SHAPES + WORDS
FACTORS = 48  # of each kind
WORD_LENGTH = 0.5
NEIGHBOURS = 15
# Bound on labelled rows of each class that the model is fitted on: 6 bytes a term, at most 18 KB a row, go to the driver, 400 bytes a row back.
SAMPLE_PER_CLASS = 1500
KINDS = (slice(0, SHAPES), slice(SHAPES, COLUMNS))
LENGTHS = (np.float32(1), np.float32(WORD_LENGTH))
ACCEPTED = 0.3
FOLDS = 5
BLOCK = 512
REMEMBERED = 300_000
LONGEST_REMEMBERED = 64


def _shape(word: str) -> str:
    """Case, digit and symbol runs of a word; runs of letters and digits count once, of symbols up to three times."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return "".join(k if k in "Aa0" else k * min(3, len(list(run))) for k, run in groupby(kinds))


class _WordHash(dict):
    """Hash of a word's shape (low 32 bits) and of its letters and digits (high 32 bits)."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        plain = "".join(filter(str.isalnum, word)).lower()
        value = xxhash.xxh32_intdigest(_shape(word)) | xxhash.xxh32_intdigest(plain) << 32
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = value
        return value


_hash_of = _WordHash()


def term_counts(text: str | None) -> np.ndarray:
    """Damped term counts of one text over SHAPES columns of layout, then WORDS of words; zeros if it has no words."""
    words = (text or "").split()
    if not words:
        return np.zeros(COLUMNS, np.float32)
    hashes = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    shapes, plain = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    names = np.fromiter(map(hash, words), np.int64, len(words))  # compared within one text only
    repeats = int((names[1:] == names[:-1]).sum())
    pairs = (shapes[:-1] * np.uint64(31) + shapes[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    layout = np.concatenate([shapes, pairs]) % np.uint64(SHAPES - 1)
    columns = np.concatenate([layout, plain % np.uint64(WORDS) + np.uint64(SHAPES)])
    counts = np.bincount(columns.astype(np.int64), minlength=COLUMNS).astype(np.float32)
    counts[SHAPES - 1] = 2 * repeats
    return np.sqrt(counts / len(words))


def packed(counts: np.ndarray) -> bytes:
    """The counts that are not zero, then their columns: 6 bytes each."""
    held = np.flatnonzero(counts)
    return counts[held].astype("<f4").tobytes() + held.astype("<u2").tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    terms = np.zeros((len(rows), COLUMNS), np.float32)
    for counts, raw in zip(terms, rows):
        n = len(raw) // 6
        counts[np.frombuffer(raw, "<u2", n, 4 * n)] = np.frombuffer(raw, "<f4", n)
    return terms


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, over all of them; COLUMNS + 1 sums reach the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, total = np.zeros(COLUMNS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                seen += term_counts(text) > 0
            total += len(batch)
        yield pd.DataFrame({"term": np.arange(COLUMNS + 1), "n": np.append(seen, total)})
    rows = (docs.select("text").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
            .collect())
    sums = np.zeros(COLUMNS + 1, np.int64)
    for row in rows:
        sums[row.term] = row.n
    return sums[:-1], int(sums[-1])


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def _training_terms(docs: DataFrame, labels: DataFrame) -> list:
    """Terms and label of up to SAMPLE_PER_CLASS labelled rows of each class, by md5 order of doc_id."""
    usable = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(fold(F.col("doc_id")) != 0)
    order = F.md5(F.col("doc_id").cast("string"))
    picked = None
    for label in (0, 1):
        some = (usable.filter(F.col("quality") == label).select("doc_id", "quality").distinct()
                .orderBy(order, "doc_id").limit(SAMPLE_PER_CLASS))
        picked = some if picked is None else picked.unionByName(some)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"terms": [packed(term_counts(t)) for t in batch["text"]], "label": batch["label"],
                                "place": batch["place"]})
    # The list is at most 2 * SAMPLE_PER_CLASS rows.
    listed = F.broadcast(picked.select("doc_id", F.col("quality").alias("label"), order.alias("place")))
    texts = docs.select("doc_id", "text").join(listed, "doc_id").select("text", "label", "place")
    rows = texts.mapInPandas(run, "terms binary, label int, place string")
    bounded = rows.orderBy("place", "label", "terms").limit(4 * SAMPLE_PER_CLASS).collect()
    return sorted(bounded, key=lambda r: (r.place, r.label, r.terms))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: term weights, latent axes, voters' unit vectors and labels, and the labels' mean as fallback."""
    seen, total = _document_frequencies(docs)
    weights = np.log((1 + total) / (1 + seen)).astype(np.float32) + np.float32(1)
    rows = _training_terms(docs, labels)
    if not rows:
        return {"weights": weights, "axes": [], "mean": 0.5, "voters": np.zeros((0, 1), np.float32),
                "labels": np.zeros(0, np.float32)}
    labels_ = np.array([r.label for r in rows], np.float32)
    terms = unpacked([r.terms for r in rows])
    del rows  # the driver holds the sample once while the axes are found
    model = {"weights": weights, "labels": labels_, "mean": float(labels_.mean()),
             "axes": [_axes(_products(terms[:, kind] * weights[kind])) for kind in KINDS]}
    return model | {"voters": latent(terms, model)}


def _products(terms: np.ndarray) -> np.ndarray:
    """Inner products of the columns of the rows' unit vectors."""
    units = _unit(terms)
    return (units.T @ units).astype(np.float64)


def _axes(products: np.ndarray) -> np.ndarray:
    """The FACTORS strongest right singular vectors of terms with these products of columns."""
    values, vectors = np.linalg.eigh(products)
    return vectors[:, np.argsort(-values)[:FACTORS]].astype(np.float32)


def latent(terms: np.ndarray, model: dict) -> np.ndarray:
    """Unit vectors of a block of documents: their latent layout and their latent words side by side."""
    weighted = terms * model["weights"]
    parts = zip(KINDS, model["axes"], LENGTHS)
    return _unit(np.hstack([_unit(weighted[:, kind] @ axes) * length for kind, axes, length in parts]))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def votes(terms: np.ndarray, model: dict) -> np.ndarray:
    """Scores of a block of documents: similarity-weighted mean label of the nearest voters."""
    if not len(model["labels"]):
        return np.full(len(terms), model["mean"])
    cosine = latent(terms, model) @ model["voters"].T
    k = min(NEIGHBOURS, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    pull = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64)
    score = (pull * model["labels"][near]).sum(1) / np.maximum(pull.sum(1), 1e-12)
    return np.where(pull.sum(1) > 1e-9, np.clip(score, 0, 1), model["mean"])


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The ``keep`` columns of each row with held_out, score (0 to 1, higher: better) and predicted (0 or 1).

    ``prefix`` goes before the new names.

    Rows whose crc32 of doc_id is a multiple of FOLDS are never learned from.  Only the text is scored: a null text
    is empty, and texts without words get the mean label of the voters; so do all texts if no label can be used
    (0.5 then).  Null or other labels are passed over, a document labelled twice counts twice.  Repeated rows get
    equal scores, other columns are ignored, an empty table gives no rows.
    """
    docs = small_batches(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    kept = docs.select(*keep)
    names = [f"_{i}" for i in range(len(keep))]
    fields = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept.schema.fields)]

    # A text that is kept travels once.
    text = keep.index("text") if "text" in keep else len(keep)
    sent = [docs[c].alias(n) for c, n in zip(keep, names)] + [docs["text"].alias("_text")] * ("text" not in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                found = votes(np.stack([term_counts(t) for t in part.column(text).to_pylist()]), model.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], pa.array(found, pa.float64())],
                                                 names=[*names, "score"])
    rows = docs.select(*sent).mapInArrow(run, ", ".join([*fields, "score double"]))
    doc_id = F.col(names[keep.index("doc_id")])
    return rows.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], (fold(doc_id) == 0).alias(f"{prefix}held_out"),
                       F.col("score").alias(f"{prefix}score"),
                       (F.col("score") >= ACCEPTED).cast("int").alias(f"{prefix}predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    judged = score(docs, labels, keep=("doc_id", *[c for c in docs.columns if c != "doc_id"]), prefix="_judged_")
    return judged.filter("_judged_predicted = 1").select(*docs.columns)
