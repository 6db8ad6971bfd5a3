"""Byte-level BPE: text to token ids and back.

A piece of text starts as single bytes.  A segment tree over the byte positions holds, for each live part, the rank
of its pair with the next live part; its root is the smallest rank and the leftmost position of it is found going
down.  A merge updates three leaves, so a piece of n bytes takes O(n log n) whatever it holds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from packetloom.llm.tables import small_batches

NO_PAIR = 1 << 60

# Pieces whose ids a worker remembers; at the bound it starts anew.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64

# Bytes of text that a worker turns into one Arrow batch.
BATCH_BYTES = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the leftmost pair of the smallest rank until no pair has one."""
    n = len(piece)
    width = 1
    while width < n:
        width *= 2
    start_of_next = list(range(1, n + 1))  # of a live part: where the next one starts
    start_before = list(range(-1, n))
    tree = [NO_PAIR] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = ranks.get(piece[i:i + 2], NO_PAIR)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, rank: int) -> None:
        node = width + i
        tree[node] = rank
        while node > 1:
            node //= 2
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    def pair_rank(i: int) -> int:
        middle = start_of_next[i]
        return NO_PAIR if middle >= n else ranks.get(piece[i:start_of_next[middle]], NO_PAIR)

    while tree[1] != NO_PAIR:
        node = 1
        while node < width:
            node *= 2
            if tree[node] != tree[node // 2]:
                node += 1
        left = node - width
        gone = start_of_next[left]
        after = start_of_next[gone]
        start_of_next[left] = after
        if after < n:
            start_before[after] = left
        put(gone, NO_PAIR)
        put(left, pair_rank(left))
        if start_before[left] >= 0:
            put(start_before[left], pair_rank(start_before[left]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:start_of_next[i]]])
        i = start_of_next[i]
    return ids


class Coder:
    """Ranks and the pattern that cuts text into pieces, with a bounded memory of pieces already merged."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(
            r"\S", r"\P{White_Space}"))
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        ids = np.array(merge(raw, self.ranks) if whole is None else [whole], dtype="<u4").tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, piece = self.known, self._piece
        return b"".join([known.get(p) or piece(p) for p in self.pieces.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_CODERS: dict[tuple, Coder] = {}


def _coder(shared, pattern: str) -> Coder:
    """One coder per worker process and vocabulary."""
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(shared.value, pattern)
    return _CODERS[key]


def _with_text(docs: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, int]:
    """The ``keep`` columns with the text, which travels once, and the place of the text among them."""
    docs = small_batches(docs)
    if "text" in keep:
        return docs.select(*keep), list(keep).index("text")
    return docs.select(*keep, docs["text"].alias("_text")), len(keep)


def _slices(batch: pa.RecordBatch, column: str | int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about BATCH_BYTES, so that what is made of them stays small."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        floor = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, floor + BATCH_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row with n_tokens and ids (binary, little-endian unsigned 32-bit).

    A null text is empty and has no tokens.  Rows are independent: repeated rows give repeated results, an empty
    table gives none.  The vocabulary (under 1 MB, fixed) is read once and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    sent, text = _with_text(docs, keep)
    n_kept = len(keep)
    schema = T.StructType([*sent.schema.fields[:n_kept], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, pattern)
        for whole in batches:
            for batch in _slices(whole, text):
                ids = [coder.encode(t or "") for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n_kept], pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary())], names=schema.names)

    return sent.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` with the column decoded (binary): the bytes its ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, pattern)
        for whole in batches:
            for batch in _slices(whole, "ids"):
                raw = [coder.decode(x or b"") for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=schema.names)

    return small_batches(encoded).mapInArrow(run, schema)


def round_trips(docs: DataFrame, ranks_path: str, pattern: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row with n_tokens, ids_sha256 (of ids as in ``encode``) and round_trip (boolean).

    round_trip says whether the ids, decoded, are the bytes of the text.  A worker encodes a text, decodes its ids
    and lets both go, so a task has one worker with one vocabulary and neither ids nor decoded bytes are written.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    sent, text = _with_text(docs, keep)
    n_kept = len(keep)
    schema = T.StructType([*sent.schema.fields[:n_kept], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, pattern)
        for whole in batches:
            for batch in _slices(whole, text):
                found = []
                for value in batch.column(text):
                    one = value.as_py() or ""
                    ids = coder.encode(one)
                    found.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), coder.decode(ids) == one.encode()))
                columns = zip(zip(*found), (pa.int64(), pa.string(), pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n_kept], *[pa.array(values, kind) for values, kind in columns]],
                    names=schema.names)

    return sent.mapInArrow(run, schema)
