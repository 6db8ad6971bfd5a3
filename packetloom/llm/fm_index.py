"""An FM-index over word numbers, for one shard of documents.

``suffix_order`` sorts suffixes by doubling the words it compares.  The last column of the sorted rotations is kept as a
wavelet tree whose levels each put all zero branches before all one branches; counting a phrase is one rank a level and
word, backwards.  Places are read off by stepping back to the next sampled suffix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Every so many words of a piece its suffix's place is kept; a lookup steps back at most one less.
SAMPLE = 32

# Occurrences located at a time.
CHUNK = 1 << 19


class Bits:
    """Packed bits with the count of ones before each 64-bit word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)]

    @classmethod
    def of(cls, flags: np.ndarray) -> Bits:
        padded = np.zeros((len(flags) // 64 + 1) * 64, bool)
        padded[:len(flags)] = flags
        return cls(np.packbits(padded, bitorder="little").view("<u8"))

    def ones(self, end: np.ndarray) -> np.ndarray:
        """Ones before each of ``end``."""
        word = end >> 6
        below = (np.uint64(1) << (end & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0

    def total(self) -> int:
        return int(self.before[-1] + np.bitwise_count(self.words[-1]))


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` in order.

    The last symbol must be one that occurs nowhere else, as must one in each stretch that repeats (pieces end in
    separators of their own), so every comparison ends inside the array.
    """
    n = len(symbols)
    width = int(symbols.max(initial=0)).bit_length() or 1
    depth = max(1, min(63 // width, n))
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= width
        key[:n - k] |= symbols[k:]
    order = np.argsort(key, kind="stable")
    heads = _heads(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = heads
    loose = _loose(heads)
    while len(loose):
        own = order[loose]
        pair = rank[own] * (n + 1) + rank[own + depth]
        by = np.argsort(pair, kind="stable")
        order[loose] = own = own[by]
        pair = pair[by]
        new = np.r_[True, pair[1:] != pair[:-1]]
        heads = loose[np.maximum.accumulate(np.where(new, np.arange(len(loose)), 0))]
        rank[own] = heads
        loose = loose[_loose(heads)]
        depth *= 2
    return order


def _heads(ordered: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the first place with the same value."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def _loose(heads: np.ndarray) -> np.ndarray:
    """Places whose head is shared."""
    if not len(heads):
        return np.zeros(0, np.int64)
    same = heads[1:] == heads[:-1]
    return np.flatnonzero(np.r_[False, same] | np.r_[same, False])


@dataclass
class FmIndex:
    """``before[c]``: suffixes that start with a symbol below c (0: the separators, then words from 1)."""
    size: int
    before: np.ndarray
    levels: list[Bits]
    marked: Bits
    samples: np.ndarray

    @classmethod
    def build(cls, pieces: list[np.ndarray], n_words: int) -> FmIndex:
        """The index over ``pieces`` (arrays of words 1..n_words), laid out one after the other with a separator each."""
        count = len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        size = int(ends[-1]) + 1 if count else 0
        text = np.zeros(size, np.int64)
        inside = np.ones(size, bool)
        inside[ends] = False
        if count:
            text[inside] = np.concatenate(pieces)
        sortable = np.where(inside, text + count - 1, 0)
        sortable[ends] = np.arange(count)
        order = suffix_order(sortable)
        last = text[order - 1]
        levels = []
        for level in range(max(1, n_words.bit_length()) - 1, -1, -1):
            flags = (last >> level) & 1 != 0
            levels.append(Bits.of(flags))
            last = np.concatenate([last[~flags], last[flags]])
        offsets = np.arange(size) - np.repeat(ends - lengths, lengths + 1)
        marked = (offsets % SAMPLE == 0)[order]
        before = np.r_[0, np.cumsum(np.bincount(text, minlength=n_words + 1))]
        return cls(size, before.astype(np.int64), levels, Bits.of(marked), order[marked].astype(np.int32))

    def pack(self) -> dict[str, bytes]:
        return {"before": self.before.astype("<i4").tobytes(),
                "levels": b"".join(b.words.tobytes() for b in self.levels),
                "marked": self.marked.words.tobytes(), "samples": self.samples.astype("<i4").tobytes()}

    @classmethod
    def unpack(cls, size: int, before: bytes, levels: bytes, marked: bytes, samples: bytes) -> FmIndex:
        rows = np.frombuffer(levels, "<u8").reshape(-1, size // 64 + 1)
        return cls(size, np.frombuffer(before, "<i4").astype(np.int64), [Bits(r) for r in rows],
                   Bits(np.frombuffer(marked, "<u8")), np.frombuffer(samples, "<i4"))

    def _down(self, level: Bits, place: np.ndarray, flags: np.ndarray) -> np.ndarray:
        ones = level.ones(place)
        return np.where(flags, self.size - level.total() + ones, place - ones)

    def _step(self, symbols: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Where suffixes below each of ``places`` stand once ``symbols`` are put before them."""
        start = np.zeros(len(symbols), np.int64)
        for k, level in enumerate(self.levels):
            flags = (symbols >> (len(self.levels) - 1 - k)) & 1 != 0
            start, *places = [self._down(level, p, flags) for p in (start, *places)]
        return [self.before[symbols] + p - start for p in places]

    def _back(self, places: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one word longer than those in rows ``places``."""
        symbols, start, at = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64), places
        for level in self.levels:
            flags = level.at(at)
            symbols = symbols * 2 + flags
            start, at = self._down(level, start, flags), self._down(level, at, flags)
        return self.before[symbols] + at - start

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases: ``phrases[i, :lengths[i]]`` are words from 1, or 0 for one that the shard lacks."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        live = np.flatnonzero(lengths > 0)
        for step in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > step]
            words = phrases[live, lengths[live] - 1 - step]
            low[live], high[live] = self._step(words, low[live], high[live])
            lost = words == 0
            high[live[lost]] = low[live[lost]]
            gone = live[high[live] <= low[live]]
            high[gone] = low[gone]
            live = live[high[live] > low[live]]
        return low, high

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes in ``rows``."""
        out, steps, at = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        left = np.arange(len(rows))
        while len(left):
            known = self.marked.at(at[left])
            done = left[known]
            out[done] = self.samples[self.marked.ones(at[done])] + steps[done]
            left = left[~known]
            at[left] = self._back(at[left])
            steps[left] += 1
        return out

    def occurrences(self, low: np.ndarray, high: np.ndarray):
        """(phrase, place) arrays of all occurrences, some at a time."""
        counts = np.cumsum(high - low)
        total = int(counts[-1]) if len(counts) else 0
        for start in range(0, total, CHUNK):
            nth = np.arange(start, min(start + CHUNK, total))
            phrase = np.searchsorted(counts, nth, "right")
            row = high[phrase] - (counts[phrase] - nth)
            yield phrase, self.places(row)
