"""A compressed FM-index over a sequence of small integers.

The Burrows-Wheeler transform is kept as a wavelet matrix of packed bits. The suffix array is used while the index is built
and not kept: of it stay one bit a suffix, which marks where two or more suffixes with `depth` equal first symbols begin, and
the first place of each such group."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64))).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        for level in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bits = (symbols >> level & 1).astype(np.uint8)
            self.levels.append((level, Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))
        every = np.arange(n_symbols)
        self.first = self._walk(every, np.zeros(n_symbols, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbols >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbols, at) - self.first[symbols]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first depth symbols at least, by place where these are equal."""
    rank, k = text.astype(np.int64), 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:] + 1
        rank = np.unique(rank * (after.max() + 1) + after, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Of text (symbols below n_symbols, 0 ends a sequence)."""

    def __init__(self, text: np.ndarray, n_symbols: int, depth: int):
        places = suffix_order(text, depth + 1)
        self.depth = depth
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))
        self.wavelet = WaveletMatrix(text[places - 1], n_symbols)
        self._group(text, places)

    def _group(self, text: np.ndarray, places: np.ndarray) -> None:
        """Suffixes of equal first `depth` symbols stand together, in the order of the suffix array."""
        n, new = len(places), np.zeros(len(places), bool)
        new[:1] = True
        for k in range(self.depth):
            at = places + k
            symbol = np.where(at < n, text[np.minimum(at, n - 1)], -1)
            new[1:] |= symbol[1:] != symbol[:-1]
        begin = np.flatnonzero(new)
        least = np.minimum.reduceat(places, begin) if n else places
        many = np.diff(np.append(begin, n)) > 1
        marks = np.zeros(n, np.uint8)
        marks[begin[many]] = 1
        self.groups, self.first = Bits(marks), least[many].astype(np.int32)

    def matching(self, text: np.ndarray, ends: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics up to depth. For each end in text (symbols of the index): the length of the longest run that
        ends there and occurs at least `least` times in the index, depth at most, and where the suffixes that start with that
        run begin. Backward search, all ends at once; an end leaves as soon as its run can't be made longer."""
        length, at = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        alive, low, high = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), self.starts[-1])
        for k in range(self.depth):
            place = ends[alive] - k
            symbol = np.where(place >= 0, text[np.maximum(place, 0)], 0)
            low, high = (self.starts[symbol] + self.wavelet.rank(symbol, x) for x in (low, high))
            going = (symbol > 0) & (high - low >= least)
            alive, low, high = alive[going], low[going], high[going]
            if not len(alive):
                break
            length[alive] = k + 1
            at[alive] = low
        return length, at

    def first_place(self, at: np.ndarray) -> np.ndarray:
        """The first place in the indexed text of runs of depth symbols with two or more occurrences, by where their suffixes begin."""
        return self.first[self.groups.ones(at)]
