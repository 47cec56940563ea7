"""A compressed FM-index over segments of 64-bit symbols, in numpy.

The index holds the Burrows-Wheeler transform of all segments as a wavelet matrix (bit vectors of the symbols' dense numbers, with
counts every 64 bits), and per row the interval of rows that agree with it in `cap` symbols and the occurrences of the rows before it. Every
segment ends in a separator of its own, and no match crosses it. The suffix array exists only while the index is built."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with counts of ones before every 64th bit."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.word = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.word), dtype=np.int64)])[:-1].astype(np.uint32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before these places."""
        block = at >> 6
        low = self.word[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block].astype(np.int64) + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.word[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """A wavelet matrix: level by level, from the highest bit, zeros go before ones."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, self.zeros = [], []
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1 == 1
            self.levels.append((shift, Bits(bit)))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.first = np.zeros(size + 1, np.int64)           # where each symbol's run begins behind the last level
        change = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])) if len(symbols) else np.zeros(0, np.int64)
        self.first[symbols[change]] = change

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places, and how often each occurs before its place."""
        symbol = np.zeros(len(at), np.int64)
        for (shift, bits), zeros in zip(self.levels, self.zeros):
            one, ones = bits.get(at), bits.ones(at)
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        for (shift, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.ones(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at - self.first[symbol]


class FMIndex:
    def __init__(self, values: np.ndarray, bounds: np.ndarray, cap: int, weight: np.ndarray | None = None):
        """Segment k is values[bounds[k]:bounds[k + 1]], which occurs weight[k] times (once by default); no segment is empty."""
        length = np.diff(bounds)
        self.length, self.cap = length, cap
        self.alphabet, self.dense = np.unique(values, return_inverse=True)
        k = len(length)
        size = len(values) + k
        place = np.arange(len(values)) + np.repeat(np.arange(k), length)      # room for a separator behind each segment
        text = np.zeros(size, np.int64)
        text[place] = self.dense + 1
        end = bounds[1:] + np.arange(k)
        rank = text + (k - 1)
        rank[end] = np.arange(k)                                              # separators differ, and are the smallest
        suffix, shared = _sorted_suffixes(rank, cap)
        symbols = len(self.alphabet) + 1
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])   # rows whose suffix begins with less
        self.wavelet = Wavelet(text[suffix - 1], symbols)                     # text[-1] is the last separator
        # rows whose suffixes agree in cap symbols are neighbours: the first of them, and one past the last, of every row
        new = np.flatnonzero(shared < cap)
        group = np.cumsum(shared < cap) - 1
        self.low, self.high = new[group].astype(np.int32), np.append(new[1:], size)[group].astype(np.int32)
        times = np.repeat(np.ones(k, np.int64) if weight is None else weight, length + 1)
        self.heavy = np.concatenate([[0], np.cumsum(times[suffix])])          # occurrences in the rows before

    def occurrences(self) -> np.ndarray:
        """For every symbol of every segment, in order: how often the cap symbols that begin there occur in all segments, each occurrence
        counted as often as its segment occurs; 0 where the segment ends before. All segments are streamed through the index at once, from
        their ends: a symbol in front narrows the interval of rows, and a match longer than cap drops its last symbol, which widens it to
        all rows that agree in cap symbols."""
        out = np.zeros(int(self.length.sum()), np.int64)
        end = np.cumsum(self.length)
        alive = np.argsort(-self.length, kind="stable")
        lengths = self.length[alive]
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.smaller[-1])
        for step in range(1, int(self.length.max(initial=0)) + 1):
            keep = int(np.searchsorted(-lengths, -step, "right"))
            alive, low, high, lengths = alive[:keep], low[:keep], high[:keep], lengths[:keep]
            at = end[alive] - step
            symbol = self.dense[at] + 1
            low, high = self.smaller[symbol] + self.wavelet.rank(symbol, low), self.smaller[symbol] + self.wavelet.rank(symbol, high)
            if step > self.cap:
                low, high = self.low[low].astype(np.int64), self.high[low].astype(np.int64)
            if step >= self.cap:
                out[at] = self.heavy[high] - self.heavy[low]
        return out

    def count(self, patterns: np.ndarray) -> np.ndarray:
        """Occurrences of patterns (one a row, of equal length), by backward search."""
        place = np.minimum(np.searchsorted(self.alphabet, patterns), len(self.alphabet) - 1)
        known = (self.alphabet[place] == patterns).all(1)
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.smaller[-1])
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = place[:, j] + 1
            low, high = self.smaller[c] + self.wavelet.rank(c, low), self.smaller[c] + self.wavelet.rank(c, high)
        return np.where(known, np.maximum(high - low, 0), 0)


def _sorted_suffixes(rank: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, by doubling the length that ranks tell apart; and how many symbols, up to cap, each shares with the one
    before. Ranks of each doubling answer whether two suffixes agree that far, so the shared length is found bit by bit."""
    n, step, levels = len(rank), 1, []
    while True:
        levels.append(rank.astype(np.int32))
        if int(rank.max(initial=0)) == n - 1:
            break
        key = rank * (n + 1)
        key[:n - step] += rank[step:] + 1
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    shared = np.zeros(n, np.int64)
    a, b = suffix[1:].copy(), suffix[:-1].copy()
    for k in range(len(levels) - 1, -1, -1):
        size, level = 1 << k, levels[k]
        if size > cap:
            continue
        agree = (a < n) & (b < n)
        agree[agree] = level[a[agree]] == level[b[agree]]
        shared[1:][agree] += size
        a[agree] += size
        b[agree] += size
    return suffix, np.minimum(shared, cap).astype(np.uint8)
