"""HyperMinHash sketches of shingle sets, in numpy.

A shingle's 64-bit hash names one of BUCKETS buckets by its upper bits; the bucket keeps its smallest remaining value, compressed to the
count of leading zeros (6 bits) and the MANTISSA bits behind the first one: 16 bits a register. An empty bucket takes over the register of
a non-empty one, drawn by a sequence of draws that is the same for all sets, so that two sets' registers agree with about the probability
of their Jaccard similarity, for small sets too. Two different values can leave equal registers; `corrected` takes that out."""

from __future__ import annotations

import numpy as np

from trackguard.llm import words as W

SHIFT = 7
BUCKETS = 1 << SHIFT
MANTISSA = 10
ROWS = 4                    # registers of a band
BANDS = BUCKETS // ROWS
_VALUE_BITS = 64 - SHIFT
_EMPTY = np.iinfo(np.uint64).max


def shingles(texts: W.Texts, n: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (n consecutive lower-cased words; all words of a text with fewer) as 64-bit hashes, ascending within each text,
    and the bounds of each text's run. A text without words has none."""
    words = W.words_of(texts, W.DARK, lower=True)
    hashes, at = W.grams(words, n)
    parts = [(hashes, words.row[at])]
    for k in range(1, n):
        if (words.per_row == k).any():
            h, i = W.grams(words, k)
            own = words.per_row[words.row[i]] == k
            parts.append((h[own], words.row[i][own]))
    row = np.concatenate([p[1] for p in parts])
    value = np.concatenate([p[0] for p in parts])
    if len(parts) > 1:
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    for a, b in zip(bounds, bounds[1:]):
        value[a:b].sort()
    keep = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])[:len(value)]
    return value[keep], np.searchsorted(row[keep], np.arange(len(texts) + 1))


def _draws(attempt: int) -> np.ndarray:
    """The bucket that each empty bucket asks at this attempt."""
    return (W.mixed(np.arange(BUCKETS, dtype=np.uint64), seed=1000 + attempt) >> np.uint64(_VALUE_BITS)).astype(np.int64)


def registers(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of BUCKETS registers per set; an empty set has zeros."""
    n = len(bounds) - 1
    least = np.full(n * BUCKETS, _EMPTY)
    row = np.repeat(np.arange(n), np.diff(bounds))
    mixed = W.mixed(value, seed=5)
    np.minimum.at(least, row * BUCKETS + (mixed >> np.uint64(_VALUE_BITS)).astype(np.int64), mixed & np.uint64((1 << _VALUE_BITS) - 1))
    least = least.reshape(n, BUCKETS)
    empty = least == _EMPTY
    out = _compressed(least)
    out[empty] = 0
    full, todo, attempt = ~empty, np.flatnonzero(empty.any(1) & ~empty.all(1)), 0
    left = empty.copy()
    while len(todo):
        ask = _draws(attempt)
        r, j = np.nonzero(left[todo])
        r = todo[r]
        found = full[r, ask[j]]
        out[r[found], j[found]] = out[r[found], ask[j[found]]]
        left[r[found], j[found]] = False
        todo, attempt = todo[left[todo].any(1)], attempt + 1
    return out


def _compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits behind the first one, of values of _VALUE_BITS bits."""
    high = np.frexp(least.astype(np.float64))[1]                  # position of the first one, up to rounding at the top
    high = np.where((least >> np.minimum(high, 63).astype(np.uint64)) > 0, high + 1, high)
    high = np.where((high > 0) & ((least >> np.maximum(high - 1, 0).astype(np.uint64)) == 0), high - 1, high).clip(0, _VALUE_BITS)
    zeros = (_VALUE_BITS - high).astype(np.uint64)
    behind = (least << (zeros + np.uint64(1 + 64 - _VALUE_BITS))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | behind).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; equal keys mean equal registers in the same band."""
    wide = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = (wide << (np.arange(ROWS, dtype=np.uint64) * np.uint64(16))).sum(2, dtype=np.uint64)
    return W.mixed(key ^ W.mixed(np.arange(BANDS, dtype=np.uint64), seed=77)[None, :])


def collision(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The chance that registers of two disjoint sets are equal: both have the same zeros with the same bits behind. With a and b
    values in a bucket, a register has more than z zeros with probability 1 - (1 - 2^-z)^a."""
    z = np.arange(0, 58)
    a, b = np.maximum(n_a / BUCKETS, 1.0)[:, None], np.maximum(n_b / BUCKETS, 1.0)[:, None]

    def at(n):
        upper, lower = 1 - (1 - 2.0 ** -z) ** n, 1 - (1 - 2.0 ** -(z + 1)) ** n
        return upper - lower
    return (at(a) * at(b)).sum(1) / (1 << MANTISSA)


def corrected(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity: the share of equal registers, without those expected equal by accident."""
    same = (regs_a == regs_b).mean(1)
    by_chance = collision(n_a.astype(float), n_b.astype(float))
    return np.clip((same - by_chance) / (1 - by_chance), 0, 1)
