"""Simple-8b word-aligned coding of unsigned integers, in numpy.

A 64-bit word holds a selector in its upper 4 bits and `count` values of `bits` bits below, the first value lowest. Selector 0 is
the escape: the next word is one value of up to 64 bits. Words are chosen greedily: as many values as fit. The last word of a
block may hold fewer values than its selector says; the block's number of values tells."""

from __future__ import annotations

import numpy as np

# Fixed values of the format: (count, bits) by selector; 0 is the escape.
PACKINGS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
ESCAPE = 0
_LONGEST = max(count for count, _ in PACKINGS.values())
_COUNT = np.array([1] + [PACKINGS[s][0] for s in range(1, 15)], np.int64)


def bit_length(values: np.ndarray) -> np.ndarray:
    """Bits of each value, at least 1."""
    if not len(values) or values.max() < np.uint64(1 << 53):            # exact as floating-point numbers
        return np.maximum(1, np.frexp(values.astype(np.float64))[1]).astype(np.uint8)
    return np.maximum(1, np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), values, "right")).astype(np.uint8)


def _widest(bits: np.ndarray, counts: list[int]) -> dict[int, np.ndarray]:
    """For every count, the largest of the next `count` entries; behind the end there are zeros."""
    padded = np.concatenate([bits, np.zeros(_LONGEST, np.uint8)])
    out, have, size = {}, padded, 1
    for count in sorted(counts):
        while size < count:
            step = min(size, count - size)
            have, size = np.maximum(have[:len(have) - step], have[step:]), size + step
        out[count] = have[:len(bits)]
    return out


def encode(values: np.ndarray) -> np.ndarray:
    """Words for one block of values."""
    values = values.astype(np.uint64)
    n = len(values)
    bits = bit_length(values)
    selector = np.zeros(n, np.uint8)
    widest = _widest(bits, [count for count, _ in PACKINGS.values()])
    for s in sorted(PACKINGS, reverse=True):            # the densest that fits is written last
        count, width = PACKINGS[s]
        fits = widest[count] <= width
        if fits.any():
            selector[fits] = s
    step, at, i = _COUNT[selector].tolist(), [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at, np.int64)
    chosen = selector[at]
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(chosen == ESCAPE)])[:-1]     # an escape takes two words
    words = np.zeros(len(at) + int((chosen == ESCAPE).sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(_LONGEST, np.uint64)])
    for s, (count, width) in PACKINGS.items():
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            word = np.full(len(mine), np.uint64(s) << np.uint64(60))
            for k in range(count):
                word |= padded[at[mine] + k] << np.uint64(k * width)
            words[place[mine]] = word
    mine = np.flatnonzero(chosen == ESCAPE)
    words[place[mine] + 1] = values[at[mine]]
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    if (selector == ESCAPE).any():                       # a word behind an escape is no word of its own
        at = 0
        for i in np.flatnonzero(selector == ESCAPE).tolist():
            if i >= at:
                at = i + 2
                head[i + 1] = False
    where = np.flatnonzero(head)
    chosen = selector[where]
    end = np.cumsum(_COUNT[chosen])
    start = end - _COUNT[chosen]
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint64)
    for s, (count, width) in PACKINGS.items():
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            mask, word, to = np.uint64((1 << width) - 1), words[where[mine]], start[mine]
            for k in range(count):
                out[to + k] = (word >> np.uint64(k * width)) & mask
    mine = np.flatnonzero(chosen == ESCAPE)
    out[start[mine]] = words[where[mine] + 1]
    return out[:n]
