"""Texts cut into chunks that a tokenizer treats alone, so that each distinct chunk of a batch is tokenized once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from trackguard.llm.words import BASE, DARK, Texts, byte_class, mixed, run_hashes, texts_of

_PLAIN = byte_class((0x21, 0x7E))
_HIGH = byte_class((0x80, 0xFF))
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
#: Marks that are part of no contraction and of no special token.
_MARK = byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x3B), (0x3D, 0x3D), (0x3F, 0x40))
#: First bytes of the characters beyond ASCII among which white space occurs.
_MAYBE_SPACE = (0xE1, 0xE2, 0xE3)


def token_edges(texts: Texts) -> np.ndarray:
    """Positions where a byte-level pre-tokenizer surely ends a token, whatever lies around: a blank or line feed behind a character
    that is not white space; a mark behind an ASCII letter; and what follows a single line feed."""
    data = texts.data
    if len(data) < 2:
        return np.zeros(0, np.int64)
    space = np.flatnonzero((data[1:] == 0x20) | (data[1:] == 0x0A)) + 1
    last, second, third = data[space - 1], data[np.maximum(space - 2, 0)], data[np.maximum(space - 3, 0)]
    unsure = (second == 0xC2) | np.isin(third, _MAYBE_SPACE)
    space = space[_PLAIN[last] | (_HIGH[last] & ~unsure)]
    mark = np.flatnonzero(_MARK[data[1:]] & _LETTER[data[:-1]]) + 1
    line = np.flatnonzero((data[1:-1] == 0x0A) & _PLAIN[data[:-2]] & _PLAIN[data[2:]]) + 2
    return np.concatenate([space, mark, line])


def word_starts(texts: Texts) -> np.ndarray:
    """Positions at which a word between ASCII white space begins; its chunk runs to the next one."""
    inside = DARK[texts.data]
    return np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(inside) else np.zeros(0, np.int64)


def distinct_column(texts: Texts, cuts: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """The distinct chunks between cuts and text bounds; for every chunk in order, its number among them; and how many chunks
    each text has."""
    if not len(texts.data):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    edge = np.zeros(len(texts.data) + 1, bool)
    edge[cuts] = True
    edge[texts.bounds] = True
    bounds = np.flatnonzero(edge)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(texts.data))])
    coded = column.dictionary_encode()
    per_text = np.diff(np.searchsorted(bounds, texts.bounds))
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), per_text


def distinct(texts: Texts, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The same, with the chunks as bytes."""
    found, code, per_text = distinct_column(texts, cuts)
    return found.to_pylist(), code, per_text


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0] + 1, ... of runs of the given lengths, one after the other."""
    total = int(length.sum())
    step = np.ones(total, np.int64)
    full = np.flatnonzero(length)
    if not len(full):
        return step[:0]
    start, length = start[full], length[full]
    at = np.cumsum(length)[:-1]
    step[0] = start[0]
    step[at] = start[1:] - start[:-1] - length[:-1] + 1
    return np.cumsum(step)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(lengths)
    return total[end] - total[end - lengths]



class Remembered:
    """The ids of at most `kept` chunks, made once. Chunks are found by a 64-bit hash in sorted arrays, some 50 bytes a chunk in all, and
    compared byte by byte. When the bound is reached, chunks that were not met again since the last time go (all, if too few did)."""

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kept: int):
        """make gives the ids of chunks, one after the other, and how many each has."""
        self.make, self.kept = make, kept
        self.hash, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)       # sorted hashes, and whose they are
        self.raw, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64)          # bytes of all entries; bytes of each
        self.made, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64)       # ids of all entries; ids of each
        self.met = np.zeros(0, bool)

    def _forget(self) -> None:
        keep = self.met if self.met.sum() <= self.kept // 2 else np.zeros(len(self.met), bool)
        kept, number = np.flatnonzero(keep), np.cumsum(keep) - 1
        self.raw = self.raw[spread((np.cumsum(self.size) - self.size)[kept], self.size[kept])]
        self.made = self.made[spread((np.cumsum(self.count) - self.count)[kept], self.count[kept])]
        self.size, self.count, self.met = self.size[kept], self.count[kept], np.zeros(len(kept), bool)
        stays = keep[self.entry]
        self.hash, self.entry = self.hash[stays], number[self.entry[stays]]

    def _known(self, texts: Texts, hashes: np.ndarray) -> np.ndarray:
        """The entry of each chunk, -1 where there is none."""
        if not len(self.hash):
            return np.full(len(texts), -1)
        place = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        entry, size = self.entry[place], np.diff(texts.bounds)
        hit = np.flatnonzero((self.hash[place] == hashes) & (self.size[entry] == size))
        theirs = self.raw[spread((np.cumsum(self.size) - self.size)[entry[hit]], size[hit])]
        wrong = sums(theirs != texts.data[spread(texts.bounds[:-1][hit], size[hit])], size[hit])
        out = np.full(len(texts), -1)
        out[hit[wrong == 0]] = entry[hit[wrong == 0]]
        return out

    def ids(self, found: pa.LargeBinaryArray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks found[code], one after the other, and how many each has."""
        if len(self.size) + len(found) > self.kept:
            self._forget()
        texts = texts_of(found)
        hashes = mixed(run_hashes(texts.data, texts.bounds[:-1], texts.bounds[1:], BASE))
        entry = self._known(texts, hashes)
        self.met[entry[entry >= 0]] = True
        new = np.flatnonzero(entry < 0)
        if len(new):
            made, count = self.make(found.take(pa.array(new)).to_pylist())
            entry[new] = len(self.size) + np.arange(len(new))
            size = np.diff(texts.bounds)[new]
            self.raw = np.concatenate([self.raw, texts.data[spread(texts.bounds[:-1][new], size)]])
            self.size, self.count = np.concatenate([self.size, size]), np.concatenate([self.count, count])
            self.made = np.concatenate([self.made, made.astype(np.uint32)])
            self.met = np.concatenate([self.met, np.zeros(len(new), bool)])
            order = new[np.argsort(hashes[new], kind="stable")]
            place = np.searchsorted(self.hash, hashes[order])
            self.hash, self.entry = np.insert(self.hash, place, hashes[order]), np.insert(self.entry, place, entry[order])
        start = np.cumsum(self.count) - self.count
        entry = entry[code]
        return self.made[spread(start[entry], self.count[entry])], self.count[entry]
