"""Words of a batch of texts as numpy arrays: where they lie in the bytes, whose they are, and their 64-bit hashes.

Texts are read from the Arrow buffers of a batch, without a Python string per text. Hashes decide nothing alone where an
operator asks for verified hits; word and shingle identity elsewhere rests on 64 or 128 bits."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; the arrays of powers have this length.
STEP = 1 << 18
#: Bytes of text that one round of an operator holds; a longer text is a round of its own.
PIECE = 2 << 20


def kept_in_process(key: tuple, make: Callable):
    """What make() gives, made once per worker process: tasks that a process runs one after the other share it. The functions of a task
    arrive with modules of their own, so the store is a module of the interpreter."""
    store = sys.modules.setdefault("_kept_by_trackguard_tasks", ModuleType("_kept_by_trackguard_tasks")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1, 1 << 62)) * 2 + 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BASE, GRAM = _odd(11), _odd(12)
_LETTER = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, kept and lengthened on demand."""
    known = kept_in_process(("powers",), dict)
    have = known.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, STEP + 1, 2 * len(have[0]) if have else 0)
        have = known[base] = (_powers(base, size), _powers(pow(base, -1, 1 << 64), size))
    return have


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


#: Digits, ASCII letters and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but the six ASCII white-space characters.
DARK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Texts:
    """Row i holds data[bounds[i]:bounds[i + 1]]."""
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if where is None or len(column) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    bounds = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(flat[bounds[0]:bounds[-1]], bounds - bounds[0])


def pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose texts hold at most limit bytes, or one row. A task begins here, so what earlier tasks of the
    process left behind (functions and their modules refer to each other, and Arrow keeps freed memory) goes first."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds, at = texts_of(batch.column(text)).bounds, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    start: np.ndarray       # byte positions in Texts.data
    end: np.ndarray
    row: np.ndarray         # which text
    hash: np.ndarray        # uint64, of the (lower-cased) bytes
    per_row: np.ndarray     # words of each text
    first: np.ndarray       # index of each text's first word

    def __len__(self) -> int:
        return len(self.start)


def words_of(texts: Texts, kind: np.ndarray = DARK, lower: bool = False) -> Words:
    """The words of every text: the longest runs of bytes of the given kind."""
    data, bounds = texts.data, texts.bounds
    inside = np.empty(len(data) + 1, bool)
    np.take(kind, data, out=inside[:-1])
    inside[-1] = False
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[1:] = True, ~inside[:-1]
    edge[bounds] = True                     # a text's first byte follows no byte of its own
    start = np.flatnonzero(inside & edge)
    after = ~inside
    after[bounds] = True
    end = np.flatnonzero(after[1:] & inside[:-1]) + 1
    row = np.searchsorted(bounds, start, "right") - 1
    per_row = np.bincount(row, minlength=len(texts)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(per_row)])[:-1]
    return Words(start, end, row, _hashes(data, start, end, lower), per_row, first)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    letter = _LETTER[LOWER] if lower else _LETTER
    return mixed(run_hashes(data, start, end, BASE, letter))


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int, letter: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hashes of the runs data[start:end] (in order of start; they may overlap), of the 64-bit values in data or of what
    letter has for them."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        a = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, a + STEP, "right")))
        b = int(end[to - 1])
        up, down = _table(base, b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b] if letter is None else letter[data[a:b]]) * up[:b - a], out=total[1:])
        s, e = start[at:to] - a, end[at:to] - a
        out[at:to] = (total[e] - total[s]) * down[s]
        at = to
    return out


def rolling(words: Words, n: int) -> np.ndarray:
    """Hashes of all runs of n words, also of those that cross from one text into the next."""
    count = max(0, len(words) - n + 1)
    at = np.arange(count)
    return mixed(run_hashes(words.hash, at, at + n, GRAM), n)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within one text, and the index of each run's first word."""
    count = max(0, len(words) - n + 1)
    at = np.flatnonzero(words.row[:count] == words.row[len(words) - count:])
    return mixed(run_hashes(words.hash, at, at + n, GRAM), n), at


def covered(start: np.ndarray, length: np.ndarray | int, size: int) -> np.ndarray:
    """Which of size positions lie in any of the runs."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def runs(marked: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest runs of marked positions that stay in one row: (first, one past the last)."""
    if not len(marked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], row[1:] != row[:-1]])
    before = np.concatenate([[False], marked[:-1]])
    after = np.concatenate([marked[1:], [False]])
    last = np.concatenate([new[1:], [True]])
    return np.flatnonzero(marked & (new | ~before)), np.flatnonzero(marked & (last | ~after)) + 1
