"""Spelling variants: frequent words, their neighbours by one edit, and the form each of them stands for.

1. Words are runs of Latin letters, counted within a batch first. A fixed rule (`drop`) deletes a letter of one run in so many.
2. The vocabulary is sorted twice, forward and backward (reversed words), and cut into shards of bounded size. Two words that differ by
   one edit either share the first half of the shorter one, and are found in the forward list, or the last half, and are found in the
   backward list; the place of the edit decides which list reports the pair, so it is reported once.
3. Each word goes, as a query, to the shards that hold words with its first (or last) half and whose shared prefix is within one edit of
   its own beginning. Shards with many queries are copied, so a task has a bounded list and a bounded number of queries.
4. In a shard the sorted list is scanned by prefix: the band of three cells of the edit matrix is computed once per (query, prefix), and
   words that share the prefix, as the lengths that neighbours of the list share tell, go on from it. A range whose three cells all exceed
   one edit is skipped. All queries of a batch take each step together, as numpy arrays.
5. Forms are followed by doubling; counts grow fivefold at every step, so few rounds do.

Defined results: null text has no words, a null id is written as nothing (":word"); repeated rows count again; ties go by code point;
empty tables give empty results; other columns are ignored."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from trackguard.llm import words as W
from trackguard.llm.chunks import spread
from trackguard.session import stored

LEAST, OFTEN, TIMES, EVERY = 6, 5, 5, 199       # code points, occurrences, factor to a form, runs of which one loses a letter
SHARD = 40_000                                  # words of a list that a task holds, about
STEP = 20_000                                   # queries that take their steps together
BOUND = 64                                      # code points of a shard's bounds that the driver sees
_ASCII = W.byte_class((0x41, 0x5A), (0x61, 0x7A))
_LEAD = 0xC3                                    # U+00C0 to U+00FF: this byte and any continuation
_LAST = "\U0010ffff"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_SHORT = 48                                     # bytes up to which CRCs are computed side by side


def letter_runs(texts: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the longest runs of letters."""
    data, bounds = texts.data, texts.bounds
    lead = data == _LEAD
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.ones(len(data) + 1, bool)
    edge[1:] = ~np.append(inside, False)[:-1]
    edge[bounds] = True
    start = np.flatnonzero(inside & edge[:-1])
    after = ~np.append(inside, False)
    after[bounds] = True
    end = np.flatnonzero(after[1:] & inside) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of the runs, each continued from the CRC before it."""
    length = end - start
    order = np.argsort(-np.minimum(length, _SHORT + 1), kind="stable")
    state, begin, size = ~before[order], start[order], length[order]
    long = int(np.searchsorted(-size, -_SHORT, "left"))
    for j in range(int(size[long]) if long < len(size) else 0):
        to = int(np.searchsorted(-size, -j, "left"))                 # runs of more than j bytes
        s = state[long:to]
        state[long:to] = _CRC[(s ^ data[begin[long:to] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out = np.empty(len(start), np.uint32)
    out[order] = ~state
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[start[k]:end[k]].tobytes(), int(before[k]))
    return out


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    length = end - start
    bounds = np.concatenate([[0], np.cumsum(length)])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[spread(start, length)])))


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, every: int = EVERY) -> DataFrame:
    """(word, n): the lower-cased words of at least `least` code points and their occurrences, summed within a batch first. Of a run whose
    CRC-32 (of its document's id, a colon, and itself) `every` divides, the letter at the CRC modulo its length is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            texts = W.texts_of(batch.column("text"))
            data = W.LOWER[texts.data]
            start, end, row = letter_runs(texts)
            letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            size = letters[end] - letters[start]
            start, end, row, size = (x[size >= least] for x in (start, end, row, size))
            before = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in batch.column("doc_id").to_pylist()], np.uint32)
            crc = crcs(data, start, end, before[row])
            cut = crc % every == 0
            _, first, n = np.unique(W.run_hashes(data, start[~cut], end[~cut], W.BASE), return_index=True, return_counts=True)
            short = [w[:k] + w[k + 1:] for w, k in zip(_strings(data, start[cut], end[cut]).to_pylist(), (crc[cut] % size[cut]).tolist()) if len(w) > least]
            word = pa.concat_arrays([_strings(data, start[~cut][first], end[~cut][first]), pa.array(short, pa.large_string())])
            yield pa.record_batch([word.cast(pa.string()), pa.array(np.concatenate([n, np.ones(len(short), np.int64)]))], names=["word", "n"])
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# shards and their queries

def halves(length: int, least: int) -> tuple[int, int]:
    """How many first and last code points a word shares at least with a neighbour whose edit lies in the other half."""
    shorter = max(length - 1, least)
    return shorter // 2, (shorter + 1) // 2


def _within_one(shared: str, word: str) -> bool:
    """Whether one edit, or none, makes shared a beginning of word."""
    k = next((i for i, (a, b) in enumerate(zip(shared, word)) if a != b), min(len(shared), len(word)))
    return k == len(shared) or word.startswith(shared[k + 1:], k + 1) or word.startswith(shared[k:], k + 1) or word.startswith(shared[k + 1:], k)


class Bounds:
    """Where the shards of both lists begin and end: (side, shard, first key, last key), cut to BOUND code points."""

    def __init__(self, rows: list[tuple[int, int, str, str]]):
        self.of = {side: sorted(((low, high, shard) for _, shard, low, high in group)) for side, group in groupby(sorted(rows), key=lambda r: r[0])}
        self.low = {side: [r[0] for r in rows] for side, rows in self.of.items()}
        self.high = {side: [r[1] for r in rows] for side, rows in self.of.items()}

    def shards(self, side: int, key: str, length: int) -> list[int]:
        """Shards that can hold neighbours of key with its first `length` code points."""
        beginning = key[:length][:BOUND]
        a, b = bisect_left(self.high[side], beginning), bisect_right(self.low[side], beginning + _LAST)
        found = self.of[side][a:b]
        if len(found) < 2:
            return [shard for _, _, shard in found]
        return [shard for low, high, shard in found if _within_one(_shared(low, high), key)]


def _shared(a: str, b: str) -> str:
    return a[:next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))]


def _lists(vocabulary: DataFrame, shard: int) -> DataFrame:
    """(side, key, n, shard): every word forward (side 0) and backward (side 1), in order."""
    both = vocabulary.select("n", F.posexplode(F.array(F.col("word"), F.reverse("word"))).alias("side", "key"))
    shards = max(1, -(-2 * vocabulary.count() // shard))
    return stored(both.repartitionByRange(shards, "side", "key").withColumn("shard", F.spark_partition_id()))


def _routed(lists: DataFrame, bounds: Bounds, least: int) -> DataFrame:
    """(side, shard, key) of every query and shard."""
    sent = lists.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for side, key in zip(batch.column("side").to_pylist(), batch.column("key").to_pylist()):
                for shard in sent.value.shards(side, key, halves(len(key), least)[side]):
                    for column, value in zip(out, (side, shard, key)):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.string()))], names=["side", "shard", "key"])
    return lists.select("side", "key").mapInArrow(run, "side int, shard int, key string")


# the scan of one shard

def _points(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, one after the other, and where each begins (and the last ends)."""
    length = pc.utf8_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer("".join(keys.to_pylist()).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(length)])


class SortedList:
    """A sorted list of different words, and its scan."""

    def __init__(self, keys: list[str], n: np.ndarray, side: int):
        self.keys, self.n, self.side = keys, n, side
        self.point, bounds = _points(pa.array(keys, pa.string()))
        self.start, self.length = bounds[:-1], np.diff(bounds)
        size = len(keys)
        shared = np.zeros(size, np.int64)                # code points that a word shares with the one before
        alive = np.arange(1, size)
        depth = 0
        while len(alive):
            alive = alive[np.minimum(self.length[alive], self.length[alive - 1]) > depth]
            alive = alive[self.point[self.start[alive] + depth] == self.point[self.start[alive - 1] + depth]]
            depth += 1
            shared[alive] = depth
        self.size = size
        self.branch = np.sort(shared * size + np.arange(size))      # by shared length, then place: where a prefix of that length branches
        word = keys if side == 0 else [k[::-1] for k in keys]
        self.order = np.empty(size, np.int64)                       # the order of the words as they are written
        self.order[np.array(sorted(range(size), key=word.__getitem__), np.int64)] = np.arange(size)

    def neighbours(self, queries: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in the list) that differ by exactly one edit, in the half that is this list's."""
        point, bounds = _points(pa.array(queries, pa.string()))
        length = np.diff(bounds)
        point = np.append(point, np.uint32(0xFFFFFFFF))             # no letter; read behind the last query
        half = np.array([halves(k, least)[self.side] for k in length.tolist()], np.int64)
        a = np.array([bisect_left(self.keys, q[:h]) for q, h in zip(queries, half.tolist())], np.int64)
        b = np.array([bisect_left(self.keys, q[:h] + _LAST) for q, h in zip(queries, half.tolist())], np.int64)
        query = np.flatnonzero(a < b)
        a, b, depth = a[query], b[query], half[query]
        under, on, over = np.ones(len(query), np.int8), np.zeros(len(query), np.int8), np.ones(len(query), np.int8)
        found = []

        def letter(q: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(at < length[q], point[np.minimum(bounds[q] + at, len(point) - 1)], np.uint32(0xFFFFFFFF))
        while len(query):
            ends = self.length[a] == depth                          # the shortest word of a range comes first
            cell = length[query] - depth
            distance = np.where(cell == 0, on, np.where(cell == -1, under, np.where(cell == 1, over, 2)))
            hit = ends & (distance == 1)
            found.append((query[hit], a[hit]))
            a = a + ends
            live = a < b
            query, a, b, depth, under, on, over = (x[live] for x in (query, a, b, depth, under, on, over))
            low = np.searchsorted(self.branch, depth * self.size + a + 1)
            more = np.searchsorted(self.branch, depth * self.size + b) - low
            parent = np.repeat(np.arange(len(query)), more + 1)
            first = np.cumsum(more + 1) - (more + 1)
            child = np.empty(len(parent), np.int64)
            child[first] = a
            rest = np.ones(len(parent), bool)
            rest[first] = False
            child[rest] = self.branch[spread(low, more)] - np.repeat(depth * self.size, more)
            end = np.append(child[1:], 0)
            end[first + more] = b
            query, depth, under, on, over = (x[parent] for x in (query, depth, under, on, over))
            x = self.point[self.start[child] + depth]
            new_under = np.minimum(under + (x != letter(query, depth - 1)), on + 1)
            new_on = np.minimum(np.minimum(on + (x != letter(query, depth)), over + 1), new_under + 1)
            new_over = np.minimum(over + (x != letter(query, depth + 1)), new_on + 1)
            depth = depth + 1
            size = length[query]
            new_on = np.where(depth > size, 2, new_on)
            new_over = np.where(depth + 1 > size, 2, new_over)
            new_under = np.where(depth - 1 > size, 2, new_under)
            keep = np.minimum(np.minimum(new_under, new_on), new_over) <= 1
            query, a, b, depth, under, on, over = (v[keep] for v in (query, child, end, depth, new_under, new_on, new_over))
            under, on, over = (v.astype(np.int8) for v in (under, on, over))
        query, place = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return self._own(query, place, point, bounds)

    def _own(self, query: np.ndarray, place: np.ndarray, point: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose edit lies where this list reports it: not within the first half of the shorter word (forward), or there."""
        mine, other = bounds[query + 1] - bounds[query], self.length[place]
        half = np.minimum(mine, other) // 2
        same = np.ones(len(query), bool)
        for j in range(int(half.max(initial=0))):
            at = np.flatnonzero(same & (half > j))
            q, p = query[at], place[at]
            left = bounds[q] + j if self.side == 0 else bounds[q + 1] - 1 - j
            right = self.start[p] + j if self.side == 0 else self.start[p] + self.length[p] - 1 - j
            same[at] = point[left] == self.point[right]
        keep = same == (self.side == 0)
        return query[keep], place[keep]


def _best(own: SortedList, queries: list[str], least: int) -> pa.RecordBatch:
    """Per query with neighbours in the list: how many, and the most frequent."""
    query, place = own.neighbours(queries, least)
    order = np.lexsort((own.order[place], -own.n[place], query))
    query, place = query[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else query
    turn = (lambda s: s) if own.side == 0 else (lambda s: s[::-1])
    return pa.record_batch([pa.array([turn(queries[q]) for q in query[first].tolist()], pa.string()), pa.array(np.diff(np.append(first, len(query)))),
                            pa.array(own.n[place[first]]), pa.array([turn(own.keys[p]) for p in place[first].tolist()], pa.string())], names=["word", "n_near", "best_n", "best"])


def near_words(vocabulary: DataFrame, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """From (word, n), a stored table of different words of at least `least` code points: (word, n_near, best_n, best) for words that have
    neighbours by one edit; best is the one of largest n (ties: first in code-point order)."""
    lists = _lists(vocabulary, shard)
    rows = lists.groupBy("side", "shard").agg(F.substring(F.min("key"), 1, BOUND).alias("low"), F.substring(F.max("key"), 1, BOUND).alias("high")).collect()
    if not rows:
        return vocabulary.sparkSession.createDataFrame([], "word string, n_near long, best_n long, best string")
    queries = stored(_routed(lists, Bounds([tuple(r) for r in rows]), least))
    # a shard with many queries is copied; each query goes to one of the copies
    copies = queries.groupBy("side", "shard").agg(F.ceil(F.count("*") / (4 * shard)).alias("copies"))
    held = lists.join(F.broadcast(copies), ["side", "shard"]).select("side", "shard", F.explode(F.expr("sequence(0, int(copies) - 1)")).alias("copy"), F.lit(0).alias("kind"), "key", "n")
    asked = queries.join(F.broadcast(copies), ["side", "shard"]).select("side", "shard", F.expr("int(pmod(xxhash64(key), copies))").alias("copy"), F.lit(1).alias("kind"), "key", F.lit(None).cast("long").alias("n"))
    group = ["side", "shard", "copy"]
    together = held.unionAll(asked).repartition(max(1, min(2 * len(rows), 10_000)), *group).sortWithinPartitions(*group, "kind", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, kind, rows in _groups(batches):
            if kind == 0:
                table = pa.Table.from_batches(rows)
                own = SortedList(table.column("key").to_pylist(), table.column("n").to_numpy(), key[0])
            else:
                for batch in rows:
                    for at in range(0, batch.num_rows, STEP):
                        yield _best(own, batch.column("key").slice(at, STEP).to_pylist(), least)
    found = together.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, Iterator[pa.RecordBatch]]]:
    """Consecutive rows of one (side, shard, copy, kind), as slices of batches."""
    def slices():
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(c).to_numpy() for c in ("side", "shard", "copy", "kind")]
                cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], 0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                    yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)
    for key, group in groupby(slices(), key=lambda s: s[0]):
        yield key[:3], key[3], (batch for _, batch in group)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form that can be reached. The links have no cycle."""
    reached = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(reached.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        reached = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            return reached


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, often: int = OFTEN, times: int = TIMES, every: int = EVERY, shard: int = SHARD) -> DataFrame:
    """Per word of at least `least` code points and `often` occurrences: n, n_near, its form (the neighbour of largest n, where that is at
    least `times` its own), form_n, and the root that forms lead to (itself where it has none)."""
    vocabulary = stored(count_words(docs, doc_id, text, least, every).filter(F.col("n") >= often))
    near = vocabulary.join(near_words(vocabulary, least, shard), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    last = roots(near.filter("form is not null").select("word", "form"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
