"""Substring deduplication: words covered by a window of `window` words whose sequence also starts somewhere else.

1. Every window has an anchor: the smallest hash among its runs of ANCHOR words. Windows whose anchor lies at the same place form a
   segment (their words together). Equal windows have equal anchors at equal offsets, so a window can only be repeated in a segment whose
   anchor occurs in another segment too. Anchors are counted; those that occur again become a bit map of bounded size.
2. Segments whose anchor hits the bit map are kept (a false hit costs work, never a result) with the bytes of their words. Equal segments
   are one from here on, with the number of their occurrences; where each occurs stays behind in a thin table.
3. Segments are dealt to shards by their anchor. Each shard builds an FM-index of its different segments and streams them through it: the
   interval of a window counts the window's occurrences, each segment as often as it occurs, and more than one is a repeated window.
   Anchors with more than HOT words of different segments are too large for a shard: their windows are dealt by their own hash and counted.
4. Runs of repeated windows go back to the documents (by the hash of the text, which copies share), whose words are then cut. Only texts
   whose hash may be among the cut ones are shuffled for that; the text of many copies is cut in place.

Words, segments and windows are the same if their 64 or 128-bit hashes are.

Defined results: null texts have no words; texts of fewer words than a window lose nothing; rows are judged one by one, and repeated
rows repeat each other's windows; empty tables give empty results; columns other than id and text are ignored by `report` and carried by
`remove`."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackguard.llm import sides, words as W
from trackguard.llm.fm_index import FMIndex
from trackguard.llm.sides import matched, side
from trackguard.session import stored

WINDOW = 35
ANCHOR = 8
SHARD_WORDS = 400_000       # words of the segments that one shard indexes, about
HOT = 200_000               # words of one anchor's segments
BITS_PER_ANCHOR, MOST_BITS = 16, 1 << 27
_FIRST, _SECOND = 0x5851F42D4C957F2D, 0x14057B7EF767814F     # odd bases of the two hashes of a segment
SLOTS = 1 << 20             # broadcast at most, to tell texts that are cut from others
SEGMENT = "anchor long, h1 long, h2 long, key binary, start long, n long, size long, words binary"


def text_key(text: Column) -> Column:
    """128 bits that equal texts share."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """For every run of n values, the place of its (first) smallest."""
    place, size = np.arange(len(values)), 1
    while size < n:
        step = min(size, n - size)
        a, b = place[:-step], place[step:]
        place, size = np.where(values[b] < values[a], b, a), size + step
    return place


def segments(words: W.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, one past the last word, and anchor of every segment."""
    count = len(words) - window + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = min(ANCHOR, window)
    value = W.rolling(words, size)
    place = _least(value, window - size + 1)[:count]
    valid = words.row[:count] == words.row[window - 1:]
    new = np.concatenate([[True], place[1:] != place[:-1]]) | ~np.concatenate([[False], valid[:-1]])
    last = np.concatenate([new[1:] | ~valid[1:], [True]])
    start, end = np.flatnonzero(valid & new), np.flatnonzero(valid & last)
    return start, end + window, value[place[start]]


def _anchor_counts(docs: DataFrame, window: int) -> DataFrame:
    """anchor and the number of its segments, summed within a batch first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            anchor, n = np.unique(segments(W.words_of(W.texts_of(batch.column("text"))), window)[2], return_counts=True)
            yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])
    return docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


class BitMap:
    """Two bits for each of some 64-bit values."""

    def __init__(self, n: int):
        self.size = 1 << 10
        while self.size < min(MOST_BITS, BITS_PER_ANCHOR * n):
            self.size *= 2
        self.words = np.zeros(self.size >> 6, np.uint64)

    def places(self, value: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(self.size - 1)
        return [(value & mask).astype(np.int64), ((value >> np.uint64(32)) & mask).astype(np.int64)]

    def fill(self, anchors: DataFrame) -> BitMap:
        """The bits are set by one aggregation; at most one row per 64 bits comes back."""
        low, high = f"(anchor & {self.size - 1})", f"(shiftrightunsigned(anchor, 32) & {self.size - 1})"
        at = anchors.select(F.explode(F.expr(f"array({low}, {high})")).alias("p"))
        rows = at.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow()
        self.words[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
        return self

    def has(self, value: np.ndarray) -> np.ndarray:
        out = np.ones(len(value), bool)
        for p in self.places(value):
            out &= (self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) != 0
        return out


def _candidates(docs: DataFrame, bits: BitMap, window: int) -> DataFrame:
    """Segments whose anchor may occur again. Of equal segments in a batch only the first carries its words; equal texts of a batch are
    taken once, with their number."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            _, first, copies = np.unique(keys, return_index=True, return_counts=True)
            batch = batch.take(pa.array(first))
            texts = W.texts_of(batch.column("text"))
            words = W.words_of(texts)
            start, end, anchor = segments(words, window)
            good = sent.value.has(anchor)
            start, end, anchor = start[good], end[good], anchor[good]
            h1, h2 = (W.mixed(W.run_hashes(words.hash, start, end, base)) for base in (_FIRST, _SECOND))
            lead = np.zeros(len(start), bool)
            lead[np.unique(h1 ^ W.mixed(h2), return_index=True)[1]] = True
            row = words.row[start]
            data, first, last = texts.data, words.start[start].tolist(), words.end[end - 1].tolist()
            yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column("key").take(pa.array(row)),
                                   pa.array(start - words.first[row]), pa.array(copies[row].astype(np.int64)), pa.array(end - start),
                                   pa.array([data[a:b].tobytes() if k else None for a, b, k in zip(first, last, lead.tolist())], pa.binary())],
                                  names=["anchor", "h1", "h2", "key", "start", "n", "size", "words"])
    return docs.select("key", "text").mapInArrow(run, SEGMENT)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column("shard").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
        for a, b in zip(cuts, cuts[1:]):
            if shard[a] != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = shard[a]
    if held:
        yield pa.Table.from_batches(held)


def repeated_in(distinct: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(h1, h2, runs) of segments with repeated windows: runs is [first window, one past the last, ...]. distinct has one row per
    different segment, with its words and occurrences n."""
    total = distinct.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            shard = shard.combine_chunks()
            words = W.words_of(W.texts_of(pa.concat_arrays(shard.column("words").chunks)))
            bounds = np.append(words.first, len(words))
            again = FMIndex(words.hash, bounds, window, shard.column("n").to_numpy()).occurrences() > 1
            a, b = W.runs(again, words.row)
            if len(a):
                row = words.row[a]
                offsets = np.concatenate([[0], 2 * np.cumsum(np.bincount(row, minlength=shard.num_rows))])
                pairs = np.stack([a - bounds[row], b - bounds[row]], 1).ravel()
                out = pa.table({"h1": shard.column("h1"), "h2": shard.column("h2"), "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs))})
                yield from out.filter(pa.array(np.diff(offsets) > 0)).combine_chunks().to_batches()
    rows = distinct.select("h1", "h2", "n", "words", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    return rows.repartition(min(shards, 10_000), "shard").sortWithinPartitions("shard", "h1", "h2").mapInArrow(run, "h1 long, h2 long, runs array<long>")


def repeated_hot(distinct: DataFrame, window: int) -> DataFrame:
    """The same for segments of anchors that are too common: each window goes its own way, by its hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "words"):
            words = W.words_of(W.texts_of(batch.column("words")))
            count = max(0, len(words) - window + 1)
            at = np.flatnonzero(words.row[:count] == words.row[len(words) - count:])
            row = words.row[at]
            w1, w2 = (pa.array(W.mixed(W.run_hashes(words.hash, at, at + window, base)).view(np.int64)) for base in (_FIRST, _SECOND))
            yield pa.record_batch([*[batch.column(c).take(pa.array(row)) for c in ("h1", "h2", "n")], pa.array(at - words.first[row]), w1, w2], names=["h1", "h2", "n", "at", "w1", "w2"])
    each = stored(distinct.select("h1", "h2", "n", "words").mapInArrow(run, "h1 long, h2 long, n long, at long, w1 long, w2 long"))
    again = each.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).filter("n > 1").select("w1", "w2", "rows")
    found = matched(each, again, ["w1", "w2"], "rows").groupBy("h1", "h2").agg(F.array_sort(F.collect_set("at")).alias("at"))
    return found.select("h1", "h2", F.flatten(F.transform("at", lambda a: F.array(a, a + 1))).alias("runs"))


def repeated_words(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """From (key, text): (key, cut, copies) for texts with repeated windows; cut lists [first word, one past the last, ...] of runs that
    may overlap."""
    counts = stored(_anchor_counts(docs, window).filter("n > 1").select("anchor"))
    found = stored(_candidates(docs, BitMap(counts.count()).fill(counts), window))
    distinct = found.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.first("anchor").alias("anchor"), F.first("size").alias("size"), F.first("words", ignorenulls=True).alias("words"))
    distinct = stored(distinct)
    common = stored(distinct.groupBy("anchor").agg(F.sum("size").alias("size")).filter(F.col("size") > hot).select("anchor"))
    if common.isEmpty():
        runs = repeated_in(distinct, window, shard_words)
    else:
        runs = repeated_in(distinct.join(side(common), "anchor", "left_anti"), window, shard_words).unionAll(repeated_hot(distinct.join(side(common), "anchor", "left_semi"), window))
    runs = stored(runs).join(distinct.select("h1", "h2", "rows"), ["h1", "h2"])
    hits = matched(found.select("h1", "h2", "key", "start", "n"), runs, ["h1", "h2"], "rows")
    spans = F.transform(F.col("runs"), lambda x, i: F.col("start") + x + F.when(i % 2 == 1, window - 1).otherwise(0))
    # every copy of a text has the same segments
    copies = F.expr("sum(n) div size(collect_set(start))")
    return hits.select("key", "start", "n", spans.alias("cut")).groupBy("key").agg(F.flatten(F.collect_set("cut")).alias("cut"), copies.alias("copies"))


def _marked(docs: DataFrame, text: str, **more) -> DataFrame:
    """docs with the column _cut (null where nothing repeats)."""
    keyed = docs.withColumn("_key", text_key(F.col(text)))
    slot = F.pmod(F.xxhash64("_key"), F.lit(SLOTS))
    cut = stored(repeated_words(keyed.select(F.col("_key").alias("key"), F.col(text).alias("text")), **more).toDF("_key", "_cut", "_copies"))
    is_hot = sides.hot("_copies", cut.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0])
    slots = cut.select(slot.alias("_slot")).distinct().withColumn("_maybe", F.lit(True))
    seen = keyed.withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left").join(F.broadcast(cut.filter(is_hot).drop("_copies")), "_key", "left")
    open_ = F.col("_maybe").isNotNull() & F.col("_cut").isNull()
    rest = seen.filter(open_).drop("_cut").join(cut.filter(~is_hot).drop("_copies"), "_key", "left")
    return seen.filter(~open_).select(*docs.columns, "_cut").unionByName(rest.select(*docs.columns, "_cut"))


def _kept(texts: W.Texts, cut: list) -> Iterator[tuple[int, int, bytes]]:
    """Words, words removed, and the kept words joined by blanks, of every text."""
    for i, c in enumerate(cut):
        words = texts.raw(i).split()            # bytes split at the six ASCII white-space characters
        gone = W.covered(np.array(c[::2]), np.array(c[1::2]) - np.array(c[::2]), len(words)) if c else np.zeros(len(words), bool)
        yield len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if c else words)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """Per document: n_words, n_removed and the SHA-256 of the kept words joined by blanks."""
    rows = _marked(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", **more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            out = [(n, gone, hashlib.sha256(rest).hexdigest()) for n, gone, rest in _kept(W.texts_of(batch.column("text")), batch.column("_cut").to_pylist())]
            yield pa.record_batch([batch.column("doc_id"), *[pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "_cut").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, text: str = "text", **more) -> DataFrame:
    """docs with repeated windows cut out of the texts; a text that loses words comes back as its kept words joined by blanks."""
    carried = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    rows = _marked(docs.select(*[F.col(c).alias(k) for c, k in carried.items()]), carried[text], **more)
    own = carried[text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, own):
            cut, old = batch.column("_cut").to_pylist(), batch.column(own)
            new = pa.array([rest.decode() if c else t.as_py() for t, c, (_, _, rest) in zip(old, cut, _kept(W.texts_of(old), cut))], old.type)
            yield pa.record_batch([new if n == own else batch.column(n) for n in carried.values()], names=list(carried.values()))
    out = rows.select(*carried.values(), "_cut")
    return out.mapInArrow(run, out.drop("_cut").schema).toDF(*docs.columns)
