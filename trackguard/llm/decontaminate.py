"""Benchmark decontamination: windows of benchmark words, broadcast as a set of hashes, are looked up in every text.

A window is `n` consecutive words of an item (default 10); an item with fewer words, but not none, is one window. Words are
runs of digits, letters a-z and anything beyond ASCII, after A-Z are lower-cased. Every hash hit is verified word by word.

Defined results: a null or wordless text has no words and no hits; an item without id or words is ignored; rows that repeat an
item_id are one item; repeated documents are judged one by one; empty tables give empty or clean results. `scan` returns only
the id and its own columns, so other columns of the input cannot clash.

Size: the broadcast set is built from blocks of items of at most `block_bytes` of text. A larger benchmark takes one pass over
the documents per block; every pass adds its hits to those found before, so nothing is lost and no broadcast grows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackguard.llm import words as W
from trackguard.session import stored

WINDOW = 10
BLOCK_BYTES = 1 << 20
#: What a pass hands on: hit runs as (first word, one past the last), and the items found.
FOUND = "n_words long, hit array<long>, items array<string>"


class Windows:
    """The windows of some items by hash, with their words for the check."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.by: dict[int, dict[int, list[tuple[bytes, str]]]] = {}
        texts = W.texts_of(pa.array([t for _, t in items], pa.string()))
        words = W.words_of(texts, W.ALNUM, lower=True)
        for size in sorted(set(np.minimum(words.per_row[words.per_row > 0], n).tolist())):
            hashes, at = W.grams(words, size)
            whole = np.minimum(words.per_row, n)[words.row[at]] == size
            for h, i in zip(hashes[whole].tolist(), at[whole].tolist()):
                entry = self.by.setdefault(size, {}).setdefault(h, [])
                entry.append((spelled(texts, words, i, size), items[int(words.row[i])][0]))
        self.keys = {size: np.array(sorted(found), np.uint64) for size, found in self.by.items()}
        self.sieve = {}
        for size, keys in self.keys.items():
            bits = np.zeros(1 << 20, bool)
            bits[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.sieve[size] = bits

    def hits(self, texts: W.Texts, words: W.Words) -> tuple[np.ndarray, list[set[str]]]:
        """Words inside verified occurrences, and the items found in each text."""
        first, length, found = [], [], [set() for _ in range(len(texts))]
        for size, keys in self.keys.items():
            hashes, at = W.grams(words, size)
            likely = np.flatnonzero(self.sieve[size][(hashes >> np.uint64(44)).astype(np.int64)])
            where = np.searchsorted(keys, hashes[likely])
            same = likely[keys[np.minimum(where, len(keys) - 1)] == hashes[likely]]
            for h, i in zip(hashes[same].tolist(), at[same].tolist()):
                text = spelled(texts, words, i, size)
                ids = [item for window, item in self.by[size][h] if window == text]
                if ids:
                    first.append(i)
                    length.append(size)
                    found[int(words.row[i])].update(ids)
        return W.covered(np.array(first, np.int64), np.array(length, np.int64), len(words)), found


def spelled(texts: W.Texts, words: W.Words, at: int, size: int) -> bytes:
    return b" ".join(W.LOWER[texts.data[words.start[k]:words.end[k]]].tobytes() for k in range(at, at + size))


def blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[DataFrame]:
    """The items in blocks by hash, so many that one holds about block_bytes of text."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).filter("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        yield items.filter(F.expr(f"pmod(xxhash64(item_id, text), {count}) = {k}")) if count > 1 else items


def _pass(docs: DataFrame, items: DataFrame, text: str, n: int) -> DataFrame:
    """docs with FOUND columns, to which this block of items has added its hits."""
    sent = docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in items.collect()], n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        for batch in W.pieces(batches, text):
            texts = W.texts_of(batch.column(text))
            words = W.words_of(texts, W.ALNUM, lower=True)
            marked, found = windows.hits(texts, words)
            for i, (hit, items) in enumerate(zip(batch.column("hit").to_pylist(), batch.column("items").to_pylist())):
                for a, b in zip(hit[::2], hit[1::2]):
                    marked[words.first[i] + a:words.first[i] + b] = True
                found[i].update(items)
            a, b = W.runs(marked, words.row)
            row = words.row[a]
            pairs = np.stack([a - words.first[row], b - words.first[row]], 1).ravel()
            offsets = np.concatenate([[0], 2 * np.cumsum(np.bincount(row, minlength=len(texts)))])
            new = {"n_words": pa.array(words.per_row), "items": pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                   "hit": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs, pa.int64()))}
            yield pa.record_batch([new.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)], names=batch.schema.names)
    return docs.mapInArrow(run, docs.schema)


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
           n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the columns of FOUND; columns of those names in docs are replaced."""
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hit": F.expr("cast(array() as array<long>)"), "items": F.expr("cast(array() as array<string>)")})
    todo = list(blocks(benchmark, item_id, item_text, block_bytes))
    for block in todo:
        out = _pass(out, block, text, n)
        if len(todo) > 1:
            out = stored(out)
    return out


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """Per document: words, hit words, items found (ids as strings, sorted), their digest, and whether there is any hit."""
    out = marked(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **more)
    size = F.expr("aggregate(sequence(0, size(hit) - 1, 2), 0L, (s, i) -> s + hit[i + 1] - hit[i])")
    n_hit = F.when(F.size("hit") > 0, size).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", mode: str = "documents", **more) -> DataFrame:
    """docs without contaminated documents (mode documents), or with hit words cut out of the texts (mode spans)."""
    carried = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c != text}
    out = marked(docs.select(F.col(text).alias("text"), *[F.col(c).alias(k) for c, k in carried.items()]), benchmark, **more)
    if mode == "documents":
        out = out.filter(F.size("hit") == 0)
    elif mode == "spans":
        out = out.withColumn("text", F.when(F.size("hit") > 0, _cut_udf()("text", "hit")).otherwise(F.col("text")))
    else:
        raise ValueError(mode)
    return out.select(*[F.col("text").alias(c) if c == text else F.col(carried[c]).alias(c) for c in docs.columns])


def _cut_udf() -> Callable:
    @F.pandas_udf("string")
    def cut(text: pd.Series, hit: pd.Series) -> pd.Series:
        out = []
        for t, h in zip(text, hit):
            if t is None or not len(h):
                out.append(t)
                continue
            texts = W.texts_of(pa.array([t], pa.string()))
            words, at, kept = W.words_of(texts, W.ALNUM, lower=True), 0, []
            for a, b in zip(h[::2], h[1::2]):
                kept.append(texts.data[at:words.start[a]].tobytes())
                at = int(words.end[b - 1])
            out.append(b"".join([*kept, texts.data[at:].tobytes()]).decode())
        return pd.Series(out)
    return cut


def digest(items: list[str]) -> str:
    """items_sha256 of some ids, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
