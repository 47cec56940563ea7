"""Toxicity by a factorization machine over hashed terms, trained in numpy on labelled documents.

Terms are lower-cased words and their first 4 and 5 bytes, hashed to 2^22 numbers. From a bounded sample of labelled documents (about
PER_LABEL of each label) the terms are kept whose presence goes with the label (G statistic above LEAST, at most TERMS, the strongest); a
document is the set of kept terms anywhere in its whole text. The machine gives

    logit = w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)

over the terms that are present, so a pair (an insult and the mention of a group) counts beyond its parts. The sample is balanced, and
the score is a probability under even odds.

Defined results: null and empty texts have no terms and get the score of w0; a document that labels name twice is toxic if any row
says so; of several texts under one id the one with the smallest hash is learnt; null labels are no labels; without any labelled row every score is 0; rows are scored one by one, empty tables give empty
results, and other columns of the input are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackguard.llm import folds, words as W
from trackguard.llm.sides import side
from trackguard.session import stored

PER_LABEL = 6_000
BITS = 22
TERMS = 8_192
LEAST = 15.0            # one in ten thousand by chance
FACTORS, EPOCHS, STEP, DECAY, BATCH = 8, 40, 0.02, 2e-5, 256
PREFIXES = (4, 5)


def terms_of(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all terms, and the text each is in; a term may come more than once."""
    words = W.words_of(texts, W.ALNUM, lower=True)
    number, row = [words.hash], [words.row]
    for n in PREFIXES:
        long = np.flatnonzero(words.end - words.start > n)
        if len(long):
            window = texts.data[words.start[long][:, None] + np.arange(n)]
            window = W.LOWER[window].astype(np.uint64)
            key = (window << (np.arange(n, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)
            number.append(W.mixed(key, seed=n))
            row.append(words.row[long])
    return (np.concatenate(number) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(row)


def present(texts: W.Texts, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs in order; with kept, only those terms, by their index in it."""
    number, row = terms_of(texts)
    if kept is not None:
        sieve = np.full(1 << BITS, -1, np.int32)
        sieve[kept] = np.arange(len(kept))
        number = sieve[number]
        row, number = row[number >= 0], number[number >= 0].astype(np.int64)
    pair = np.unique((row.astype(np.int64) << 32) | number)
    return pair >> 32, pair & 0xFFFFFFFF


@dataclass
class Machine:
    terms: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.w0)
        if len(row):
            linear = np.bincount(row, self.w[term], n)
            total = np.stack([np.bincount(row, self.v[term, f], n) for f in range(self.v.shape[1])], 1)
            squares = np.bincount(row, (self.v[term] ** 2).sum(1), n)
            out += linear + 0.5 * ((total ** 2).sum(1) - squares)
        return out

    def score(self, texts: W.Texts) -> np.ndarray:
        row, term = present(texts, self.terms)
        return sigmoid(self.logits(row, term, len(texts)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def surprise(all_: Column, toxic: Column, n: int, n1: int) -> Column:
    """The G statistic of a term's presence against the label: in toxic of n1 labelled documents, in all_ of n."""
    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)
    cells = ((toxic, all_ * n1 / n), (all_ - toxic, all_ * (n - n1) / n), (n1 - toxic, (n - all_) * n1 / n), (n - n1 - all_ + toxic, (n - all_) * (n - n1) / n))
    return 2 * sum((part(seen.cast("double"), expected) for seen, expected in cells), F.lit(0.0))


def chosen(sample: DataFrame, least: float = LEAST, most: int = TERMS) -> np.ndarray:
    """Terms of (text, label) rows that go with the label; sorted. Terms are counted per task, and summed and ranked by Spark: at most
    `most` of them come to the driver."""
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            row, term = present(W.texts_of(batch.column("text")))
            hot = batch.column("label").to_numpy()[row] == 1
            number, place, count = np.unique(term, return_inverse=True, return_counts=True)
            yield pa.record_batch([pa.array(number), pa.array(count), pa.array(np.bincount(place[hot], minlength=len(number)))], names=["term", "n", "toxic"])
    counts = sample.mapInArrow(run, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    found = counts.filter("n >= 3").withColumn("g", surprise(F.col("n"), F.col("toxic"), n, n1)).filter(F.col("g") > least)
    return np.sort(np.array([r["term"] for r in found.orderBy(F.desc("g"), "term").limit(most).select("term").collect()], np.int64))


def train(label: np.ndarray, row: np.ndarray, term: np.ndarray, terms: np.ndarray, seed: int = 0) -> Machine:
    """label per document; distinct (row, term) pairs in order of rows, term being a place in terms."""
    row, term = row.astype(np.int64), term.astype(np.int64)
    start = np.searchsorted(row, np.arange(len(label) + 1))
    rng = np.random.default_rng(seed)
    m = Machine(terms, 0.0, np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS)))
    state = {k: [0.0, 0.0] for k in ("w0", "w", "v")}
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            docs = order[at:at + BATCH]
            length = start[docs + 1] - start[docs]
            where = np.repeat(start[docs] - np.cumsum(length) + length, length) + np.arange(length.sum())
            r, f = np.repeat(np.arange(len(docs)), length), term[where]
            miss = (sigmoid(m.logits(r, f, len(docs))) - label[docs]) / len(docs)
            total = np.zeros((len(docs), FACTORS))
            np.add.at(total, r, m.v[f])
            gw, gv = np.bincount(f, miss[r], len(terms)), np.zeros_like(m.v)
            np.add.at(gv, f, miss[r][:, None] * (total[r] - m.v[f]))
            t += 1
            for name, grad in (("w0", miss.sum()), ("w", gw + DECAY * m.w), ("v", gv + DECAY * m.v)):
                s = state[name]
                s[0], s[1] = 0.9 * s[0] + 0.1 * grad, 0.999 * s[1] + 0.001 * grad ** 2
                move = STEP * (s[0] / (1 - 0.9 ** t)) / (np.sqrt(s[1] / (1 - 0.999 ** t)) + 1e-8)
                setattr(m, name, getattr(m, name) - move)
    return m


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = PER_LABEL) -> Machine | None:
    """A machine learnt from labelled documents outside the held-out fold; None without any."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label is not null")
    known = known.filter(~folds.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = stored(folds.sampled(known, "label", per_label))
    sample = stored(folds.one_text_each(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(side(picked), "doc_id")))
    terms = chosen(sample)
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            row, term = present(W.texts_of(batch.column("text")), sent.value)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.record_batch([batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array([term[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())],
                                  names=["doc_id", "label", "terms"])
    got = sample.mapInArrow(run, "doc_id string, label int, terms binary").orderBy("doc_id").toArrow()
    if not got.num_rows:
        return None
    column = got.column("terms").combine_chunks()
    texts = W.texts_of(column)                                  # the bytes of all documents' terms, without a copy
    row = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(texts.bounds) // 4)
    y = (got.column("label").to_numpy() == 1).astype(np.int64)
    return train(y, row, texts.data.view("<i4"), terms)


def _scored(docs: DataFrame, machine: Machine | None, text: str, name: str) -> DataFrame:
    """docs with a score column."""
    if machine is None:
        return docs.withColumn(name, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text):
            yield pa.record_batch([*batch.columns, pa.array(sent.value.score(W.texts_of(batch.column(text))))], names=[*batch.schema.names, name])
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, machine: Machine | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: held_out, score and predicted."""
    rows = _scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), machine, "text", "score")
    return rows.select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, machine: Machine | None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without those that score threshold or more."""
    carried = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    rows = _scored(docs.select(*[F.col(c).alias(k) for c, k in carried.items()]), machine, carried[text], "_score")
    return rows.filter(F.col("_score") < threshold).select(*[F.col(k).alias(c) for c, k in carried.items()])
