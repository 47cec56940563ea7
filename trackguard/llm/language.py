"""Language identification by a byte convolutional network, trained in numpy on labelled text.

A text is cut into windows of LENGTH bytes (A-Z lower-cased, the last padded with zero bytes). Filters of 2, 3 and 4 bytes slide
over a window; the largest response of each filter goes through a ramp into a softmax over the languages seen in training. Every
window of the whole text counts: its probabilities are averaged, weighted by its bytes of letters. The language with the largest
average is the prediction, the average its score.

The model learns from about PER_LABEL documents of each language (chosen by the hash of the id), of each up to TAKEN windows.

Defined results: null texts and texts without letters are `und` with score 0, and so is every text when there is nothing to learn from;
ties go to the language first by code point; rows are judged one by one; empty tables give empty results; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from trackguard.llm import folds, words as W
from trackguard.llm.sides import side
from trackguard.session import stored

PER_LABEL, TAKEN = 1_000, 4
LENGTH = 256
WIDTHS, FILTERS = (2, 3, 4), 12
EPOCHS, BATCH, STEP = 4, 64, 0.01
NONE = "und"
WINDOWS_AT_ONCE = 4096
_LETTERS = W.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_ASCII_LETTERS = W.byte_class((0x41, 0x5A), (0x61, 0x7A))
_LETTER = regex.compile(r"\p{L}")


def windows(texts: W.Texts, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as rows of bytes, and the text each is of."""
    size = np.diff(texts.bounds)
    per = -(-size // length)
    row = np.repeat(np.arange(len(texts)), per)
    begin = texts.bounds[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * length
    out = np.zeros((len(row), length), np.uint8)
    for k in range(0, len(row), WINDOWS_AT_ONCE):               # the places of all windows would take many times the text
        part = slice(k, k + WINDOWS_AT_ONCE)
        at = begin[part, None] + np.arange(length)
        inside = at < texts.bounds[row[part] + 1][:, None]
        out[part] = np.where(inside, W.LOWER[texts.data[np.minimum(at, len(texts.data) - 1)]], 0)
    return out, row


@dataclass
class Network:
    labels: list[str]
    filters: list[np.ndarray]       # per width: (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray                 # (all filters, labels)
    out_bias: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """The filters as tables over pairs of bytes (and a single byte at the end of odd widths): the responses are the same, with
        fewer look-ups."""
        tables = []
        for f in self.filters:
            own = [np.ascontiguousarray((f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1)) for k in range(0, len(f) - 1, 2)]
            tables.append(own + ([np.ascontiguousarray(f[-1])] if len(f) % 2 else []))
        return tables

    def probabilities(self, data: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pair = (data[:, :-1].astype(np.int32) << 8) | data[:, 1:]
        pooled = []
        for f, own in zip(self.filters, tables):
            n = data.shape[1] - len(f) + 1
            total = own[0][pair[:, :n]]
            for k, t in enumerate(own[1:], 1):
                total += t[pair[:, 2 * k:2 * k + n] if len(t) > 256 else data[:, 2 * k:2 * k + n]]
            pooled.append(total.max(1))
        return softmax(np.maximum(np.concatenate(pooled, 1) + self.bias, 0) @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Adam:
    def __init__(self, values: list[np.ndarray], step: float):
        self.values, self.step, self.t = values, step, 0
        self.m, self.s = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]

    def move(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for v, g, m, s in zip(self.values, grads, self.m, self.s):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= self.step * (m / (1 - 0.9 ** self.t)) / (np.sqrt(s / (1 - 0.999 ** self.t)) + 1e-7)


def train(data: np.ndarray, label: np.ndarray, labels: list[str], seed: int = 0) -> Network:
    """Windows and the number of each one's label. Max pooling sends a filter's gradient to the one place that responded most."""
    rng = np.random.default_rng(seed)
    net = Network(labels, [rng.normal(0, 0.2, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32),
                  rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    adam = Adam([*net.filters, net.bias, net.out, net.out_bias], STEP)
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            x, y = data[order[at:at + BATCH]], label[order[at:at + BATCH]]
            best, pooled = [], []
            for f in net.filters:
                n = x.shape[1] - len(f) + 1
                total = sum(f[k][x[:, k:k + n]] for k in range(len(f)))
                best.append(total.argmax(1))
                pooled.append(np.take_along_axis(total, best[-1][:, None, :], 1)[:, 0])
            raw = np.concatenate(pooled, 1) + net.bias
            hidden = np.maximum(raw, 0)
            miss = softmax(hidden @ net.out + net.out_bias)
            miss[np.arange(len(y)), y] -= 1
            miss /= len(y)
            back = (miss @ net.out.T) * (raw > 0)
            grads = []
            for j, (f, where) in enumerate(zip(net.filters, best)):
                g, own = np.zeros_like(f), back[:, j * FILTERS:(j + 1) * FILTERS]
                for k in range(len(f)):
                    np.add.at(g[k], (np.take_along_axis(x, where + k, 1), np.arange(FILTERS)), own)
                grads.append(g)
            adam.move([*grads, back.sum(0), hidden.T @ miss, miss.sum(0)])
    return net


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = PER_LABEL) -> Network | None:
    """A network learnt from labelled documents outside the held-out fold; None without any."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("label"))
    rows = rows.filter(~folds.held_out(F.col("doc_id")) & F.col("label").isNotNull() & F.col("text").isNotNull())
    picked = folds.sampled(rows.groupBy("doc_id").agg(F.min("label").alias("label")), "label", per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            data, row = windows(W.texts_of(batch.column("text")))
            per = np.bincount(row, minlength=batch.num_rows)
            turn = np.arange(len(row)) - (np.cumsum(per) - per)[row]
            keep = (turn * TAKEN) // np.maximum(per[row], TAKEN) != ((turn - 1) * TAKEN) // np.maximum(per[row], TAKEN)    # spread over the text
            yield pa.record_batch([batch.column("doc_id").cast(pa.string()).take(pa.array(row[keep])), batch.column("label").take(pa.array(row[keep])), pa.array([w.tobytes() for w in data[keep]], pa.binary())],
                                  names=["doc_id", "label", "window"])
    sample = folds.one_text_each(rows.drop("label").join(side(stored(picked)), "doc_id"))
    got = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id string, label string, window binary").orderBy("doc_id", "window").toArrow()
    if not got.num_rows:
        return None
    label = got.column("label").to_pylist()
    labels = sorted(set(label))
    data = np.frombuffer(b"".join(got.column("window").to_pylist()), np.uint8).reshape(-1, LENGTH)
    return train(data, np.array([labels.index(x) for x in label]), labels)


def _judged(texts: W.Texts, net: Network, tables: list[list[np.ndarray]]) -> tuple[list[str], np.ndarray]:
    data, row = windows(texts)
    total, weight = np.zeros((len(texts), len(net.labels))), np.zeros(len(texts))
    for at in range(0, len(row), 128):
        part, own = data[at:at + 128], row[at:at + 128]
        letters = _LETTERS[part].sum(1)
        np.add.at(total, own, net.probabilities(part, tables) * letters[:, None])
        np.add.at(weight, own, letters)
    plain = np.zeros(len(texts), bool)
    if len(row):
        np.logical_or.at(plain, row, _ASCII_LETTERS[data].any(1))
    for i in np.flatnonzero(~plain & (weight > 0)):
        plain[i] = _LETTER.search(texts.raw(i).decode()) is not None
    mean = total / np.maximum(weight, 1)[:, None]
    best = mean.argmax(1)
    score = np.where(plain, np.clip(mean[np.arange(len(mean)), best], 0, 1), 0.0)
    return [net.labels[b] if p else NONE for b, p in zip(best, plain)], score


def predict(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: held_out, lang_pred and score."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if net is None:
        return rows.select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in W.pieces(batches, "text"):
            tables = tables or sent.value.pairs()
            lang, score = _judged(W.texts_of(batch.column("text")), sent.value, tables)
            yield pa.record_batch([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
