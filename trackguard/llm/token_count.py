"""Token counts of whole texts for a BPE tokenizer file with word ends, by rank-synchronous merging of ragged arrays.

All pre-tokens of a batch lie in one flat array of symbols. In every round each pre-token's lowest-rank pair is merged wherever it
occurs (from the left, without overlap), for all pre-tokens at once; those without a pair in the merge table leave. What is left of a
pre-token is its number of tokens. The merges are read from the tokenizer's file; the library only normalizes and splits text beyond
Latin letters. Distinct chunks (words between white space) of a batch are counted once and remembered up to a bound.

A special string inside a text is one token, as the library's default has it. Defined results: null counts as an empty text with no
tokens; empty tables give empty results; repeated rows are counted one by one; other columns of the input are ignored."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from trackguard.llm import chunks, words as W

KEPT = 150_000
#: Below this code point (but for the dotted capital I) text is its own composed form and lower case needs no context.
_LATIN = regex.compile(r"[\u0000-įı-ɏ]*")
_NONE = np.iinfo(np.int64).max


class Merger:
    """The merge table of a file, and the counting of pre-tokens given as bytes."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letter = byte_letters()
        self.inner = np.array([vocab[c] for c in letter], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letter], np.int64)
        self.size = max(vocab.values()) + 1
        pair = np.array([vocab[a] * self.size + vocab[b] for a, b in model["merges"]], np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        order = np.argsort(pair)
        self.pair, self.rank, self.made = pair[order], order, made          # made is by rank

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """The number of tokens of each pre-token (none is empty)."""
        out = np.zeros(len(tokens), np.int64)
        if not tokens:
            return out
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        data = np.frombuffer(b"".join(tokens), np.uint8)
        symbol = self.inner[data]
        end = np.cumsum(length)
        symbol[end - 1] = self.final[data[end - 1]]
        owner = np.repeat(np.arange(len(tokens)), length)
        rank = np.full(len(symbol), _NONE)
        self._rank(rank, symbol, owner, np.arange(len(symbol)))
        while len(symbol):
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            span = np.diff(np.append(start, len(symbol)))
            best = np.minimum.reduceat(rank, start)
            done = best == _NONE
            out[owner[start[done]]] = span[done]
            lowest = np.repeat(best, span)
            merge = (rank == lowest) & (rank != _NONE)
            where = np.flatnonzero(merge)
            if len(where):
                # of neighbouring places (a pair of equal symbols) every second one merges
                fresh = np.concatenate([[True], where[1:] != where[:-1] + 1])
                run = np.arange(len(where)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                where = where[run % 2 == 0]
                symbol[where] = self.made[rank[where]]
            keep = ~np.repeat(done, span)
            keep[where + 1] = False
            changed = (np.cumsum(keep) - 1)[where]
            symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
            self._rank(rank, symbol, owner, np.concatenate([changed, changed[changed > 0] - 1]))
        return out

    def _rank(self, rank: np.ndarray, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> None:
        """Writes the rank of the pairs that begin at these places."""
        rank[at] = _NONE
        at = at[at < len(symbol) - 1]
        at = at[owner[at] == owner[at + 1]]
        key = symbol[at] * self.size + symbol[at + 1]
        place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[place] == key
        rank[at[hit]] = self.rank[place[hit]]


def byte_letters() -> list[str]:
    """The characters by which byte-level vocabularies write the 256 bytes: printable Latin-1 stands for itself, the others are
    numbered from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts the tokens of texts for one tokenizer file."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library, self.merger, self.kept = Tokenizer.from_file(path), Merger(spec), kept
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.byte = {c: b for b, c in enumerate(byte_letters())}
        self.known: dict[bytes, int] = {}

    def _pre_tokens(self, text: str) -> list[bytes]:
        if _LATIN.fullmatch(text):
            return [t.encode() for t in self.split.findall(text.lower())]
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, t)) for t, _ in split]

    def _learn(self, found: list[bytes]) -> None:
        tokens, number, owner = [], {}, []
        extra = np.zeros(len(found), np.int64)
        for k, chunk in enumerate(found):
            text = chunk.decode().strip(" \t\n\r\x0b\x0c")
            if "<" in text or self.special.search(text):
                extra[k] = len(self.special.findall(text))
                parts = self.special.split(text)
            else:
                parts = [text]
            for part in parts:
                for t in self._pre_tokens(part) if part else ():
                    owner.append((k, number.setdefault(t, len(number))))
        tokens = self.merger.count(list(number))
        if owner:
            k, t = np.array(owner, np.int64).T
            np.add.at(extra, k, tokens[t])
        self.known.update(zip(found, extra.tolist()))

    def count(self, texts: W.Texts) -> np.ndarray:
        found, code, per_text = chunks.distinct(texts, chunks.word_starts(texts))
        if len(self.known) + len(found) > self.kept:
            self.known.clear()
        self._learn([c for c in found if c not in self.known])
        each = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        return chunks.sums(each[code] if found else code, per_text)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether they exceed the limit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = W.kept_in_process(("token counts", tokenizer), lambda: Counter(tokenizer))
        for batch in W.pieces(batches, "text"):
            texts = W.texts_of(batch.column("text"))
            n = counter.count(texts)
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(texts.bounds)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
