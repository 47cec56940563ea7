"""Encoding and decoding with a sentencepiece BPE model (byte fallback, no normalization), by vectorised merge rounds.

A text gets a blank in front and is cut wherever no piece of the model has the two neighbouring characters side by side; no merge
crosses such a place. The distinct chunks of a batch are encoded together: their symbols lie in one flat array; in every round each
chunk merges the places of its best-scored pair at once, from the left, and the arrays are compacted, until no pair is left. Where such
a merge would make a pair that is at least as good (only then the order of equal pairs matters), the chunk merges its leftmost place
alone. That is the order in which the library takes its pairs. What is then no piece becomes its UTF-8 bytes.

Decoding joins the bytes of the pieces, without the first blank; bytes that are no UTF-8 become U+FFFD, one each.

Defined results: null counts as an empty text, which has the begin and end ids alone; repeated rows are encoded one by one; empty tables
give empty results; other columns of the input are ignored."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackguard.llm import chunks, words as W

KEPT = 300_000                      # distinct chunks that a worker process remembers
SPACE, BLANK = "▁", 0x20       # the model's letter for a blank
_NONE = np.iinfo(np.int32).max
_PROBE = ("Ａ  b ", "▁Ａ▁▁b▁")
codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class Codec:
    def __init__(self, path: str, kept: int = KEPT):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(_PROBE[0]) != _PROBE[1]:
            raise ValueError(f"{path} normalizes texts; only models that put a blank in front and change nothing else are supported")
        size = self.size = model.vocab_size()
        piece = [model.id_to_piece(i) for i in range(size)]
        kind = ["byte" if model.is_byte(i) else "control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "piece" for i in range(size)]
        self.begin, self.end = model.bos_id(), model.eos_id()
        own = {p: i for i, p in enumerate(piece) if kind[i] == "piece"}
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self._merges(own, [model.get_score(i) for i in range(size)])
        self._neighbours(own)
        raw = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "piece" else " ⁇ ".encode() if k == "unknown" else b"" for p, k in zip(piece, kind)]
        self.raw_length = np.fromiter(map(len, raw), np.int64, size)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.silent = np.array([k == "control" for k in kind])
        self.spaced = np.array([k == "piece" and p.startswith(SPACE) for p, k in zip(piece, kind)])
        self.is_byte = np.array([k == "byte" for k in kind])
        self.remembered = chunks.Remembered(self.encode_chunks, kept)

    def _merges(self, own: dict[str, int], score: list[float]) -> None:
        """Every way to make a piece of two symbols, by pair; equal scores have equal ranks. Characters of pieces that are no piece
        themselves are symbols beyond the vocabulary."""
        letters = sorted({c for p in own for c in p})
        extra = {c: self.size + k for k, c in enumerate(c for c in letters if c not in own)}
        self.symbols = self.size + len(extra) + 1           # the last one stands for any other character
        symbol = own | extra
        order = {s: k for k, s in enumerate(sorted({score[i] for i in own.values()}, reverse=True))}
        rows = sorted((symbol[p[:k]] * self.symbols + symbol[p[k:]], order[score[i]], i) for p, i in own.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self.pair, self.rank, self.made = (np.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (np.int64, np.int32, np.int64)))
        self.letter = np.array([ord(c) for c in letters] + [0x110000], np.uint32)
        self.letter_symbol = np.array([symbol[c] for c in letters] + [self.symbols - 1], np.int64)

    def _neighbours(self, own: dict[str, int]) -> None:
        """Which bytes may stand side by side at the bound of two characters that a piece has side by side."""
        self.joined = np.zeros((256, 256), bool)
        ways = {SPACE: (b" ", SPACE.encode())}
        for a, b in {(p[k], p[k + 1]) for p in own for k in range(len(p) - 1)}:
            for x in ways.get(a, (a.encode(),)):
                for y in ways.get(b, (b.encode(),)):
                    self.joined[x[-1], y[0]] = True

    # encoding

    def encode(self, texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with begin and end, and how many each text has."""
        filled = np.diff(texts.bounds) > 0
        data = np.insert(texts.data, texts.bounds[:-1][filled], BLANK)
        bounds = texts.bounds + np.concatenate([[0], np.cumsum(filled)])
        cuts = np.flatnonzero(~self.joined[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)) + 1 if len(data) else np.zeros(0, np.int64)
        found, code, per_text = chunks.distinct_column(W.Texts(data, bounds), cuts)
        ids, length = self.remembered.ids(found, code)
        count = chunks.sums(length, per_text)
        end = np.cumsum(count)
        out = np.insert(ids, np.stack([end - count, end], 1).ravel(), np.tile(np.array([self.begin, self.end], np.uint32), len(count)))
        return out, count + 2

    def encode_chunks(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(found)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        owner = (np.searchsorted(bounds, np.flatnonzero(lead), "right") - 1).astype(np.int64)
        point = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        point = np.where(point == BLANK, np.uint32(ord(SPACE)), point)
        place = np.searchsorted(self.letter, point)
        symbol = self.letter_symbol[np.where(self.letter[place] == point, place, len(self.letter) - 1)]
        symbol, owner, at = self._merged(symbol, owner)
        unknown = symbol >= self.size                       # as many ids as the character has bytes
        wide = point[at]
        length = np.where(unknown, 1 + (wide >= 0x80) + (wide >= 0x800) + (wide >= 0x10000), 1)
        ids = np.repeat(symbol, length)
        if unknown.any():
            spelled = np.frombuffer(wide[unknown].tobytes().decode("utf-32-le").encode(), np.uint8)
            ids[np.repeat(unknown, length)] = self.byte[spelled]
        return ids, np.bincount(np.repeat(owner, length), minlength=len(found)).astype(np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE if no piece) and result of pairs."""
        if not len(self.pair):
            return np.full(len(left), _NONE, np.int32), np.zeros(len(left), np.int64)
        key = left * self.symbols + right
        place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[place] == key, self.rank[place], _NONE), self.made[place]

    def _merged(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols that no merge is left for, whose they are, and where each began."""
        at = np.arange(len(symbol))
        rank, made = self._lookup(symbol, np.append(symbol[1:], 0))
        rank[np.append(owner[1:] != owner[:-1], True)] = _NONE
        done = []
        while len(symbol):
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            span = np.diff(np.append(start, len(symbol)))
            best = np.minimum.reduceat(rank, start)
            ready = np.repeat(best == _NONE, span)
            if ready.any():
                done.append((symbol[ready], owner[ready], at[ready]))
                symbol, owner, at, rank, made = (x[~ready] for x in (symbol, owner, at, rank, made))
                span, best = span[best != _NONE], best[best != _NONE]
                if not len(symbol):
                    break
            word = np.repeat(np.arange(len(span)), span)
            where = np.flatnonzero(rank == best[word])
            fresh = np.concatenate([[True], where[1:] != where[:-1] + 1])        # of overlapping places every second one
            where = where[(np.arange(len(where)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            where = self._safe(symbol, word, best, made, where)
            symbol[where] = made[where]
            keep = np.ones(len(symbol), bool)
            keep[where + 1] = False
            new = (np.cumsum(keep) - 1)[where]
            symbol, owner, at, rank, made = (x[keep] for x in (symbol, owner, at, rank, made))
            changed = np.zeros(len(symbol), bool)
            changed[new] = changed[np.maximum(new - 1, 0)] = True
            touched = np.flatnonzero(changed)
            right = np.minimum(touched + 1, len(symbol) - 1)
            rank[touched], made[touched] = self._lookup(symbol[touched], symbol[right])
            rank[touched[(right == touched) | (owner[right] != owner[touched])]] = _NONE
        symbol, owner, at = (np.concatenate(c) for c in zip(*done)) if done else (symbol, owner, at)
        order = np.argsort(at)
        return symbol[order], owner[order], at[order]

    def _safe(self, symbol: np.ndarray, word: np.ndarray, best: np.ndarray, made: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The places without those that an earlier merge of the same word could forestall."""
        again = np.concatenate([[False], word[where[1:]] == word[where[:-1]]])
        several = np.zeros(len(best), bool)
        several[word[where[again]]] = True
        check = several[word[where]]
        if not check.any():
            return where
        last = len(symbol) - 1
        after = symbol.copy()                                # symbols left of a place once the merges there are done
        after[where + 1] = made[where]
        p = where[check]
        left, right = np.maximum(p - 1, 0), np.minimum(p + 2, last)
        near = np.where((p > 0) & (word[left] == word[p]), self._lookup(after[left], made[p])[0], _NONE)
        far = np.where((p + 2 <= last) & (word[right] == word[p]), self._lookup(made[p], symbol[right])[0], _NONE)
        bad = np.zeros(len(best), bool)
        bad[word[p[np.minimum(near, far) <= best[word[p]]]]] = True
        return where[~(again & bad[word[where]])]

    # decoding

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of runs of ids of the given lengths."""
        start, length = self.raw_start[ids].copy(), self.raw_length[ids].copy()
        text = np.repeat(np.arange(len(count)), count)
        loud = np.flatnonzero(~self.silent[ids])
        first = loud[np.concatenate([[True], text[loud[1:]] != text[loud[:-1]]])] if len(loud) else loud
        first = first[self.spaced[ids[first]]]
        start[first] += 1
        length[first] -= 1
        data = self.raw[chunks.spread(start, length)]
        bounds = np.concatenate([[0], np.cumsum(chunks.sums(length, count))]).tolist()
        out, end = [], np.cumsum(count)
        inner = self.silent[ids]                            # a control id inside a text parts the bytes around it
        inner[np.concatenate([end[count > 0] - 1, (end - count)[count > 0]])] = False
        parted = set(text[inner].tolist())
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            raw = data[a:b].tobytes()
            try:
                good = k not in parted and raw.decode() is not None
            except UnicodeDecodeError:
                good = False
            if not good:
                mine = slice(end[k] - count[k], end[k])
                raw = self._mended(ids[mine], start[mine], length[mine])
            out.append(raw)
        return out

    def _mended(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> bytes:
        """A text some of whose byte pieces are no UTF-8."""
        fallback, out = self.is_byte[ids], []
        cut = np.concatenate([[0], np.flatnonzero(fallback[1:] != fallback[:-1]) + 1, [len(ids)]])
        for a, b in zip(cut, cut[1:]):
            out.append(self.raw[chunks.spread(start[a:b], length[a:b])].tobytes().decode("utf-8", "each_byte" if fallback[a] else "strict"))
        return "".join(out).encode()


def _codec(path: str) -> Codec:
    return W.kept_in_process(("sentence pieces", path), lambda: Codec(path))


def _mapped(rows: DataFrame, model: str, columns: dict[str, pa.DataType], schema: str, each) -> DataFrame:
    """doc_id and the columns that each(codec, batch) gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in W.pieces(batches, "text"):
            made = each(codec, batch)
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(x, t) for x, t in zip(made, columns.values())]], names=["doc_id", *columns])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def _ids(codec: Codec, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return codec.encode(W.texts_of(batch.column("text")))


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its ids."""
    def each(codec: Codec, batch: pa.RecordBatch):
        ids, count = _ids(codec, batch)
        return [np.split(ids.astype(np.int32), np.cumsum(count)[:-1])]
    return _mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, {"ids": pa.list_(pa.int32())}, "ids array<int>", each)


def decode(rows: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row the text of its ids; null ids give an empty text."""
    rows = rows.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            column = batch.column("ids")
            texts = codec.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy()).astype(np.int64))
            yield pa.record_batch([batch.column("doc_id"), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its number of ids, the SHA-256 of the ids as little-endian 32-bit integers, and that of the text they decode to."""
    def each(codec: Codec, batch: pa.RecordBatch):
        ids, count = _ids(codec, batch)
        flat, end = ids.astype("<u4"), np.cumsum(count)
        return (count, [hashlib.sha256(flat[b - n:b]).hexdigest() for b, n in zip(end.tolist(), count.tolist())],
                [hashlib.sha256(t).hexdigest() for t in codec.decode(ids, count)])
    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, columns, "n_tokens long, ids_sha256 string, decoded_sha256 string", each)
