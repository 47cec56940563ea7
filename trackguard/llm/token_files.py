"""Token ids in binary files of Simple-8b blocks, in ascending order of document id.

`write` range-partitions the documents by id, encodes whole texts with a tokenizers file, ends each document with `end_id`, and
writes one file per partition. Its result is the index: one row per file (part, uri, n_docs, n_ids, n_bytes). `read` and
`digests` go back from the files alone.

File: MAGIC; blocks of BLOCK ids (the last of a file has fewer; a document may span blocks), each a header (ids, words: uint32)
and little-endian words of `simple8b`; then the document table (ids and token counts, int64; a presence byte each) and the table of
block offsets (int64); then, in the last 32 bytes, the place of the tables, the numbers of documents and blocks, and MAGIC.

Every distinct chunk of a batch (a blank with the word behind it) is encoded once, and kept for the next batches and tasks of the worker
process up to a bound.

Defined results: null text is an empty text, whose only id is end_id; documents without id come first; rows that repeat an id
follow each other by the hash of their text; an empty table gives an empty index and no files. Other columns are ignored."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from trackguard.llm import binfiles, chunks, simple8b, words as W
from trackguard.llm.token_count import byte_letters
from trackguard.session import stored

MAGIC = b"TGS8BID1"
BLOCK = 1 << 16
END_ID = 2
KEPT = 500_000          # distinct chunks that a worker process remembers
INDEX = "part int, uri string, n_docs long, n_ids long, n_bytes long"


class Encoder:
    """Ids of texts by the library, chunk by chunk. What begins with white space behind other text begins a token, so the ids of
    the chunks are the ids of the text."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()             # one letter a byte
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = list(map(len, vocabulary))
        self.feed = vocabulary[byte_letters()[0x0A]]
        self.remembered = chunks.Remembered(self._made, kept)

    def encode(self, texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        found, code, per_text = chunks.distinct_column(texts, chunks.token_edges(texts))
        ids, length = self.remembered.ids(found, code)
        return ids, chunks.sums(length, per_text)

    def _made(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk, by the library. Words of Latin letters go to it as one long text, in which a blank or a line feed parts them:
        no token crosses those, so the bytes of the tokens tell where a word ends. Other chunks are texts of their own."""
        texts = [c.decode() for c in new]
        kind = np.fromiter((self._kind(c, t) for c, t in zip(new, texts)), np.int8, len(new))
        size = np.fromiter(map(len, new), np.int64, len(new))
        where, ids, length = [], [], []
        for k, joint in ((1, ""), (2, "\n")):
            mine = np.flatnonzero(kind == k)
            if len(mine):
                e = self.tokenizer.encode_batch_fast([joint.join([texts[i] for i in mine.tolist()])], add_special_tokens=False)[0]
                got = np.array(e.ids, np.uint32)
                end = np.cumsum(self.size[got])
                word = np.searchsorted(np.cumsum(size[mine] + len(joint)), end - 1, "right")
                inside = got != self.feed if joint else np.ones(len(got), bool)
                where.append(mine)
                ids.append(got[inside])
                length.append(np.bincount(word[inside], minlength=len(mine)))
        mine = np.flatnonzero(kind == 0)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in mine.tolist()], add_special_tokens=False)]
        where.append(mine)
        ids.append(np.fromiter((i for own in rest for i in own), np.uint32))
        length.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        where, ids, length = np.concatenate(where), np.concatenate(ids), np.concatenate(length).astype(np.int64)
        order = np.argsort(where)
        start = np.cumsum(length) - length
        return ids[chunks.spread(start[order], length[order])], length[order]

    @staticmethod
    def _kind(chunk: bytes, text: str) -> int:
        """1: a blank and a word of Latin letters; 2: such a word alone; 0: anything else."""
        blank = chunk[:1] == b" "
        word = text[1:] if blank else text
        return (1 if blank else 2) if word.isalpha() and (chunk.isascii() or max(word) < "\u0250") else 0


class File:
    """One open file of blocks."""

    def __init__(self, uri: str):
        self.uri, self.out = uri, binfiles.writer(uri)
        self.out.write(MAGIC)
        self.at, self.rest, self.held = len(MAGIC), [], 0
        self.doc_id, self.present, self.count, self.offset = [], [], [], []

    def add(self, doc_id: pa.Array, ids: np.ndarray, count: np.ndarray) -> None:
        self.present.append(np.asarray(doc_id.is_valid()))
        self.doc_id.append(doc_id.fill_null(0).to_numpy().astype("<i8"))
        self.count.append(count.astype("<i8"))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ids, at = np.concatenate(self.rest), 0
            for at in range(0, len(ids) - BLOCK + 1, BLOCK):
                self._block(ids[at:at + BLOCK])
            self.rest = [ids[at + BLOCK:]]
            self.held = len(self.rest[0])

    def _block(self, ids: np.ndarray) -> None:
        coded = simple8b.encode(ids)
        self.offset.append(self.at)
        self.out.write(struct.pack("<II", len(ids), len(coded)))
        self.out.write(coded.astype("<u8").tobytes())
        self.at += 8 + 8 * len(coded)

    def close(self) -> tuple[str, int, int, int]:
        if self.held:
            self._block(np.concatenate(self.rest))
        doc_id, present, count = np.concatenate(self.doc_id), np.concatenate(self.present), np.concatenate(self.count)
        for table in (doc_id, count, present.astype("u1"), np.array(self.offset, "<i8")):
            self.out.write(table.tobytes())
        self.out.write(struct.pack("<qqq", self.at, len(doc_id), len(self.offset)) + MAGIC)
        self.out.close()
        return self.uri, len(doc_id), int(count.sum()), self.at + 17 * len(doc_id) + 8 * len(self.offset) + 32


def write(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the files; returns their index, itself a stored table."""
    folder = binfiles.new_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = W.kept_in_process(("token ids", tokenizer), lambda: Encoder(tokenizer)), None
        for batch in W.pieces(batches, "text"):
            file = file or File(binfiles.new_file(folder, ".s8b"))
            ids, count = encoder.encode(W.texts_of(batch.column("text")))
            ids = np.insert(ids, np.cumsum(count), end_id)
            file.add(batch.column("doc_id"), ids, count + 1)
        if file:
            uri, n_docs, n_ids, n_bytes = file.close()
            yield pa.record_batch([pa.array([x], t) for x, t in ((TaskContext.get().partitionId(), pa.int32()), (uri, pa.string()), (n_docs, pa.int64()), (n_ids, pa.int64()), (n_bytes, pa.int64()))],
                                  names=["part", "uri", "n_docs", "n_ids", "n_bytes"])
    return stored(rows.mapInArrow(run, INDEX))


def _opened(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[np.ndarray]]]:
    """Document ids, presence, token counts, and an iterator over the blocks' ids."""
    with binfiles.reader(uri) as f:
        f.seek(f.size() - 32)
        at, n_docs, n_blocks = struct.unpack("<qqq", f.read(24))
        if f.read(8) != MAGIC:
            raise ValueError(f"{uri} is not a file of token ids")
        f.seek(at)
        table = f.read(17 * n_docs + 8 * n_blocks)
        doc_id, count = np.frombuffer(table, "<i8", n_docs), np.frombuffer(table, "<i8", n_docs, 8 * n_docs)
        present, offset = np.frombuffer(table, "u1", n_docs, 16 * n_docs).astype(bool), np.frombuffer(table, "<i8", n_blocks, 17 * n_docs)

        def blocks() -> Iterator[np.ndarray]:
            for o in offset.tolist():
                f.seek(o)
                n, n_words = struct.unpack("<II", f.read(8))
                yield simple8b.decode(np.frombuffer(f.read(8 * n_words), "<u8"), n).astype("<u4")
        yield doc_id, present, count, blocks()


def _parts(uri: str) -> Iterator[tuple[int | None, np.ndarray, bool]]:
    """(document id, some of its ids, whether they are its last), in order."""
    for doc_id, present, count, blocks in _opened(uri):
        end, doc, at = np.cumsum(count), 0, 0
        for ids in blocks:
            to = at + len(ids)
            while doc < len(end) and at < to:
                b = min(int(end[doc]), to)
                last = b == end[doc]
                yield (int(doc_id[doc]) if present[doc] else None), ids[len(ids) - (to - at):len(ids) - (to - b)], bool(last)
                at, doc = b, doc + bool(last)


def _files(index: DataFrame) -> DataFrame:
    """One partition per file, with the number of ids in all files before it."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = index.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    return files.select("part", "uri", "before").repartitionByRange(max(1, index.count()), "part").select("uri", "before")


def read(index: DataFrame) -> DataFrame:
    """doc_id and ids of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                held = []
                for doc, ids, last in _parts(uri):
                    held.append(ids)
                    if last:
                        yield pa.record_batch([pa.array([doc], pa.int64()), pa.array([np.concatenate(held).astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "ids"])
                        held = []
    return _files(index).mapInArrow(run, "doc_id long, ids array<long>")


def digests(index: DataFrame) -> DataFrame:
    """Per document: the ids before it in all files, its number of ids, and their CRC-32 as little-endian 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("before").to_pylist()):
                out, n, crc = [], 0, 0
                for doc, ids, last in _parts(uri):
                    n, crc = n + len(ids), zlib.crc32(ids, crc)
                    if last:
                        out.append((doc, start, n, crc))
                        start, n, crc = start + n, 0, 0
                    if len(out) == 4096:
                        yield _rows(out)
                        out = []
                yield _rows(out)
    return _files(index).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=names)
