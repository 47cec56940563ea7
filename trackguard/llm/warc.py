"""WARC archives: written with an index, read back by coalesced byte ranges.

`write` stores one gzip-compressed archive per task (one gzip member per record) and returns the index: for every record its page,
type, file, offset, length, URL and payload digest. `read` takes any selection of index rows, sorts them by file and offset, joins
neighbouring records into one read, and parses what the archive holds.

Of pages with equal payloads of at least SMALL bytes, the one with the smallest page id is a `response`, the others are `revisit`
records without a payload that refer to it. Equality is that of the SHA-256 digest.

Defined results: null html is an empty payload; a page without id is always a response and is never referred to; rows that repeat the
smallest id of a group are all responses; null or odd URLs are written with control characters escaped, null without the header; an
empty table gives an empty index. Columns other than id, URL and html are ignored."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackguard.llm import binfiles
from trackguard.llm.sides import side
from trackguard.session import stored

SMALL = 100
DATE = "1970-01-01T00:00:00Z"       # the tables have no capture time
INDEX = "page_id long, url string, record_type string, payload_digest string, uri string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Records closer than GAP are read in one go, up to READ bytes.
GAP, READ = 64 << 10, 8 << 20
SPAN = 32 << 20                     # bytes of archives that one task reads, about
_PAGE = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LEVEL = 4


def _block(page_id: int | None, url: str | None, kind: str, digest: str, refers_to: int | None, n_bytes: int, payload: bytes) -> bytes:
    """One record, as WARC 1.1 has it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_PAGE}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def _escaped(url: str) -> str:
    """Control characters, blanks at the ends and percent signs before them would not survive a header line."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: quote(m[0], safe=""), url)


def _parsed(block: bytes) -> tuple:
    """What one record says, with its payload. The digest of a response is computed from the payload and must be the one it names."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) for line in lines[1:])
    body = body[:int(field["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    n_bytes = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = field["WARC-Payload-Digest"].removeprefix("sha256:"), field["WARC-Type"]
    if kind == "response" and (len(payload) != n_bytes or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {field['WARC-Record-ID']} does not match its digest")
    page, target = _page(field["WARC-Record-ID"]), _page(field["WARC-Refers-To"]) if kind == "revisit" else None
    url = unquote(field["WARC-Target-URI"]) if "WARC-Target-URI" in field else None
    return page, url, kind, target, n_bytes, digest, payload if kind == "response" else None


def _page(urn: str) -> int | None:
    number = urn.strip("<>").removeprefix(_PAGE)
    return int(number) if number else None


def typed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses). Only digests that several pages share are joined back; as a
    broadcast while their table is small, else by a shuffle."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    shared = (rows.filter((F.octet_length("html") >= SMALL) & F.col("page_id").isNotNull()).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    shared = stored(shared)
    out = rows.join(side(shared), "digest", "left")
    return out.withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first"))).drop("first")


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives; returns the index as a stored table."""
    folder = binfiles.new_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at = None, "", 0
        for batch in batches:
            if out is None and batch.num_rows:
                uri = binfiles.new_file(folder, ".warc.gz")
                out = binfiles.writer(uri)
            rows = []
            for page, link, text, digest, target in zip(*[batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]):
                payload, page, target, kind = text.as_buffer().to_pybytes(), page.as_py(), target.as_py(), "response"
                if target is not None:
                    kind = "revisit"
                block = _block(page, link.as_py(), kind, digest.as_py(), target, len(payload), payload)
                packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(block) + packer.flush()
                out.write(member)
                rows.append((kind, at, len(member)))
                at += len(member)
            kind, offset, length = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(kind, pa.string()), batch.column("digest"), pa.array([uri] * len(rows), pa.string()),
                                   pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["page_id", "url", "record_type", "payload_digest", "uri", "offset", "length"])
        if out is not None:
            out.close()
    return stored(typed(pages, page_id, url, html).select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, INDEX))


def ranges(rows: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(uri, offset, length) in order, joined into reads of (uri, begin, end, records)."""
    uri, begin, end, held = "", 0, 0, []
    for u, offset, length in rows:
        if held and (u != uri or offset - end > gap or offset + length - begin > most):
            yield uri, begin, end, held
            held = []
        if not held:
            uri, begin = u, offset
        end = offset + length
        held.append((offset, length))
    if held:
        yield uri, begin, end, held


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records of these index rows, from the archives. Without payload the column is left out; it is verified all the same."""
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SPAN))
    part = index.select("uri", "offset", "length").repartition(tasks, "uri", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("uri", "offset")
    schema = RECORD if payload else RECORD.replace(", payload binary", "")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("uri", "offset", "length")]))
        opened, file = "", None
        for uri, begin, end, records in ranges(rows):
            if uri != opened:
                opened, file = uri, binfiles.reader(uri)
            file.seek(begin)
            data = file.read(end - begin)
            out = [_parsed(zlib.decompress(data[o - begin:o - begin + n], 31)) for o, n in records]
            yield pa.record_batch([pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))], names=names)
    return part.mapInArrow(run, schema)
