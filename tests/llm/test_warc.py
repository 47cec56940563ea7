"""Archives: round trips, revisits, range reads, and files as other readers see them."""

import gzip
import hashlib
import os

from trackguard.llm import binfiles, warc

LONG = "x" * 100
ROWS = [(5, "u5", LONG), (3, "u3", LONG), (9, "u9", LONG), (None, "n", LONG), (1, None, None), (2, "a b\r\nX: y%20", "short"), (4, "u4", "short"),
        (3, "again", LONG), (7, "ü", "é" * 50), (8, "u8", "é" * 50), (10, "z", "\r\n\r\nHTTP/1.1 " * 20)]


def pages(spark):
    return spark.createDataFrame([(h, p, u, "q") for p, u, h in ROWS], "html string, page_id long, url string, digest string")


def test_records_come_back(spark):
    got = {(r.page_id, r.url): r for r in warc.read(warc.write(pages(spark))).collect()}
    assert len(got) == len(ROWS)
    for p, u, h in ROWS:
        r, raw = got[(p, u)], (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        revisit = {5: 3, 9: 3, 8: 7}.get(p)
        assert (r.record_type, r.refers_to) == (("revisit", revisit) if revisit else ("response", None))
        assert r.payload == (None if revisit else raw)


def test_a_selection_reads_only_its_records(spark):
    index = warc.write(pages(spark))
    assert {r.page_id for r in warc.read(index.filter("page_id in (2, 8)")).collect()} == {2, 8}
    assert warc.read(warc.write(pages(spark).limit(0))).collect() == []


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 100, 50), ("b", 150, 1)]
    assert [(u, b, e, len(r)) for u, b, e, r in warc.ranges(iter(rows), gap=25, most=60)] == [("a", 0, 45, 3), ("a", 100, 150, 1), ("b", 150, 151, 1)]


def test_files_are_plain_gzip_archives(spark):
    index = warc.write(pages(spark))
    for uri in {r.uri for r in index.collect()}:
        with binfiles.reader(uri) as f:
            text = gzip.decompress(f.read())
        assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Record-ID") == index.filter(index.uri == uri).count()
        assert os.path.basename(uri).endswith(".warc.gz")
