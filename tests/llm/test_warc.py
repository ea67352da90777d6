import gzip
import hashlib

import pytest

from quillon.llm import warc
from quillon.llm.storage import fresh_path

BIG = "<p>é line\r\n\r\nWARC/1.1\r\n" + "x" * 2000
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (3, "http://a/\r\n3", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "y" * 1000), (8, "u", "y" * 999), (10, "u", "y" * 999), (None, "u", BIG)]


def _plain(rows):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        digest = hashlib.sha1(raw).hexdigest()
        same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        refers = max(same) if len(raw) >= 1000 and max(same) != i else None
        out.append((i, len(raw), digest, "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def _tuples(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_written_read_and_resolved(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert _tuples(warc.archive_digest(pages)) == _plain(ROWS)
    assert warc.archive_digest(pages.limit(0)).count() == 0


def test_archives_are_rewritten_with_fresh_headers(spark):
    pages = spark.createDataFrame([(i, f"u{i}", BIG if i < 4 else f"{i}" * 600) for i in range(6)], "page_id long, url string, payload string")
    first, second = fresh_path(spark, "t"), fresh_path(spark, "t")
    warc.write_deduplicated(pages, first)
    lost = warc.rewrite_archives(spark, first, second, written="2030-01-01T00:00:00Z")
    assert lost.count() == 0
    assert _tuples(warc.resolve(warc.read_archives(spark, second))) == _tuples(warc.resolve(warc.read_archives(spark, first)))
    pieces = (x for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(second).collect() for x in warc._inflate(bytes(r.content)))
    records = list(warc.parse_records(pieces))
    assert {h["warc-date"] for h, _ in records} == {"2030-01-01T00:00:00Z"} and len(records) == 6


def test_page_ids_that_repeat(spark):
    rows = [(5, "u", "A" * 1500), (5, "v", "B" * 1500), (3, "w", "A" * 1500), (2, "x", "B" * 1500), (5, "u", "A" * 1500), (1, "y", "C" * 1500), (1, "y", "C" * 1500)]
    assert _tuples(warc.archive_digest(spark.createDataFrame(rows, "page_id long, url string, html string"))) == _plain(rows)


def test_pieces_of_any_size_and_members_are_read_alike(monkeypatch):
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\r\n\r\n"
    raw = gzip.compress(record) + gzip.compress(record * 3)
    for size in (1, 3, 1 << 20):
        monkeypatch.setattr(warc, "_PIECE", size)
        assert [block for _, block in warc.parse_records(warc._inflate(raw))] == [b"ab\r\n\r"] * 4
    with pytest.raises(ValueError):
        list(warc._inflate(raw[:-9]))


def test_a_revisit_without_its_original(spark):
    alone = spark.createDataFrame([("<urn:uuid:1>", "revisit", "<urn:uuid:2>", "ab", 12, None, 0, "5", "u")], "record string, record_type string, refers_record string, stated_digest string, stated_bytes long, digest string, bytes long, page_id string, url string")
    r = warc.resolve(alone).first()
    assert (r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) == (5, 12, "ab", None)


def test_damage_raises():
    with pytest.raises(ValueError):
        list(warc.parse_records([b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"]))
    with pytest.raises(ValueError):
        list(warc.parse_records([b"junk"]))
