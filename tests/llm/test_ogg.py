import hashlib
import os
import zlib

import pytest

from quillon.llm import ogg
from tests.llm.common import documents, odd_texts


def _bitwise(data: bytes) -> int:
    crc = 0
    for x in data:
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1 & 0xFFFFFFFF
    return crc


def test_checksum():
    for n in (0, 1, 27, 300):
        data = os.urandom(n)
        assert ogg.page_checksum(data) == _bitwise(data)


def test_round_trip_and_times():
    for frames in (1, 2, 3, 31, 32, 33, 509, 1300, 12_000):
        payload = os.urandom(ogg.FRAME * frames)
        media = ogg.encode(payload)
        back, streams = ogg.decode(media)
        assert back == payload and (frames < 12_000 or max(s.pages for s in streams) > len(streams[0].packets))
        size = ogg.packet_size(len(payload))
        sizes = [len(payload[i : i + size]) for i in range(0, len(payload), size)]
        for k, s in enumerate(streams):
            ends = [sum(sizes[k::2][: i + 1]) for i in range(len(sizes[k::2]))]
            assert ogg.packet_times(s) == [e / ogg.RATE for e in ends]


def test_the_stored_form_is_read_by_the_format_alone():
    """A reader of its own: pages by their fields, packets by lacing values, no code shared with the writer."""
    for n in (192, 192 * 40, 192 * 9000):
        payload, at, streams = os.urandom(n), 0, {}
        media = ogg.encode(payload)
        while at < len(media):
            assert media[at : at + 4] == b"OggS" and media[at + 4] == 0
            serial, number, crc = (int.from_bytes(media[at + i : at + i + 4], "little") for i in (14, 18, 22))
            lacing = media[at + 27 : at + 27 + media[at + 26]]
            end = at + 27 + len(lacing) + sum(lacing)
            if n < 10_000:
                assert crc == _bitwise(media[at : at + 22] + bytes(4) + media[at + 26 : end])
            stream = streams.setdefault(serial, {"pages": 0, "packets": [b""]})
            assert stream["pages"] == number
            stream["pages"] += 1
            body = at + 27 + len(lacing)
            for value in lacing:
                stream["packets"][-1] += media[body : body + value]
                body += value
                if value < 255:
                    stream["packets"].append(b"")
            at = end
        a, b = (s["packets"][1:-1] for s in streams.values())
        assert b"".join(x for pair in zip(a, b + [b""], strict=False) for x in pair) == payload


def test_packets_over_many_segments_and_pages():
    packets = [os.urandom(n) for n in (0, 254, 255, 256, 510, 70_000, 3, 65_025, 130_050)]
    pages = ogg._stream_pages(packets, 7)
    assert ogg.demultiplex(b"".join(pages))[0].packets[1:] == packets


def test_damage_is_found():
    media = bytearray(ogg.encode(os.urandom(ogg.FRAME * 700)))
    for at in (0, 5, 30, 60, len(media) // 2, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.decode(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.decode(bytes(media[:-5]))
    second = media.find(b"OggS", 4)
    with pytest.raises(ogg.OggError):
        ogg.decode(bytes(media[second:]))


def test_columns(spark):
    docs = documents(spark, odd_texts()).withColumnRenamed("lang", "media")
    rows = {r.doc_id: r for r in ogg.media_digest(docs).collect()}
    for i, t in enumerate(odd_texts()):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r, media = rows[i + 1], ogg.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    narrow = spark.createDataFrame([(1, 'a'), (None, None)], 'doc_id int, text string')
    assert dict(ogg.media_digest(narrow).dtypes)['doc_id'] == 'int' and ogg.media_digest(narrow).count() == 2
    assert rows[4].feature == rows[5].feature and ogg.media_digest(docs.limit(0)).count() == 0
