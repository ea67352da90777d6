"""Ogg media columns: texts stored as 8-bit samples in Ogg pages, and read back with all checks.

A payload is cut into packets of a multiple of 192 samples, so many that a file has some 32 of them;
a long payload's packets take several lacing values and cross pages. Even packets belong to logical
stream A, odd ones to stream B. Each stream opens with a header packet on a page of its own, packs its packets into pages
by lacing values, and marks its last page. A page's granule position counts the stream's samples up
to the end of the last packet that ends on it, from which timestamps follow. Pages of the streams
alternate, as a multiplexed file has them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.words import blocks

#: Samples (bytes) in a frame; payloads are padded to a multiple of it with blanks.
FRAME = 192
#: Packets that a file should have; each holds whole frames.
PACKETS = 32
#: Samples a second, for timestamps.
RATE = 8000
#: Lacing values in a page at most, and the header packet's magic. Fixed values of the format.
MAX_SEGMENTS = 255
CAPTURE, MAGIC = b"OggS", b"\x01smp8"
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A page or packet that breaks the format's rules."""


def page_checksum(page: bytes) -> int:
    """The format's CRC-32: polynomial 0x04C11DB7, highest bit first, from 0, not inverted.

    It is the common reflected CRC of the bit-reversed bytes, with the bits of the result reversed.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing))
    raw = bytearray(head + lacing + body)
    raw[22:26] = page_checksum(bytes(raw)).to_bytes(4, "little")
    return bytes(raw)


def packet_size(n: int) -> int:
    """Bytes in each packet of a payload of n bytes (the last may have fewer)."""
    return max(1, -(-n // (FRAME * PACKETS))) * FRAME


def _stream_pages(packets: list[bytes], serial: int, size: int = FRAME) -> list[bytes]:
    """A logical stream's pages: the header packet alone, then the others packed by lacing values."""
    header = MAGIC + struct.pack("<II", RATE, size)
    pages = [_page(FIRST, 0, serial, 0, bytes([len(header)]), header)]
    lacing, body, granule, done, begun = bytearray(), [], -1, 0, False
    flags = 0
    for packet in packets:
        values = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        for i, value in enumerate(values):
            if len(lacing) == MAX_SEGMENTS:
                pages.append(_page(flags, granule, serial, len(pages), bytes(lacing), b"".join(body)))
                lacing, body, granule = bytearray(), [], -1
                flags = CONTINUED if i else 0
            lacing.append(value)
            body.append(packet[at : at + value])
            at += value
        done += len(packet)
        granule = done
        begun = True
    if lacing or not begun:
        pages.append(_page(flags | LAST, max(granule, 0) if not begun else granule, serial, len(pages), bytes(lacing), b"".join(body)))
    return pages


def encode(payload: bytes) -> bytes:
    """The payload as a multiplexed file of two logical streams; equal payloads give equal files."""
    serial = zlib.crc32(payload)
    size = packet_size(len(payload))
    packets = [payload[i : i + size] for i in range(0, len(payload), size)]
    a = _stream_pages(packets[0::2], serial, size)
    b = _stream_pages(packets[1::2], serial ^ 0xFFFFFFFF, size)
    out = [a[0], b[0]]  # all headers come before any data
    for i in range(1, max(len(a), len(b))):
        out += a[i : i + 1] + b[i : i + 1]
    return b"".join(out)


@dataclass
class LogicalStream:
    """What a reader knows of one logical stream."""

    serial: int
    pages: int = 0
    packets: list[bytes] = field(default_factory=list)
    partial: list[bytes] = field(default_factory=list)
    #: (granule position, packets that have ended) of each page on which a packet ends.
    marks: list[tuple[int, int]] = field(default_factory=list)
    ended: bool = False


def demultiplex(data: bytes) -> list[LogicalStream]:
    """Verify every page and reassemble each stream's packets, in the order in which streams begin."""
    view, at, streams = memoryview(data), 0, {}
    while at < len(data):
        if at + 27 > len(data):
            raise OggError("a page header is cut short")
        capture, version, flags, granule, serial, number, checksum, segments = _HEAD.unpack_from(data, at)
        if capture != CAPTURE or version:
            raise OggError(f"no page begins at byte {at}")
        lacing = data[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        if len(lacing) < segments or end > len(data):
            raise OggError("a page is cut short")
        if page_checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != checksum:
            raise OggError(f"wrong checksum of the page at byte {at}")
        stream = streams.get(serial)
        if (stream is None) != bool(flags & FIRST):
            raise OggError("a stream must begin once, with its first page")
        stream = streams.setdefault(serial, LogicalStream(serial))
        if stream.ended or number != stream.pages or bool(flags & CONTINUED) != bool(stream.partial):
            raise OggError("a page is missing, repeated or out of order")
        stream.pages += 1
        body, before = at + 27 + segments, len(stream.packets)
        for value in lacing:
            stream.partial.append(data[body : body + value])
            body += value
            if value < 255:
                stream.packets.append(b"".join(stream.partial))
                stream.partial = []
        if len(stream.packets) > before:
            stream.marks.append((granule, len(stream.packets)))
        elif granule != -1 and lacing:
            raise OggError("a granule position on a page where no packet ends")
        stream.ended = bool(flags & LAST)
        at = end
    for stream in streams.values():
        if stream.partial or not stream.ended:
            raise OggError("a stream has no end")
    return list(streams.values())


def packet_times(stream: LogicalStream) -> list[float]:
    """The time in seconds at which each packet after the header ends, from the granule positions.

    A page states the position of its last packet; those before it are counted back by their lengths.
    """
    rate, _ = struct.unpack_from("<II", stream.packets[0], len(MAGIC))
    times: list[float] = []
    for (granule, upto), (_, begin) in zip(stream.marks[1:], stream.marks[:-1], strict=True):
        own, position, back = stream.packets[begin:upto], granule, []
        for packet in reversed(own):
            back.append(position / rate)
            position -= len(packet)
        times += reversed(back)
    return times


def decode(data: bytes) -> tuple[bytes, list[LogicalStream]]:
    """The payload of a file that `encode` made, and its streams."""
    streams = demultiplex(data)
    if len(streams) != 2 or any(not s.packets or not s.packets[0].startswith(MAGIC) for s in streams):
        raise OggError("two streams of 8-bit samples are needed")
    even, odd = streams[0].packets[1:], streams[1].packets[1:]
    if len(even) - len(odd) not in (0, 1):
        raise OggError("the streams do not fit together")
    packets: list[bytes] = [b""] * (len(even) + len(odd))
    packets[0::2], packets[1::2] = even, odd
    return b"".join(packets), streams


def features(payload: bytes, streams: list[LogicalStream]) -> str:
    """Pages, packets and seconds of each stream, then mean and peak distance from the middle, as text."""
    parts = []
    for stream in streams:
        times = packet_times(stream)
        parts.append(f"pages={stream.pages} packets={len(stream.packets) - 1} seconds={times[-1] if times else 0.0:.4f}")
    low, high = (min(payload), max(payload)) if payload else (128, 128)
    mean = sum(payload) / len(payload) if payload else 128.0
    return "; ".join(parts) + f"; mean={mean:.3f} peak={max(abs(low - 128), abs(high - 128))}"


def padded(raw: bytes) -> bytes:
    """`raw` with blanks to a positive multiple of a frame."""
    return raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" ")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bytes of the text, media) of every text."""
    for batch in batches:
        for part, data, offsets in blocks(batch):
            raw = data.tobytes()
            media = [encode(padded(raw[offsets[i] : offsets[i + 1]])) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the stored bytes say: payload digests and features, and digests of the bytes themselves."""
    for batch in batches:
        for part, data, offsets in blocks(batch, "media"):
            raw, rows = data.tobytes(), []
            for i in range(part.num_rows):
                media = raw[offsets[i] : offsets[i + 1]]
                payload, streams = decode(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, streams)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["doc_id", "n_bytes", *_READ])


_READ = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary) of every row of `docs`: its text as an Ogg file.

    A null text counts as empty, and an empty one is stored as one packet of blanks. Null ids stay
    null and keep their type; rows that repeat are stored each, no rows give none; other columns are not read.
    """
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_store, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of stored files (doc_id, n_bytes, media); a damaged file raises OggError."""
    rows = media.select("doc_id", "n_bytes", "media")
    return rows.mapInArrow(_read, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_DIGEST}")


def media_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document; nulls, repeated rows and empty tables as in `store_media`."""
    return read_media(store_media(docs))
