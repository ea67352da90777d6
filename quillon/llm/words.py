"""Words and their hashes, taken from the bytes of many texts at once.

All functions work on the UTF-8 bytes of a block of texts that lie one after the other, as Arrow
stores them, so the cost per word is a few array operations and no Python object is made for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text makes a block of its own.
BLOCK_BYTES = 2 << 20

_M64 = (1 << 64) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Longest word (bytes) that is hashed side by side with others; longer ones are hashed each by itself.
LANE_BYTES = 64
#: Masks that keep the first n bytes of eight read as a little-endian number.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def _byte_class(members: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in members:
        out[low : high + 1] = True
    return out


#: Bytes of a word for `[^\x20\x09-\x0D]+`: everything but blanks.
NOT_BLANK = ~_byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of a word for `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, small letters, all beyond ASCII.
ALNUM_LOWER = ~_byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8) + 32 * _byte_class([(0x41, 0x5A)]).astype(np.uint8)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & _M64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of at most `limit` bytes of text (or one row): slice, bytes, offsets of its rows."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind, raw = (np.int64 if wide else np.int32), texts.buffers()
    offsets = np.frombuffer(raw[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def split(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and where each text's words begin (one entry more than texts).

    A word is a maximal run of bytes for which `member` holds, inside one text.
    """
    inside = member[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        heads, tails = offsets[:-1], offsets[1:] - 1
        heads = heads[heads < len(data)]
        tails = tails[tails >= 0]
        begins[heads] = inside[heads]
        ends[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes in every process.

    Eight bytes at a time are mixed in by a bijection, so different words of up to 8 bytes and one
    length never share a hash, and no pattern of a longer word cancels out, as it may in a sum. Words
    of more than LANE_BYTES bytes are hashed by BLAKE2b.
    """
    length = ends - starts
    out = mix(length.astype(np.uint64), 1)
    if not len(starts):
        return out
    room = np.zeros(len(data) + 8, dtype=np.uint8)
    room[: len(data)] = data
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=room, strides=(1,))
    live = np.flatnonzero(length <= LANE_BYTES)
    at, left, state = starts[live], length[live], out[live]
    while len(live):
        state = mix(state ^ (eights[at] & _FIRST[np.minimum(left, 8)]), 2)
        out[live] = state
        more = left > 8
        live, at, left, state = live[more], at[more] + 8, left[more] - 8, state[more]
    for i in np.flatnonzero(length > LANE_BYTES):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def sequence_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of word hashes [start, end).

    Runs of 1, 2, 4, ... words are hashed everywhere, each from its two halves; a run of any length is
    the two such runs that begin and end with it. Memory and time grow with the logarithm of the longest.
    """
    length = ends - starts
    out = mix(length.astype(np.uint64), 5 + salt)
    if not len(starts):
        return out
    power, size = (mix(words, salt + 11) if salt else words), 1
    longest = int(length.max())
    while size <= longest:
        now = np.flatnonzero((length >= size) & (length < 2 * size))
        if len(now):
            out[now] = mix(out[now] ^ mix(power[starts[now]] * _STEP + power[ends[now] - size], 3), 4)
        if 2 * size > longest:
            break
        power = mix(power[:-size] * _STEP + power[size:], 6)
        size *= 2
    return out


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text that each entry belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ..., start + count - 1 for each pair, one after the other."""
    counts = np.asarray(counts, dtype=np.int64)
    if not len(counts) or not (total := int(counts.sum())):
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - before, counts)


def as_signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
