"""Packing token sequences by harmonic classes.

A document's ids are cut into pieces whose lengths are a reciprocal share of the capacity: `capacity // k`
for k = 1, 2, 3, ... Pieces of one class are alike in length, so a sequence of class k takes k of them,
whichever they are, and wastes less than k tokens. Every task fills the sequences of its classes by
itself, without an exchange; what a task is left with, fewer than k pieces a class, is numbered over all
tasks (running counts by class and task) and fills sequences of the same classes. Fewer than k pieces a
class are left in all, a number that doesn't grow with the input: they are laid end to end, cut at the
capacity, and the last stretch into powers of two, which need no padding.

Texts are tokenized once. Words are told apart before (a word is a stretch between blanks, cut further
between ASCII letters and marks, where no token of the pre-tokenizer can run on), and each different word
is given to the tokenizer once, as far as a worker remembers it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.storage import cut
from quillon.llm.words import LOWER, NOT_BLANK, blocks, ranges

#: Tokens in a sequence, and the id that ends a document.
CAPACITY, END_ID = 2048, 1
TOKENIZER = "word_bpe_49k.json"
#: Different words that a worker remembers the ids of.
REMEMBERED = 600_000

#: Sequences of a task are numbered from its number times this; those of all tasks' remainders from _SHARED, the last ones from _LAST.
_TASK, _SHARED, _CLASS, _LAST = 1 << 32, 1 << 62, 1 << 44, 3 << 61

# Classes of bytes: blank, ASCII letter, other ASCII, and those at which a word is never cut (apostrophes, which
# begin contractions, and all beyond ASCII, which may compose).
_BLANK, _LETTER, _MARK, _GLUE = 0, 1, 2, 3
_CLASS_OF = np.full(256, _MARK, dtype=np.uint8)
_CLASS_OF[~NOT_BLANK] = _BLANK
_CLASS_OF[0x41:0x5B], _CLASS_OF[0x61:0x7B] = _LETTER, _LETTER
_CLASS_OF[0x27], _CLASS_OF[0x80:] = _GLUE, _GLUE
#: Whether a word begins at a byte, by the classes of the byte before (times 4) and its own.
_BEGINS = np.array([b != _BLANK and (a == _BLANK or {a, b} == {_LETTER, _MARK}) for a in range(4) for b in range(4)])


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public tokenizer's file lies on this machine (every worker has its own copy)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of many texts at once, equal to those of the tokenizer text by text."""

    def __init__(self, name: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        self._tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._known: dict[str, bytes] = {}
        self._remembered = remembered

    def plain(self, text: str) -> np.ndarray:
        """The ids of one text, straight from the tokenizer."""
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _of_words(self, words: list[str]) -> list[bytes]:
        out = [*map(self._known.get, words)]
        new = [i for i, ids in enumerate(out) if ids is None]
        if new:
            if len(self._known) + len(new) > self._remembered:
                self._known = {}
            for i, e in zip(new, self._tokenizer.encode_batch_fast([words[i] for i in new], add_special_tokens=False), strict=True):
                ids = e.ids
                out[i] = self._known[words[i]] = pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32 bits) of the texts that lie one after the other in `data`, and where each begins."""
        raw = data.tobytes()
        if any(s in raw for s in self._special):  # tokens of their own, which may run over the cuts below
            each = [self.plain(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.concatenate([*each, np.zeros(0, dtype="<u4")]), np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
        kind = _CLASS_OF[data]
        inside = kind != _BLANK
        begins = inside.copy()
        if len(data):
            begins[1:] = _BEGINS[kind[:-1] * np.uint8(4) + kind[1:]]
            heads = offsets[:-1][offsets[:-1] < len(data)]
            begins[heads] = inside[heads]
        starts = np.flatnonzero(begins)
        first = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.zeros(0, dtype="<u4"), np.zeros(len(offsets), dtype=np.int64)
        packed = data[inside]
        ends = np.append(np.flatnonzero(begins[inside]), len(packed))
        # The tokenizer folds case; as it composes letters before, words are folded here only where nothing composes.
        plain = np.maximum.reduceat(packed, ends[:-1]) < 0x80
        packed = np.where(np.repeat(plain, np.diff(ends)), LOWER[packed], packed)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(packed)).dictionary_encode()
        found = self._of_words(words.dictionary.to_pylist())
        length = np.array([len(b) // 4 for b in found], dtype=np.int64)
        begin = np.cumsum(length) - length
        pool = np.frombuffer(b"".join(found), dtype="<u4")
        which = words.indices.to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(length[which])]).astype(np.int64)
        return pool[ranges(begin[which], length[which])], upto[first]


@lru_cache(maxsize=4)
def _encoder(name: str) -> Encoder:
    """A worker's encoder, which lives on from task to task."""
    return Encoder(name)


def piece_lengths(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths that so many tokens are cut into: at each step the longest reciprocal share that fits."""
    out = [capacity] * (tokens // capacity)
    left = tokens % capacity
    while left:
        k = capacity // left
        k += capacity // k > left
        out.append(capacity // k)
        left -= capacity // k
    return out


_NAMES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "number", "ids")
_LONGS = ", ".join(f"{n} long" for n in _NAMES[:-1]) + ", ids binary"


def _filler(name: str, capacity: int, end_id: int, keep_ids: bool):  # noqa: ANN202
    """For mapInArrow over (key, text): pieces of full sequences as they fill, at the end those left over (without a sequence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, filled = _encoder(name), TaskContext.get().partitionId(), 0
        shares = [np.array(piece_lengths(r, capacity), dtype=np.int64) for r in range(capacity)]
        waiting, key_type = None, None

        def told(keys, numbers, ids, sequence, offset, number):  # noqa: ANN001, ANN202
            """Rows of pieces; those without a sequence have their ids."""
            n = len(ids)
            column = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64())
            arrays = [keys, *[pa.array(x, pa.int64()) for x in numbers], column(sequence), column(offset), pa.array(np.full(n, task), pa.int64()), column(number)]
            arrays.append(pa.array(ids, pa.binary()) if sequence is None or keep_ids else pa.nulls(n, pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, names=["key", *_NAMES])

        for batch in batches:
            key_type = batch.column(0).type
            for part, data, offsets in blocks(batch):
                ids, upto = encoder.encode(data, offsets)
                keys, rows, start, length, crc, total, own = part.column(0), [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)):
                    n, whole, at = b - a + 1, ids[a:b].tobytes() + int(end_id).to_bytes(4, "little"), 0
                    for size in [capacity] * (n // capacity) + shares[n % capacity].tolist():
                        piece = whole[4 * at : 4 * (at + size)]
                        rows.append(i), start.append(at), length.append(size), crc.append(zlib.crc32(piece)), total.append(n), own.append(piece)
                        at += size
                held = pc.take(keys, pa.array(rows, pa.int64()))
                numbers = np.array([start, length, crc, total], dtype=np.int64).reshape(4, -1)
                if waiting is not None:
                    held, numbers, own = pa.concat_arrays([waiting[0], held]), np.concatenate([waiting[1], numbers], axis=1), waiting[2] + own
                # Those that waited come first in their class.
                order = np.argsort(numbers[1], kind="stable")
                size = numbers[1][order]
                heads = np.flatnonzero(np.diff(size, prepend=-1))
                count = np.diff(np.append(heads, len(size)))
                rank = np.arange(len(size)) - np.repeat(heads, count)
                k = capacity // size
                full = np.repeat(count // k[heads], count)
                bins_before = np.repeat(np.cumsum(count // k[heads]) - count // k[heads], count)
                done = rank < full * k
                at = order[done]
                if len(at):
                    sequence = task * _TASK + filled + (bins_before + rank // k)[done]
                    yield told(pc.take(held, pa.array(at)), numbers[:, at], [own[i] for i in at.tolist()], sequence, (rank % k * size)[done], None)
                    filled += int((count // k[heads]).sum())
                rest = order[~done]
                waiting = (pc.take(held, pa.array(rest)), numbers[:, rest], [own[i] for i in rest.tolist()])
        if waiting is not None and len(waiting[2]):
            size = waiting[1][1]
            heads = np.flatnonzero(np.diff(size, prepend=-1))
            yield told(*waiting, None, None, np.arange(len(size)) - np.repeat(heads, np.diff(np.append(heads, len(size)))))

    return run


def last_stretches(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the sequences that hold so many tokens without padding: full ones, then powers of two."""
    left = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]


def _finisher(capacity: int, keep_ids: bool):  # noqa: ANN202
    """For mapInArrow over the last pieces of all classes, in order: laid end to end and cut at the ends of sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = list(batches)
        if not every:
            return
        table = pa.Table.from_batches(every)
        start, length, total = (table.column(n).to_numpy() for n in ("start", "length", "doc_tokens"))
        ids = table.column("ids").to_pylist()
        ends = np.cumsum(last_stretches(int(length.sum()), capacity))
        rows, out, at, sequence, offset = [], [], 0, 0, 0
        for i, n in enumerate(length.tolist()):
            done = 0
            while done < n:
                size = min(n - done, int(ends[sequence]) - at)
                piece = ids[i][4 * done : 4 * (done + size)]
                rows.append(i)
                out.append((int(start[i]) + done, size, zlib.crc32(piece), int(total[i]), _LAST + sequence, offset, piece if keep_ids else None))
                done, at, offset = done + size, at + size, offset + size
                if at == ends[sequence]:
                    sequence, offset = sequence + 1, 0
        keys = table.column("key").combine_chunks() if len(every) > 1 else every[0].column(every[0].schema.get_field_index("key"))
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        columns = [pa.array(x, pa.int64()) for x in list(zip(*out, strict=True))[:6]]
        yield pa.RecordBatch.from_arrays([pc.take(keys, pa.array(rows, pa.int64())), *columns, pa.array([x[6] for x in out], pa.binary())], names=["key", *_NAMES[:6], "ids"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): a row per piece of a document.

    A document's ids, and `end_id` after them, are cut into pieces; `start` is the ids before a piece in its
    document, `offset` those before it in its sequence, `ids` its own (unsigned 32 bits, little-endian; null
    unless `keep_ids`). A null text, like an empty one, has `end_id` only. Null and repeated keys stay, each row
    for itself; strings of special tokens in a text are what the tokenizer makes of them. Other columns are left
    out; an empty table gives an empty one. Which piece goes to which sequence depends on how the input is read;
    a sequence's number has gaps. A task holds its block of texts and fewer than `capacity` ids a class.
    """
    plain = docs.select(F.col(f"`{key}`").alias("key"), "text")
    kind = plain.schema["key"].dataType.simpleString()
    pieces = cut(plain.mapInArrow(_filler(tokenizer, capacity, end_id, keep_ids), f"key {kind}, {_LONGS}"), "pieces")
    wanted = ["key", *_NAMES[:6], "ids"]

    # What tasks are left with: a running number over all of them by class. Counts have a row per task and class.
    left = pieces.where("sequence_id is null")
    counts = left.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    of_class = Window.partitionBy("length")
    before = F.coalesce(F.sum("n").over(of_class.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("length", "task", before.alias("before"), F.sum("n").over(of_class).alias("held"))
    k = F.expr(f"{capacity} div length")
    numbered = cut(left.join(placed, ["length", "task"]).withColumns({"place": F.col("before") + F.col("number"), "k": k}), "pieces-left")
    bin_ = F.expr("place div k")
    fits = bin_ < F.expr("held div k")
    shared = numbered.where(fits).withColumns({"sequence_id": F.lit(_SHARED) + F.col("length") * _CLASS + bin_, "offset": F.col("place") % F.col("k") * F.col("length")})
    # Fewer than k pieces of each class, however large the input: one task.
    last = numbered.where(~fits).select("key", "start", "length", "doc_tokens", "ids", "place").repartition(1).sortWithinPartitions(F.desc("length"), "place")
    finished = last.mapInArrow(_finisher(capacity, keep_ids), f"key {kind}, " + ", ".join(f"{n} long" for n in _NAMES[:6]) + ", ids binary")
    kept = F.col("ids") if keep_ids else F.lit(None).cast("binary").alias("ids")
    out = pieces.where("sequence_id is not null").select(*wanted).unionByName(shared.select(*wanted[:-1], kept)).unionByName(finished)
    return out.withColumnRenamed("key", key)


def sequences(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, tokens, ids, pieces): the sequences themselves, from pieces that have their ids.

    `ids` are the pieces' ids end to end, `pieces` tells (offset, length, key, start) of each; both are bounded
    by the capacity.
    """
    own = F.struct("offset", "length", F.col(f"`{key}`").alias("key"), "start", "ids")
    grouped = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.sort_array(F.collect_list(own)).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return grouped.select("sequence_id", "tokens", joined.alias("ids"), F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), x["key"].alias("key"), x["start"].alias("start"))).alias("pieces"))


def packing_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every piece; nulls, repeated rows and empty tables as in `pack_documents`."""
    return pack_documents(docs, keep_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
