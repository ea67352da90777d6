"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 words of every benchmark item (an item of fewer words is one window).
Texts and patterns are sequences of word hashes. For the patterns of one length m, a shift table
says for each block of two words how far a search may jump when a text's position ends in that block:
m - 1 for a block that no pattern holds, else its distance from the pattern's end. Where the shift is
0, the suffix and prefix blocks select a bucket of patterns, and direct comparison confirms them.
All texts of a block of rows are searched side by side, each from a cursor of its own.

The search tables are broadcast in parts of a fixed size, and a task holds a fixed number of them. A
benchmark of more parts takes further passes over the texts; what an earlier pass finds is written by
text (only texts with hits have a row) and merged in the last one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.storage import cut
from quillon.llm.words import ALNUM_LOWER, LOWER, blocks, hashes, mix, owners, ranges, sequence_hashes, split

#: Words in a window.
WINDOW = 13
#: Bytes of benchmark text in a part (its tables take some six times as much), and parts held in one pass.
PART_BYTES, PARTS_AT_ONCE = 8 << 20, 8
#: Words of a text that one cursor searches; texts are cut so that cursors end at about the same time.
STRIDE = 1024
_TABLE_BITS = 18


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts after lower-casing A-Z, and where each text's words begin."""
    low = LOWER[data]
    starts, ends, first = split(low, offsets, ALNUM_LOWER)
    return hashes(low, starts, ends), first


def _pairs(words: np.ndarray) -> np.ndarray:
    """A hash of each two neighbouring words (the block of the shift table), by its second word."""
    out = np.zeros(len(words), dtype=np.uint64)
    out[1:] = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    return out


class Patterns:
    """Search tables for windows of one length: shifts, buckets, the windows' places and their items."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, items: np.ndarray, m: int):
        """words: the items' word hashes, end to end; a window begins at each start, in the item given."""
        self.words, self.m, self.width = words, m, min(2, m)
        name = sequence_hashes(words, starts, starts + m)
        order = np.lexsort((items, name))
        starts, items, name = starts[order], items[order], name[order]
        # Equal windows are one pattern, told by their words, with a list of the items that hold it.
        same = np.zeros(len(starts), dtype=bool)
        same[1:] = name[1:] == name[:-1]
        for j in range(m):
            same[1:] &= words[starts[1:] + j] == words[starts[:-1] + j]
        fresh = ~same
        fresh[1:] |= items[1:] != items[:-1]
        pattern = np.cumsum(~same) - 1
        self.items, self.bounds = items[fresh], np.concatenate(([0], np.cumsum(np.bincount(pattern[fresh]))))
        self.starts = starts[~same]
        key = self._bucket(words, self.starts + m - 1)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.shift = np.full(1 << _TABLE_BITS, m - self.width + 1, dtype=np.uint8 if m < 250 else np.int32)
        blocks_of = mix(words) if self.width == 1 else _pairs(words)
        for end in range(self.width - 1, m):
            slot = (blocks_of[self.starts + end] >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            self.shift[slot] = np.minimum(self.shift[slot], m - 1 - end)

    def _bucket(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The suffix block's hash and the prefix block's hash of the windows that end at `ends`."""
        last, first = ends, ends - self.m + 1
        a, b = words[last], words[first]
        c, d = words[np.maximum(last - 1, first)], words[np.minimum(first + 1, last)]
        return mix(mix(a * np.uint64(3) + c) * np.uint64(5) + mix(b * np.uint64(7) + d))

    def search(self, words: np.ndarray, blocks_of: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, pattern) of every occurrence inside one text."""
        n_words = np.diff(first)
        # A cursor searches the end positions [start, stop) of a stretch of one text.
        room = np.maximum(n_words - self.m + 1, 0)
        parts = -(-room // STRIDE)
        text = np.repeat(np.arange(len(room)), parts)
        part = ranges(np.zeros(len(room), dtype=np.int64), parts)
        cursor = first[:-1][text] + self.m - 1 + part * STRIDE
        stop = np.minimum(cursor + STRIDE, first[1:][text])
        found = []
        slots = (blocks_of >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        while len(cursor):
            jump = self.shift[slots[cursor]].astype(np.int64)
            hit = cursor[jump == 0]
            if len(hit):
                found.append(hit)
            cursor = cursor + np.maximum(jump, 1)
            live = cursor < stop
            if not live.all():
                cursor, stop = cursor[live], stop[live]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        ends = np.concatenate(found)
        key = self._bucket(words, ends)
        low, high = np.searchsorted(self.keys, key, side="left"), np.searchsorted(self.keys, key, side="right")
        count = high - low
        ends, pattern = np.repeat(ends, count), self.order[ranges(low, count)]
        for j in range(self.m):
            same = words[ends - self.m + 1 + j] == self.words[self.starts[pattern] + j]
            ends, pattern = ends[same], pattern[same]
        return ends, pattern


def build_tables(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Search tables, one for each length of window, for (item id, text) pairs."""
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in items], pa.string())})
    found, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for _, data, offsets in blocks(batch):
        words, first = normal_words(data, offsets)
        found.append(words)
        sizes.append(np.diff(first))
    words, n = np.concatenate(found), np.concatenate(sizes)
    first = np.cumsum(n) - n
    length = np.minimum(n, window)
    tables = []
    for m in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == m)
        count = n[rows] - m + 1
        tables.append(Patterns(words, ranges(first[rows], count), np.repeat(rows, count), m))
    return tables


def find_hits(tables: list[Patterns], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether each word is hit, where texts' words begin, and (text, item row) pairs of what occurs."""
    words, first = normal_words(data, offsets)
    pair = _pairs(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    texts, rows = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    owner = owners(first)
    for table in tables:
        ends, pattern = table.search(words, pair if table.width == 2 else mix(words), first)
        np.add.at(edge, ends - table.m + 1, 1)
        np.add.at(edge, ends + 1, -1)
        n = len(table.starts)
        text, pattern = np.divmod(np.unique(owner[ends] * n + pattern), max(n, 1))
        count = table.bounds[pattern + 1] - table.bounds[pattern]
        texts.append(np.repeat(text, count))
        rows.append(table.items[ranges(table.bounds[pattern], count)])
    return np.cumsum(edge[:-1]) > 0, first, np.concatenate(texts), np.concatenate(rows)


_DIGEST = "__n_words long, __n_hit long, __n_items long, __digest string, __list array<string>"


def _pass(shared: list, text: str, keep: list[str], last: bool):  # noqa: ANN202
    """For mapInArrow: search the parts in `shared`. The last pass adds what `__found` holds and makes the digest;
    another one gives a row (h, size, hit, items) for each text with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [s.value for s in shared]
        for batch in batches:
            for part, data, offsets in blocks(batch, text):
                hit, items = None, [set() for _ in range(part.num_rows)]
                for tables, ids in parts:
                    own, first, texts, rows = find_hits(tables, data, offsets)
                    hit = own if hit is None else hit | own
                    for t, r in zip(texts.tolist(), rows.tolist(), strict=True):
                        items[t].add(ids[r])
                bits = [hit[first[i] : first[i + 1]] for i in range(part.num_rows)]
                if not last:
                    at = [i for i, x in enumerate(items) if x]
                    columns = [*part.select(["__h", "__size"]).take(pa.array(at, pa.int64())).columns, pa.array([np.packbits(bits[i]).tobytes() for i in at], pa.binary()), pa.array([sorted(items[i]) for i in at], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["h", "size", "hit", "items"])
                    continue
                if "__found" in part.schema.names:
                    for i, earlier in enumerate(part.column(part.schema.get_field_index("__found")).to_pylist()):
                        for x in earlier or ():
                            bits[i] = bits[i] | np.unpackbits(np.frombuffer(x["hit"], dtype=np.uint8), count=len(bits[i])).astype(bool)
                            items[i].update(x["items"])
                lists = [sorted(x) for x in items]
                columns = [
                    *part.select(keep).columns,
                    pa.array([len(b) for b in bits], pa.int64()),
                    pa.array([int(b.sum()) for b in bits], pa.int64()),
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], pa.string()),
                    pa.array(lists, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "__n_words", "__n_hit", "__n_items", "__digest", "__list"])

    return run


def scan_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], part_bytes: int = PART_BYTES, text: str = "text") -> DataFrame:
    """`docs` (columns `keep`, from its own) with n_words, n_hit, n_items, items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of any window; `contaminated` if any word is hit and hit
    words are a twentieth of all at least. Null texts have no words, items without words no windows.
    An item id counts once however often it is listed; a null id counts as the empty string. Rows that
    repeat are judged each for itself. Kept columns may have any names.
    """
    spark = docs.sparkSession
    listed = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).distinct()
    size = listed.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)))).first()[0] or 0
    n_parts = max(1, -(-int(size) // part_bytes))
    numbered = listed.withColumn("p", F.pmod(F.xxhash64("i", "t"), F.lit(n_parts)))

    def share(p: int):  # noqa: ANN202
        rows = [(r["i"] or "", r["t"]) for r in numbered.where(F.col("p") == p).select("i", "t").collect()]  # PART_BYTES of text, as its hash deals it
        return spark.sparkContext.broadcast((build_tables(rows), [i for i, _ in rows]))

    names = list(dict.fromkeys([*keep, text]))
    inner = {c: f"k{i}" for i, c in enumerate(names)}
    rows = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in names])
    passes = [range(p, min(p + PARTS_AT_ONCE, n_parts)) for p in range(0, n_parts, PARTS_AT_ONCE)]
    found = None
    if passes[1:]:
        rows = rows.withColumns({"__h": F.xxhash64(inner[text]), "__size": F.coalesce(F.octet_length(inner[text]), F.lit(0)).cast("long")})
        for numbers in passes[:-1]:
            shared = [share(p) for p in numbers]
            one = rows.select(inner[text], "__h", "__size").mapInArrow(_pass(shared, inner[text], [], False), "h long, size long, hit binary, items array<string>")
            one = cut(one.dropDuplicates(["h", "size"]), "hits")
            for s in shared:
                s.destroy()
            found = one if found is None else found.unionByName(one)
        merged = found.groupBy(F.col("h").alias("__h"), F.col("size").alias("__size")).agg(F.collect_list(F.struct("hit", "items")).alias("__found"))
        rows = rows.join(merged, ["__h", "__size"], "left").drop("__h", "__size")  # a row per pass and text
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = [inner[c] for c in keep]
    schema = "".join(f"{c} {kinds[c]}, " for c in kept) + _DIGEST
    out = rows.mapInArrow(_pass([share(p) for p in passes[-1]], inner[text], kept, True), schema)
    return out.select(
        *[F.col(inner[c]).alias(c) for c in keep],
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.col("__n_items").alias("n_items"),
        F.col("__list").alias("items"),
        F.col("__digest").alias("items_sha256"),
        ((F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words"))).alias("contaminated"),
    )


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns for every document; nulls and repeated rows as in `scan_contamination`."""
    return scan_contamination(docs, benchmark, ["doc_id"]).drop("items")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, in their own columns; null and empty texts stay."""
    names = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in names])
    judged = scan_contamination(renamed, benchmark, renamed.columns, text="c_text")
    return judged.where(~F.col("contaminated")).select(*[F.col(f"`c_{c}`").alias(c) for c in names])
