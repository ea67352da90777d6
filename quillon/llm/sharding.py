"""Sharding by histogram sort.

Rows are ordered by three longs (a text's hash, then the document's id, then a hash of the row's place
in the input), so equal texts lie side by side. The driver keeps candidate boundaries (probes) between keys. In each round every partition
counts the exact bytes and rows that fall between neighbouring probes, the counts are added up, and
probes move into the intervals that still hold a splitter, until each splitter is within tolerance.
Only counts travel in these rounds. The rows move once, at the end, to ranges finer than a shard; as
the rows below each range are known from the same counts, slots follow without another pass.

A boundary runs between groups of equal texts where tolerance allows, and through a group (by
document id, and among rows that are alike in both by their place) where the group is too large for
that, so no group of copies has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.storage import cut

#: How far a shard's boundary may lie from its exact place, as a share of a shard.
TOLERANCE = 0.004
#: How far a range's boundary may lie from its place, as a share of a range.
RANGE_TOLERANCE = 0.25
#: Ranges per shard at least, and ranges in all at most: the driver holds a few numbers for each.
RANGES_PER_SHARD, MAX_RANGES = 32, 8192
#: Rows that one range should hold.
ROWS_PER_RANGE = 500_000
#: Probes put into an interval that still holds a splitter.
PROBES = 32

_SIGN, _LOW = 1 << 63, (1 << 64) - 1
#: Longs in a key.
_PARTS = 3


@dataclass(frozen=True)
class Splitters:
    """Ascending keys; keys below the first go to range 0. `bytes_below`, `rows_below` are exact."""

    keys: list[int]
    shard_of: list[int]
    rows_below: list[int]
    bytes_below: list[int]
    rounds: int


def _pack(parts: Sequence[int]) -> int:
    """Longs, the major one first, as one Python number that sorts alike."""
    out = 0
    for part in parts:
        out = out << 64 | (int(part) + _SIGN)
    return out


def _unpack(keys: list[int]) -> list[np.ndarray]:
    """An array of longs for each part of the keys."""
    return [np.array([(k >> (64 * (_PARTS - 1 - i)) & _LOW) - _SIGN for k in keys], dtype=np.int64) for i in range(_PARTS)]


def _interval(keys: list[np.ndarray], probes: list[np.ndarray]) -> np.ndarray:
    """How many probes are at or below each key; both are given by their parts, the major one first."""
    at, upto = (np.searchsorted(probes[0], keys[0], side=side) for side in ("left", "right"))
    if len(keys) == 1:
        return upto
    tied = np.flatnonzero(upto > at)
    for value in np.unique(keys[0][tied]):
        here = tied[keys[0][tied] == value]
        a, b = at[here[0]], upto[here[0]]
        at[here] = a + _interval([k[here] for k in keys[1:]], [p[a:b] for p in probes[1:]])
    return at


def _counter(probes: list[np.ndarray]):  # noqa: ANN202
    """For mapInArrow: bytes, rows, first and last key of every interval, added up over the partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            *keys, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(_PARTS + 1))
            at = _interval(keys, probes)
            order = np.lexsort((*reversed(keys), at))
            at, keys, size = at[order], [k[order] for k in keys], size[order]
            heads = np.flatnonzero(np.diff(at, prepend=-1))
            tails = np.append(heads[1:], len(at)) - 1
            if not len(heads):
                continue
            weight, rows = np.add.reduceat(size, heads), tails - heads + 1
            for i, a, z, w, n in zip(at[heads].tolist(), heads, tails, weight.tolist(), rows.tolist(), strict=True):
                first, last = tuple(int(k[a]) for k in keys), tuple(int(k[z]) for k in keys)
                old = sums.get(i)
                sums[i] = [w, n, first, last] if old is None else [old[0] + w, old[1] + n, min(old[2], first), max(old[3], last)]
        at = sorted(sums)
        columns = {"at": pa.array(at, pa.int32()), "bytes": pa.array([sums[k][0] for k in at], pa.int64()), "rows": pa.array([sums[k][1] for k in at], pa.int64())}
        for name, which in (("first", 2), ("last", 3)):
            columns |= {f"{name}{i}": pa.array([sums[k][which][i] for k in at], pa.int64()) for i in range(_PARTS)}
        yield pa.RecordBatch.from_pydict(columns)

    return count


def _count(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """One round: interval -> (bytes, rows, first key, last key). The result has a row per interval at most."""
    ends = [f"{name}{i}" for name in ("first", "last") for i in range(_PARTS)]
    counted = keys.mapInArrow(_counter(_unpack(probes)), "at int, bytes long, rows long, " + ", ".join(f"{e} long" for e in ends))
    found = counted.groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min(F.struct(*ends[:_PARTS])).alias("first"), F.max(F.struct(*ends[_PARTS:])).alias("last")).collect()
    return {r["at"]: (r["bytes"], r["rows"], _pack(r["first"]), _pack(r["last"])) for r in found}


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float = TOLERANCE, ranges_per_shard: int | None = None) -> Splitters:
    """Splitters for `n_shards` shards of near-equal bytes, each cut further into ranges.

    `keys` has four long columns without nulls: the parts of the key, bytes. It is read once a round.
    """
    probes = [i << (64 * _PARTS - 12) for i in range(1, 1 << 12)]
    chosen: dict[int, int] = {}
    rounds, per, targets = 0, 1, []
    while True:
        rounds += 1
        counts = _count(keys, probes)
        edges = [0, *probes]
        weights = np.array([counts[i][0] if i in counts else 0 for i in range(len(edges))], dtype=np.int64)
        numbers = np.array([counts[i][1] if i in counts else 0 for i in range(len(edges))], dtype=np.int64)
        bytes_below, rows_below = np.cumsum(weights) - weights, np.cumsum(numbers) - numbers
        if rounds == 1:
            total_bytes, total_rows = int(weights.sum()), int(numbers.sum())
            if not total_rows:
                return Splitters([], [0], [0], [0], rounds)
            per = ranges_per_shard or min(max(RANGES_PER_SHARD, -(-total_rows // (n_shards * ROWS_PER_RANGE))), max(1, MAX_RANGES // n_shards))
            step = total_bytes / (n_shards * per)
            targets = [(i * step, step * per * tolerance if i % per == 0 else step * RANGE_TOLERANCE) for i in range(1, n_shards * per)]
        fresh: set[int] = set()
        for t, (target, slack) in enumerate(targets):
            if t in chosen:
                continue
            i = int(np.searchsorted(bytes_below, target, side="right")) - 1
            low = (abs(int(bytes_below[i]) - target), edges[i])
            high = (abs(int(bytes_below[i] + weights[i]) - target), edges[i + 1] if i + 1 < len(edges) else counts[i][3] + 1)
            first, last = counts[i][2], counts[i][3]
            if min(low, high)[0] <= slack or first == last:
                chosen[t] = min(low, high)[1]
            else:  # probe the first part in which the interval's keys differ: between groups while there are several
                shift = next(64 * p for p in range(_PARTS - 1, -1, -1) if first >> 64 * p != last >> 64 * p)
                a, b = (first >> shift) + 1, last >> shift
                fresh |= {(a + (b - a) * j // PROBES) << shift for j in range(PROBES + 1)}
        if not fresh:
            break
        probes = sorted(fresh.union(probes))
    cuts = [chosen[t] for t in range(per - 1, len(targets), per)]
    starts = sorted({0, *chosen.values()})
    place = {k: i for i, k in enumerate(edges)}
    rows = [int(rows_below[place[k]]) if k in place else total_rows for k in starts]
    sizes = [int(bytes_below[place[k]]) if k in place else total_bytes for k in starts]
    return Splitters(starts[1:], [sum(c <= k for c in cuts) for k in starts], rows, sizes, rounds)


def key_columns(text: Column, doc_id: Column) -> tuple[Column, Column]:
    """Major and minor key: the text's hash (null: that of no text), the id (null: the smallest long)."""
    return F.xxhash64(F.coalesce(text, F.lit(""))), F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)).cast("long"))


def histogram_sort(rows: DataFrame, major: str, minor: str, size: str, n_shards: int, tolerance: float = TOLERANCE, ranges_per_shard: int | None = None) -> DataFrame:
    """`rows` with `shard` (int) and `slot` (long, gapless from 0 in each shard, in key order).

    `major`, `minor` and `size` name long columns without nulls. Shards are near equal in the sum of
    `size`. Rows with both keys equal are told apart by their place in the input (partition and row), so
    they are cut like others. `rows` is read once and written with its places, as a second read could cut
    the input otherwise; rounds read the keys of what was written. An empty table gives an empty one. Other
    columns pass through.
    """
    placed = cut(rows.withColumn("__t", F.xxhash64(F.monotonically_increasing_id())), "shard-rows")
    splitters = find_splitters(placed.select(major, minor, "__t", size), n_shards, tolerance, ranges_per_shard)
    spark = rows.sparkSession
    shard_of, below = np.array(splitters.shard_of), np.array(splitters.rows_below, dtype=np.int64)
    first_of_shard = np.array([below[np.searchsorted(shard_of, s, side="left")] for s in shard_of], dtype=np.int64)
    shared = spark.sparkContext.broadcast((_unpack(splitters.keys), shard_of.astype(np.int32), below - first_of_shard))  # MAX_RANGES rows at most

    @F.pandas_udf("range int, shard int, before long")
    def place(h, m, t):  # noqa: ANN001, ANN202
        import pandas as pd

        probes, shards, before = shared.value
        at = _interval([x.to_numpy() for x in (h, m, t)], probes)
        return pd.DataFrame({"range": at.astype(np.int32), "shard": shards[at], "before": before[at]})

    placed = placed.withColumn("__place", place(F.col(major), F.col(minor), F.col("__t")))
    order = Window.partitionBy("__place.range").orderBy(major, minor, "__t")
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return placed.withColumn("__rank", F.row_number().over(order)).select(
        *kept,
        F.col("__place.shard").alias("shard"),
        (F.col("__place.before") + F.col("__rank") - 1).cast("long").alias("slot"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """Documents dealt to shards of near-equal bytes: all columns, then shard, slot and size.

    A row weighs its text's UTF-8 bytes plus 1 (null: 1). Columns of the input that are named shard,
    slot or size are replaced. Null ids come first among equal texts; repeated rows are all kept.
    """
    plain = docs.drop("shard", "slot", "size")
    major, minor = key_columns(F.col("text"), F.col("doc_id"))
    rows = plain.withColumns({"__h": major, "__l": minor, "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1})
    return histogram_sort(rows, "__h", "__l", "size", n_shards, tolerance).drop("__h", "__l")


def shard_digest(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The contract's columns for every document: only these travel, not the texts.

    Nulls, repeated rows and empty tables are as in `shard_documents`; grown_shard is null under this law.
    """
    major, minor = key_columns(F.col("text"), F.col("doc_id"))
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        major.alias("__h"),
        minor.alias("__l"),
    )
    placed = histogram_sort(rows, "__h", "__l", "size", n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
