"""Mixing sources to target weights with Sainte-Lague apportionment.

Each source's words, laid end to end, are cut into blocks of nearly equal size. The blocks that the
mix takes are apportioned by highest quotients (weight / (2 n + 1) for the n-th block more): first to
sources by their targets, then to the shards of each source by the words they hold. Inside a shard
whole rounds of its blocks are taken first, and a seeded permutation picks the rest, so a document's
share is the words it has in the blocks taken. Every count is an integer and every rerun agrees.

Sources are rows of a table, however many there are: they are numbered, capped and given their seats by
aggregations over it, of which the driver sees sums only. Rows are numbered once, as they are written
with the words they have, and known by that number from there on: a second read of the input could cut it
otherwise. The shares are computed from the written table's narrow columns and joined to its rows by number.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.storage import cut
from quillon.llm.words import mix, ranges

#: A word: any run of bytes but blanks (space, tab, line feed, vertical tab, form feed, return).
WORD = r"[^\x20\x09-\x0D]+"
#: Weights given to the sources in order of code point, repeating; null comes last.
WEIGHTS = (1, 2, 3)
#: A source is taken at most so many times over, and so is each of its documents.
MAX_REPEATS = 3
#: Words in a block.
BLOCK_WORDS = 64
#: Documents that one shard of a source should hold, and shards in all.
ROWS_PER_SHARD, MAX_SHARDS = 500, 16_384
SEED = 20_240_601
#: Divisors that one round of apportionment tries, and rounds at most.
PROBES, ROUNDS = 128, 12
#: Parts of one in which shares of documents are counted.
_ONE = 1 << 30


def word_count(text: Column) -> Column:
    """Words in a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: Sequence[int], weights: Sequence[float], cap: float = MAX_REPEATS) -> list[float]:
    """Share the sum of `sizes` by `weights`, none above `cap` times its size; excess is reshared."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while free and left > 0:
        share = left / sum(weights[i] for i in free)
        over = [i for i in free if share * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                targets[i] = share * weights[i]
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
        free = [i for i in free if i not in over]
    return targets


def sainte_lague(weights: Sequence[float], seats: int, limits: Sequence[int]) -> list[int]:
    """Seats by highest quotients weight / (2 n + 1), ties to the earlier entry, none above its limit.

    Most seats are found from a divisor below every quotient that wins one; the last are dealt one by
    one, so the cost doesn't grow with the number of seats. Fewer seats are dealt if all limits are met.
    """
    seats = min(seats, sum(limits))
    weights = [float(w) for w in weights]

    def at(divisor: float) -> list[int]:
        # Seats whose quotient w / (2 n + 1) is above the divisor: n < (w / divisor - 1) / 2.
        return [min(limit, max(0, int(np.ceil((w / divisor - 1) / 2 - 1e-9)))) if w > 0 else 0 for w, limit in zip(weights, limits, strict=True)]

    high = max(weights, default=0.0) + 1.0
    low = high
    got = [0] * len(weights)
    while sum(at(low)) < seats and low > 1e-300:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if sum(at(middle)) <= seats:
            high, got = middle, at(middle)
        else:
            low = middle
        if sum(got) == seats:
            break
    queue = [(-w / (2 * n + 1), i) for i, (w, n, limit) in enumerate(zip(weights, got, limits, strict=True)) if n < limit]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < limits[i]:
            heapq.heappush(queue, (-weights[i] / (2 * got[i] + 1), i))
    return got


def _numbered(sized: DataFrame) -> DataFrame:
    """(source, number, words, n, weight): a row per source, numbered from 0 by code point, null last."""
    per = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    ranged = cut(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "sources")
    counts = sorted((r["range"], r["count"]) for r in ranged.groupBy("range").count().collect())  # a row per range
    before, offsets = 0, []
    for number, count in counts:
        offsets.append((number, before))
        before += count
    starts = sized.sparkSession.createDataFrame(offsets, "range int, before long")
    rank = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    numbered = ranged.join(F.broadcast(starts), "range").withColumn("number", F.col("before") + rank - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("number") % len(WEIGHTS)).cast("int") + 1)
    return cut(numbered.select("source", "number", "words", "n", weight.alias("weight")), "sources")


def _share(sources: DataFrame) -> float:
    """Words for each unit of weight, such that sources capped at MAX_REPEATS times their words leave none over."""
    total, free = sources.agg(F.sum("words"), F.sum(F.when(F.col("words") > 0, F.col("weight")))).first()
    share, capped = (total / free if free else 0.0), -1
    while free:
        over = F.col("weight") * share > MAX_REPEATS * F.col("words")
        words, free, count = sources.where("words > 0").agg(F.sum(F.when(over, MAX_REPEATS * F.col("words"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if count == capped or not free:
            break
        share, capped = (total - (words or 0)) / free, count
    return share


def _seats(table: DataFrame, seats: int) -> DataFrame:
    """`table` (number, weight, most) with `seats`, apportioned as `sainte_lague` does, by sums over the table."""
    at = lambda d: F.least(F.col("most"), F.greatest(F.lit(0), F.ceil((F.col("weight") / d - 1) / 2 - 1e-9))).cast("long")
    top, limit = table.where("weight > 0").agg(F.max("weight"), F.sum("most")).first()
    seats, high, held = min(seats, limit or 0), float(top or 0.0) + 1.0, 0
    low = min(0.25, high / 2)
    for _ in range(ROUNDS):
        if held == seats:
            break
        step = (high / low) ** (1 / PROBES)
        probes = [float(low * step**i) for i in range(PROBES)]
        tried = table.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(probes)])).alias("p"), "weight", "most")
        sums = dict(tried.groupBy("p.i").agg(F.sum(at(F.col("p.d"))).alias("held")).collect())
        fits = [i for i in range(PROBES) if sums[i] <= seats]
        if not fits:
            low = probes[-1]
            continue
        if fits[0] == 0:
            high, held, low = probes[0], sums[0], low / 256
        else:
            high, held, low = probes[fits[0]], sums[fits[0]], probes[fits[0] - 1]
    given = table.withColumn("seats", at(F.lit(high)))
    if held == seats:
        return given
    # Those whose next quotients are all but equal get one more each, the highest first, then by number.
    extra = given.where("seats < most and weight > 0").orderBy(F.desc(F.col("weight") / (2 * F.col("seats") + 1)), "number").limit(seats - held).select("number", F.lit(1).alias("more"))
    return given.join(extra, "number", "left").withColumn("seats", F.col("seats") + F.coalesce("more", F.lit(0))).drop("more")


def _deal(cells: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one source (its `seats`) apportioned to its shards by their words."""
    cells = cells.sort_values("shard")
    cells["quota"] = sainte_lague(cells["held"].tolist(), int(cells["seats"].iloc[0]), (MAX_REPEATS * cells["blocks"]).tolist())
    return cells[["number", "shard", "held", "blocks", "quota"]]


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a seeded permutation of 0 .. n - 1 puts each index; n and key may differ from entry to entry.

    A Feistel network permutes the numbers of an even count of bits; those that land beyond n go on.
    """
    out, n = index.astype(np.uint64), n.astype(np.uint64)
    half = np.ones(len(out), dtype=np.uint64)
    while (short := (np.uint64(1) << (np.uint64(2) * half)) < n).any():
        half += short.astype(np.uint64)
    mask, live = (np.uint64(1) << half) - np.uint64(1), np.arange(len(out))
    while len(live):
        h, m, k = half[live], mask[live], key[live]
        left, right = out[live] >> h, out[live] & m
        for turn in range(4):
            left, right = right, left ^ (mix(right ^ k, turn) & m)
        out[live] = left << h | right
        live = live[out[live] >= n[live]]
    return out.astype(np.int64)


def _taken(seed: int):  # noqa: ANN202
    """A pandas UDF: the words of each row that lie in blocks taken, repeats counted."""

    @F.pandas_udf("long")
    def taken(source: pd.Series, shard: pd.Series, start: pd.Series, size: pd.Series, words: pd.Series, blocks: pd.Series, quota: pd.Series) -> pd.Series:
        s, k, f, n, c, b, q = (x.fillna(0).to_numpy(dtype=np.int64) for x in (source, shard, start, size, words, blocks, quota))
        out = np.zeros(len(n), dtype=np.int64)
        live = np.flatnonzero((n > 0) & (b > 0))
        s, k, f, n, c, b, q = (x[live] for x in (s, k, f, n, c, b, q))
        # Block j of b over c words is [j c div b, (j + 1) c div b): those that a row touches.
        low, high = np.maximum(f * b // c - 1, 0), np.minimum((f + n - 1) * b // c + 1, b - 1)
        count = high - low + 1
        row, block = np.repeat(np.arange(len(n)), count), ranges(low, count)
        overlap = np.minimum((block + 1) * c[row] // b[row], (f + n)[row]) - np.maximum(block * c[row] // b[row], f[row])
        key = mix(mix(s.astype(np.uint64), seed) ^ k.astype(np.uint64))
        times = (q // np.maximum(b, 1))[row] + (permuted(block, b[row], key[row]) < (q % np.maximum(b, 1))[row])
        out[live] = np.bincount(row, weights=np.maximum(overlap, 0) * times, minlength=len(n)).astype(np.int64)
        return pd.Series(out)

    return taken


def _numbered_rows(docs: DataFrame, seed: int, columns: Sequence[str] = ()) -> DataFrame:
    """(place, doc_id, source, order, size, c_...) of every row, written: its number, what the mix needs, and the `columns` asked for."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("order")
    own = [F.col(f"`{c}`").alias(f"c_{c}") for c in columns]
    return cut(docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", "source", order, word_count(F.col("text")).alias("size"), *own), "sizes")


def _laid(numbered: DataFrame, block_words: int, rows_per_shard: int, seed: int) -> DataFrame:
    """(place, doc_id, size, source_size, target, taken, number, shard, order) of every row of `_numbered_rows`."""
    sized = numbered.select("place", "doc_id", "source", "order", "size")
    sources = _numbered(sized)
    rows = sources.agg(F.sum("n")).first()[0] or 0
    share = _share(sources)
    per = max(rows_per_shard, -(-rows // MAX_SHARDS), 1)
    told = sources.select(
        "source",
        "number",
        F.col("words").alias("source_size"),
        F.least(F.col("weight") * share, (MAX_REPEATS * F.col("words")).cast("double")).alias("target"),
        F.ceil(F.col("n") / per).alias("shards"),
    )
    keyed = sized.join(told.withColumnRenamed("source", "from"), F.col("source").eqNullSafe(F.col("from"))).drop("from", "source")
    placed = keyed.withColumn("shard", F.pmod(F.shiftrightunsigned("order", 20), F.col("shards")).cast("int"))

    # Blocks of every shard, of every source, and how many of them are taken.
    held = placed.groupBy("number", "shard").agg(F.sum("size").alias("held")).where("held > 0")
    cells = cut(held.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("held") / block_words)).cast("long")), "cells")
    of_source = cells.groupBy("number").agg(F.sum("blocks").alias("n_blocks"))
    # A source's blocks may be a little off the common size, so its target is counted in its own.
    weights = of_source.join(told, "number").select("number", (F.col("target") / F.col("source_size") * F.col("n_blocks")).alias("weight"), (MAX_REPEATS * F.col("n_blocks")).alias("most"))
    weights = cut(weights, "weights")
    seats = _seats(weights, round(weights.agg(F.sum("weight")).first()[0] or 0))
    quotas = cells.join(seats.select("number", "seats"), "number").groupBy("number").applyInPandas(_deal, "number long, shard int, held long, blocks long, quota long")

    # Words before each row in its shard; rows that tie in this order are alike in all that counts.
    before = Window.partitionBy("number", "shard").orderBy("order", "doc_id", "size", "place").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).join(quotas, ["number", "shard"], "left")
    return laid.withColumn("taken", _taken(seed)("number", "shard", "start", "size", "held", "blocks", "quota"))


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, rows_per_shard: int = ROWS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """`docs` with size, source_size, target, taken: the words the mix takes of each row, repeats counted.

    Null text has no words and is never taken. Null source is a source of its own, the last one. Rows
    that repeat count each for themselves; their shares are dealt in a fixed order. An empty table
    gives an empty one. Columns of the input named as the new ones are replaced. `docs` is read once.
    """
    new = ["size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c not in new]
    numbered = _numbered_rows(docs, seed, kept)
    laid = _laid(numbered, block_words, rows_per_shard, seed)
    wide = numbered.select("place", *[F.col(f"`c_{c}`") for c in kept])
    return wide.join(laid.select("place", *new), "place").select(*[F.col(f"`c_{c}`").alias(c) for c in kept], *new)


def mixed_copies(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of `docs` as often as the mix takes it, in its own columns.

    A row taken for a part of its words stays or goes so that, in each shard of a source and in order of
    size, the parts add up to whole rows: a shard's words end within one of its documents of its quota.
    Rows without words are not taken. Nulls, repeated rows and empty tables are as in `mix_sources`.
    """
    numbered = _numbered_rows(docs, seed, docs.columns)
    laid = _laid(numbered, BLOCK_WORDS, ROWS_PER_SHARD, seed).where("size > 0")
    part = F.floor((F.col("taken") % F.col("size")) * F.lit(_ONE) / F.col("size")).cast("long")
    upto = Window.partitionBy("number", "shard").orderBy("size", "order", "place").rowsBetween(Window.unboundedPreceding, 0)
    from_ = F.pmod(F.xxhash64(F.lit(seed + 2), "number", "shard"), F.lit(_ONE))
    summed = laid.withColumn("part", part).withColumn("sum", F.sum("part").over(upto) + from_)
    extra = F.floor(F.col("sum") / _ONE) - F.floor((F.col("sum") - F.col("part")) / _ONE)
    times = summed.select("place", (F.floor(F.col("taken") / F.col("size")) + extra).cast("int").alias("times")).where("times > 0")
    wide = numbered.select("place", *[F.col(f"`c_{c}`") for c in docs.columns])
    repeated = wide.join(times, "place").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    return repeated.select(*[F.col(f"`c_{c}`").alias(c) for c in docs.columns])


def mix_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document; nulls, repeated rows and empty tables as in `mix_sources`."""
    return _laid(_numbered_rows(docs, SEED), BLOCK_WORDS, ROWS_PER_SHARD, SEED).select("doc_id", "size", "source_size", "target", "taken")
