"""Ordered work over few, long keys: rows are cut into ranges of (key, order), and ranges run side by side.

A window partitioned by a key with very many rows sorts them in one task. Here rows are dealt by range once
and written with the number of their range; what a range must know of those before it is small (a total per
range and key, or the last rows of its neighbours), so no task holds more than a range, whatever the key.
Ranges come from Spark's range exchange; rows that are equal in key and order lie in one of them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.sources.intermediate import cut


def in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """`df` in ascending ranges of the columns, written, with a row's range as `__part`."""
    return cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """`df` with `before`, the sum of `value` over the key's rows before each one, and `total`, over all of the key's rows.

    Null keys are keys, null values count as 0; an empty table gives an empty one. Rows that tie in order are
    taken one after the other.
    """
    rows = in_ranges(df, [*by, *order])
    own = [f"__{c}" for c in ("part", *by)]
    sums = rows.groupBy("__part", *by).agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum"))
    of_key = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("__sum").over(of_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row per range and key that lies in it.
    offsets = sums.select(F.col("__part").alias("___part"), *[F.col(c).alias(f"__{c}") for c in by], earlier.alias("__earlier"), F.sum("__sum").over(of_key).alias("total"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = rows.withColumn("__inside", inside).join(offsets, _same(["__part", *by], ["___part", *own[1:]]))
    return laid.select(*df.columns, (F.col("__earlier") + F.col("__inside")).alias("before"), "total")


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str], rollup: bool = False) -> DataFrame:
    """A row per group with the interpolated percentiles of its values, exact; with `rollup` also one of all rows (keys null).

    Values are counted first, then ranked by running totals, so no group has to fit in a task. Null and NaN
    values are left out, and groups that have no other.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__all", F.lit(False))
    if rollup:
        blank = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in by]
        counts = counts.unionByName(counts.groupBy(value).agg(F.sum("__n").alias("__n")).select(*blank, value, "__n", F.lit(True).alias("__all")))
    keys = [*by, "__all"]
    ranked = running_total(counts, keys, [value], "__n")
    place = lambda q: (F.col("total") - 1) * F.lit(float(q))
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("__n")), F.col(value)))
    told = [x for i, q in enumerate(shares) for x in (at(F.floor(place(q))).alias(f"__low{i}"), at(F.ceil(place(q))).alias(f"__high{i}"))]
    found = ranked.groupBy(*keys).agg(F.max("total").alias("total"), *told)
    between = [(F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * (place(q) - F.floor(place(q)))).alias(name) for i, (q, name) in enumerate(zip(shares, names, strict=True))]
    return found.select(*by, *between)


def percentile_ranks(df: DataFrame, columns: dict[str, str], by: Sequence[str] = ("date",), least: int = 10, digits: int = 8) -> DataFrame:
    """`df` with a column per entry of `columns` (new name -> column): the mean rank over the number of values of its
    cross-section, as `windows.percentile_rank` has it, from counts of values instead of a sort of a cross-section in one task.

    0.5 for nulls and in cross-sections of fewer than `least` values.
    """
    for name, c in columns.items():
        keyed = df.withColumn("__key", F.round(c, digits))
        counts = keyed.where("__key is not null").groupBy(*by, "__key").agg(F.count(F.lit(1)).alias("__n"))
        ranked = running_total(counts, by, ["__key"], "__n")
        share = F.when(F.col("total") >= least, (F.col("before") + (F.col("__n") + 1) / 2) / F.col("total"))
        told = ranked.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("__key").alias("__value"), share.alias("__share"))
        met = keyed.join(told, _same([*by, "__key"], [*[f"__{k}" for k in by], "__value"]), "left")
        df = met.select(*df.columns, F.coalesce("__share", F.lit(0.5)).alias(name))
    return df


def with_rows_before(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """`df` with `__at` and `__own`: every range's rows, and again those up to `n` before it (not `__own`), under its number `__at`."""
    own = in_ranges(df, [*by, *order])
    held = {r["__part"]: r["count"] for r in own.groupBy("__part").count().collect()}  # a number per range
    pairs = []
    for at in sorted(held):
        left = n
        for part in sorted((p for p in held if p < at), reverse=True):
            if left <= 0:
                break
            pairs.append((part, at, left))
            left -= held[part]
    tail = own.withColumn("__late", F.row_number().over(Window.partitionBy("__part").orderBy(*[F.desc(c) for c in (*by, *order)]))).where(F.col("__late") <= n)
    wanted = F.broadcast(own.sparkSession.createDataFrame(pairs, "__part int, __at int, __upto int"))  # a range and the few that follow it
    halo = tail.join(wanted, "__part").where("__late <= __upto").select(*df.columns, "__at", F.lit(False).alias("__own"))
    return own.select(*df.columns, F.col("__part").alias("__at"), F.lit(True).alias("__own")).unionByName(halo)


def trailing(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, columns: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """`df` with columns over the key's rows in order, each from a window that its function frames; frames reach `n` rows back at most.

    One key may hold all rows: its ranges run in tasks of their own, each with the `n` rows before it.
    """
    spec = Window.partitionBy("__at", *by).orderBy(*order)
    every = with_rows_before(df, by, order, n)
    return every.withColumns({name: make(spec) for name, make in columns.items()}).where("__own").select(*df.columns, *columns)


def _slide(keys: int, n: int, q: float, warmup: int):  # noqa: ANN202
    """For mapInArrow over sorted (keys..., own, score, row): the quantile of the `n` scores before each own row.

    The last scores are kept in order of arrival and in order of size; a row moves one in and one out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        arrived: deque = deque()
        ordered: list[float] = []
        for batch in batches:
            heads = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
            own, scores, out = batch.column(keys).to_pylist(), batch.column(keys + 1).to_pylist(), []
            for head, mine, score in zip(heads, own, scores, strict=True):
                if head != now:
                    now, arrived, ordered = head, deque(), []
                if mine:
                    held = len(ordered)
                    out.append(ordered[min(int(held * q), held - 1)] if held and held >= warmup else 0.0)
                arrived.append(score)
                if score is not None:
                    insort(ordered, score)
                if len(arrived) > n:
                    gone = arrived.popleft()
                    if gone is not None:
                        del ordered[bisect_left(ordered, gone)]
            kept = batch.column(keys + 2).filter(pa.array(own, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept, pa.array(out, pa.float64())], names=["row", "found"])

    return run


def trailing_quantile(df: DataFrame, by: Sequence[str], order: Sequence[str], score: Column, window: int, q: float, warmup: int, name: str) -> DataFrame:
    """`df` with `name`: the (floor(n q) + 1)-th smallest of the n scores among the key's rows before (30 or `window`, the larger), 0 until there are `warmup`.

    Null scores take a place in the window and are not counted.
    """
    n = max(30, window)
    every = with_rows_before(df.withColumn("__score", score.cast("double")), by, order, n)
    row = F.struct(*df.columns)
    ready = every.repartition("__at", *by).sortWithinPartitions("__at", *by, *order).select("__at", *[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], "__own", "__score", row.alias("row"))
    found = ready.mapInArrow(_slide(1 + len(by), n, q, warmup), f"row {ready.schema['row'].dataType.simpleString()}, found double")
    return found.select("row.*", F.col("found").alias(name))
