"""Quantiles of conformal calibration, as aggregates and as window expressions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Stretches of a group's values that running sums are taken over side by side.
PARTS = 64


def weighted_quantile(df: DataFrame, by: Sequence[str], value: str, weight: str, q: float, name: str = "q") -> DataFrame:
    """Per group: the first value in ascending order at which the weight up to it exceeds q of all, else the last.

    Weights below 0 count as 0; if all are 0 the last value is taken. Equal values are joined first,
    so an order among them does not matter. A group's values are cut into stretches at approximate
    quantiles; each stretch's sums run in a task of its own, from what the stretches before it hold.
    """
    merged = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.greatest(F.col(weight), F.lit(0.0))).alias("w"))
    shares = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    cuts = merged.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.percentile_approx(value, shares, F.lit(10_000)).alias("cuts"))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"__{c}"))
    placed = merged.join(cuts, [same(c) for c in by]).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col(value)))).select(*by, value, "w", "part")
    parts = placed.groupBy(*by, "part").agg(F.sum("w").alias("held"))
    of_group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("held").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = parts.select(*[F.col(c).alias(f"__{c}") for c in (*by, "part")], before.alias("before"), F.sum("held").over(of_group).alias("tw"))  # PARTS rows a group
    up_to = Window.partitionBy(*by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.join(starts, [same(c) for c in (*by, "part")]).withColumn("cw", F.col("before") + F.sum("w").over(up_to))
    chosen = laid.groupBy(*by).agg(F.min(F.when(F.col("cw") > q * F.col("tw"), F.col(value))).alias("a"), F.max(value).alias("b"))
    return chosen.select(*by, F.coalesce("a", "b").alias(name))


def finite_sample_quantile(values: Column, q: float) -> Column:
    """Of an array: the ceil((n + 1) q)-th smallest, at most the largest; an empty array gives 0."""
    n = F.size(values)
    k = F.least(F.greatest(F.ceil((n + 1) * q).cast("int"), F.lit(1)), n)
    return F.when(n > 0, F.element_at(F.array_sort(values), k)).otherwise(F.lit(0.0))


def index_quantile(values: Column, q: float) -> Column:
    """Of an array: the (floor(n q) + 1)-th smallest, at most the largest (equal weights)."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.least(F.floor(n * q).cast("int") + 1, n)))


def kth_smallest(df: DataFrame, ranks: dict[str, int], bins: int = 1024, few: int = 10_000) -> dict[str, float]:
    """Column -> its value of that rank (from 1), exactly, without ordering rows.

    Each round counts every column's rows in equal bins of the interval that holds the rank, and goes on
    in one bin, until it holds `few` rows or one value; those values are counted and the rank read off.
    The driver sees counts of bins and of at most `few` values. Nulls must be gone.
    """
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in ranks for n, f in (("low", F.min), ("high", F.max))]).first()
    state = {c: (float(ends[f"low_{c}"]), float(ends[f"high_{c}"]), k) for c, k in ranks.items()}
    done: dict[str, float] = {c: low for c, (low, high, _) in state.items() if low == high}
    while open_ := [c for c in ranks if c not in done]:
        at = {c: F.least(F.floor((F.col(c) - state[c][0]) / ((state[c][1] - state[c][0]) / bins)), F.lit(bins - 1)).cast("int") for c in open_}
        rows = [F.when(F.col(c).between(state[c][0], state[c][1]), F.struct(F.lit(c).alias("c"), at[c].alias("bin"), F.col(c).alias("v"))) for c in open_]
        long = df.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")
        counts = long.groupBy("c", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for c in open_:
            left = state[c][2]
            for r in sorted((r for r in counts if r["c"] == c), key=lambda r: r["bin"]):
                if left <= r["n"]:
                    state[c] = (r["low"], r["high"], left)
                    if r["low"] == r["high"]:
                        done[c] = r["low"]
                    elif r["n"] <= few:
                        values = df.where(F.col(c).between(r["low"], r["high"])).groupBy(c).count().orderBy(c).collect()
                        upto = accumulate(v["count"] for v in values)
                        done[c] = next(v[c] for v, n in zip(values, upto, strict=True) if n >= left)
                    break
                left -= r["n"]
    return done


def batch_cqr(df: DataFrame, y: str, low: str, high: str, q: float) -> DataFrame:
    """One row: how far lower and upper bounds must move so that each side holds with level q."""
    below, above = F.greatest(F.col(low) - F.col(y), F.lit(0.0)), F.greatest(F.col(y) - F.col(high), F.lit(0.0))
    scored = df.where(f"{y} is not null and {low} is not null and {high} is not null").select(below.alias("a"), above.alias("b"))
    n = scored.count()
    k = min(max(-int(-((n + 1) * q) // 1), 1), n)
    found = kth_smallest(scored, {"a": k, "b": k}) if n else {"a": 0.0, "b": 0.0}
    return df.sparkSession.createDataFrame([(found["a"], found["b"])], "q_low double, q_high double")
