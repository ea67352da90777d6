"""Window operators of the panel. Time is counted in an id's rows, never in days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.operators.ranges import trailing

#: Least standard deviation in momentum, what is added to it, and rows that rolling sums need.
VOL_FLOOR, VOL_EPS, MIN_ROWS = 0.01, 1e-8, 5


def by_id() -> WindowSpec:
    """An id's rows in order of date."""
    return Window.partitionBy("id").orderBy("date")


def _gated(value: Column, seen: Column, least: int) -> Column:
    return F.when(seen >= least, value)


def momentum(ret: Column, w: int) -> Column:
    """Sum of the w returns before a row over their floored deviation (of 20 rows at least)."""
    past, wide = by_id().rowsBetween(-w, -1), by_id().rowsBetween(-max(20, w), -1)
    total = _gated(F.sum(ret).over(past), F.count(ret).over(past), MIN_ROWS)
    sd = _gated(F.stddev_samp(ret).over(wide), F.count(ret).over(wide), MIN_ROWS)
    return total / (F.greatest(F.coalesce(sd, F.lit(VOL_FLOOR)), F.lit(VOL_FLOOR)) + VOL_EPS)


def rolling_std(c: Column, n: int, least: int, spec: WindowSpec | None = None) -> Column:
    """Sample deviation over the last n rows, the present one included; 0 below `least` values."""
    frame = (spec if spec is not None else by_id()).rowsBetween(-(n - 1), 0)
    return F.coalesce(_gated(F.stddev_samp(c).over(frame), F.count(c).over(frame), least), F.lit(0.0))


def rolling_mean(c: Column, n: int, least: int, spec: WindowSpec) -> Column:
    """Mean of the last n rows; null below `least` values."""
    frame = spec.rowsBetween(-(n - 1), 0)
    return _gated(F.avg(c).over(frame), F.count(c).over(frame), least)


def autocorrelation(ret: Column, n: int = 21, least: int = 10) -> Column:
    """Correlation of returns with those a row before, in the last n rows; 0 where there are too few."""
    frame, whole = by_id().rowsBetween(-(n - 2), 0), by_id().rowsBetween(-(n - 1), 0)
    before = F.lag(ret).over(by_id())
    now = F.when(before.isNotNull(), ret)
    before = F.when(ret.isNotNull(), before)
    # A frame without variance has no correlation; the quotient then is null rather than an error.
    r = F.try_divide(F.covar_samp(now, before).over(frame), F.stddev_samp(now).over(frame) * F.stddev_samp(before).over(frame))
    return F.coalesce(_gated(r, F.count(ret).over(whole), least), F.lit(0.0))


def forward_return(ret: Column, h: int) -> Column:
    """Compound return of the next h rows, a missing one as 0; null if there are fewer."""
    frame = by_id().rowsBetween(1, h)
    return F.when(F.lead("date", h).over(by_id()).isNotNull(), F.product(1 + F.coalesce(ret, F.lit(0.0))).over(frame) - 1)


def percentile_rank(c: Column, by: Sequence[str] = ("date",), least: int = 10, digits: int = 8) -> Column:
    """Mean rank over the number of values of a cross-section; 0.5 for nulls and small ones."""
    key = F.round(c, digits)
    n = F.count(key).over(Window.partitionBy(*by))
    ordered = Window.partitionBy(*by).orderBy(key.asc_nulls_last())
    # A value's first and last place, so that ties need no exchange of their own.
    first, last = F.rank().over(ordered), F.count(key).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when((n < least) | key.isNull(), F.lit(0.5)).otherwise(((first + last) / 2) / n)


def forward_fill(c: str) -> Column:
    """The last value so far that is not null."""
    return F.last(c, ignorenulls=True).over(by_id().rowsBetween(Window.unboundedPreceding, 0))


def weighted_mean_by(c: Column, w: Column, by: Sequence[str], eps: float = 1e-15, need_weight: bool = False) -> Column:
    """Weighted mean of a group, on each of its rows; null for groups without weight if asked for."""
    group = Window.partitionBy(*by)
    mean = F.sum(c * (w + eps)).over(group) / F.sum(w + eps).over(group)
    return F.when(F.sum(w).over(group) > 0, mean) if need_weight else mean


def normalized_weight(w: Column, by: Sequence[str], eps: float = 1e-12) -> Column:
    """A row's share of its group's weight."""
    return w / (F.sum(w).over(Window.partitionBy(*by)) + eps)


def alive_and_maturity(df: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """`alive_h{h}` and `mat_date_h{h}`: whether the row h steps on exists, and its date. For the test slice."""
    added = {}
    for h in horizons:
        ahead = F.lead("date", h).over(by_id())
        added[f"alive_h{h}"] = ahead.isNotNull().cast("int")
        added[f"mat_date_h{h}"] = ahead
    return df.withColumns(added)


def date_positions(df: DataFrame) -> DataFrame:
    """(date, position) of the distinct dates, from 0. Dates are few; the rows are not ordered."""
    return df.select("date").distinct().withColumn("position", F.row_number().over(Window.orderBy("date")) - 1)


def lagged_outcome(c: str, k: int, by: Sequence[str] = ("id",)) -> Column:
    """The value k rows before."""
    return F.lag(c, k).over(Window.partitionBy(*by).orderBy("date"))


def running_number() -> Column:
    """An id's rows counted from 0 in order of date."""
    return F.row_number().over(by_id()) - 1


def last_flags_mean(df: DataFrame, c: str, n: int = 60, by: Sequence[str] = ("run",), order: Sequence[str] = ("date", "id"), name: str = "share") -> DataFrame:
    """`df` with the share of set flags among the last n (10 at least) rows of a run, the present one included, however few there are.

    A run's rows are many and runs are few, so its ranges go side by side.
    """
    frame = max(10, n) - 1
    return trailing(df, by, order, frame, {name: lambda spec: F.avg(F.col(c).cast("double")).over(spec.rowsBetween(-frame, 0))})
