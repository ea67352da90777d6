"""Inference on date series: HAC errors, block bootstrap, Diebold-Mariano, binomial test.

A series is a table (by..., date, v). Its rows are dates, which are few next to the panel's rows; all
work stays in joins and windows per series, so many series are handled side by side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numbered(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Null and non-finite values dropped; position from 1, rows and mean of each series."""
    whole = Window.partitionBy(*by)
    ok = series.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    return ok.withColumns({"rn": F.row_number().over(whole.orderBy("date")), "n": F.count(F.lit(1)).over(whole), "mu": F.avg("v").over(whole)}).withColumn("e", F.col("v") - F.col("mu"))


def newey_west(series: DataFrame, by: Sequence[str] = (), max_lags: int | None = None, floor: float | None = 1e-18) -> DataFrame:
    """(by..., n, mean, nw_se): the HAC standard error of the mean, Bartlett weights.

    Without `max_lags`: floor(4 (n / 100)^(2/9)) lags, from 1 to n - 1, the weights' denominator one
    more. With it: at most n - 1 lags, and its own denominator. One value gives null.
    """
    by = list(by) or ["__all"]
    if by == ["__all"]:
        series = series.withColumn("__all", F.lit(1))
    rows = _numbered(series.select(*by, "date", "v"), by)
    n = F.col("n")
    if max_lags is None:
        lags = F.greatest(F.least(F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))), n - 1), F.lit(1)).cast("int")
        width = lags + 1.0
    else:
        lags, width = F.least(F.lit(max_lags), n - 1).cast("int"), F.lit(max_lags + 1.0)
    rows = rows.withColumns({"lags": lags, "width": width})
    ahead = rows.where("n > 1").select(*by, "rn", "e", "n", "lags", "width", F.explode(F.sequence(F.lit(1), F.greatest("lags", F.lit(1)))).alias("l")).where("l <= lags")
    late = ahead.select(*by, (F.col("rn") - F.col("l")).alias("rn"), "l", F.col("e").alias("e1"), "width")
    products = late.join(rows.select(*by, "rn", F.col("e").alias("e0")), [*by, "rn"])
    cross = products.groupBy(*by).agg(F.sum(2 * (1 - F.col("l") / F.col("width")) * F.col("e1") * F.col("e0")).alias("cross"))
    own = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.sum(F.col("e") * F.col("e")).alias("own"))
    variance = (F.col("own") + F.coalesce("cross", F.lit(0.0))) / F.col("n") / F.col("n")
    least = F.lit(floor if floor is not None else 0.0)
    out = own.join(cross, by, "left").select(*by, "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.greatest(variance, least))).alias("nw_se"))
    return out.drop("__all")


def block_bootstrap(series: DataFrame, by: Sequence[str] = (), block: int = 5, draws: int = 2000, alpha: float = 0.05, seed: int = 123) -> DataFrame:
    """(by..., n, mean, ci_lo, ci_hi): percentile interval of the mean under a circular moving-block bootstrap.

    Block starts come from a linear congruential rule of (draw, block), so engines agree. A draw's mean
    is a sum over its blocks of running-sum differences, so the work is draws x blocks, not draws x rows.
    """
    by = list(by) or ["__all"]
    if by == ["__all"]:
        series = series.withColumn("__all", F.lit(1))
    rows = _numbered(series.select(*by, "date", "v"), by)
    b = F.least(F.lit(block), F.col("n"))
    # Sum of each block of full length that starts at a row, and of the shorter last block.
    values = Window.partitionBy(*by).orderBy("rn")
    up = F.sum("v").over(values.rowsBetween(Window.unboundedPreceding, 0))
    laid = rows.withColumns({"up": up, "total": F.sum("v").over(Window.partitionBy(*by)), "b": b}).withColumn("last", F.col("n") - b * (F.ceil(F.col("n") / b) - 1))
    before = F.col("up") - F.col("v")
    sums = {}
    for name, length in (("full", F.col("b")), ("part", F.col("last"))):
        end = F.col("rn") + length - 1
        wrapped = end > F.col("n")
        stop = F.when(wrapped, end - F.col("n")).otherwise(end)
        sums[name] = (stop, wrapped)
    ups = laid.select(*by, F.col("rn").alias("stop"), F.col("up").alias("up_stop"))
    for name, (stop, wrapped) in sums.items():
        laid = laid.withColumn("stop", stop).join(ups, [*by, "stop"]).withColumn(name, F.col("up_stop") - before + F.when(wrapped, F.col("total")).otherwise(F.lit(0.0))).drop("stop", "up_stop")
    meta = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).withColumn("k", F.ceil(F.col("n") / F.least(F.lit(block), F.col("n"))).cast("int"))
    plan = meta.select(*by, "n", "mean", "k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    start = (F.col("draw").cast("long") * 1103515245 + F.col("j").cast("long") * 12345 * 7919 + seed) % F.col("n") + 1
    picked = plan.withColumn("rn", start).join(laid.select(*by, "rn", "full", "part"), [*by, "rn"])
    means = picked.groupBy(*by, "draw", "n", "mean", "k").agg((F.sum(F.when(F.col("j") == F.col("k") - 1, F.col("part")).otherwise(F.col("full")))).alias("s")).withColumn("m", F.col("s") / F.col("n"))
    out = means.groupBy(*by, "n", "mean").agg(F.percentile("m", alpha / 2).alias("ci_lo"), F.percentile("m", 1 - alpha / 2).alias("ci_hi"))
    return out.drop("__all")


def _t_tail(t: float, df: int) -> float:
    """Two-sided tail of Student's t, from the incomplete beta function's continued fraction."""
    if not math.isfinite(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))
    swap = x >= (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    value = front * h / a
    return min(1.0, max(0.0, 1 - value if swap else value))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    return pd.Series([_t_tail(abs(a), int(b)) if pd.notna(a) and pd.notna(b) and b > 0 else None for a, b in zip(t, df, strict=True)], dtype="float64")


def _binomial_tail(k: int, n: int, p: float) -> float:
    """Two-sided exact test: the chance of outcomes no likelier than k."""

    def log_mass(i: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)

    limit, mode = log_mass(k) + 1e-7, int((n + 1) * p)
    if k == mode:
        return 1.0

    def tail(start: int, stop: int, step: int) -> float:
        total, top = 0.0, log_mass(start)
        for i in range(start, stop, step):
            term = math.exp(log_mass(i) - top)
            total += term
            if term < 1e-18:
                break
        return math.exp(top) * total

    # The nearest outcome beyond the mode that is no likelier than k, by bisection.
    below = k < mode
    low, high = (mode, n) if below else (0, mode)
    while low < high:
        middle = (low + high + (not below)) // 2
        rare = log_mass(middle) <= limit
        if below:
            low, high = (low, middle) if rare else (middle + 1, high)
        else:
            low, high = (middle, high) if rare else (low, middle - 1)
    far = (tail(low, n + 1, 1) if below else tail(low, -1, -1)) if log_mass(low) <= limit else 0.0
    return min(1.0, (tail(k, -1, -1) if below else tail(k, n + 1, 1)) + far)


@F.pandas_udf(T.DoubleType())
def binomial_p_value(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Two-sided exact binomial p-value."""
    return pd.Series([_binomial_tail(int(a), int(b), float(c)) if b else None for a, b, c in zip(k, n, p, strict=True)], dtype="float64")


def diebold_mariano(pairs: DataFrame, by: Sequence[str] = (), h: int = 1, max_lags: int = 10, correction: str = "standard") -> DataFrame:
    """(by..., n, diff_mean, nw_se, dm_stat, p_value) of (by..., date, a, b): are the two losses equal on average?

    The small-sample factor multiplies the statistic ('standard') or divides it ('inverse').
    """
    base = newey_west(pairs.withColumn("v", F.col("a") - F.col("b")), by, max_lags, floor=None)
    n = F.col("n")
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    ratio: Column = F.col("mean") / F.when(F.col("nw_se") > 0, F.col("nw_se"))
    out = base.withColumn("dm_stat", ratio * factor if correction == "standard" else ratio / factor)
    return out.select(*by, "n", F.col("mean").alias("diff_mean"), "nw_se", "dm_stat", t_p_value("dm_stat", n - 1).alias("p_value"))


def paired_differences(base: DataFrame, variants: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., date, h, d_loss_scaled) of index series on the keys common with the base; none raises ValueError."""
    a = base.select("date", "h", F.col("loss_scaled").alias("loss_base"))
    out = a.join(variants.select(*by, "date", "h", F.col("loss_scaled").alias("loss_var")), ["date", "h"]).withColumn("d_loss_scaled", F.col("loss_var") - F.col("loss_base"))
    if out.isEmpty():
        raise ValueError("no common (date, h)")
    return out


def compare_variant(base: DataFrame, variants: DataFrame, by: Sequence[str] = (), block: int = 5, draws: int = 2000, alpha: float = 0.05) -> DataFrame:
    """Overall (scope 'all': horizons averaged by date) and by horizon: means, difference, HAC t, bootstrap interval.

    With `by`, all variants that it tells apart are compared side by side.
    """
    by = list(by)
    d = paired_differences(base, variants, by)
    cells = d.select(*by, F.concat(F.lit("h="), F.col("h").cast("string")).alias("scope"), "date", "loss_base", "loss_var", F.col("d_loss_scaled").alias("v"))
    total = d.groupBy(*by, "date").agg(F.avg("loss_base").alias("loss_base"), F.avg("loss_var").alias("loss_var"), F.avg("d_loss_scaled").alias("v"))
    both = cells.unionByName(total.withColumn("scope", F.lit("all")))
    key = [*by, "scope"]
    means = both.groupBy(*key).agg(F.avg("loss_base").alias("mean_loss_base"), F.avg("loss_var").alias("mean_loss_var"))
    hac = newey_west(both, key).select(*key, "n", F.col("mean").alias("mean_diff"), F.col("nw_se").alias("hac_se"), F.try_divide("mean", "nw_se").alias("hac_t"))
    boot = block_bootstrap(both, key, block, draws, alpha).select(*key, F.col("ci_lo").alias("mbb_ci_lo"), F.col("ci_hi").alias("mbb_ci_hi"))
    return means.join(hac, key).join(boot, key)


def performance_table(scores: DataFrame, block: int = 20, draws: int = 1000, alpha: float = 0.10) -> DataFrame:
    """(model, date, h, loss_scaled) index series: mean loss over dates with HAC error and bootstrap interval."""
    daily = scores.groupBy("model", "date").agg(F.avg("loss_scaled").alias("v"))
    hac = newey_west(daily, ["model"], 10, floor=None).select("model", F.col("mean").alias("mean_loss"), "nw_se")
    return hac.join(block_bootstrap(daily, ["model"], block, draws, alpha, 12345).select("model", "ci_lo", "ci_hi"), "model")


def significance_table(policy: DataFrame, baselines: DataFrame, least: int = 10) -> DataFrame:
    """Policy (date, loss) against each baseline (baseline, date, loss): improvement, statistic, flags; 10 dates at least."""
    pairs = baselines.select("baseline", "date", F.col("loss").alias("b")).join(policy.select("date", F.col("loss").alias("a")), "date")
    means = pairs.groupBy("baseline").agg(F.avg("a").alias("policy_loss"), F.avg("b").alias("baseline_loss"))
    test = diebold_mariano(pairs, ["baseline"])
    out = means.join(test, "baseline").where(F.col("n") >= least)
    gain = (F.col("baseline_loss") - F.col("policy_loss")) / F.nullif(F.col("baseline_loss"), F.lit(0.0)) * 100
    return out.select("baseline", "policy_loss", "baseline_loss", gain.alias("improvement_pct"), "dm_stat", "p_value", "nw_se", F.col("n").alias("n_dates"), (F.col("p_value") < 0.05).alias("significant_5pct"), (F.col("p_value") < 0.01).alias("significant_1pct"))
