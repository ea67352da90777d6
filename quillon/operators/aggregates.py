"""Aggregations of panels and score logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ranges import percentiles
from quillon.operators.windows import normalized_weight

SCORE_COLUMNS = ("y", "l", "u", "width_scaled", "loss_scaled", "covered")


def with_weights(scores: DataFrame, panel: DataFrame | None, default: float = 1.0) -> DataFrame:
    """`scores` with the index weight of its (date, id), or its own where no panel is given; rows without one get `default`."""
    if panel is None:
        return scores.withColumn("index_weight", F.coalesce("index_weight", F.lit(default)))
    weights = panel.select("date", "id", "index_weight").dropDuplicates(["date", "id"])
    plain = scores.drop("index_weight")
    return plain.join(weights, ["date", "id"], "left").withColumn("index_weight", F.coalesce("index_weight", F.lit(default)))


def index_mean(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("date",), eps: float = 1e-12) -> DataFrame:
    """Weighted mean of each column over its own non-null rows, per group, in one pass."""
    w = F.col("index_weight")
    return df.groupBy(*by).agg(*[(F.sum(F.col(c) * w) / (F.sum(F.when(F.col(c).isNotNull(), w)) + eps)).alias(c) for c in columns])


def security_to_index(scores: DataFrame, by: Sequence[str] = ("date", "h"), columns: Sequence[str] = SCORE_COLUMNS) -> DataFrame:
    """Score log to an index series: weighted means and the alpha of each group, in one pass."""
    w = F.col("index_weight")
    return scores.groupBy(*by).agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in columns], F.min("alpha").alias("alpha"))


def overall_loss(scores: DataFrame) -> DataFrame:
    """One row: weighted loss of each (date, h), then the mean over those."""
    daily = scores.withColumn("w", normalized_weight(F.col("index_weight"), ["date", "h"])).groupBy("date", "h").agg(F.sum(F.col("w") * F.col("loss_scaled")).alias("loss"))
    return daily.agg(F.avg("loss").alias("overall_weighted"), F.count(F.lit(1)).alias("n"))


def summary(scores: DataFrame) -> DataFrame:
    """Overall and by horizon (h null: all): a rollup of mean, median and 99th percentile of losses, and more.

    Percentiles are exact and come from counts of values by range, so no horizon's losses have to fit in one task.
    """
    plain = scores.rollup("h").agg(
        F.avg("loss_scaled").alias("mean_loss"),
        F.avg("covered").alias("coverage"),
        F.avg("width_scaled").alias("mean_width"),
        F.count_distinct("id").alias("n_ids"),
        F.count_distinct("date").alias("n_dates"),
        F.count(F.lit(1)).alias("n"),
    )
    ranked = percentiles(scores, ["h"], "loss_scaled", (0.5, 0.99), ("median_loss", "p99_loss"), rollup=True).withColumnRenamed("h", "__h")
    both = plain.join(ranked, F.col("h").eqNullSafe(F.col("__h")), "left")
    return both.select("h", "mean_loss", "median_loss", "p99_loss", "coverage", "mean_width", "n_ids", "n_dates", "n")


def by_horizon(scores: DataFrame) -> DataFrame:
    """Loss, coverage, width and days of each horizon."""
    return scores.groupBy("h").agg(F.avg("loss_scaled").alias("mean_loss"), F.avg("covered").alias("coverage"), F.avg("width_scaled").alias("mean_width"), F.count_distinct("date").alias("n_days"))


def per_security(scores: DataFrame) -> DataFrame:
    """Loss, coverage, width and rows of each id."""
    return scores.groupBy("id").agg(F.avg("loss_scaled").alias("mean_loss"), F.avg("covered").alias("coverage"), F.avg("width_scaled").alias("mean_width"), F.count(F.lit(1)).alias("n"))


def top_bottom(table: DataFrame, k: int = 30, column: str = "mean_loss", key: str = "id") -> DataFrame:
    """The k smallest and the k largest rows, marked by `side`; ties go by key."""
    low = table.orderBy(F.col(column).asc(), F.col(key).asc()).limit(k).withColumn("side", F.lit("best"))
    high = table.orderBy(F.col(column).desc(), F.col(key).asc()).limit(k).withColumn("side", F.lit("worst"))
    return low.unionByName(high)


def leaderboard(scores: DataFrame) -> DataFrame:
    """Per baseline: weighted loss (mean over its dates and horizons), plain loss, coverage, width, rows; in one pass over the log."""
    w = F.col("index_weight")
    weighted = F.sum(w * F.col("loss_scaled")) / (F.sum(w) + 1e-12)  # the rows' shares of their group's weight times loss
    daily = scores.groupBy("baseline", "date", "h").agg(weighted.alias("wl"), F.sum("loss_scaled").alias("sl"), F.sum("covered").alias("sc"), F.sum("width_scaled").alias("sw"), F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return daily.groupBy("baseline").agg(
        F.avg("wl").alias("mean_loss_scaled"),
        (F.sum("sl") / total).alias("mean_loss_simple"),
        (F.sum("sc") / total).alias("cov_rate"),
        (F.sum("sw") / total).alias("mean_width_scaled"),
        total.alias("n_predictions"),
    )


def best_and_worst(board: DataFrame, k: int = 3) -> DataFrame:
    """The k best and k worst fixed policies, none in both (a row counts as best first)."""
    fixed = board.where(F.col("baseline").startswith("fixed_"))
    # A row per policy: few enough for one ordered pass.
    ranked = fixed.withColumn("up", F.row_number().over(Window.orderBy("mean_loss_scaled", "baseline"))).withColumn("down", F.row_number().over(Window.orderBy(F.desc("mean_loss_scaled"), "baseline")))
    side = F.when(F.col("up") <= k, "best").when(F.col("down") <= k, "worst")
    return ranked.withColumn("side", side).where("side is not null").select("side", "baseline", "mean_loss_scaled", F.when(F.col("side") == "best", F.col("up")).otherwise(F.col("down")).alias("place"))


def policy_mode(actions: DataFrame) -> DataFrame:
    """Per date the most frequent momentum and, apart from it, the most frequent horizon; ties to the lowest id."""

    def mode(c: str) -> DataFrame:
        counts = actions.groupBy("date", c).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
        best = counts.groupBy("date").agg(F.min(F.struct(-F.col("n"), F.col("first"), F.col(c))).alias("b"))
        return best.select("date", F.col(f"b.{c}").alias(c))

    return mode("momentum").join(mode("h"), "date")


def effective_size(w: str = "w"):  # noqa: ANN201
    """(sum w) squared over the sum of squares."""
    return F.pow(F.sum(w), F.lit(2)) / (F.sum(F.col(w) * F.col(w)) + 1e-18)


def coverage_statistics(scores: DataFrame) -> DataFrame:
    """By horizon and overall (h null): coverage, rows, and the spread of daily coverage."""
    daily = scores.groupBy("h", "date").agg(F.sum("covered").alias("k"), F.count(F.lit(1)).alias("n"))
    every = daily.unionByName(daily.groupBy("date").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).withColumn("h", F.lit(None).cast("int")))
    rate = F.col("k") / F.col("n")
    return every.groupBy("h").agg((F.sum("k") / F.sum("n")).alias("coverage"), F.sum("n").alias("n"), F.sum("k").alias("hits"), F.min(rate).alias("min_daily"), F.max(rate).alias("max_daily"), F.stddev_samp(rate).alias("std_daily"))


def observation_counts(scores: DataFrame) -> DataFrame:
    """One row: rows, ids, dates, averages, and five numbers of the rows per id."""
    per_id = scores.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    shape = per_id.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"), F.avg("n").alias("per_id"), F.stddev_samp("n").alias("sd_per_id"), F.min("n").alias("least"), F.max("n").alias("most"), q.alias("q"))
    dates = scores.agg(F.count_distinct("date").alias("dates"))
    return shape.crossJoin(dates).select("rows", "ids", "dates", "per_id", (F.col("rows") / F.col("dates")).alias("per_date"), "sd_per_id", "least", "most", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def histogram(df: DataFrame, c: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin from 0, n): equal bins over [low, high]; the last one holds `high`."""
    at = F.least(F.floor((F.col(c) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(c).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_of_range(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """(bin from 0, low, high, n): equal bins between the least and the largest value; empty bins are given too.

    Where all values are one, the range is half a unit to either side of it.
    """
    ends = df.agg(F.min(c).alias("a"), F.max(c).alias("b")).where("a is not null")
    ends = ends.select(F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("a") - 0.5).alias("a"), F.when(F.col("a") < F.col("b"), F.col("b")).otherwise(F.col("b") + 0.5).alias("b"))
    step = (F.col("b") - F.col("a")) / bins
    placed = df.where(F.col(c).isNotNull()).crossJoin(F.broadcast(ends)).select(F.least(F.floor((F.col(c) - F.col("a")) / step), F.lit(bins - 1)).cast("int").alias("bin"))  # ends: one row
    every = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", step.alias("step"))
    counted = every.join(placed.groupBy("bin").agg(F.count(F.lit(1)).alias("k")), "bin", "left")
    return counted.select("bin", (F.col("a") + F.col("bin") * F.col("step")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("step")).alias("high"), F.coalesce("k", F.lit(0)).alias("n"))


def pivot_mean(df: DataFrame, row: str, column: str, values: Sequence, c: str) -> DataFrame:
    """Means of `c`, rows by `row` and columns by the given values of `column`."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(c))
