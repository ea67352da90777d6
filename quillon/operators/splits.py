"""Purged and embargoed folds over dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillon.operators.windows import date_positions
from quillon.sources.intermediate import cut


def fold_bounds(n_dates: int, n_folds: int) -> list[tuple[int, int]]:
    """First and last position of each test fold: n // k dates, one more for the first n mod k."""
    if n_folds < 2:
        raise ValueError("at least two folds are needed")
    if n_dates < n_folds:
        raise ValueError(f"{n_dates} dates do not fill {n_folds} folds")
    out, at = [], 0
    for i in range(n_folds):
        size = n_dates // n_folds + (i < n_dates % n_folds)
        out.append((at, at + size - 1))
        at += size
    return out


def purged_folds(df: DataFrame, n_folds: int, purge: int, embargo: int) -> DataFrame:
    """(date, fold, role): each date is `test` in one fold and `train` where it lies outside purge and embargo.

    Folds whose training part is empty are left out. Join it to rows by date; folds are a handful of rows.
    """
    dates = date_positions(df)
    spark = df.sparkSession
    folds = spark.createDataFrame([Row(fold=i, low=a, high=b) for i, (a, b) in enumerate(fold_bounds(dates.count(), n_folds))])
    p = F.col("position")
    role = F.when(p.between(F.col("low"), F.col("high")), "test").when((p <= F.col("low") - purge - 1) | (p >= F.col("high") + embargo + 1), "train")
    placed = dates.crossJoin(F.broadcast(folds)).withColumn("role", role).where("role is not null").select("date", "fold", "role")
    trained = placed.where("role = 'train'").select("fold").distinct()
    return placed.join(F.broadcast(trained), "fold", "left_semi").select("date", "fold", "role")


def fold_roles(rows: DataFrame, group: str, steps: Mapping[int, tuple[int, int]], n_folds: int, least: int = 1, partly: bool = False) -> DataFrame:
    """(group, date, fold, model, role): purged folds over each group's own dates. `steps`: purge and embargo by group.

    Rows of other groups are left out, and so are folds with fewer than `least` rows to train on. What is then
    tested by no fold is tested by one model of all rows of its group (fold null), if the group has no fold left
    or if `partly`. A group with fewer dates than folds has no fold. Models are numbered apart over all groups.
    """
    sizes = cut(rows.where(F.col(group).isin(list(steps))).groupBy(group, "date").count(), "dates")
    dates = {r[0]: r[1] for r in sizes.groupBy(group).count().collect()}  # a row per group
    whole = F.coalesce(*[F.when(F.col(group) == v, F.lit(i * (n_folds + 1) + n_folds)) for i, v in enumerate(steps)])
    columns = [group, "date", "fold", "model", "role"]

    def of_all(df: DataFrame, role: str) -> DataFrame:
        return df.select(group, "date", F.lit(None).cast("long").alias("fold"), whole.cast("int").alias("model"), F.lit(role).alias("role"))

    folds = of_all(sizes.where("false"), "")
    for i, (v, (purge, embargo)) in enumerate(steps.items()):
        if dates.get(v, 0) >= n_folds:
            one = purged_folds(sizes.where(F.col(group) == v), n_folds, purge, embargo)
            folds = folds.unionByName(one.withColumns({group: F.lit(v), "model": (F.col("fold") + i * (n_folds + 1)).cast("int")}).select(*columns))
    folds = cut(folds, "folds")
    enough = folds.where("role = 'train'").join(sizes, [group, "date"]).groupBy("model").agg(F.sum("count").alias("n")).where(F.col("n") >= least)
    kept = cut(folds.join(F.broadcast(enough), "model", "left_semi").select(*columns), "kept")  # a row per date and fold
    tested = kept.where("role = 'test'")
    left = sizes.join(tested, [group, "date"], "left_anti")
    left = left if partly else left.join(tested, group, "left_anti")
    return cut(kept.unionByName(of_all(left, "test")).unionByName(of_all(sizes.join(left, group, "left_semi"), "train")), "roles")


def steps_for(horizons: Sequence[int], most: int | None = None) -> int:
    """Rows to purge so that no label of a training row reaches the test: the longest horizon, or less."""
    return min(max(horizons), most) if most is not None else max(horizons)


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most n rows by a seeded hash of (id, date): the same rows whatever the partitioning."""
    return df.withColumn("__h", F.xxhash64(F.lit(seed), "id", "date")).orderBy("__h", "id", "date").limit(n).drop("__h")
