"""The security panel: from the sales tables at hand, and from raw quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.schema import PANEL, enforce_schema, normalize_quotes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly panel of suppliers: each is a security, its return the price-weighted discount less 5 %."""
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    day = F.to_date("l_shipdate")
    price = F.col("l_extendedprice")
    weekly = (
        lines.withColumn("date", F.date_sub(day, F.weekday(day)))
        .groupBy("date", "l_suppkey")
        .agg(
            (F.sum(price * (F.col("l_discount") - 0.05)) / F.sum(price)).alias("ret"),
            F.sum(price).alias("notional"),
            F.round(F.avg("l_tax"), 8).alias("spread"),
            F.avg("l_quantity").alias("duration"),
        )
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    share = F.col("notional") / F.sum("notional").over(Window.partitionBy("date"))
    return weekly.select(
        "date",
        F.col("l_suppkey").cast("string").alias("id"),
        "ret",
        share.alias("index_weight"),
        "spread",
        "duration",
        F.col("s_nationkey").alias("sector_id"),
        F.lit(1).alias("active"),
    )


def quotes_to_panel(quotes: DataFrame, min_obs: int = 100, index_mode: str = "row", return_cap: float | None = None, spread_cap: float | None = None, max_missing: float | None = None) -> DataFrame:
    """The panel from normalised quotes (see `schema.normalize_quotes`).

    Attributes are carried forward per id; the return is MTM over weight (0 where the weight is not
    positive), or the column `return` where quotes have no MTM. The index return is the change of
    `index_value`, of which each date's first row by id counts. Where that is absent the weighted mean of
    returns stands in: per row (`index_mode='row'`) or for all rows as soon as one lacks it ('all').
    Ids of fewer than `min_obs` rows go. The quality filters are off unless given.
    """
    has_mtm = "weighted_mtm" in quotes.columns
    for name in ("index_weight", "weighted_mtm", "return", "spread", "duration", "index_value", "sector", "issuer"):
        if name not in quotes.columns:
            quotes = quotes.withColumn(name, F.lit(None).cast("string" if name in ("sector", "issuer") else "double"))
    own = Window.partitionBy("debenture_id")
    so_far = own.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = quotes.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("sector", "issuer", "spread", "duration")})
    ratio = F.try_divide("weighted_mtm", F.greatest("index_weight", F.lit(1e-15)))
    total = F.when(F.col("index_weight") > 0, ratio) if has_mtm else F.col("return")
    filled = filled.withColumn("ret", F.coalesce(total, F.lit(0.0)))
    levels = quotes.where("index_value is not null").groupBy("date").agg(F.min_by("index_value", "debenture_id").alias("level"))
    # One row per date: few enough for one ordered pass.
    changes = levels.select("date", F.coalesce(F.col("level") / F.lag("level").over(Window.orderBy("date")) - 1, F.lit(0.0)).alias("level_return"))
    day = Window.partitionBy("date")
    w = F.coalesce("index_weight", F.lit(0.0)) + 1e-15
    joined = filled.join(changes, "date", "left").withColumn("mean_return", F.sum(F.col("ret") * w).over(day) / F.sum(w).over(day))
    if index_mode == "all":
        lacking = joined.agg(F.max(F.col("level_return").isNull())).first()[0]
        joined = joined.withColumn("index_return", F.col("mean_return") if lacking else F.col("level_return"))
    else:
        joined = joined.withColumn("index_return", F.coalesce("level_return", "mean_return"))
    codes = joined.where("sector is not null").select("sector").distinct()
    codes = codes.withColumn("sector_id", F.dense_rank().over(Window.orderBy("sector")) - 1)
    panel = joined.join(codes, "sector", "left").select(
        "date",
        F.col("debenture_id").alias("id"),
        "ret",
        F.coalesce("index_weight", F.lit(0.0)).alias("index_weight"),
        "index_return",
        F.coalesce("spread", F.lit(0.0)).alias("spread"),
        F.coalesce("duration", F.lit(0.0)).alias("duration"),
        F.coalesce("sector_id", F.lit(-1)).alias("sector_id"),
        (F.coalesce("index_weight", F.lit(0.0)) > 0).cast("int").alias("active"),
        (F.datediff(F.max("date").over(own), "date") / 252).alias("ttm"),
    )
    return enforce_schema(quality_filters(min_observations(panel, min_obs), return_cap, spread_cap, max_missing), PANEL)


def min_observations(panel: DataFrame, n: int) -> DataFrame:
    """Rows of ids with at least `n` rows."""
    enough = panel.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n).select("id")
    return panel.join(enough, "id", "left_semi").select(*panel.columns)


def quality_filters(panel: DataFrame, return_cap: float | None = None, spread_cap: float | None = None, max_missing: float | None = None) -> DataFrame:
    """Optional filters: caps on returns and spreads, and on an id's share of missing returns."""
    if return_cap is not None:
        panel = panel.withColumn("ret", F.greatest(F.least("ret", F.lit(return_cap)), F.lit(-return_cap)))
    if spread_cap is not None:
        panel = panel.withColumn("spread", F.least("spread", F.lit(spread_cap)))
    if max_missing is not None:
        poor = panel.groupBy("id").agg(F.avg(F.col("ret").isNull().cast("int")).alias("m")).where(F.col("m") > max_missing)
        panel = panel.join(poor, "id", "left_anti")
    return panel


def panel_from_raw(raw: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """Raw quote rows straight to the panel."""
    return quotes_to_panel(normalize_quotes(raw), **options)
