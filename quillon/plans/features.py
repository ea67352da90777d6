"""The feature table: all panel features, train-only scaling, forward targets, and arms' labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.functions.scalars import context_vector, standardize
from quillon.operators.series import own_features
from quillon.operators.windows import alive_and_maturity, percentile_rank, weighted_mean_by

BASE = ("spread", "duration", "ret_vol20", "idx_vol", "ret_autocorr")


def add_features(panel: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Momentum, volatility, autocorrelation and targets by id, then market volatility and ranks by date.

    Inactive rows are dropped first, as horizons count active rows. What ids tell comes of one exchange and sort,
    what dates tell of another.
    """
    by_security = own_features(panel.where("active > 0"), cfg.windows, cfg.horizons)
    return by_security.withColumns(
        {
            "idx_vol": weighted_mean_by(F.col("ret_vol20"), F.col("index_weight"), ["date"]),
            "spread_percentile": percentile_rank(F.col("spread")),
            "vol_percentile": percentile_rank(F.col("ret_vol20")),
        }
    )


def split_dates(df: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Rows up to the end of training, and rows from the start of the test."""
    return df.where(F.col("date") <= F.lit(cfg.train_end).cast("date")), df.where(F.col("date") >= F.lit(cfg.test_start).cast("date"))


def train_statistics(df: DataFrame, cfg: Config, columns: Sequence[str]) -> DataFrame:
    """One row: mean and deviation of each column over training rows; a deviation of 0 or none is 1."""
    train, _ = split_dates(df, cfg)
    exprs = []
    for c in columns:
        sd = F.stddev_samp(c)
        exprs += [F.avg(c).alias(f"{c}_mean"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias(f"{c}_sd")]
    return train.agg(*exprs)


def add_scores(features: DataFrame, cfg: Config = Config(), columns: Sequence[str] | None = None) -> DataFrame:
    """`{c}_z` for each column, scaled by training rows only."""
    columns = list(columns or [*(f"mom_w{w}" for w in cfg.windows), *BASE])
    stats = train_statistics(features, cfg, columns)
    joined = features.crossJoin(F.broadcast(stats))  # one row
    out = joined.withColumns({f"{c}_z": standardize(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_sd")) for c in columns})
    return out.drop(*[f"{c}_{x}" for c in columns for x in ("mean", "sd")])


def add_context(scored: DataFrame) -> DataFrame:
    """`x`, the context vector."""
    return scored.withColumn("x", context_vector(*[F.col(c) for c in ("ret_vol20_z", "idx_vol_z", "spread_z", "duration_z", "ret_autocorr_z", "spread_percentile", "vol_percentile")]))


def feature_table(panel: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Everything that policies and evaluations read. Write it once and share it among them."""
    return add_context(add_scores(add_features(panel, cfg), cfg))


def test_slice(features: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Test rows with what is alive and when it matures, counted inside the test."""
    return alive_and_maturity(split_dates(features, cfg)[1], cfg.horizons)


def long_targets(df: DataFrame, cfg: Config = Config(), keep: Sequence[str] = ("date", "id", "index_weight")) -> DataFrame:
    """(keep, h, y, alive, mat_date): a row per horizon."""
    arms = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"y_h{h}").alias("y"), F.col(f"alive_h{h}").alias("alive"), F.col(f"mat_date_h{h}").alias("mat_date")) for h in cfg.horizons])).alias("a")
    return df.select(*keep, arms).select(*keep, "a.h", "a.y", "a.alive", "a.mat_date")
