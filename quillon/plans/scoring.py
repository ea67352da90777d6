"""Scores of intervals: the fixed model for tests and examples, and the columns that every score log has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.functions.scalars import alpha_for, covered, horizon_factor, interval_score
from quillon.plans.features import long_targets, split_dates, test_slice

#: Deviations from the mean to a bound of the fixed model, and what momentum moves its middle.
Z, TILT = 1.645, 0.0005


def horizon_moments(features: DataFrame, cfg: Config) -> DataFrame:
    """(h, mu, sigma) of the targets over training rows; a deviation of 0 or none is 1. One scan for all horizons."""
    train, _ = split_dates(features, cfg)
    exprs = [e for h in cfg.horizons for e in (F.avg(f"y_h{h}").alias(f"m{h}"), F.stddev_samp(f"y_h{h}").alias(f"s{h}"))]
    one = train.agg(*exprs)
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.coalesce(f"m{h}", F.lit(0.0)).alias("mu"), F.when(F.col(f"s{h}") > 0, F.col(f"s{h}")).otherwise(F.lit(1.0)).alias("sigma")) for h in cfg.horizons])).alias("r")
    return one.select(rows).select("r.*")


def score(df: DataFrame, cfg: Config, sigma: dict[int, float] | None = None) -> DataFrame:
    """Add alpha, covered, width, loss and their scaled forms to (h, y, l, u)."""
    y, low, high, h = (F.col(c) for c in ("y", "l", "u", "h"))
    scale = horizon_factor(h, cfg.scale_mode, sigma)
    out = df.withColumn("alpha", alpha_for(h, cfg.alpha_by_h, cfg.alpha)).withColumns({"covered": covered(y, low, high), "width": F.greatest(high - low, F.lit(0.0))})
    out = out.withColumn("loss", interval_score(y, low, high, F.col("alpha")))
    return out.withColumns({"width_scaled": F.col("width") * scale, "loss_scaled": F.col("loss") * scale})


def _alive_targets(features: DataFrame, cfg: Config, extra: tuple[str, ...]) -> DataFrame:
    keep = ("date", "id", "index_weight", *extra)
    return long_targets(test_slice(features, cfg), cfg, keep).where("alive = 1 and y is not null")


def fixed_scores(features: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Scores of one interval per horizon, from training moments, on all test rows that mature."""
    moments = F.broadcast(horizon_moments(features, cfg))  # a row per horizon
    joined = _alive_targets(features, cfg, ("spread", "ret_vol20")).join(moments, "h")
    return score(joined.withColumns({"l": F.col("mu") - Z * F.col("sigma"), "u": F.col("mu") + Z * F.col("sigma")}), cfg)


def arm_scores(features: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Scores of a fixed interval per arm (`baseline`, `momentum`, `h`): momentum tilts its middle."""
    momenta = tuple(f"mom_w{w}" for w in cfg.windows)
    rows = _alive_targets(features, cfg, momenta).join(F.broadcast(horizon_moments(features, cfg)), "h")
    arms = F.explode(F.array(*[F.struct(F.lit(m).alias("momentum"), F.coalesce(F.col(m), F.lit(0.0)).alias("signal")) for m in momenta])).alias("a")
    wide = rows.select("date", "id", "index_weight", "h", "y", "mu", "sigma", arms).select("date", "id", "index_weight", "h", "y", "mu", "sigma", "a.*")
    middle: Column = F.col("mu") + TILT * F.col("signal")
    out = wide.withColumns({"l": middle - Z * F.col("sigma"), "u": middle + Z * F.col("sigma"), "baseline": F.concat(F.lit("fixed_"), "momentum", F.lit("_h"), F.col("h").cast("string"))})
    return score(out, cfg)
