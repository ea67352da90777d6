"""Counterfactual baskets, learned-policy returns, alignment, and the cross-fitted value function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.functions.scalars import nearest_windows
from quillon.operators.forest import Growth, crossfit
from quillon.operators.splits import fold_roles
from quillon.plans.stats import block_bootstrap, newey_west
from quillon.sources.intermediate import cut

# The inputs of outcome models.
CONTEXT = ("ret_vol20_z", "idx_vol_z", "spread_z", "duration_z", "ret_autocorr_z", "spread_percentile", "vol_percentile", "index_weight")


def day_quantile(c: Column, q: float, by: Sequence[str] = ("date",)) -> Column:
    """The linear quantile of a group, on each of its rows."""
    return F.percentile(c, q).over(Window.partitionBy(*by))


def basket_returns(rows: DataFrame, signal: Column, target: Column, by: Sequence[str] = ("date",), fraction: float = 0.2, least: int = 5) -> DataFrame:
    """(by..., value, n): weighted target of the rows in the top `fraction` by signal.

    Rows without signal, target or weight do not count. Where fewer than `least` are chosen, all are.
    Signals are rounded to 8 places, so that equal ones stay equal.
    """
    valid = rows.withColumns({"__s": F.round(signal, 8), "__y": target}).where("__s is not null and __y is not null and index_weight is not null")
    chosen = (F.col("__s") >= F.round(day_quantile(F.col("__s"), 1 - fraction, by), 8)).cast("int")
    marked = valid.withColumn("__in", chosen).withColumn("__n", F.sum("__in").over(Window.partitionBy(*by)))
    kept = marked.where((F.col("__in") == 1) | (F.col("__n") < least))
    return kept.groupBy(*by).agg((F.sum(F.col("index_weight") * F.col("__y")) / (F.sum("index_weight") + 1e-12)).alias("value"), F.count(F.lit(1)).alias("n"))


def _pick(column: Column, options: Sequence, name) -> Column:  # noqa: ANN001
    """The value of the column that `column` names among the options."""
    return F.coalesce(*[F.when(column == F.lit(o), F.col(name(o))) for o in options])


def policy_baskets(features: DataFrame, choices: DataFrame, cfg: Config = Config(), per_step: bool = True, fixed_h: int | None = None) -> DataFrame:
    """(policy, date, v): on the dates the policy acted, the basket of its momentum and of fixed ones, same horizon."""
    momenta = [f"mom_w{w}" for w in cfg.windows]
    acted = choices.select("date", F.col("momentum").alias("chosen"), F.col("h").alias("chosen_h")).distinct()
    horizon = F.lit(fixed_h) if fixed_h else F.col("chosen_h")
    rows = features.join(acted, "date").withColumn("__h", horizon).withColumn("__target", _pick(F.col("__h"), cfg.horizons, lambda h: f"y_h{h}"))
    fixed = dict(zip(("short", "medium", "long"), nearest_windows(cfg.windows), strict=True))
    policies = [F.struct(F.lit("learned_policy").alias("policy"), _pick(F.col("chosen"), momenta, lambda m: f"{m}_z").alias("signal"))]
    policies += [F.struct(F.lit(f"fixed_{n}").alias("policy"), F.col(f"mom_w{w}_z").alias("signal")) for n, w in fixed.items()]
    rows = rows.where("__target is not null")  # a basket holds rows with both; so no row is multiplied in vain
    long = rows.select("date", "index_weight", "__h", "__target", F.explode(F.array(*policies)).alias("p")).select("date", "index_weight", "__h", "__target", "p.*")
    values = basket_returns(long, F.col("signal"), F.col("__target"), ("policy", "date", "__h"), cfg.top_fraction, cfg.min_selected)
    return values.select("policy", "date", (F.col("value") / (F.col("__h") if per_step else F.lit(1.0))).alias("v"))


def policy_metrics(baskets: DataFrame, block: int = 5, draws: int = 2000) -> DataFrame:
    """Per policy: mean, deviation, HAC error, bootstrap interval, Sharpe ratio, dates."""
    spread = baskets.groupBy("policy").agg(F.avg("v").alias("mean_return"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std_return"), F.count(F.lit(1)).alias("n_obs"))
    hac = newey_west(baskets, ["policy"]).select("policy", "nw_se")
    boot = block_bootstrap(baskets, ["policy"], block, draws).select("policy", F.col("ci_lo").alias("mbb_ci_lo"), F.col("ci_hi").alias("mbb_ci_hi"))
    return spread.join(hac, "policy").join(boot, "policy").withColumn("sharpe", F.col("mean_return") / (F.col("std_return") + 1e-18) * F.sqrt(F.lit(252.0)))


def outperformance(metrics: DataFrame) -> DataFrame:
    """One row: the learned policy's mean, the best fixed one's, and the difference."""
    return metrics.agg(F.max(F.when(F.col("policy") == "learned_policy", F.col("mean_return"))).alias("learned"), F.max(F.when(F.col("policy").startswith("fixed_"), F.col("mean_return"))).alias("best_fixed")).withColumn("outperformance", F.col("learned") - F.col("best_fixed"))


def learned_returns(scores: DataFrame, per_step: bool = True) -> DataFrame:
    """(h, date, v): weighted realised return of a score log by horizon, and pooled by date (h null)."""
    y = F.col("y") / F.col("h") if per_step else F.col("y")
    w = F.col("index_weight")
    by_h = scores.groupBy("h", "date").agg((F.sum(y * w) / (F.sum(w) + 1e-12)).alias("v"))
    pooled = scores.groupBy("date").agg((F.sum(y * w) / (F.sum(w) + 1e-12)).alias("v")).select(F.lit(None).cast("int").alias("h"), "date", "v")
    return by_h.select("h", "date", "v").unionByName(pooled)


def spread_alignment(features: DataFrame, choices: DataFrame, momentum: str, h: int) -> DataFrame:
    """One row per momentum: mean long-short spread, share of dates whose sign agrees with h over its median, dates."""
    rows = features.withColumns({"__s": F.round(F.col(momentum), 8), "__y": F.col(f"y_h{h}")})
    high, low = F.round(day_quantile(F.col("__s"), 0.8), 8), F.round(day_quantile(F.col("__s"), 0.2), 8)
    marked = rows.withColumns({"__a": (F.col("__s") >= high) & F.col("__y").isNotNull(), "__b": (F.col("__s") <= low) & F.col("__y").isNotNull()})
    w, y = F.col("index_weight"), F.col("__y")

    def mean(side: str) -> Column:
        return F.sum(F.when(F.col(side), w * y)) / (F.sum(F.when(F.col(side), w)) + 1e-12)

    daily = marked.groupBy("date").agg((mean("__a") - mean("__b")).alias("spread")).where("spread is not null")
    common = daily.join(choices.select("date", F.col("h").alias("ph")).distinct(), "date")
    middle = common.agg(F.median("ph").alias("m"))
    agree = (F.signum(F.round("spread", 12)) == F.signum(F.col("ph") - F.col("m"))).cast("int")
    return common.crossJoin(F.broadcast(middle)).agg(F.avg("spread").alias("mean_spread"), F.avg(agree).alias("mean_alignment"), F.count(F.lit(1)).alias("n")).withColumn("momentum", F.lit(momentum))


def value_rows(features: DataFrame, choices: DataFrame, cfg: Config = Config(), pointwise: bool = True) -> DataFrame:
    """(h, date, [id], CONTEXT..., weight, label): the top fraction by the policy's momentum each day, with the return per step.

    `weight` sums to 1 over an h and date. The per-date form has plain means of inputs and the weighted mean of labels,
    with weight 1; dates without a mean of every input are left out. Rows without label or index weight do not count;
    other absent inputs are 0 in the row form.
    """
    momenta = [f"mom_w{w}" for w in cfg.windows]
    acted = choices.select("date", F.col("momentum").alias("chosen")).distinct()
    signal = F.round(_pick(F.col("chosen"), momenta, lambda m: f"{m}_z"), 8)
    rows = features.join(acted, "date").withColumn("__s", signal).where("__s is not null")
    chosen = rows.withColumn("__t", day_quantile(F.col("__s"), 1 - cfg.top_fraction)).where("__s >= round(__t, 8) and index_weight is not null")
    labels = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), (F.col(f"y_h{h}") / h).alias("label")) for h in cfg.horizons]))
    long = chosen.select("date", "id", *CONTEXT, labels.alias("l")).select("l.h", "date", "id", *CONTEXT, "l.label").where("label is not null")
    if pointwise:
        return long.na.fill(0.0, list(CONTEXT)).withColumn("weight", F.col("index_weight") / (F.sum("index_weight").over(Window.partitionBy("h", "date")) + 1e-12))
    w = F.col("index_weight")
    means = long.groupBy("h", "date").agg(*[F.avg(c).alias(c) for c in CONTEXT], (F.sum(F.col("label") * w) / (F.sum(w) + 1e-12)).alias("label"))
    return means.na.drop(subset=[*CONTEXT, "label"]).withColumn("weight", F.lit(1.0))


def value_function(features: DataFrame, choices: DataFrame, cfg: Config = Config(), pointwise: bool = True, trees: int | None = None) -> DataFrame:
    """Per horizon: mean of the dates' mean label and of their mean prediction, their correlation, dates, rows, folds, and whether no fold could be fitted.

    Means of a date are weighted. Predictions are out of fold; a horizon without a fold of `value_least` training rows
    is predicted by a forest of all its rows (`fallback`). Labels of long horizons end early, so each horizon's own
    dates make its folds; the forests of all horizons and folds are grown in one job.
    """
    rows = cut(value_rows(features, choices, cfg, pointwise), "labelled")
    roles = fold_roles(rows, "h", {h: cfg.fold_steps(h) for h in cfg.horizons}, cfg.folds, cfg.value_least)
    placed = rows.join(F.broadcast(roles), ["h", "date"])  # a row per horizon, date and fold
    growth = Growth(trees or cfg.value_trees, cfg.value_depth, cfg.value_leaf, seed=cfg.seed)
    fitted = crossfit(placed, CONTEXT, "label", ["date", "id"] if pointwise else ["date"], "weight", g=growth)
    mean = {to: F.try_divide(F.sum(F.col(c) * F.col("weight")), F.sum("weight")) for c, to in (("label", "y"), ("oof", "p"))}
    daily = fitted.groupBy("h", "date").agg(*[v.alias(k) for k, v in mean.items()], F.count("oof").alias("n"), F.max("fold").alias("fold")).where("y is not null and p is not null")
    corr = F.when(F.count("p") > 2, F.try_divide(F.covar_samp("y", "p"), F.stddev_samp("y") * F.stddev_samp("p")))
    told = daily.groupBy("h").agg(F.avg("y").alias("mean_y"), F.avg("p").alias("mean_oof"), corr.alias("corr"), F.count("p").alias("n_dates"), F.sum("n").alias("n"), F.count_distinct("fold").alias("folds"))
    return told.withColumn("fallback", F.col("folds") == 0)
