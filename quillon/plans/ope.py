"""Off-policy evaluation: propensities, and direct, importance-weighted and doubly robust estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.functions.scalars import horizon_factor, one_hot, propensity
from quillon.operators.aggregates import effective_size
from quillon.operators.forest import Growth, crossfit
from quillon.operators.splits import fold_roles
from quillon.plans.causal import CONTEXT
from quillon.sources.intermediate import cut


def align_actions(behaviour: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(date, id, mom_b, h_b, mom_e, h_e, y, support): rows on which both policies acted and the outcome is known."""
    b = behaviour.select("date", "id", F.col("momentum").alias("mom_b"), F.col("h").cast("int").alias("h_b"), "y", *(["support"] if "support" in behaviour.columns else []))
    e = evaluation.select("date", "id", F.col("momentum").alias("mom_e"), F.col("h").cast("int").alias("h_e"))
    return b.join(e, ["date", "id"]).na.drop(subset=["mom_b", "h_b", "mom_e", "h_e", "y"])


def reconstruct_support(test: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(date, id, support): live horizons of each row times momenta, 1 at least, for logs that lack it."""
    live = sum((F.col(f"alive_h{h}") for h in cfg.horizons), F.lit(0))
    return test.select("date", "id", F.greatest(live * len(cfg.windows), F.lit(1)).alias("support"))


def estimators(rows: DataFrame) -> DataFrame:
    """Add pi_b, same_action, iw, DM, IPS, DR to (support, y, q_b, q_e, actions)."""
    same = ((F.col("mom_b") == F.col("mom_e")) & (F.col("h_b") == F.col("h_e"))).cast("int")
    out = rows.withColumns({"pi_b": propensity(F.col("support")), "same_action": same})
    out = out.withColumn("iw", F.col("same_action") / F.col("pi_b"))
    return out.withColumns({"DM_hat": F.col("q_e"), "IPS_hat": F.col("iw") * F.col("y"), "DR_hat": F.col("q_e") + F.col("iw") * (F.col("y") - F.col("q_b"))})


def summarize(rows: DataFrame) -> DataFrame:
    """By evaluated horizon and overall (h_e null): plain, index-weighted and self-normalised estimates, effective size."""
    w = F.col("index_weight")
    aggs = []
    for name in ("DM", "IPS", "DR"):
        c = F.col(f"{name}_hat")
        aggs += [F.avg(c).alias(name), (F.sum(c * w) / (F.sum(w) + 1e-18)).alias(f"{name}_w")]
    norm = F.sum("iw") + 1e-12
    aggs += [(F.sum("IPS_hat") / norm).alias("IPS_sn"), (F.avg("q_e") + F.sum(F.col("iw") * (F.col("y") - F.col("q_b"))) / norm).alias("DR_sn"), effective_size("iw").alias("ess"), F.count(F.lit(1)).alias("n")]
    return rows.rollup("h_e").agg(*aggs)


def _scaled(rows: DataFrame, cfg: Config) -> DataFrame:
    return rows.withColumn("y", F.col("y") * horizon_factor(F.col("h_b"), cfg.scale_mode))


def evaluate_group_mean(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Estimates with the behaviour's mean outcome of each action as the model; an action never seen has the overall mean."""
    rows = _scaled(rows, cfg)
    means = rows.groupBy("mom_b", "h_b").agg(F.avg("y").alias("q"))
    overall = rows.agg(F.avg("y").alias("q0"))
    arms = F.broadcast(means)  # a row per arm
    joined = rows.join(arms.withColumnRenamed("q", "q_b"), ["mom_b", "h_b"], "left")
    joined = joined.join(arms.select(F.col("mom_b").alias("mom_e"), F.col("h_b").alias("h_e"), F.col("q").alias("q_e0")), ["mom_e", "h_e"], "left").crossJoin(F.broadcast(overall))
    return summarize(estimators(joined.withColumn("q_e", F.coalesce("q_e0", "q0"))))


def training_table(rows: DataFrame, features: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Aligned rows with scaled outcome and context; context that is absent, or whose row is, is 0."""
    context = [c for c in CONTEXT if c != "index_weight"]
    joined = _scaled(rows, cfg).drop(*CONTEXT).join(features.select("date", "id", *context, "index_weight"), ["date", "id"], "left")
    return joined.na.fill(0.0, list(CONTEXT))


def evaluate_forest(rows: DataFrame, features: DataFrame, cfg: Config = Config(), trees: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) with cross-fitted forests over context and one-hot action as the model, all folds grown in one job.

    Rows whose fold has fewer than `ope_least` rows to train on are predicted by a forest of all rows (`fold` null).
    """
    arms: Sequence[tuple[str, int]] = [(f"mom_w{w}", h) for w in cfg.windows for h in cfg.horizons]
    names = [f"{m}|h={h}" for m, h in arms]

    def action(m: str, h: str):  # noqa: ANN202
        return one_hot(F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.concat(F.col(m), F.lit("|h="), F.col(h).cast("string"))), F.lit(0)) - 1, len(names))

    joined = training_table(rows, features, cfg).withColumns({"__b": action("mom_b", "h_b"), "__e": action("mom_e", "h_e")})
    wide = joined.select("*", *[F.col("__b")[i].alias(f"b{i}") for i in range(len(names))], *[F.col("__e")[i].alias(f"e{i}") for i in range(len(names))])
    wide = cut(wide.withColumn("series", F.lit(0)), "wide")
    steps = max(cfg.horizons) if cfg.purge is None else cfg.purge
    roles = fold_roles(wide, "series", {0: (steps, steps if cfg.embargo is None else cfg.embargo)}, cfg.ope_folds, cfg.ope_least, partly=True)
    b, e = [f"b{i}" for i in range(len(names))], [f"e{i}" for i in range(len(names))]
    placed = wide.join(F.broadcast(roles), ["series", "date"]).drop("series")  # a row per date and fold
    growth = Growth(trees or cfg.ope_trees, cfg.ope_depth, cfg.ope_leaf, seed=cfg.seed)
    fitted = crossfit(placed, [*CONTEXT, *b], "y", ["date", "id"], also={"q_e": [*CONTEXT, *e]}, g=growth).withColumnRenamed("oof", "q_b")
    scored = estimators(fitted.drop(*b, *e, "__b", "__e", "model"))
    return scored, summarize(scored)
