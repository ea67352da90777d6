"""Report tables, the frames behind its plots, and the written summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import fixed_arm, regime
from quillon.operators.aggregates import by_horizon, coverage_statistics, histogram_of_range, per_security
from quillon.operators.ranges import percentiles
from quillon.operators.windows import lagged_outcome, rolling_mean, rolling_std
from quillon.plans.stats import binomial_p_value
from quillon.sources.files import write_text


def rolling_coverage(index: DataFrame, n: int = 60) -> DataFrame:
    """(h, date, coverage): mean of the last n dates of each horizon; null below a third of n (10 at least)."""
    spec = Window.partitionBy("h").orderBy("date")
    return index.select("h", "date", rolling_mean(F.col("covered"), n, max(10, n // 3), spec).alias("coverage"))


def daily_coverage(scores: DataFrame, n: int = 60, least: int = 10) -> DataFrame:
    """(date, coverage, rolling): coverage of a date's rows, and its mean over the last n dates (null below `least`)."""
    daily = scores.groupBy("date").agg(F.avg("covered").alias("coverage"))
    return daily.select("date", "coverage", rolling_mean(F.col("coverage"), n, least, Window.orderBy("date")).alias("rolling"))  # a row per date


def security_histogram(scores: DataFrame, column: str = "mean_loss", bins: int = 30) -> DataFrame:
    """The histogram of a column of the table per security."""
    return histogram_of_range(per_security(scores), column, bins)


def index_context(index: DataFrame, n: int = 20, least: int = 5) -> DataFrame:
    """(date, ret_vol20, bias) of a daily (date, index_return): the deviation of the last n dates, 0 below `least`, and 1."""
    return index.select("date", rolling_std(F.col("index_return"), n, least, Window.orderBy("date")).alias("ret_vol20"), F.lit(1.0).alias("bias"))  # a row per date


def bars(table: DataFrame, name: str, value: str, error: str | None = None) -> DataFrame:
    """(place from 1, name, value, error): a bar chart's rows, the least value first, rows without a value left out.

    For off-policy risk, counterfactual returns and ablation differences alike; each table has a row per bar.
    """
    place = F.row_number().over(Window.orderBy(value, name))
    return table.where(F.col(value).isNotNull()).select(place.alias("place"), F.col(name).alias("name"), F.col(value).alias("value"), (F.col(error) if error else F.lit(None).cast("double")).alias("error"))


def ablation_heatmap(overview: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """Mean difference to the base: a row per variant, a column per scope."""
    return overview.groupBy("variant").pivot("scope", list(scopes)).agg(F.first("mean_diff"))


def calibration_gap(index: DataFrame) -> DataFrame:
    """(h, coverage, nominal, gap)."""
    out = index.groupBy("h").agg(F.avg("covered").alias("coverage"), (1 - F.min("alpha")).alias("nominal"))
    return out.withColumn("gap", F.col("coverage") - F.col("nominal"))


def placebo_coverage(scores: DataFrame, shifts: Sequence[int] = (20,)) -> DataFrame:
    """(shift, coverage, n): coverage of the outcome of `shift` rows before, by id and horizon; far off if intervals say anything."""
    lagged = scores.select("id", "h", "date", "l", "u", *[lagged_outcome("y", k, ("id", "h")).alias(f"y{k}") for k in shifts])
    long = lagged.select("l", "u", F.explode(F.array(*[F.struct(F.lit(k).alias("shift"), F.col(f"y{k}").alias("y")) for k in shifts])).alias("s")).select("l", "u", "s.*")
    return long.where("y is not null").groupBy("shift").agg(F.avg(F.col("y").between(F.col("l"), F.col("u")).cast("int")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def baseline_heatmap(board: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Mean loss of fixed policies: a row per momentum, a column per horizon."""
    momentum, h = fixed_arm(F.col("baseline"))
    return board.where(F.col("baseline").startswith("fixed_")).select(momentum.alias("momentum"), h.alias("h"), "mean_loss_scaled").groupBy("momentum").pivot("h", list(horizons)).agg(F.first("mean_loss_scaled"))


def coverage_heatmap(index: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Coverage: a row per date, a column per horizon."""
    return index.groupBy("date").pivot("h", list(horizons)).agg(F.first("covered"))


def loss_quartiles(scores: DataFrame) -> DataFrame:
    """(h, q25, q50, q75): the boxes of losses by horizon, exact, from counts of values by range."""
    return percentiles(scores, ["h"], "loss_scaled", (0.25, 0.5, 0.75), ("q25", "q50", "q75"))


def policy_evolution(choices: DataFrame) -> DataFrame:
    """(date, momentum, h, code): the modal arm over time, coded in order of name."""
    arms = choices.select("momentum", "h").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("momentum", "h")) - 1)  # a row per arm
    return choices.select("date", "momentum", "h").join(F.broadcast(arms), ["momentum", "h"])


def regimes(daily: DataFrame, value: str = "vol") -> DataFrame:
    """(date, regime): Low, Mid or High by the terciles of a daily value."""
    cuts = daily.agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    return daily.crossJoin(F.broadcast(cuts)).select("date", regime(F.col(value), F.col("q")[0], F.col("q")[1]).alias("regime"))


def selection_by_regime(choices: DataFrame, regime_days: DataFrame, short: str = "mom_w5|mom_w10|mom_w21") -> DataFrame:
    """(regime, p_short, n): how often a short momentum was chosen; regimes without dates have null."""
    names = choices.sparkSession.createDataFrame([("Low",), ("Mid",), ("High",)], "regime string")
    joined = choices.join(regime_days, "date").groupBy("regime").agg(F.avg(F.col("momentum").rlike(f"^({short})").cast("int")).alias("p_short"), F.count(F.lit(1)).alias("n"))
    return names.join(joined, "regime", "left")


def index_volatility(index_returns: DataFrame, n: int = 60, least: int = 10) -> DataFrame:
    """(date, vol) of a daily index return; the ordered pass is over dates."""
    return index_returns.select("date", rolling_std(F.col("v"), n, least, Window.orderBy("date")).alias("vol"))


def bars_with_error(table: DataFrame, name: str, value: str) -> DataFrame:
    """(name, value, error): the HAC error, else half the interval."""
    return table.select(name, value, F.coalesce("nw_se", (F.col("ci_hi") - F.col("ci_lo")) / 2).alias("error"))


def improvements(board: DataFrame, policy_loss: float) -> DataFrame:
    """(name, loss, improvement_pct) against the best and worst fixed and the random policy."""
    fixed = board.where(F.col("baseline").startswith("fixed_"))
    rows = fixed.agg(F.min("mean_loss_scaled").alias("loss")).withColumn("name", F.lit("best_fixed")).unionByName(fixed.agg(F.max("mean_loss_scaled").alias("loss")).withColumn("name", F.lit("worst_fixed")))
    rows = rows.unionByName(board.where("baseline = 'random'").select(F.col("mean_loss_scaled").alias("loss"), F.lit("random").alias("name")))
    return rows.select("name", "loss", ((F.col("loss") - policy_loss) / F.nullif(F.col("loss"), F.lit(0.0)) * 100).alias("improvement_pct"))


def markdown_table(df: DataFrame, limit: int = 50) -> str:
    """A small table as Markdown."""
    rows = df.limit(limit).collect()
    cells = [[f"{v:.6g}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *cells])


def write_report(path: str, title: str, sections: Mapping[str, DataFrame | str], spark: SparkSession | None = None) -> str:
    """A Markdown report of text and small tables, on the driver's disk or in a store; returns it."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body)]
    text = "\n\n".join(parts) + "\n"
    if spark is not None:
        write_text(spark, text, path)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def coverage_document(scores: DataFrame, alpha: float) -> dict:
    """Coverage overall, by horizon and over dates, and the exact test of the nominal level."""
    by_h = [r.asDict() for r in coverage_statistics(scores).withColumn("p_value", binomial_p_value("hits", "n", F.lit(1 - alpha))).collect()]  # a row per horizon
    total = next((r for r in by_h if r["h"] is None), None)
    if total is None:
        return {}
    gap = total["coverage"] - (1 - alpha)
    return {"overall": total, "nominal": 1 - alpha, "deviation": gap, "deviation_pct": gap / (1 - alpha) * 100, "by_horizon": [r for r in by_h if r["h"] is not None]}


def falsification_document(scores: DataFrame, shifts: Sequence[int] = (20,)) -> dict:
    """Coverage by horizon, and that of outcomes of other dates."""
    by_h = {str(r["h"]): r["coverage"] for r in by_horizon(scores).select("h", "coverage").collect()}
    return {"coverage_by_h": by_h, **{f"placebo_cov_k{r['shift']}": r["coverage"] for r in placebo_coverage(scores, shifts).collect()}}
