"""Registered queries of the panel operators and the same in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.functions import quantiles as Q
from quillon.functions import scalars as S
from quillon.operators import aggregates as A
from quillon.operators import ranges, splits, windows
from quillon.plans import ablation, causal, ope, policy, report, stats
from quillon.plans import features as plan
from quillon.plans.scoring import arm_scores, fixed_scores, horizon_moments
from quillon.schema import enforce_schema
from quillon.sources.intermediate import cut
from quillon.sources.panel import min_observations, panel_from_raw, quality_filters, sales_panel, table
from quillon.streaming import events as ev

CFG = Config()
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None, times: tuple[str, ...] = (), totals: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query. Dates, times (columns `times`) and keys whose null means all rows (`totals`) leave
    both engines as text, which compares alike."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = lambda spark, d: _as_text(f(spark, d), totals)
        if sql:
            listed = sql[sql.rfind("SELECT") :].split(" FROM ")[0]
            dates = re.findall(r"(?:SELECT|DISTINCT|,)\s+(date|mat_date_h\d+)\s*(?=,|$)", listed) + re.findall(r" AS (first_date|last_date)\b", listed)
            swaps = [f"CAST({c} AS VARCHAR) AS {c}" for c in dict.fromkeys(dates)] + [f"strftime(\"{c}\", '%Y-%m-%d %H:%M:%S.%f') AS \"{c}\"" for c in times]
            swaps += [f"coalesce(CAST({c} AS VARCHAR), 'all') AS {c}" for c in totals]
            _SQL[key] = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({sql})" if swaps else sql
        return f

    return add


def _as_text(df: DataFrame, totals: tuple[str, ...] = ()) -> DataFrame:
    kinds = dict(df.dtypes)
    df = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in totals}) if totals else df
    texts = {c: F.col(c).cast("string") for c, k in kinds.items() if k == "date"}
    texts |= {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c, k in kinds.items() if k.startswith("timestamp")}
    return df.withColumns(texts) if texts else df


def _r(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded for comparison between engines; -0.0 becomes 0.0."""
    column = F.col(c) if isinstance(c, str) else c
    return (F.round(column.cast("double"), digits) + F.lit(0.0)).alias(name or str(c))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return plan.add_features(sales_panel(spark, d), CFG)


def _table(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The features as a written table, for plans that read them more than once: only the columns that they read are computed."""
    features = _features(spark, d)
    return cut(features.select("date", "id", *columns) if columns else features, "features")


_TARGETS = ("index_weight", "spread", "ret_vol20", *(f"y_h{h}" for h in CFG.horizons))


def _scored(t: DataFrame) -> DataFrame:
    return plan.add_scores(t, CFG)


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    return fixed_scores(_table(spark, d, *_TARGETS), CFG)


def _arms(spark: SparkSession, d: str) -> DataFrame:
    return arm_scores(_table(spark, d, *_TARGETS, *(f"mom_w{w}" for w in CFG.windows)), CFG)


def _index(spark: SparkSession, d: str) -> DataFrame:
    return A.security_to_index(_fixed(spark, d))


# SQL building blocks: each needs the ones before it.
W, H = CFG.windows, CFG.horizons
PANEL = """
weekly AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_suppkey,
    sum(l_extendedprice * (l_discount - CAST(0.05 AS DOUBLE))) / sum(l_extendedprice) AS ret,
    sum(l_extendedprice) AS notional, round(avg(l_tax), 8) AS spread, avg(l_quantity) AS duration
  FROM lineitem GROUP BY 1, 2
), panel AS (
  SELECT date, CAST(l_suppkey AS VARCHAR) AS id, ret, notional / sum(notional) OVER (PARTITION BY date) AS index_weight,
    spread, duration, s_nationkey AS sector_id, 1 AS active
  FROM weekly JOIN supplier ON l_suppkey = s_suppkey
)"""


def _mom(w: int) -> str:
    v = max(20, w)
    return f"""CASE WHEN count(ret) OVER (wi ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) >= 5
      THEN sum(ret) OVER (wi ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) END / (greatest(coalesce(
        CASE WHEN count(ret) OVER (wi ROWS BETWEEN {v} PRECEDING AND 1 PRECEDING) >= 5
          THEN stddev_samp(ret) OVER (wi ROWS BETWEEN {v} PRECEDING AND 1 PRECEDING) END,
        CAST(0.01 AS DOUBLE)), CAST(0.01 AS DOUBLE)) + 1e-8) AS mom_w{w}"""


_OWN = ",\n    ".join(
    [_mom(w) for w in W]
    + [
        "coalesce(CASE WHEN count(ret) OVER (wi ROWS 19 PRECEDING) >= 5 THEN stddev_samp(ret) OVER (wi ROWS 19 PRECEDING) END, 0) AS ret_vol20",
        "coalesce(CASE WHEN count(ret) OVER (wi ROWS 20 PRECEDING) >= 10 THEN nullif(corr(ret, ret_lag) OVER (wi ROWS 19 PRECEDING), 'NaN'::DOUBLE) END, 0) AS ret_autocorr",
    ]
    + [f"CASE WHEN lead(date, {h}) OVER wi IS NOT NULL THEN product(1 + ret) OVER (wi ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) - 1 END AS y_h{h}" for h in H]
)
FEATURES = (
    PANEL
    + f""", lagged AS (SELECT *, lag(ret) OVER (PARTITION BY id ORDER BY date) AS ret_lag FROM panel),
own AS (SELECT *, {_OWN}
  FROM lagged WINDOW wi AS (PARTITION BY id ORDER BY date)
), feat AS (
  SELECT *, sum(ret_vol20 * (index_weight + 1e-15)) OVER d / sum(index_weight + 1e-15) OVER d AS idx_vol,
    CASE WHEN count(spread) OVER d < 10 THEN CAST(0.5 AS DOUBLE) ELSE (rank() OVER (d ORDER BY round(spread, 8))
      + (count(*) OVER (PARTITION BY date, round(spread, 8)) - 1) / 2.0::DOUBLE) / count(spread) OVER d END AS spread_percentile,
    CASE WHEN count(ret_vol20) OVER d < 10 THEN CAST(0.5 AS DOUBLE) ELSE (rank() OVER (d ORDER BY round(ret_vol20, 8))
      + (count(*) OVER (PARTITION BY date, round(ret_vol20, 8)) - 1) / 2.0::DOUBLE) / count(ret_vol20) OVER d END AS vol_percentile
  FROM own WINDOW d AS (PARTITION BY date)
)"""
)
_ZCOLS = [*(f"mom_w{w}" for w in W), *plan.BASE]
SCORED = (
    FEATURES
    + ", train_stats AS (SELECT "
    + ", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) ELSE 1 END AS {c}_s" for c in _ZCOLS)
    + f" FROM feat WHERE date <= DATE '{CFG.train_end}'), scored AS (SELECT feat.*, "
    + ", ".join(f"greatest(least(coalesce(({c} - {c}_m) / {c}_s, 0), 8), -8) AS {c}_z" for c in _ZCOLS)
    + " FROM feat, train_stats)"
)
_ALIVE = ", ".join(f"CASE WHEN lead(date, {h}) OVER wi IS NOT NULL THEN 1 ELSE 0 END AS alive_h{h}, lead(date, {h}) OVER wi AS mat_date_h{h}" for h in H)
TEST = FEATURES + f""", test_rows AS (SELECT *, {_ALIVE} FROM feat WHERE date >= DATE '{CFG.test_start}' WINDOW wi AS (PARTITION BY id ORDER BY date)),
moments AS ({" UNION ALL ".join(f"SELECT {h} AS h, coalesce(avg(y_h{h}), 0) AS mu, CASE WHEN stddev_samp(y_h{h}) > 0 THEN stddev_samp(y_h{h}) ELSE 1 END AS sigma FROM feat WHERE date <= DATE '{CFG.train_end}'" for h in H)}),
targets AS ({" UNION ALL ".join(f"SELECT *, {h} AS h, y_h{h} AS y FROM test_rows WHERE alive_h{h} = 1 AND y_h{h} IS NOT NULL" for h in H)})"""


def _score_sql(source: str) -> str:
    return f"""SELECT *, CASE WHEN y BETWEEN l AND u THEN 1 ELSE 0 END AS covered, greatest(u - l, 0) AS width, CAST(0.1 AS DOUBLE) AS alpha,
    greatest(u - l, 0) + 2 / CAST(0.1 AS DOUBLE) * greatest(l - y, 0) + 2 / CAST(0.1 AS DOUBLE) * greatest(y - u, 0) AS loss FROM ({source})"""


FIXED = TEST + ", raw_fixed AS (" + _score_sql("SELECT t.*, mu, sigma, mu - CAST(1.645 AS DOUBLE) * sigma AS l, mu + CAST(1.645 AS DOUBLE) * sigma AS u FROM targets t JOIN moments USING (h)") + """),
fixed AS (SELECT *, width / h AS width_scaled, loss / h AS loss_scaled FROM raw_fixed)"""
_ARM_ROWS = " UNION ALL ".join(f"SELECT date, id, index_weight, h, y, 'mom_w{w}' AS momentum, coalesce(mom_w{w}, 0) AS signal FROM targets" for w in W)
ARMS = TEST + f", arm_rows AS ({_ARM_ROWS}), raw_arms AS (" + _score_sql(
    "SELECT a.*, mu, sigma, mu + CAST(0.0005 AS DOUBLE) * signal - CAST(1.645 AS DOUBLE) * sigma AS l, mu + CAST(0.0005 AS DOUBLE) * signal + CAST(1.645 AS DOUBLE) * sigma AS u, 'fixed_' || momentum || '_h' || h AS baseline FROM arm_rows a JOIN moments USING (h)"
) + "), arms AS (SELECT *, width / h AS width_scaled, loss / h AS loss_scaled FROM raw_arms)"
INDEX = FIXED + """, index_series AS (
  SELECT date, h, sum(y * w) / sum(w) AS y, sum(l * w) / sum(w) AS l, sum(u * w) / sum(w) AS u, sum(width_scaled * w) / sum(w) AS width_scaled,
    sum(loss_scaled * w) / sum(w) AS loss_scaled, sum(covered * w) / sum(w) AS covered, min(alpha) AS alpha
  FROM (SELECT *, index_weight / (sum(index_weight) OVER (PARTITION BY date, h) + 1e-12) AS w FROM fixed) GROUP BY date, h
)"""
BOARD = ARMS + """, board AS (
  SELECT baseline, avg(wl) AS mean_loss_scaled, sum(sl) / sum(n) AS mean_loss_simple, sum(sc) / sum(n) AS cov_rate, sum(sw) / sum(n) AS mean_width_scaled, sum(n) AS n_predictions
  FROM (SELECT baseline, date, h, sum(w * loss_scaled) AS wl, sum(loss_scaled) AS sl, sum(covered) AS sc, sum(width_scaled) AS sw, count(*) AS n
    FROM (SELECT *, index_weight / (sum(index_weight) OVER (PARTITION BY baseline, date, h) + 1e-12) AS w FROM arms) GROUP BY 1, 2, 3)
  GROUP BY baseline
)"""
# A policy's actions without a policy: each row takes the arm that its id and date name.
_ACT = """(CAST(id AS BIGINT) * 7 + date_diff('day', DATE '1995-01-02', date) // 7 * {k}) % 4"""
_PICK = "CASE {x} " + " ".join(f"WHEN {i} THEN 'mom_w{w}'" for i, w in enumerate(W)) + " END"
_PICKH = "CASE {x} " + " ".join(f"WHEN {i} THEN {h}" for i, h in enumerate(H)) + " END"
ACTIONS = TEST + f""", actions AS (
  SELECT date, id, {_PICK.format(x=_ACT.format(k=3))} AS momentum, {_PICKH.format(x=_ACT.format(k=5))} AS h FROM test_rows
), momentum_counts AS (SELECT date, momentum, count(*) AS n, min(id) AS first_id FROM actions GROUP BY 1, 2),
horizon_counts AS (SELECT date, h, count(*) AS n, min(id) AS first_id FROM actions GROUP BY 1, 2),
choices AS (
  SELECT m.date, m.momentum, k.h FROM
    (SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, first_id, momentum) AS r FROM momentum_counts) m
    JOIN (SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, first_id, h) AS r FROM horizon_counts) k ON m.date = k.date AND m.r = 1 AND k.r = 1
)"""


def _actions(test: DataFrame, a: int = 3, b: int = 5) -> DataFrame:
    """Arms that ids and dates name, for queries that need a policy's log but no policy."""
    week = F.floor(F.datediff("date", F.lit("1995-01-02").cast("date")) / 7)
    at = lambda k: ((F.col("id").cast("long") * 7 + week * k) % 4).cast("int")
    return test.withColumns({"momentum": F.element_at(F.array(*[F.lit(f"mom_w{w}") for w in W]), at(a) + 1), "h": F.element_at(F.array(*[F.lit(h) for h in H]), at(b) + 1)})


def _test(spark: SparkSession, d: str) -> DataFrame:
    return cut(plan.test_slice(_features(spark, d), CFG), "test")


def _choices(t: DataFrame) -> DataFrame:
    """The modal arms of each date of the test slice of a feature table."""
    return A.policy_mode(_actions(plan.test_slice(t, CFG)).select("date", "id", "momentum", "h"))


# Panel and features.
@_query(f"WITH {PANEL} SELECT date, id, round(ret, 6) AS ret, round(index_weight, 6) AS index_weight, round(spread, 6) AS spread, round(duration, 6) AS duration, sector_id, active FROM panel")
def panel_build(spark: SparkSession, d: str) -> DataFrame:
    return sales_panel(spark, d).select("date", "id", _r("ret"), _r("index_weight"), _r("spread"), _r("duration"), "sector_id", "active")


@_query(f"WITH {PANEL} SELECT id, count(*) AS n FROM panel GROUP BY id HAVING count(*) >= 290")
def panel_min_obs(spark: SparkSession, d: str) -> DataFrame:
    return min_observations(sales_panel(spark, d), 290).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH t AS (SELECT DISTINCT l_linenumber || ',' || CAST(l_quantity AS INTEGER) || CASE WHEN l_linenumber = 3 THEN '' ELSE '%' END || CASE WHEN l_linenumber = 5 THEN ',1' ELSE '' END AS raw FROM lineitem)
SELECT raw, round(try_cast(replace(replace(raw, '%', ''), ',', '.') AS DOUBLE) / 100, 8) AS value FROM t""")
def percent_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    raw = F.concat(n.cast("string"), F.lit(","), F.col("l_quantity").cast("int").cast("string"), F.when(n == 3, "").otherwise("%"), F.when(n == 5, ",1").otherwise(""))
    return table(spark, d, "lineitem").select(raw.alias("raw")).distinct().select("raw", _r(S.parse_percent(F.col("raw")), "value", 8))


@_query(f"WITH {PANEL} SELECT date, count(*) AS n, CAST(0 AS DOUBLE) AS spread, CAST(0 AS DOUBLE) AS ttm, CAST(-sum(1) AS BIGINT) AS sectors, sum(CAST(1 AS BIGINT))::BIGINT AS active FROM panel GROUP BY date")
def schema_defaults(spark: SparkSession, d: str) -> DataFrame:
    bare = sales_panel(spark, d).select("date", F.col("id").alias("debenture_id"), F.col("ret").alias("return"), "index_weight")
    full = enforce_schema(bare)
    return full.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("spread").alias("spread"), F.sum("ttm").alias("ttm"), F.sum("sector_id").alias("sectors"), F.sum("active").alias("active"))


@_query(f"""WITH {PANEL}, holes AS (SELECT date, id, CASE WHEN (CAST(id AS BIGINT) + date_diff('day', DATE '1995-01-02', date) // 7) % 3 = 0 THEN spread END AS spread FROM panel)
SELECT date, id, round(last_value(spread IGNORE NULLS) OVER (PARTITION BY id ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS spread FROM holes""")
def ffill_attributes(spark: SparkSession, d: str) -> DataFrame:
    week = F.floor(F.datediff("date", F.lit("1995-01-02").cast("date")) / 7)
    holes = sales_panel(spark, d).withColumn("spread", F.when((F.col("id").cast("long") + week) % 3 == 0, F.col("spread")))
    return holes.select("date", "id", _r(windows.forward_fill("spread"), "spread"))


def _raw(spark: SparkSession, d: str, level: bool = True) -> DataFrame:
    """The sales panel as raw quotes under their headers: percents as text, sectors and issuers by name."""
    day = F.to_date("l_shipdate")
    levels = table(spark, d, "lineitem").groupBy(F.date_sub(day, F.weekday(day)).alias("date")).agg(F.sum("l_extendedprice").alias("level"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("sector_id"), "n_name")
    percent = lambda c: F.concat(F.translate(F.format_string("%.14f", c * 100), ".", ","), F.lit("%"))
    rows = sales_panel(spark, d).join(names, "sector_id").join(levels, "date")
    # The levels of all ids but the first are off: a date's first row by id counts.
    first = F.col("id") == F.min("id").over(Window.partitionBy("date"))
    week = F.floor(F.datediff("date", F.lit("1995-01-02").cast("date")) / 7)
    return rows.select(
        F.col("date").cast("string").alias("Data"),
        F.col("id").alias("Debênture"),
        percent(F.col("index_weight")).alias("Peso no índice (%)"),
        percent(F.col("ret") * F.col("index_weight")).alias("MTM ponderado (%)"),
        percent(F.lit(0.0)).alias("Carrego ponderado (%)"),
        percent(F.col("spread")).alias("Spread de compra (%)"),
        F.when((week + F.col("id").cast("long")) % 3 > 0, F.col("duration")).alias("Duração"),
        *([F.when(first, F.col("level")).otherwise(F.col("level") + 1).alias("Índice (nível)"), F.lit(7.0).alias("Índice")] if level else []),
        F.col("n_name").alias("Setor"),
        F.col("n_name").alias("Emissor"),
    )


@_query("""WITH level AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1)
SELECT date, round(coalesce(x / lag(x) OVER (ORDER BY date) - 1, 0), 6) AS index_return FROM level""")
def index_return_pct(spark: SparkSession, d: str) -> DataFrame:
    return panel_from_raw(_raw(spark, d), min_obs=1).select("date", _r("index_return")).distinct()


@_query(f"WITH {PANEL} SELECT DISTINCT date, round(sum(ret * (index_weight + 1e-15)) OVER d / sum(index_weight + 1e-15) OVER d, 6) AS mean_return, round(CASE WHEN sum(index_weight) OVER d > 0 THEN sum(ret * (index_weight + 1e-12)) OVER d / sum(index_weight + 1e-12) OVER d END, 6) AS gated_return FROM panel WINDOW d AS (PARTITION BY date)")
def index_return_weighted(spark: SparkSession, d: str) -> DataFrame:
    p = panel_from_raw(_raw(spark, d, level=False), min_obs=1)
    gated = windows.weighted_mean_by(F.col("ret"), F.col("index_weight"), ["date"], 1e-12, need_weight=True)
    return p.select("date", _r("index_return", "mean_return"), _r(gated, "gated_return")).distinct()


@_query(f"WITH {PANEL} SELECT date, id, round(date_diff('day', date, max(date) OVER (PARTITION BY id)) / CAST(252 AS DOUBLE), 6) AS ttm FROM panel")
def time_to_maturity(spark: SparkSession, d: str) -> DataFrame:
    return panel_from_raw(_raw(spark, d), min_obs=1).select("date", "id", _r("ttm"))


@_query(f"""WITH {PANEL}, raw AS (SELECT *, CASE WHEN (date_diff('day', DATE '1995-01-02', date) // 7 + CAST(id AS BIGINT)) % 3 > 0 THEN duration END AS seen FROM panel),
held AS (SELECT *, last_value(seen IGNORE NULLS) OVER (PARTITION BY id ORDER BY date ROWS UNBOUNDED PRECEDING) AS kept FROM raw)
SELECT date, id, round(spread, 6) AS spread, round(coalesce(kept, 0), 6) AS duration, CAST(index_weight > 0 AS INTEGER) AS active FROM held""")
def raw_quotes_attributes(spark: SparkSession, d: str) -> DataFrame:
    return panel_from_raw(_raw(spark, d), min_obs=1).select("date", "id", _r("spread"), _r("duration"), "active")


for _w in W:

    @_query(f"WITH {FEATURES} SELECT date, id, round(mom_w{_w}, 6) AS mom FROM feat", f"momentum_w{_w}")
    def _momentum(spark: SparkSession, d: str, w: int = _w) -> DataFrame:
        return sales_panel(spark, d).select("date", "id", _r(windows.momentum(F.col("ret"), w), "mom"))


@_query(f"WITH {FEATURES} SELECT date, id, round(ret_vol20, 6) AS ret_vol20 FROM feat")
def ret_vol20(spark: SparkSession, d: str) -> DataFrame:
    return sales_panel(spark, d).select("date", "id", _r(windows.rolling_std(F.col("ret"), 20, 5), "ret_vol20"))


@_query(f"WITH {FEATURES} SELECT DISTINCT date, round(idx_vol, 6) AS idx_vol FROM feat")
def idx_vol(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("date", _r("idx_vol")).distinct()


@_query(f"WITH {FEATURES} SELECT date, id, round(ret_autocorr, 6) AS ret_autocorr FROM feat")
def ret_autocorr21(spark: SparkSession, d: str) -> DataFrame:
    return sales_panel(spark, d).select("date", "id", _r(windows.autocorrelation(F.col("ret")), "ret_autocorr"))


@_query(f"WITH {FEATURES} SELECT date, id, round(spread_percentile, 6) AS spread_percentile, round(vol_percentile, 6) AS vol_percentile FROM feat")
def percentile_ranks(spark: SparkSession, d: str) -> DataFrame:
    p = sales_panel(spark, d).withColumn("ret_vol20", windows.rolling_std(F.col("ret"), 20, 5)).select("date", "id", "spread", "ret_vol20")
    return ranges.percentile_ranks(p, {"spread_percentile": "spread", "vol_percentile": "ret_vol20"}).select("date", "id", _r("spread_percentile"), _r("vol_percentile"))


@_query(f"WITH {FEATURES} SELECT date, id, " + ", ".join(f"round(y_h{h}, 6) + 0 AS y_h{h}" for h in H) + " FROM feat")
def forward_return_h(spark: SparkSession, d: str) -> DataFrame:
    return sales_panel(spark, d).select("date", "id", *[_r(windows.forward_return(F.col("ret"), h), f"y_h{h}") for h in H])


@_query(f"WITH {TEST} SELECT date, id, " + ", ".join(f"alive_h{h}, mat_date_h{h}" for h in H) + " FROM test_rows")
def alive_maturity(spark: SparkSession, d: str) -> DataFrame:
    test = plan.split_dates(sales_panel(spark, d), CFG)[1]
    return windows.alive_and_maturity(test, H).select("date", "id", *[c for h in H for c in (f"alive_h{h}", f"mat_date_h{h}")])


@_query(f"WITH {SCORED} SELECT date, id, " + ", ".join(f"round({c}_z, 5) + 0 AS {c}_z" for c in _ZCOLS) + " FROM scored")
def train_zscores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_table(spark, d, *_ZCOLS)).select("date", "id", *[_r(f"{c}_z", digits=5) for c in _ZCOLS])


@_query(f"""WITH {SCORED} SELECT date, id, CAST(1 AS DOUBLE) AS x0, round(ret_vol20_z, 5) + 0 AS x1, round(idx_vol_z, 5) + 0 AS x2, round(spread_z, 5) + 0 AS x3, round(duration_z, 5) + 0 AS x4,
  round(ret_autocorr_z, 5) + 0 AS x5, round(spread_percentile, 5) AS x6, round(vol_percentile, 5) AS x7, round(spread_z * duration_z, 5) + 0 AS x8, round(ret_vol20_z * idx_vol_z, 5) + 0 AS x9 FROM scored""")
def context_vector(spark: SparkSession, d: str) -> DataFrame:
    return plan.add_context(_scored(_table(spark, d))).select("date", "id", *[_r(F.col("x")[i], f"x{i}", 5) for i in range(10)])


@_query(f"WITH {PANEL}, s AS (SELECT DISTINCT n_name AS sector FROM panel JOIN nation ON sector_id = n_nationkey) SELECT sector, CAST(dense_rank() OVER (ORDER BY sector) - 1 AS INTEGER) AS sector_id FROM s")
def sector_codes(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw(spark, d)
    coded = panel_from_raw(raw, min_obs=1).select("id", "sector_id").distinct()
    return coded.join(raw.select(F.col("Debênture").alias("id"), F.col("Setor").alias("sector")).distinct(), "id").select("sector", "sector_id").distinct()


@_query(f"WITH {PANEL} SELECT CASE WHEN date <= DATE '{CFG.train_end}' THEN 'train' WHEN date >= DATE '{CFG.test_start}' THEN 'test' END AS part, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM panel GROUP BY 1")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    train, test = plan.split_dates(sales_panel(spark, d), CFG)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@_query(f"""WITH {PANEL}, dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)),
folds AS (SELECT f AS fold, f * (n // 3) + least(f, n % 3) AS low, (f + 1) * (n // 3) + least(f + 1, n % 3) - 1 AS high FROM (SELECT DISTINCT n FROM dates), range(3) t(f)),
placed AS (SELECT date, fold, CASE WHEN p BETWEEN low AND high THEN 'test' WHEN p <= low - 5 OR p >= high + 5 THEN 'train' END AS role FROM dates, folds)
SELECT date, CAST(fold AS BIGINT) AS fold, role FROM placed WHERE role IS NOT NULL""")
def purged_folds(spark: SparkSession, d: str) -> DataFrame:
    return splits.purged_folds(sales_panel(spark, d), 3, 4, 4)


# Scores of the fixed model.
@_query(f"WITH {FIXED} SELECT date, id, h, round(y, 6) + 0 AS y, round(l, 6) AS l, round(u, 6) AS u, covered, round(width, 6) AS width, round(loss, 6) AS loss FROM fixed")
def interval_score(spark: SparkSession, d: str) -> DataFrame:
    return _fixed(spark, d).select("date", "id", "h", *[_r(c) for c in ("y", "l", "u")], "covered", _r("width"), _r("loss"))


@_query(f"WITH {FIXED} SELECT h, round(avg(loss), 6) AS plain, round(avg(loss / h), 6) AS per_h, round(avg(loss / sqrt(h)), 6) AS per_sqrt_h, round(avg(loss / sigma), 5) AS per_sigma FROM fixed GROUP BY h")
def horizon_scaling(spark: SparkSession, d: str) -> DataFrame:
    f = _table(spark, d)
    sigma = {r["h"]: r["sigma"] for r in horizon_moments(f, CFG).collect()}  # a row per horizon
    h, loss = F.col("h"), F.col("loss")
    names = {"plain": "none", "per_h": "per_h", "per_sqrt_h": "per_sqrt_h", "per_sigma": "per_sigma"}
    return fixed_scores(f, CFG).groupBy("h").agg(*[_r(F.avg(loss * S.horizon_factor(h, mode, sigma)), n, 5 if n == "per_sigma" else 6) for n, mode in names.items()])


@_query(f"""WITH {FIXED}, m AS (SELECT date, id, h, sigma, l, u, (l + u) / 2 AS c, greatest(least(u - l, CAST(0.05 AS DOUBLE)), CAST(0.002 AS DOUBLE)) / 2 AS half FROM fixed)
SELECT date, id, h, round(c - half, 6) AS l_width, round(c + half, 6) AS u_width, round(greatest(least(l, CAST(0.5 AS DOUBLE) * sigma), CAST(-0.5 AS DOUBLE) * sigma), 6) AS l_level FROM m""")
def coldstart_clamps(spark: SparkSession, d: str) -> DataFrame:
    low, high = S.clamp_width(F.col("l"), F.col("u"), 0.002, 0.05)
    return _fixed(spark, d).select("date", "id", "h", _r(low, "l_width"), _r(high, "u_width"), _r(S.clamp_level(F.col("l"), F.col("sigma"), 0.5), "l_level"))


@_query(f"WITH {FIXED} SELECT date, id, h, round(greatest(l - y, 0), 6) AS below, round(greatest(y - u, 0), 6) AS above, round(greatest(l - y, y - u, 0), 6) AS score FROM fixed")
def nonconformity_scores(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = S.nonconformity(*[F.col(x) for x in ("y", "l", "u")])
    return _fixed(spark, d).select("date", "id", "h", _r(a, "below"), _r(b, "above"), _r(c, "score"))


def _quantile_sql(weight: str, q: float) -> str:
    return f"""merged AS (SELECT h, v, sum(greatest({weight}, 0)) AS w FROM raw WHERE v IS NOT NULL GROUP BY h, v),
laid AS (SELECT h, v, sum(w) OVER (PARTITION BY h ORDER BY v) AS cw, sum(w) OVER (PARTITION BY h) AS tw FROM merged)
SELECT h, coalesce(min(CASE WHEN cw > {q} * tw THEN v END), max(v)) AS q FROM laid GROUP BY h"""


@_query(f"WITH {FIXED}, raw AS (SELECT h, round(loss_scaled, 5) AS v, round(index_weight, 6) AS iw FROM fixed), {_quantile_sql('iw', 0.9003)}")
def weighted_quantile(spark: SparkSession, d: str) -> DataFrame:
    rows = _fixed(spark, d).select("h", _r("loss_scaled", "v", 5), _r("index_weight", "iw"))
    return Q.weighted_quantile(rows, ["h"], "v", "iw", 0.9003)


@_query(f"""WITH {INDEX}, aged AS (SELECT h, round(loss_scaled, 5) AS v, row_number() OVER (PARTITION BY h ORDER BY date DESC) AS age FROM index_series),
raw AS (SELECT h, v, round(exp(CAST(-0.01 AS DOUBLE) * age), 6) AS iw FROM aged), {_quantile_sql('iw', 0.9003)}""")
def recency_quantile(spark: SparkSession, d: str) -> DataFrame:
    aged = _index(spark, d).withColumn("age", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("date"))))
    rows = aged.select("h", _r("loss_scaled", "v", 5), _r(S.recency_weight(F.col("age"), 0.01), "iw"))
    return Q.weighted_quantile(rows, ["h"], "v", "iw", 0.9003)


@_query(f"WITH {INDEX}, l AS (SELECT h, list_sort(list(loss_scaled)) AS v, count(*) AS n FROM index_series GROUP BY h) SELECT h, round(v[least(greatest(CAST(ceil((n + 1) * CAST(0.9 AS DOUBLE)) AS INTEGER), 1), n)], 6) AS q FROM l")
def finite_sample_quantile(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).groupBy("h").agg(F.collect_list("loss_scaled").alias("v")).select("h", _r(Q.finite_sample_quantile(F.col("v"), 0.9), "q"))


@_query(f"""WITH {FIXED}, s AS (SELECT date, id, h, list(greatest(l - y, y - u, 0)) OVER (PARTITION BY id, h ORDER BY date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS v FROM fixed)
SELECT date, id, h, round(CASE WHEN len(v) >= 20 THEN list_sort(v)[least(CAST(floor(len(v) * CAST(0.9 AS DOUBLE)) AS INTEGER) + 1, len(v))] ELSE 0 END, 6) AS qhat FROM s""")
def rolling_qhat(spark: SparkSession, d: str) -> DataFrame:
    score = S.nonconformity(*[F.col(x) for x in ("y", "l", "u")])[2]
    return ranges.trailing_quantile(_fixed(spark, d), ["id", "h"], ["date"], score, 50, 0.9, 20, "qhat").select("date", "id", "h", _r("qhat"))


@_query(f"""WITH {FIXED}, s AS (SELECT greatest(l - y, 0) AS a, greatest(y - u, 0) AS b FROM fixed), l AS (SELECT list_sort(list(a)) AS a, list_sort(list(b)) AS b, count(*) AS n FROM s)
SELECT round(a[least(CAST(ceil((n + 1) * CAST(0.97 AS DOUBLE)) AS INTEGER), n)], 6) AS q_low, round(b[least(CAST(ceil((n + 1) * CAST(0.97 AS DOUBLE)) AS INTEGER), n)], 6) AS q_high FROM l""")
def batch_cqr(spark: SparkSession, d: str) -> DataFrame:
    return Q.batch_cqr(_fixed(spark, d), "y", "l", "u", 0.97).select(_r("q_low"), _r("q_high"))


# Aggregates.
@_query(f"WITH {FIXED} SELECT date, id, h, round(index_weight / (sum(index_weight) OVER (PARTITION BY date) + 1e-12), 8) AS w_date, round(index_weight / (sum(index_weight) OVER (PARTITION BY date, h) + 1e-12), 8) AS w_cell FROM fixed")
def index_weights_norm(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("index_weight")
    return A.with_weights(_fixed(spark, d), sales_panel(spark, d)).select("date", "id", "h", _r(windows.normalized_weight(w, ["date"]), "w_date", 8), _r(windows.normalized_weight(w, ["date", "h"]), "w_cell", 8))


@_query(f"WITH {INDEX} SELECT date, h, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in A.SCORE_COLUMNS) + ", alpha FROM index_series")
def security_to_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).select("date", "h", *[_r(c) for c in A.SCORE_COLUMNS], "alpha")


@_query(f"WITH {FEATURES} SELECT date, " + ", ".join(f"round(sum({c} * index_weight) / (sum(CASE WHEN {c} IS NOT NULL THEN index_weight END) + 1e-12), 6) + 0 AS {c}" for c in ("ret", "spread", "mom_w21", "y_h21")) + " FROM feat GROUP BY date")
def index_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    c = ("ret", "spread", "mom_w21", "y_h21")
    return A.index_mean(_features(spark, d), c).select("date", *[_r(x) for x in c])


@_query(f"WITH {FIXED} SELECT round(avg(x), 6) AS overall_weighted, count(*) AS n FROM (SELECT date, h, sum(loss_scaled * w) AS x FROM (SELECT *, index_weight / (sum(index_weight) OVER (PARTITION BY date, h) + 1e-12) AS w FROM fixed) GROUP BY date, h)")
def weighted_overall_loss(spark: SparkSession, d: str) -> DataFrame:
    return A.overall_loss(_fixed(spark, d)).select(_r("overall_weighted"), "n")


@_query(f"WITH {FIXED} SELECT h, round(avg(loss_scaled), 6) AS mean_loss, round(avg(covered), 6) AS coverage, round(avg(width_scaled), 6) AS mean_width, count(DISTINCT date) AS n_days FROM fixed GROUP BY h")
def by_horizon_table(spark: SparkSession, d: str) -> DataFrame:
    return A.by_horizon(_fixed(spark, d)).select("h", _r("mean_loss"), _r("coverage"), _r("mean_width"), "n_days")


@_query(f"WITH {FIXED} SELECT h, round(avg(loss_scaled), 6) AS mean_loss, round(median(loss_scaled), 6) AS median_loss, round(quantile_cont(loss_scaled, 0.99), 6) AS p99_loss, round(avg(covered), 6) AS coverage, round(avg(width_scaled), 6) AS mean_width, count(DISTINCT id) AS n_ids, count(DISTINCT date) AS n_dates, count(*) AS n FROM fixed GROUP BY ROLLUP (h)", totals=("h",))
def overall_rollup(spark: SparkSession, d: str) -> DataFrame:
    return A.summary(_fixed(spark, d)).select("h", *[_r(c) for c in ("mean_loss", "median_loss", "p99_loss", "coverage", "mean_width")], "n_ids", "n_dates", "n")


_PER_ID = "SELECT id, round(avg(loss_scaled), 6) AS mean_loss, round(avg(covered), 6) AS coverage, round(avg(width_scaled), 6) AS mean_width, count(*) AS n FROM fixed GROUP BY id"


@_query(f"WITH {FIXED} {_PER_ID}")
def per_security_table(spark: SparkSession, d: str) -> DataFrame:
    return A.per_security(_fixed(spark, d)).select("id", _r("mean_loss"), _r("coverage"), _r("mean_width"), "n")


@_query(f"WITH {FIXED}, t AS ({_PER_ID}) SELECT *, 'best' AS side FROM (SELECT * FROM t ORDER BY mean_loss, id LIMIT 30) UNION ALL SELECT *, 'worst' AS side FROM (SELECT * FROM t ORDER BY mean_loss DESC, id LIMIT 30)")
def leaderboard_top30(spark: SparkSession, d: str) -> DataFrame:
    return A.top_bottom(per_security_table(spark, d), 30)


_BOARD = ("mean_loss_scaled", "mean_loss_simple", "cov_rate", "mean_width_scaled")


@_query(f"WITH {BOARD} SELECT baseline, " + ", ".join(f"round({c}, 6) AS {c}" for c in _BOARD) + ", CAST(n_predictions AS BIGINT) AS n_predictions FROM board")
def baseline_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return A.leaderboard(_arms(spark, d)).select("baseline", *[_r(c) for c in _BOARD], "n_predictions")


@_query(f"""WITH {BOARD}, r AS (SELECT baseline, mean_loss_scaled, row_number() OVER (ORDER BY mean_loss_scaled, baseline) AS up, row_number() OVER (ORDER BY mean_loss_scaled DESC, baseline) AS down FROM (SELECT baseline, round(mean_loss_scaled, 7) AS mean_loss_scaled FROM board))
SELECT CASE WHEN up <= 3 THEN 'best' ELSE 'worst' END AS side, baseline, round(mean_loss_scaled, 6) AS mean_loss_scaled, CAST(CASE WHEN up <= 3 THEN up ELSE down END AS INTEGER) AS place FROM r WHERE up <= 3 OR down <= 3""")
def best_worst_fixed(spark: SparkSession, d: str) -> DataFrame:
    board = A.leaderboard(_arms(spark, d)).withColumn("mean_loss_scaled", F.round("mean_loss_scaled", 7))
    return A.best_and_worst(board).select("side", "baseline", _r("mean_loss_scaled"), "place")


@_query(f"""WITH {FIXED}, per_id AS (SELECT id, count(*) AS n FROM fixed GROUP BY id)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS ids, (SELECT count(DISTINCT date) FROM fixed) AS dates, round(avg(n), 6) AS per_id, round(sum(n) / (SELECT count(DISTINCT date) FROM fixed), 6) AS per_date,
  round(stddev_samp(n), 6) AS sd_per_id, min(n) AS least, max(n) AS most, quantile_cont(CAST(n AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(n AS DOUBLE), 0.5) AS q50, quantile_cont(CAST(n AS DOUBLE), 0.75) AS q75 FROM per_id""")
def observation_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.observation_counts(_fixed(spark, d)).select("rows", "ids", "dates", _r("per_id"), _r("per_date"), _r("sd_per_id"), "least", "most", "q25", "q50", "q75")


@_query(f"""WITH {FIXED}, daily AS (SELECT h, date, sum(covered) AS k, count(*) AS n FROM fixed GROUP BY h, date), every AS (SELECT * FROM daily UNION ALL SELECT NULL, date, sum(k), sum(n) FROM daily GROUP BY date)
SELECT h, round(sum(k) / sum(n), 6) AS coverage, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS hits, round(min(k / n), 6) AS min_daily, round(max(k / n), 6) AS max_daily, round(stddev_samp(k / n), 6) AS std_daily FROM every GROUP BY h""", totals=("h",))
def coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage_statistics(_fixed(spark, d)).select("h", _r("coverage"), "n", "hits", _r("min_daily"), _r("max_daily"), _r("std_daily"))


@_query(f"WITH {INDEX} SELECT CAST(least(floor(round(covered, 9) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM index_series GROUP BY 1")
def coverage_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(_index(spark, d).select(F.round("covered", 9).alias("c")), "c", 0.0, 1.0, 20)


# Report frames.
@_query(f"WITH {INDEX} SELECT h, date, round(CASE WHEN count(covered) OVER w >= 20 THEN avg(covered) OVER w END, 6) AS coverage FROM index_series WINDOW w AS (PARTITION BY h ORDER BY date ROWS 59 PRECEDING)")
def rolling_coverage_60(spark: SparkSession, d: str) -> DataFrame:
    return report.rolling_coverage(_index(spark, d)).select("h", "date", _r("coverage"))


@_query(f"WITH {FIXED}, daily AS (SELECT date, avg(covered) AS c FROM fixed GROUP BY date) SELECT date, round(c, 6) AS coverage, round(CASE WHEN count(c) OVER w >= 10 THEN avg(c) OVER w END, 6) AS rolling FROM daily WINDOW w AS (ORDER BY date ROWS 59 PRECEDING)")
def daily_coverage(spark: SparkSession, d: str) -> DataFrame:
    return report.daily_coverage(_fixed(spark, d)).select("date", _r("coverage"), _r("rolling"))


@_query(f"""WITH {FIXED}, t AS (SELECT id, round(avg(loss_scaled), 6) AS m FROM fixed GROUP BY id), e AS (SELECT min(m) AS a, (max(m) - min(m)) / 30 AS step FROM t),
c AS (SELECT CAST(least(floor((m - a) / step), 29) AS INTEGER) AS bin, count(*) AS k FROM t, e GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, round(a + b * step, 6) AS low, round(a + (b + 1) * step, 6) AS high, CAST(coalesce(k, 0) AS BIGINT) AS n FROM e, range(30) r(b) LEFT JOIN c ON c.bin = b""")
def security_histogram(spark: SparkSession, d: str) -> DataFrame:
    table_ = per_security_table(spark, d).select("id", "mean_loss")
    return A.histogram_of_range(table_, "mean_loss", 30).select("bin", _r("low"), _r("high"), "n")


@_query(f"WITH {PANEL}, daily AS (SELECT date, sum(ret * index_weight) / (sum(index_weight) + 1e-12) AS r FROM panel GROUP BY date) SELECT date, round(CASE WHEN count(r) OVER w >= 5 THEN stddev_samp(r) OVER w ELSE 0 END, 6) AS ret_vol20, CAST(1 AS DOUBLE) AS bias FROM daily WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)")
def index_context(spark: SparkSession, d: str) -> DataFrame:
    daily = A.index_mean(sales_panel(spark, d), ("ret",)).select("date", F.col("ret").alias("index_return"))
    return report.index_context(daily).select("date", _r("ret_vol20"), "bias")


@_query(f"WITH {PANEL}, daily AS (SELECT date, sum(ret * index_weight) / (sum(index_weight) + 1e-12) AS r FROM panel GROUP BY date) SELECT date, round(CASE WHEN count(r) OVER w >= 10 THEN stddev_samp(r) OVER w ELSE 0 END, 6) AS vol FROM daily WINDOW w AS (ORDER BY date ROWS 59 PRECEDING)")
def index_volatility(spark: SparkSession, d: str) -> DataFrame:
    daily = A.index_mean(sales_panel(spark, d), ("ret",)).select("date", F.col("ret").alias("v"))
    return report.index_volatility(daily).select("date", _r("vol"))


@_query(f"WITH {PANEL} SELECT date, id, CAST(row_number() OVER (PARTITION BY id ORDER BY date) - 1 AS INTEGER) AS number FROM panel")
def running_number(spark: SparkSession, d: str) -> DataFrame:
    return sales_panel(spark, d).select("date", "id", windows.running_number().cast("int").alias("number"))


@_query(f"WITH {FIXED} SELECT date, id, h, round(avg(covered) OVER (PARTITION BY h ORDER BY date, id ROWS 59 PRECEDING), 6) AS share FROM fixed")
def last_flags_mean(spark: SparkSession, d: str) -> DataFrame:
    return windows.last_flags_mean(_fixed(spark, d), "covered", 60, ("h",), name="share").select("date", "id", "h", _r("share"))


@_query(f"WITH {BOARD} SELECT CAST(row_number() OVER (ORDER BY round(mean_loss_scaled, 6), baseline) AS INTEGER) AS place, baseline AS name, round(mean_loss_scaled, 6) AS value FROM board")
def leaderboard_bars(spark: SparkSession, d: str) -> DataFrame:
    return report.bars(baseline_leaderboard(spark, d), "baseline", "mean_loss_scaled").select("place", "name", "value")


@_query(f"""WITH {BOARD}, named AS (SELECT 'best_fixed' AS name, min(mean_loss_scaled) AS loss FROM board UNION ALL SELECT 'worst_fixed', max(mean_loss_scaled) FROM board)
SELECT name, round(loss, 6) AS loss, round((loss - CAST(0.001 AS DOUBLE)) / nullif(loss, 0) * 100, 4) AS improvement_pct FROM named""")
def improvements(spark: SparkSession, d: str) -> DataFrame:
    return report.improvements(A.leaderboard(_arms(spark, d)), 0.001).select("name", _r("loss"), _r("improvement_pct", digits=4))


@_query(f"""WITH {FIXED}, s AS (SELECT date, id, h, list(greatest(l - y, y - u, 0)) OVER (PARTITION BY h ORDER BY date, id ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) AS v FROM fixed)
SELECT date, id, h, round(CASE WHEN len(v) >= 20 THEN list_sort(v)[least(CAST(floor(len(v) * CAST(0.9 AS DOUBLE)) AS INTEGER) + 1, len(v))] ELSE 0 END, 6) AS qhat FROM s""")
def calibrator_by_horizon(spark: SparkSession, d: str) -> DataFrame:
    """A horizon's calibrator over all ids: the quantile of its last 250 scores before each row."""
    score = S.nonconformity(*[F.col(x) for x in ("y", "l", "u")])[2]
    return ranges.trailing_quantile(_fixed(spark, d), ["h"], ["date", "id"], score, 250, 0.9, 20, "qhat").select("date", "id", "h", _r("qhat"))


@_query(f"WITH {INDEX} SELECT h, round(avg(covered), 6) AS coverage, round(1 - min(alpha), 6) AS nominal, round(avg(covered) - (1 - min(alpha)), 6) AS gap FROM index_series GROUP BY h")
def calibration_gap(spark: SparkSession, d: str) -> DataFrame:
    return report.calibration_gap(_index(spark, d)).select("h", _r("coverage"), _r("nominal"), _r("gap"))


@_query(f"""WITH {FIXED}, s AS (SELECT *, lag(y, 5) OVER w AS y5, lag(y, 20) OVER w AS y20 FROM fixed WINDOW w AS (PARTITION BY id, h ORDER BY date))
SELECT 5 AS shift, round(avg(CASE WHEN y5 BETWEEN l AND u THEN 1 ELSE 0 END), 6) AS coverage, count(*) AS n FROM s WHERE y5 IS NOT NULL UNION ALL SELECT 20, round(avg(CASE WHEN y20 BETWEEN l AND u THEN 1 ELSE 0 END), 6), count(*) FROM s WHERE y20 IS NOT NULL""")
def placebo_coverage(spark: SparkSession, d: str) -> DataFrame:
    return report.placebo_coverage(_fixed(spark, d), (5, 20)).select("shift", _r("coverage"), "n")


@_query(f"WITH {INDEX} SELECT date, " + ", ".join(f'round(max(CASE WHEN h = {h} THEN covered END), 6) AS "{h}"' for h in H) + " FROM index_series GROUP BY date")
def coverage_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return report.coverage_heatmap(_index(spark, d), H).select("date", *[_r(F.col(f"`{h}`"), str(h)) for h in H])


@_query(f"WITH {BOARD} SELECT regexp_extract(baseline, '^fixed_(.+)_h[0-9]+$', 1) AS momentum, " + ", ".join(f"""round(max(CASE WHEN regexp_extract(baseline, '_h([0-9]+)$', 1) = '{h}' THEN mean_loss_scaled END), 6) AS "{h}\"""" for h in H) + " FROM board GROUP BY 1")
def arm_parse_pivot(spark: SparkSession, d: str) -> DataFrame:
    return report.baseline_heatmap(A.leaderboard(_arms(spark, d)), H).select("momentum", *[_r(F.col(f"`{h}`"), str(h)) for h in H])


@_query(f"WITH {FIXED} SELECT h, round(quantile_cont(loss_scaled, 0.25), 6) AS q25, round(quantile_cont(loss_scaled, 0.5), 6) AS q50, round(quantile_cont(loss_scaled, 0.75), 6) AS q75 FROM fixed GROUP BY h")
def loss_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return report.loss_quartiles(_fixed(spark, d)).select("h", _r("q25"), _r("q50"), _r("q75"))


@_query(f"WITH {ACTIONS} SELECT date, momentum, h FROM choices")
def policy_mode(spark: SparkSession, d: str) -> DataFrame:
    return _choices(_table(spark, d, *_TARGETS)).select("date", "momentum", "h")


@_query(f"WITH {ACTIONS} SELECT date, momentum, h, CAST(dense_rank() OVER (ORDER BY momentum, h) - 1 AS INTEGER) AS code FROM choices")
def policy_evolution(spark: SparkSession, d: str) -> DataFrame:
    return report.policy_evolution(cut(_choices(_table(spark, d, *_TARGETS)), "choices")).select("date", "momentum", "h", "code")


@_query(f"WITH {TEST} SELECT date, round(avg(ret_vol20), 5) AS ctx_retvol20, round(avg(spread), 5) AS ctx_spread, round(avg(duration), 5) AS ctx_duration FROM test_rows GROUP BY date")
def daily_context(spark: SparkSession, d: str) -> DataFrame:
    test = _test(spark, d)
    out = policy.daily_choices(_actions(test).select("date", "id", "momentum", "h"), test)
    return out.select("date", *[_r(c, digits=5) for c in ("ctx_retvol20", "ctx_spread", "ctx_duration")])


@_query(f"""WITH {ACTIONS}, vol AS (SELECT DISTINCT date, round(idx_vol, 8) AS vol FROM test_rows), q AS (SELECT quantile_cont(vol, [1.0 / 3, 2.0 / 3]) AS q FROM vol),
days AS (SELECT date, CASE WHEN vol < round(q[1], 12) THEN 'Low' WHEN vol < round(q[2], 12) THEN 'Mid' ELSE 'High' END AS regime FROM vol, q), names AS (SELECT unnest(['Low', 'Mid', 'High']) AS regime)
SELECT names.regime, round(avg(CASE WHEN c.momentum IS NULL THEN NULL WHEN regexp_matches(c.momentum, '^(mom_w5|mom_w10|mom_w21)') THEN 1 ELSE 0 END), 6) AS p_short, CASE WHEN count(c.date) > 0 THEN count(c.date) END AS n
FROM names LEFT JOIN days ON days.regime = names.regime LEFT JOIN choices c ON c.date = days.date GROUP BY names.regime""")
def regime_selection(spark: SparkSession, d: str) -> DataFrame:
    test = _test(spark, d)
    vol = test.select("date", F.round("idx_vol", 8).alias("vol")).distinct()
    choices = A.policy_mode(_actions(test).select("date", "id", "momentum", "h"))
    return report.selection_by_regime(choices, report.regimes(vol)).select("regime", _r("p_short"), "n")


# Baskets and inference.
_BASKET = """basket AS (SELECT {by}, s, y, index_weight FROM {source} WHERE s IS NOT NULL AND y IS NOT NULL),
marked AS (SELECT *, CASE WHEN s >= round(quantile_cont(s, 0.8) OVER (PARTITION BY {by}), 8) THEN 1 ELSE 0 END AS chosen FROM basket),
counted AS (SELECT *, sum(chosen) OVER (PARTITION BY {by}) AS k FROM marked),
values_ AS (SELECT {by}, sum(index_weight * y) / (sum(index_weight) + 1e-12) AS value, count(*) AS n FROM counted WHERE chosen = 1 OR k < 5 GROUP BY {by})"""


@_query(f"WITH {FEATURES}, src AS (SELECT date, round(mom_w21, 8) AS s, y_h21 AS y, index_weight FROM feat), {_BASKET.format(by='date', source='src')} SELECT date, round(value, 6) + 0 AS value, n FROM values_")
def basket_forward_return(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: each week the top fifth by momentum, and what it returned over the next 21 weeks."""
    rows = sales_panel(spark, d).withColumns({"mom": windows.momentum(F.col("ret"), 21), "y": windows.forward_return(F.col("ret"), 21)})
    return causal.basket_returns(rows, F.col("mom"), F.col("y")).select("date", _r("value"), "n")


_POLICIES = {"learned_policy": "CASE c.momentum " + " ".join(f"WHEN 'mom_w{w}' THEN mom_w{w}_z" for w in W) + " END", "fixed_short": "mom_w10_z", "fixed_medium": "mom_w21_z", "fixed_long": "mom_w42_z"}
_TARGET = "CASE c.h " + " ".join(f"WHEN {h} THEN y_h{h}" for h in H) + " END"
COUNTER = (
    ACTIONS + ", " + SCORED[len(FEATURES) + 2 :] + ", src AS (" + " UNION ALL ".join(f"SELECT '{p}' AS policy, f.date AS date, c.h AS ph, round({s}, 8) AS s, {_TARGET} AS y, index_weight FROM scored f JOIN choices c ON f.date = c.date" for p, s in _POLICIES.items()) + "), " + _BASKET.format(by="policy, date, ph", source="src")
)


@_query(f"WITH {COUNTER} SELECT policy, round(avg(value / ph), 7) + 0 AS mean_return, round(coalesce(stddev_samp(value / ph), 0), 7) AS std_return, count(*) AS n_obs FROM values_ GROUP BY policy")
def counterfactual_policies(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d)
    baskets = causal.policy_baskets(_scored(t), _choices(t), CFG)
    return baskets.groupBy("policy").agg(_r(F.avg("v"), "mean_return", 7), _r(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), "std_return", 7), F.count(F.lit(1)).alias("n_obs"))


@_query(f"WITH {FIXED}, r AS (SELECT h, date, sum(y / h * index_weight) / (sum(index_weight) + 1e-12) AS v FROM fixed GROUP BY h, date UNION ALL SELECT NULL, date, sum(y / h * index_weight) / (sum(index_weight) + 1e-12) FROM fixed GROUP BY date) SELECT h, date, round(v, 8) + 0 AS v FROM r", totals=("h",))
def learned_policy_returns(spark: SparkSession, d: str) -> DataFrame:
    return causal.learned_returns(_fixed(spark, d)).select("h", "date", _r("v", digits=8))


@_query(f"""WITH {ACTIONS}, base AS (SELECT date, round(mom_w21, 8) AS s, y_h21 AS y, index_weight AS w FROM feat), q AS (SELECT *, round(quantile_cont(s, 0.8) OVER (PARTITION BY date), 8) AS hi, round(quantile_cont(s, 0.2) OVER (PARTITION BY date), 8) AS lo FROM base),
sp AS (SELECT date, sum(CASE WHEN s >= hi THEN w * y END) / (sum(CASE WHEN s >= hi AND y IS NOT NULL THEN w END) + 1e-12) - sum(CASE WHEN s <= lo THEN w * y END) / (sum(CASE WHEN s <= lo AND y IS NOT NULL THEN w END) + 1e-12) AS spread FROM q GROUP BY date),
j AS (SELECT spread, c.h FROM sp JOIN choices c ON sp.date = c.date WHERE spread IS NOT NULL), m AS (SELECT median(h) AS m FROM j)
SELECT round(avg(spread), 6) + 0 AS mean_spread, round(avg(CASE WHEN sign(round(spread, 12)) = sign(h - m) THEN 1 ELSE 0 END), 6) AS mean_alignment, count(*) AS n, 'mom_w21' AS momentum FROM j, m""")
def spread_alignment(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d)
    return causal.spread_alignment(t, _choices(t), "mom_w21", 21).select(_r("mean_spread"), _r("mean_alignment"), "n", "momentum")


def _nw_sql(series: str, by: str, lags: str, width: str) -> str:
    return f"""ser AS ({series}), num AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY date) AS rn, count(*) OVER (PARTITION BY {by}) AS n, v - avg(v) OVER (PARTITION BY {by}) AS e FROM ser),
own_ AS (SELECT {by}, count(*) AS n, avg(v) AS mean, sum(e * e) AS own FROM num GROUP BY {by}),
crossed AS (SELECT a.{by}, sum(2 * (1 - (a.rn - b.rn) / CAST({width} AS DOUBLE)) * a.e * b.e) AS x FROM num a JOIN num b ON a.{by} = b.{by} AND a.rn - b.rn BETWEEN 1 AND {lags} GROUP BY a.{by}),
nw AS (SELECT o.{by}, n, mean, CASE WHEN n > 1 THEN sqrt(greatest((own + coalesce(x, 0)) / n / n, 1e-18)) END AS nw_se FROM own_ o LEFT JOIN crossed c ON o.{by} = c.{by})"""


_AUTO = "greatest(least(CAST(floor(4 * pow(a.n / CAST(100 AS DOUBLE), 2 / CAST(9 AS DOUBLE))) AS BIGINT), a.n - 1), 1)"
_SERIES = "SELECT h, date, loss_scaled AS v FROM index_series"


@_query(f"WITH {INDEX}, {_nw_sql(_SERIES, 'h', _AUTO, f'({_AUTO} + 1)')} SELECT h, n, round(mean, 7) AS mean, round(nw_se, 7) AS nw_se FROM nw")
def newey_west_se(spark: SparkSession, d: str) -> DataFrame:
    return stats.newey_west(cut(_index(spark, d).select("h", "date", F.col("loss_scaled").alias("v")), "series"), ["h"]).select("h", "n", _r("mean", digits=7), _r("nw_se", digits=7))


@_query(f"WITH {INDEX}, {_nw_sql(_SERIES, 'h', 'least(10, a.n - 1)', '11')} SELECT h, n, round(mean, 7) AS mean, round(nw_se, 7) AS nw_se FROM nw")
def newey_west_fixed_lags(spark: SparkSession, d: str) -> DataFrame:
    return stats.newey_west(cut(_index(spark, d).select("h", "date", F.col("loss_scaled").alias("v")), "series"), ["h"], 10).select("h", "n", _r("mean", digits=7), _r("nw_se", digits=7))


def _boot_sql(series: str, by: str, block: int, draws: int, alpha: float, seed: int) -> str:
    """Circular moving-block bootstrap of the mean of each series, with the library's block starts."""
    return f"""bser AS ({series}), bnum AS (SELECT {by}, v, row_number() OVER (PARTITION BY {by} ORDER BY date) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM bser),
bsizes AS (SELECT {by}, max(n) AS n, avg(v) AS mean FROM bnum GROUP BY {by}),
bdraws AS (SELECT {by}, n, b, j, i, (CAST(b AS BIGINT) * 1103515245 + CAST(j AS BIGINT) * 97760055 + {seed}) % n AS s FROM bsizes, range({draws}) t(b), range(1000) u(j), range({block}) w(i) WHERE j < ceil(n / CAST({block} AS DOUBLE)) AND j * {block} + i < n),
bmeans AS (SELECT d.{by}, b, avg(v) AS m FROM bdraws d JOIN bnum ON bnum.{by} = d.{by} AND bnum.rn = (d.s + d.i) % d.n + 1 GROUP BY d.{by}, b),
boot AS (SELECT {by}, any_value(n) AS n, any_value(mean) AS mean, quantile_cont(m, {alpha / 2}) AS ci_lo, quantile_cont(m, {1 - alpha / 2}) AS ci_hi FROM bmeans JOIN bsizes USING ({by}) GROUP BY {by})"""


@_query(f"WITH {INDEX}, {_boot_sql(_SERIES, 'h', 5, 2000, 0.05, 123)} SELECT h, n, round(mean, 7) AS mean, round(ci_lo, 7) AS ci_lo, round(ci_hi, 7) AS ci_hi FROM boot")
def block_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    series = cut(_index(spark, d).select("h", "date", F.col("loss_scaled").alias("v")), "series")
    return stats.block_bootstrap(series, ["h"], 5, 2000).select("h", "n", _r("mean", digits=7), _r("ci_lo", digits=7), _r("ci_hi", digits=7))


def _variant_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    arms = cut(A.security_to_index(_arms(spark, d), ("baseline", "momentum", "date", "h")), "arms")
    return arms.where("momentum = 'mom_w10'"), arms.where("momentum = 'mom_w63'")


VARIANT = ARMS + """, arm_index AS (SELECT momentum, date, h, sum(loss_scaled * w) / sum(w) AS loss_scaled FROM (SELECT *, index_weight / (sum(index_weight) OVER (PARTITION BY baseline, date, h) + 1e-12) AS w FROM arms) GROUP BY 1, 2, 3),
pair AS (SELECT a.date, a.h, a.loss_scaled AS la, b.loss_scaled AS lb FROM arm_index a JOIN arm_index b ON a.date = b.date AND a.h = b.h AND a.momentum = 'mom_w10' AND b.momentum = 'mom_w63')"""
_DIFFS = "SELECT 'h=' || h AS scope, date, (lb - la) * 1000000 AS v FROM pair UNION ALL SELECT 'all', date, avg(lb - la) * 1000000 FROM pair GROUP BY date"


@_query(f"""WITH {VARIANT}, {_nw_sql(_DIFFS, 'scope', _AUTO, f'({_AUTO} + 1)')}, {_boot_sql(_DIFFS, 'scope', 5, 2000, 0.05, 123)}
SELECT scope, nw.n, round(nw.mean, 4) + 0 AS mean_diff, round(nw_se, 4) AS hac_se, round(nw.mean / nw_se, 5) + 0 AS hac_t, round(ci_lo, 4) + 0 AS mbb_ci_lo, round(ci_hi, 4) + 0 AS mbb_ci_hi FROM nw JOIN boot USING (scope)""")
def paired_variant_diff(spark: SparkSession, d: str) -> DataFrame:
    base, variant = _variant_pair(spark, d)
    out = stats.compare_variant(base, variant)
    return out.select("scope", "n", *[_r(F.col(c) * 1_000_000, c, 4) for c in ("mean_diff", "hac_se", "mbb_ci_lo", "mbb_ci_hi")], _r("hac_t", digits=5))


@_query(f"""WITH {VARIANT}, {_nw_sql("SELECT h, date, (la - lb) * 1000000 AS v FROM pair", 'h', 'least(10, a.n - 1)', '11')}
SELECT h, n, round(mean, 4) + 0 AS diff_mean, round(mean / nw_se * sqrt((n + 1 - 2 + CAST(0 AS DOUBLE)) / n), 4) + 0 AS dm_stat FROM nw""")
def diebold_mariano(spark: SparkSession, d: str) -> DataFrame:
    base, variant = _variant_pair(spark, d)
    pairs = base.select("date", "h", (F.col("loss_scaled") * 1_000_000).alias("a")).join(variant.select("date", "h", (F.col("loss_scaled") * 1_000_000).alias("b")), ["date", "h"])
    return stats.diebold_mariano(pairs, ["h"]).select("h", "n", _r("diff_mean", digits=4), _r("dm_stat", digits=4))


def _significance(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d)
    daily = A.security_to_index(arm_scores(t, CFG), ("baseline", "date", "h")).groupBy("baseline", "date").agg(F.avg("loss_scaled").alias("loss"))
    mine = A.security_to_index(fixed_scores(t, CFG)).groupBy("date").agg(F.avg("loss_scaled").alias("loss"))
    daily, mine = cut(daily, "daily"), cut(mine, "daily")
    return stats.significance_table(mine, daily)


@_query()
def significance_table(spark: SparkSession, d: str) -> DataFrame:
    return _significance(spark, d)


_BOARD_DAYS = ARMS + """, cells AS (SELECT baseline, date, h, sum(loss_scaled * w) / sum(w) AS loss FROM (SELECT *, index_weight / (sum(index_weight) OVER (PARTITION BY baseline, date, h) + 1e-12) AS w FROM arms) GROUP BY 1, 2, 3),
arm_days AS (SELECT baseline, date, avg(loss) AS loss FROM cells GROUP BY 1, 2)"""
_MINE = INDEX[len(TEST) :] + ", mine AS (SELECT date, avg(loss_scaled) AS loss FROM index_series GROUP BY date)"


@_query(f"""WITH {_BOARD_DAYS}{_MINE}, pairs AS (SELECT baseline, a.date AS date, m.loss AS a, a.loss AS b FROM arm_days a JOIN mine m ON a.date = m.date),
{_nw_sql("SELECT baseline, date, (a - b) * 1000000 AS v FROM pairs", 'baseline', 'least(10, a.n - 1)', '11')},
means AS (SELECT baseline, avg(a) AS pl, avg(b) AS bl FROM pairs GROUP BY baseline)
SELECT baseline, round(pl, 6) AS policy_loss, round(bl, 6) AS baseline_loss, round((bl - pl) / nullif(bl, 0) * 100, 4) + 0 AS improvement_pct, round(mean / nw_se * sqrt((n - 1 + CAST(0 AS DOUBLE)) / n), 3) + 0 AS dm_stat, n AS n_dates
FROM means JOIN nw USING (baseline) WHERE n >= 10 AND nw_se > 1e-3""")
def significance_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The significance table without p-values, for baselines whose losses differ from the policy's."""
    out = _significance(spark, d).where("nw_se > 1e-9")
    return out.select("baseline", _r("policy_loss"), _r("baseline_loss"), _r("improvement_pct", digits=4), _r("dm_stat", digits=3), "n_dates")


@_query(f"""WITH {_BOARD_DAYS}, days AS (SELECT baseline AS model, date, loss * 1000000 AS v FROM arm_days), {_nw_sql('SELECT model, date, v FROM days', 'model', 'least(10, a.n - 1)', '11')}, {_boot_sql('SELECT model, date, v FROM days', 'model', 20, 1000, 0.10, 12345)}
SELECT model, round(nw.mean / 1000000, 7) AS mean_loss, round(nw_se / 1000000, 7) AS nw_se, round(ci_lo / 1000000, 7) AS ci_lo, round(ci_hi / 1000000, 7) AS ci_hi FROM nw JOIN boot USING (model)""")
def performance_table(spark: SparkSession, d: str) -> DataFrame:
    models = cut(A.security_to_index(_arms(spark, d), ("baseline", "date", "h")).withColumnRenamed("baseline", "model"), "models")
    return stats.performance_table(models).select("model", *[_r(c, digits=7) for c in ("mean_loss", "nw_se", "ci_lo", "ci_hi")])


@_query(f"""WITH {FIXED}, every AS (SELECT h, sum(covered) AS k, count(*) AS n FROM fixed GROUP BY ROLLUP (h)), p AS (SELECT CAST(1 AS DOUBLE) - CAST({CFG.alpha} AS DOUBLE) AS p),
mass AS (SELECT h, k, n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)) AS m FROM every, p, LATERAL (SELECT unnest(range(n + 1)) AS i)),
here AS (SELECT h, m AS limit_ FROM mass WHERE i = k)
SELECT mass.h AS h, CAST(any_value(k) AS BIGINT) AS hits, any_value(n) AS n, round(least(sum(CASE WHEN m <= limit_ * (1 + 1e-7) THEN m ELSE 0 END), 1), 6) AS p_value FROM mass JOIN here ON mass.h IS NOT DISTINCT FROM here.h GROUP BY mass.h""", totals=("h",))
def binomial_test(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage_statistics(_fixed(spark, d)).select("h", "hits", "n", _r(stats.binomial_p_value("hits", "n", F.lit(1 - CFG.alpha)), "p_value"))


# Off-policy evaluation, actions, sets.
_LIVE = " + ".join(f"alive_h{h}" for h in H)


@_query(f"WITH {TEST} SELECT date, id, CAST(greatest(({_LIVE}) * 4, 1) AS INTEGER) AS support, round(least(greatest(1 / CAST(greatest(({_LIVE}) * 4, 1) AS DOUBLE), 1e-6), 1), 8) AS pi_b FROM test_rows")
def ope_propensity(spark: SparkSession, d: str) -> DataFrame:
    return ope.reconstruct_support(_test(spark, d), CFG).select("date", "id", F.col("support").cast("int").alias("support"), _r(S.propensity(F.col("support")), "pi_b", 8))


def _ope_rows(spark: SparkSession, d: str, features: DataFrame | None = None) -> DataFrame:
    test = _test(spark, d) if features is None else cut(plan.test_slice(features.select("date", "id", "index_weight", *(f"y_h{h}" for h in H)), CFG), "test")
    y = F.coalesce(*[F.when(F.col("h") == h, F.when(F.col(f"alive_h{h}") == 1, F.col(f"y_h{h}"))) for h in H])
    behaviour = _actions(test, 3, 5).select("date", "id", "momentum", "h", y.alias("y"))
    evaluation = _actions(test, 7, 5).select("date", "id", "momentum", "h")
    rows = ope.align_actions(behaviour, evaluation).join(ope.reconstruct_support(test, CFG), ["date", "id"])
    return rows.join(test.select("date", "id", "index_weight"), ["date", "id"])


_YB = "CASE h_b " + " ".join(f"WHEN {h} THEN CASE WHEN alive_h{h} = 1 THEN y_h{h} END" for h in H) + " END"
OPE = TEST + f""", o0 AS (SELECT *, {_PICK.format(x=_ACT.format(k=3))} AS mom_b, {_PICKH.format(x=_ACT.format(k=5))} AS h_b, {_PICK.format(x=_ACT.format(k=7))} AS mom_e, {_PICKH.format(x=_ACT.format(k=5))} AS h_e, greatest(({_LIVE}) * 4, 1) AS support FROM test_rows),
o1 AS (SELECT *, {_YB} / h_b AS yy FROM o0), o2 AS (SELECT * FROM o1 WHERE yy IS NOT NULL), qm AS (SELECT mom_b, h_b, avg(yy) AS q FROM o2 GROUP BY 1, 2), q0 AS (SELECT avg(yy) AS q0 FROM o2),
o3 AS (SELECT o2.*, b.q AS q_b, coalesce(e.q, q0.q0) AS q_e, CASE WHEN o2.mom_b = o2.mom_e AND o2.h_b = o2.h_e THEN 1 ELSE 0 END / least(greatest(1 / CAST(support AS DOUBLE), 1e-6), 1) AS iw
  FROM o2 CROSS JOIN q0 JOIN qm b ON o2.mom_b = b.mom_b AND o2.h_b = b.h_b LEFT JOIN qm e ON o2.mom_e = e.mom_b AND o2.h_e = e.h_b)"""


@_query(f"""WITH {OPE} SELECT h_e, round(avg(q_e), 8) + 0 AS "DM", round(avg(iw * yy), 8) + 0 AS "IPS", round(avg(q_e + iw * (yy - q_b)), 8) + 0 AS "DR", round(sum(q_e * index_weight) / (sum(index_weight) + 1e-18), 8) + 0 AS "DM_w",
  round(sum(iw * yy) / (sum(iw) + 1e-12), 8) + 0 AS "IPS_sn", round(pow(sum(iw), 2) / (sum(iw * iw) + 1e-18), 4) AS ess, count(*) AS n FROM o3 GROUP BY ROLLUP (h_e)""", totals=("h_e",))
def ope_dr_groupmean(spark: SparkSession, d: str) -> DataFrame:
    out = ope.evaluate_group_mean(cut(_ope_rows(spark, d), "ope"), CFG)
    return out.select("h_e", *[_r(c, digits=8) for c in ("DM", "IPS", "DR", "DM_w", "IPS_sn")], _r("ess", digits=4), "n")


@_query(totals=("h_e",))
def ope_dr_forest(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d)
    return ope.evaluate_forest(_ope_rows(spark, d, t), _scored(t), CFG)[1]


@_query()
def value_function_oof(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d)
    return causal.value_function(_scored(t), _choices(t), CFG)


@_query()
def value_function_purged(spark: SparkSession, d: str) -> DataFrame:
    """The value function with folds purged and embargoed by 21 dates, or by the horizon where that is longer."""
    t = _table(spark, d)
    return causal.value_function(_scored(t), _choices(t), Config.from_mapping({"max_purge_steps": 21}))


_MEANS = causal.CONTEXT
_BY_DATE = (
    COUNTER.split(", src AS (")[0]
    + f""", src AS (SELECT f.*, round({_POLICIES['learned_policy']}, 8) AS s FROM scored f JOIN choices c ON f.date = c.date),
top AS (SELECT * FROM (SELECT *, round(quantile_cont(s, 0.8) OVER (PARTITION BY date), 8) AS cutoff FROM src WHERE s IS NOT NULL) WHERE s >= cutoff AND index_weight IS NOT NULL),
told AS ({" UNION ALL ".join(f"SELECT {h} AS h, *, y_h{h} / {h} AS label FROM top WHERE y_h{h} IS NOT NULL" for h in H)}),
means AS (SELECT h, date, {", ".join(f"avg({c}) AS {c}" for c in _MEANS)}, sum(label * index_weight) / (sum(index_weight) + 1e-12) AS label FROM told GROUP BY h, date)"""
)


@_query(f"WITH {_BY_DATE} SELECT CAST(h AS INTEGER) AS h, date, {', '.join(f'round({c}, 6) + 0 AS {c}' for c in (*_MEANS, 'label'))} FROM means WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _MEANS)}")
def value_rows_by_date(spark: SparkSession, d: str) -> DataFrame:
    """What the value function by date is fitted on."""
    t = _table(spark, d)
    return causal.value_rows(_scored(t), _choices(t), CFG, pointwise=False).select("h", "date", *[_r(c) for c in (*_MEANS, "label")])


@_query()
def value_function_by_date(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d)
    return causal.value_function(_scored(t), _choices(t), CFG, pointwise=False)


@_query(f"""WITH {OPE}, {SCORED[len(FEATURES) + 2 :]}, known AS (SELECT * FROM scored WHERE CAST(id AS BIGINT) % 5 > 0)
SELECT date, id, round(o2.yy, 6) + 0 AS y, {', '.join(f'round(coalesce(known.{c}, 0), 5) + 0 AS {c}' for c in _MEANS)} FROM o2 LEFT JOIN known USING (date, id)""")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the outcome forest is fitted on, with a feature table that lacks a fifth of the ids."""
    features = _scored(_table(spark, d)).where(F.col("id").cast("long") % 5 > 0)
    return ope.training_table(_ope_rows(spark, d), features, CFG).select("date", "id", _r("y"), *[_r(c, digits=5) for c in _MEANS])


@_query(f"WITH {ACTIONS} SELECT DISTINCT momentum || '|h=' || h AS arm FROM (SELECT momentum, h FROM actions UNION ALL SELECT momentum, h FROM choices)")
def union_distinct_actions(spark: SparkSession, d: str) -> DataFrame:
    acts = _actions(_test(spark, d)).select("date", "id", "momentum", "h")
    both = acts.select("momentum", "h").unionByName(A.policy_mode(acts).select("momentum", "h"))
    return both.select(S.action_key(F.col("momentum"), F.col("h")).alias("arm")).distinct()


# Metrics, settings and filters over whole tables.
_BASKET_SERIES = "SELECT policy, date, value / ph AS v FROM values_"


@_query(f"""WITH {COUNTER}, spreads AS (SELECT policy, coalesce(stddev_samp(value / ph), 0) AS sd FROM values_ GROUP BY policy), {_nw_sql(_BASKET_SERIES, 'policy', _AUTO, f'({_AUTO} + 1)')}, {_boot_sql(_BASKET_SERIES, 'policy', 5, 2000, 0.05, 123)}
SELECT policy, nw.n AS n_obs, round(nw.mean, 7) + 0 AS mean_return, round(sd, 7) AS std_return, round(nw_se, 7) AS nw_se, round(ci_lo, 7) + 0 AS mbb_ci_lo, round(ci_hi, 7) + 0 AS mbb_ci_hi, round(nw.mean / (sd + 1e-18) * sqrt(252), 5) + 0 AS sharpe
FROM nw JOIN boot USING (policy) JOIN spreads USING (policy)""")
def policy_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d)
    baskets = cut(causal.policy_baskets(_scored(t), _choices(t), CFG), "baskets")
    out = causal.policy_metrics(baskets)
    return out.select("policy", "n_obs", *[_r(c, digits=7) for c in ("mean_return", "std_return", "nw_se", "mbb_ci_lo", "mbb_ci_hi")], _r("sharpe", digits=5))


@_query(f"""WITH {COUNTER}, means AS (SELECT policy, avg(value / ph) AS m FROM values_ GROUP BY policy), two AS (SELECT max(CASE WHEN policy = 'learned_policy' THEN m END) AS learned, max(CASE WHEN policy LIKE 'fixed%' THEN m END) AS best_fixed FROM means)
SELECT round(learned, 7) + 0 AS learned, round(best_fixed, 7) + 0 AS best_fixed, round(learned - best_fixed, 7) + 0 AS outperformance FROM two""")
def outperformance(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d)
    metrics = causal.policy_baskets(_scored(t), _choices(t), CFG).groupBy("policy").agg(F.avg("v").alias("mean_return"))
    return causal.outperformance(metrics).select(_r("learned", digits=7), _r("best_fixed", digits=7), _r("outperformance", digits=7))


_PINNED = replace(CFG, alpha_by_h={21: 0.05, 63: 0.2})
_PINNED_SQL = "CASE h WHEN 21 THEN CAST(0.05 AS DOUBLE) WHEN 63 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END"


@_query(f"""WITH {FIXED} SELECT date, id, h, {_PINNED_SQL} AS alpha, round((width + 2 / {_PINNED_SQL} * greatest(l - y, 0) + 2 / {_PINNED_SQL} * greatest(y - u, 0)) / h, 6) AS loss_scaled FROM fixed""")
def pinned_alphas(spark: SparkSession, d: str) -> DataFrame:
    """Scores under miss rates that two horizons have of their own."""
    return fixed_scores(_table(spark, d, *_TARGETS), _PINNED).select("date", "id", "h", "alpha", _r("loss_scaled"))


_N_ARMS = len(W) * len(H)


@_query(f"""WITH {ACTIONS}, placed AS (SELECT date, id, CASE momentum {" ".join(f"WHEN 'mom_w{w}' THEN {i * len(H)}" for i, w in enumerate(W))} END + CASE h {" ".join(f"WHEN {h} THEN {i}" for i, h in enumerate(H))} END AS arm FROM actions)
SELECT date, id, CAST(arm AS INTEGER) AS arm, {", ".join(f"CAST(CASE WHEN arm = {i} THEN 1 ELSE 0 END AS DOUBLE) AS a{i}" for i in range(_N_ARMS))} FROM placed""")
def one_hot_actions(spark: SparkSession, d: str) -> DataFrame:
    acts = _actions(_test(spark, d))
    keys = F.array(*[F.lit(f"mom_w{w}|h={h}") for w in W for h in H])
    arm = (F.array_position(keys, S.action_key(F.col("momentum"), F.col("h"))) - 1).cast("int")
    hot = acts.select("date", "id", arm.alias("arm"), S.one_hot(arm, _N_ARMS).alias("x"))
    return hot.select("date", "id", "arm", *[F.col("x")[i].alias(f"a{i}") for i in range(_N_ARMS)])


@_query(f"""WITH {PANEL}, holes AS (SELECT date, id, CASE WHEN CAST(id AS BIGINT) % 5 = 0 AND date_diff('day', DATE '1995-01-02', date) // 7 % 2 = 0 THEN NULL ELSE ret END AS ret, spread FROM panel),
capped AS (SELECT date, id, greatest(least(ret, CAST(0.01 AS DOUBLE)), CAST(-0.01 AS DOUBLE)) AS ret, least(spread, CAST(0.045 AS DOUBLE)) AS spread FROM holes),
poor AS (SELECT id FROM capped GROUP BY id HAVING avg(CASE WHEN ret IS NULL THEN 1 ELSE 0 END) > 0.3)
SELECT date, id, CASE WHEN ret IS NULL THEN CAST(0 AS DOUBLE) ELSE round(ret, 6) END AS ret, ret IS NULL AS missing, round(spread, 6) AS spread FROM capped ANTI JOIN poor USING (id)""")
def quality_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Caps on returns and spreads, ids with more than 30 % of their returns missing left out."""
    week = F.floor(F.datediff("date", F.lit("1995-01-02").cast("date")) / 7)
    hole = (F.col("id").cast("long") % 5 == 0) & (week % 2 == 0)
    holes = sales_panel(spark, d).withColumn("ret", F.when(~hole, F.col("ret")))
    kept = quality_filters(holes, 0.01, 0.045, 0.3)
    return kept.select("date", "id", _r(F.coalesce("ret", F.lit(0.0)), "ret"), F.col("ret").isNull().alias("missing"), _r("spread"))


@_query(f"""WITH {FIXED}, held AS (SELECT date, id, index_weight FROM panel WHERE CAST(id AS BIGINT) % 3 > 0)
SELECT date, id, f.h AS h, round(coalesce(s.index_weight, CAST(0.5 AS DOUBLE)), 8) AS index_weight FROM fixed f LEFT JOIN held s USING (date, id)""")
def default_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of a panel that lacks a third of the ids: rows without one get the default."""
    some = sales_panel(spark, d).where(F.col("id").cast("long") % 3 > 0)
    return A.with_weights(_fixed(spark, d), some, 0.5).select("date", "id", "h", _r("index_weight", digits=8))


@_query(f"""WITH {VARIANT}, cells AS ({_DIFFS}), means AS (SELECT scope, avg(v) AS m FROM cells GROUP BY scope)
SELECT 'mom_w63' AS variant, {", ".join(f"round(max(CASE WHEN scope = 'h={h}' THEN m END), 4) + 0 AS h{h}" for h in H)}, round(max(CASE WHEN scope = 'all' THEN m END), 4) + 0 AS overall FROM means""")
def ablation_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Differences to the base: a row per variant, a column per horizon, and all of them."""
    base, variant = _variant_pair(spark, d)
    overview = stats.compare_variant(base, variant.withColumn("variant", F.lit("mom_w63")), ["variant"], draws=50)
    wide = report.ablation_heatmap(overview, [*(f"h={h}" for h in H), "all"])
    return wide.select("variant", *[_r(F.col(f"`h={h}`") * 1_000_000, f"h{h}", 4) for h in H], _r(F.col("all") * 1_000_000, "overall", 4))


@_query(f"""WITH {_BOARD_DAYS}, days AS (SELECT baseline AS model, date, loss * 1000000 AS v FROM arm_days), {_nw_sql('SELECT model, date, v FROM days', 'model', 'least(10, a.n - 1)', '11')}
SELECT model, round(mean / 1000000, 7) AS mean_loss, round(nw_se / 1000000, 7) AS error FROM nw""")
def bars_with_error(spark: SparkSession, d: str) -> DataFrame:
    models = cut(A.security_to_index(_arms(spark, d), ("baseline", "date", "h")).withColumnRenamed("baseline", "model"), "models")
    return report.bars_with_error(stats.performance_table(models), "model", "mean_loss").select("model", _r("mean_loss", digits=7), _r("error", digits=7))


@_query(f"""WITH {ACTIONS}, told AS (SELECT a.date, a.id, a.momentum, a.h, CASE a.h {" ".join(f"WHEN {h} THEN y_h{h}" for h in H)} END AS outcome FROM actions a JOIN test_rows t ON a.date = t.date AND a.id = t.id)
SELECT date, id, t.momentum AS mom_b, CAST(t.h AS INTEGER) AS h_b, c.momentum AS mom_e, CAST(c.h AS INTEGER) AS h_e, round(outcome, 6) + 0 AS y FROM told t JOIN choices c USING (date) WHERE outcome IS NOT NULL AND CAST(id AS BIGINT) % 4 > 0""")
def aligned_actions(spark: SparkSession, d: str) -> DataFrame:
    """Rows on which the logged policy and the one to evaluate both acted: the latter skips a fourth of the ids."""
    t = _test(spark, d)
    acts = _actions(t)
    y = F.coalesce(*[F.when(F.col("h") == h, F.col(f"y_h{h}")) for h in H])
    modal = A.policy_mode(acts.select("date", "id", "momentum", "h"))
    evaluated = t.where(F.col("id").cast("long") % 4 > 0).select("date", "id").join(modal, "date")
    return ope.align_actions(acts.withColumn("y", y), evaluated).select("date", "id", "mom_b", "h_b", "mom_e", "h_e", _r("y"))


# Policies.
def _feature_table(spark: SparkSession, d: str) -> DataFrame:
    """Scores and context are computed as the written features are read, so the features are made once. Policies read no momentum."""
    percentiles = ("spread_percentile", "vol_percentile")
    return plan.add_context(plan.add_scores(_table(spark, d, *dict.fromkeys(("index_weight", *plan.BASE, *percentiles, *_TARGETS))), CFG, plan.BASE))


@_query()
def bandit_run(spark: SparkSession, d: str) -> DataFrame:
    return policy.run_policies(_feature_table(spark, d), [policy.Run("crl", "bandit", CFG)], CFG)


# What fixed policies choose: the arm, or its momentum at the first horizon alive; runs that learn first leave out the last dates.
_FIRST = "CASE " + " ".join(f"WHEN alive_h{h} = 1 THEN {h}" for h in H) + " END"
_OWN_H = "CASE a.h " + " ".join(f"WHEN {h} THEN alive_h{h}" for h in H) + " END"
_FIXED_ARMS = " UNION ALL ".join(f"SELECT 'mom_w{w}' AS momentum, {h} AS h" for w in W for h in H)


@_query(f"""WITH {TEST}, test_dates AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM test_rows)),
kept AS (SELECT t.* FROM test_rows t JOIN test_dates d USING (date) WHERE k <= CASE WHEN n > {max(H)} THEN n - {max(H)} ELSE n END),
fixed_arms AS ({_FIXED_ARMS}), chosen AS (
  SELECT 'fixed_' || a.momentum || '_h' || a.h AS run, date, id, a.momentum, CASE WHEN {_OWN_H} = 1 THEN a.h ELSE {_FIRST} END AS h, CAST(({_LIVE}) * {len(W)} AS INTEGER) AS support, t.* EXCLUDE (date, id)
  FROM kept t CROSS JOIN fixed_arms a WHERE {_LIVE} > 0
), matured AS (SELECT run, date, id, momentum, CAST(h AS INTEGER) AS h, support, CASE h {" ".join(f"WHEN {h} THEN y_h{h}" for h in H)} END AS outcome FROM chosen)
SELECT run, date, id, momentum, h, support, round(outcome, 6) AS y FROM matured WHERE outcome IS NOT NULL""")
def fixed_policy_choices(spark: SparkSession, d: str) -> DataFrame:
    """The choices, supports and matured outcomes of whole runs of all fixed policies."""
    runs = [r for r in policy.baseline_runs(CFG) if r.kind == "fixed"]
    return policy.run_policies(_feature_table(spark, d), runs, CFG).select("run", "date", "id", "momentum", "h", "support", _r("y"))


@_query()
def baseline_runs(spark: SparkSession, d: str) -> DataFrame:
    scores = policy.run_policies(_feature_table(spark, d), policy.baseline_runs(CFG), CFG, weights=True).withColumn("baseline", F.col("run"))
    return A.leaderboard(A.with_weights(scores, None, 0.0))


@_query()
def ablation_overview(spark: SparkSession, d: str) -> DataFrame:
    return ablation.run_ablation(_feature_table(spark, d), CFG)[0]


# Raw quotes.
@_query(f"""WITH {PANEL}, counted AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM panel)
SELECT date, id, round(index_weight, 6) AS index_weight, round(ret, 6) + 0 AS ret, CAST(dense_rank() OVER (ORDER BY sector_id + 100) - 1 AS INTEGER) AS sector_id FROM counted WHERE n >= 290""")
def raw_quotes_panel(spark: SparkSession, d: str) -> DataFrame:
    p = sales_panel(spark, d)
    percent = lambda c: F.concat(F.translate(F.format_string("%.14f", c * 100), ".", ","), F.lit("%"))
    raw = min_observations(p, 290).select(
        F.col("date").cast("string").alias("Data"),
        F.col("id").alias("Debênture"),
        percent(F.col("index_weight")).alias("Peso no índice (%)"),
        percent(F.col("ret") * F.col("index_weight")).alias("MTM ponderado (%)"),
        (F.col("sector_id") + 100).cast("string").alias("Setor"),
    )
    return panel_from_raw(raw, min_obs=290).select("date", "id", _r("index_weight"), _r("ret"), "sector_id")


# Event time.
@_query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", times=("start",))
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ev.tumbling(table(spark, d, "events")).select("start", "event_type", "n", _r("total", digits=4))


@_query("SELECT date_trunc('day', ts) - to_days(k) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2", times=("start",))
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return ev.sliding(table(spark, d, "events")).select("start", "event_type", "n", _r("total", digits=4))


@_query("""WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""", times=("start", "end"))
def events_session(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(table(spark, d, "events"))


def queries() -> dict[str, Query]:
    """Name -> query."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL with the same result."""
    return dict(_SQL)
