"""Every panel query against DuckDB on the smallest tables, values compared after rounding in both engines."""

import os

import duckdb
import pandas as pd
import pytest

from quillon.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")


def _rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows in order of their keys, then of their numbers."""
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or v != v else float(v) if isinstance(v, float) else str(v)
    rows = [tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [round(v, 7) + 0.0 for v in r if isinstance(v, float)]))


def _units(frame: pd.DataFrame) -> list[float]:
    """One unit of the last digit that a column of numbers is rounded to, by column in order of name; 0 for other columns."""
    digits = lambda v: len(f"{v:.10f}".rstrip("0").split(".")[1])
    return [10.0 ** -max([digits(v) for v in frame[c].dropna()], default=0) if pd.api.types.is_float_dtype(frame[c]) else 0.0 for c in sorted(frame.columns)]


def _alike(a: object, b: object, unit: float) -> bool:
    """Numbers may differ by one unit of their column's last digit, where a tie went to either side."""
    return abs(a - b) <= 1.01 * unit + 1e-12 * abs(a) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, duck, name):
    mine, want = queries()[name](spark, SF).toPandas(), duck.execute(oracle_sql()[name]).fetch_df()
    assert sorted(mine.columns) == sorted(want.columns) and len(mine) == len(want)
    units = _units(want)
    different = [(a, b) for a, b in zip(_rows(mine), _rows(want), strict=True) if not all(map(_alike, a, b, units))]
    assert not different, different[:3]


@pytest.mark.parametrize("name", ["significance_table", "bandit_run"])
def test_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_value_function_has_every_horizon(spark):
    # Over the dates of all labels the last fold of the longest horizon had no row to train on.
    from quillon.plans.causal import CONTEXT, value_function

    day, value = "date_add(date'2000-01-03', cast(d.id * 7 as int))", "cast(hash(d.id, i.id) % 100 / 1000.0 as double)"
    labels = [f"case when d.id < {60 - h // 2} then {value} end as y_h{h}" for h in (10, 21, 42, 63)]
    rows = spark.range(60).alias("d").crossJoin(spark.range(12).alias("i"))
    features = rows.selectExpr(f"{day} as date", "cast(i.id as string) as id", "cast(i.id as double) as mom_w10_z", *[f"{value} as {c}" for c in CONTEXT], *labels)
    for w in (21, 42, 63):
        features = features.withColumn(f"mom_w{w}_z", features["mom_w10_z"])
    choices = features.selectExpr("date", "'mom_w10' as momentum", "21 as h").distinct()
    found = {r.h: (r.n, r.folds) for r in value_function(features, choices, trees=2).collect()}
    assert found == {h: (3 * (60 - h // 2), 3) for h in (10, 21, 42, 63)}


def test_registered_over_the_whole_job(monkeypatch):
    from quillon import queries as q

    seen = {}
    monkeypatch.setattr(q.ope, "evaluate_forest", lambda *a, **k: (None, seen.setdefault("ope", (a[2], k)) and _Frame()))
    monkeypatch.setattr(q.causal, "value_function", lambda *a, **k: seen.setdefault("value", (a[2], k)) and _Frame())
    monkeypatch.setattr(q.ablation, "run_ablation", lambda *a, **k: (seen.setdefault("ablation", (a[1:], k)) and _Frame(), None))
    for name in ("_ope_rows", "_scored", "_choices", "_feature_table", "_table"):
        monkeypatch.setattr(q, name, lambda *_: None)
    monkeypatch.setattr(q, "_as_text", lambda df, totals=(): df)
    for name in ("ope_dr_forest", "value_function_oof", "ablation_overview"):
        queries()[name](None, SF)
    assert seen == {"ope": (q.CFG, {}), "value": (q.CFG, {}), "ablation": ((q.CFG,), {})}
    names = {r.name for r in q.policy.variant_runs(q.CFG)}
    assert {"alpha=0.05", "alpha=0.2", "conf_window=125", "lambda_recency=0.02", "lam_bandit=0.5"} <= names


class _Frame:
    """Stands for a query's result."""
