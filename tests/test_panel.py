import datetime

import pytest
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.operators import aggregates as A
from quillon.operators import splits, windows
from quillon.plans import stats
from quillon.schema import enforce_schema, normalize_quotes
from quillon.sources.panel import panel_from_raw, quotes_to_panel

DAY = datetime.date(2020, 1, 6)


def _panel(spark, lengths):
    rows = [(DAY + datetime.timedelta(7 * i), f"s{k}", 0.01 * ((i * 7 + k * 3) % 5 - 2), 1.0 + k) for k, n in enumerate(lengths) for i in range(n)]
    return spark.createDataFrame(rows, "date date, id string, ret double, index_weight double")


def test_short_series_meet_their_gates(spark):
    p = _panel(spark, [3, 5, 12, 40])
    f = p.select("id", "date", windows.momentum(F.col("ret"), 10).alias("m"), windows.forward_return(F.col("ret"), 10).alias("y"), windows.autocorrelation(F.col("ret")).alias("a"), windows.rolling_std(F.col("ret"), 20, 5).alias("v")).toPandas().sort_values(["id", "date"])
    for i, n in enumerate([3, 5, 12, 40]):
        g = f[f["id"] == f"s{i}"]
        assert g["m"].notna().sum() == max(0, n - 5) and g["y"].notna().sum() == max(0, n - 10)
        assert (g["v"].iloc[:4] == 0).all() and (g["a"].iloc[:9] == 0).all()


def test_future_returns_do_not_reach_features(spark):
    p = _panel(spark, [60, 60])
    cut = DAY + datetime.timedelta(7 * 40)
    moved = p.withColumn("ret", F.when(F.col("date") >= F.lit(cut), F.col("ret") * 3 + 1).otherwise(F.col("ret")))
    take = lambda d: sorted(map(tuple, d.select("id", "date", windows.momentum(F.col("ret"), 21).alias("m")).where(F.col("date") <= F.lit(cut)).collect()))
    assert take(p) == take(moved)


def test_ranks_with_ties_and_small_sections(spark):
    rows = [("a", v) for v in (1.0, 1.0, 2.0, 3.0, 3.0, 3.0, 4.0, 5.0, 6.0, None, 7.0)] + [("b", float(v)) for v in range(9)]
    df = spark.createDataFrame(rows, "date string, x double").withColumn("p", windows.percentile_rank(F.col("x")))
    got = {(r.date, r.x): r.p for r in df.collect()}
    assert got[("a", 1.0)] == 0.15 and got[("a", 3.0)] == 0.5 and got[("a", None)] == 0.5 and got[("a", 7.0)] == 1.0
    assert all(v == 0.5 for (d, _), v in got.items() if d == "b")


def test_schema_and_quotes(spark):
    with pytest.raises(ValueError, match="index_weight"):
        enforce_schema(spark.createDataFrame([(DAY, "a", 0.1)], "date date, id string, ret double"))
    full = enforce_schema(spark.createDataFrame([(DAY, "a", float("nan"), 1.0)], "date date, debenture_id string, return double, index_weight double")).first()
    assert (full.id, full.ret, full.active, full.sector_id) == ("a", None, 1, -1)
    raw = spark.createDataFrame([("2020-01-06", "x", "50%", "1%", None), ("2020-01-07", "x", "0", "1%", "bank"), ("bad", "y", "1%", "1%", None), ("2020-01-06", None, "1%", "1%", None)], "`Data` string, `Ticker` string, `Peso no índice (%)` string, `MTM ponderado (%)` string, `Setor` string")
    quotes = normalize_quotes(raw)
    assert quotes.count() == 2
    panel = quotes_to_panel(quotes, min_obs=1).orderBy("date").collect()
    assert [round(r.ret, 6) for r in panel] == [0.02, 0.0] and [r.active for r in panel] == [1, 0] and [r.sector_id for r in panel] == [-1, 0]
    with pytest.raises(ValueError):
        normalize_quotes(raw.drop("Ticker"))


def test_folds(spark):
    assert [b - a + 1 for a, b in splits.fold_bounds(10, 3)] == [4, 3, 3]
    for bad in ((2, 3), (10, 1)):
        with pytest.raises(ValueError):
            splits.fold_bounds(*bad)
    p = _panel(spark, [30])
    for k, purge, embargo in ((3, 0, 0), (3, 4, 2), (5, 30, 30)):
        rows = splits.purged_folds(p, k, purge, embargo).join(windows.date_positions(p), "date").collect()
        tests = [r.position for r in rows if r.role == "test"]
        assert len(tests) == len(set(tests))
        for f in {r.fold for r in rows}:
            own = [r.position for r in rows if r.fold == f and r.role == "test"]
            train = [r.position for r in rows if r.fold == f and r.role == "train"]
            assert train and all(t < min(own) - purge or t > max(own) + embargo for t in train)


def test_series_inference(spark):
    import numpy as np

    v = np.sin(np.arange(50.0)) + np.arange(50) * 0.01
    rows = [(DAY + datetime.timedelta(i), float(x), "a") for i, x in enumerate(v)] + [(DAY, 1.0, "b")]
    df = spark.createDataFrame(rows, "date date, v double, g string")
    got = {r.g: r for r in stats.newey_west(df, ["g"]).collect()}
    e, n, lags = v - v.mean(), len(v), max(1, int(4 * (len(v) / 100) ** (2 / 9)))
    variance = (e @ e + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n / n
    assert got["a"].nw_se == pytest.approx(variance**0.5) and got["b"].nw_se is None
    boot = {r.g: r for r in stats.block_bootstrap(df, ["g"], 5, 100).collect()}
    means = []
    for b in range(100):
        idx = [(b * 1103515245 + j * 12345 * 7919 + 123) % n for j in range(10)]
        means.append(np.mean([v[(s + i) % n] for s in idx for i in range(5)][:n]))
    assert boot["a"].ci_lo == pytest.approx(np.quantile(means, 0.025)) and boot["a"].ci_hi == pytest.approx(np.quantile(means, 0.975)) and boot["b"].mean == 1.0
    with pytest.raises(ValueError):
        base = spark.createDataFrame([(DAY, 1, 1.0)], "date date, h int, loss_scaled double")
        stats.paired_differences(base, base.withColumn("h", F.lit(2)))


def test_mode_takes_the_lowest_id_of_a_tie(spark):
    acts = spark.createDataFrame([("d", "2", "m1", 5), ("d", "1", "m2", 9), ("d", "3", "m1", 9), ("d", "0", "m2", 5)], "date string, id string, momentum string, h int")
    assert tuple(A.policy_mode(acts).select("momentum", "h").first()) == ("m2", 5)


def test_weights_and_defaults(spark):
    p = _panel(spark, [2])
    s = spark.createDataFrame([(DAY, "s0", 1.0), (DAY, "zz", 1.0)], "date date, id string, y double")
    for default in (0.0, 1.0):
        assert {r.id: r.index_weight for r in A.with_weights(s, p, default).collect()} == {"s0": 1.0, "zz": default}
    assert Config().alpha_for(10) == 0.1


def test_index_return_comes_from_index_values(spark):
    rows = [(f"2020-01-0{i + 1}", name, "10%", "0,1%", 100.0 + i + (5 if name == "b" else 0), 50.0) for i in range(4) for name in ("b", "a")]
    raw = spark.createDataFrame(rows, "`Data` string, `Debênture` string, `Peso no índice (%)` string, `MTM ponderado (%)` string, `Índice (nível)` double, `Índice` double")
    got = [r.index_return for r in panel_from_raw(raw, min_obs=1).where("id = 'a'").orderBy("date").collect()]
    assert [round(x, 6) for x in got] == [0.0, round(1 / 100, 6), round(1 / 101, 6), round(1 / 102, 6)]
    plain = panel_from_raw(raw.drop("Índice (nível)"), min_obs=1)
    assert {round(r.index_return, 9) for r in plain.collect()} == {0.01}


def test_plain_returns_stand_in_for_mtm(spark):
    raw = spark.createDataFrame([("2020-01-01", "a", 0.5, 0.02), ("2020-01-02", "a", 0.0, -0.01), ("2020-01-03", "a", 0.5, None)], "`Data` string, `Debênture` string, `Peso no índice (%)` double, `return` double")
    assert [r.ret for r in panel_from_raw(raw, min_obs=1).orderBy("date").collect()] == [0.02, -0.01, 0.0]
