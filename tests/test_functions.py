import math

import pytest
from pyspark.sql import functions as F

from quillon.config import Config, lookup, merge
from quillon.functions import quantiles as Q
from quillon.functions import scalars as S
from quillon.plans import policy, stats


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_percent_text(spark):
    rows = spark.createDataFrame([("1,25%", 0.0125), ("0.5", 0.005), ("1.234,5", None), ("", None), (None, None), ("NaN", None)], "t string, want double")
    assert all(r.got == r.want for r in rows.select(S.parse_percent(F.col("t")).alias("got"), "want").collect())


def test_scales(spark):
    h = F.col("h")
    for mode, want in (("none", 1.0), ("per_h", 0.25), ("per_sqrt_h", 0.5)):
        assert _one(spark, S.horizon_factor(h, mode), h=4) == want
    assert _one(spark, S.horizon_factor(h, "per_h"), h=0) == 1.0
    assert _one(spark, S.horizon_factor(h, "per_sigma", {4: 0.5}), h=4) == 2.0
    for bad in (("per_sigma", None), ("cubic", None)):
        with pytest.raises(ValueError):
            S.horizon_factor(h, *bad)


def test_interval_arithmetic(spark):
    df = spark.createDataFrame([(5.0, 1.0, 3.0), (2.0, 1.0, 3.0), (0.0, 1.0, 3.0)], "y double, l double, u double")
    y, low, high = (F.col(c) for c in "ylu")
    rows = df.select(S.interval_score(y, low, high, 0.1).alias("s"), S.covered(y, low, high).alias("c"), S.nonconformity(y, low, high)[2].alias("n")).collect()
    assert [tuple(round(v, 9) for v in r) for r in rows] == [(42.0, 0, 2.0), (2.0, 1, 0.0), (22.0, 0, 1.0)]
    a, b = S.clamp_width(F.lit(0.3), F.lit(0.1), 0.002, 0.05)
    assert abs(_one(spark, b - a, x=1) - 0.05) < 1e-12
    for how, want in (("swap", (1.0, 2.0)), ("collapse", (1.5, 1.5)), ("gap", (1.5 - 1e-6, 1.5 + 1e-6))):
        got = [_one(spark, c, x=1) for c in S.uncross(F.lit(2.0), F.lit(1.0), how)]
        assert got == pytest.approx(want)


def test_names(spark):
    m, h = S.fixed_arm(F.col("n"))
    assert (_one(spark, m, n="fixed_mom_w21_h42"), _one(spark, h, n="fixed_mom_w21_h42")) == ("mom_w21", 42)
    assert _one(spark, S.window_number(F.col("n")), n="mom_w63") == 63 and S.nearest_windows([10, 21, 42, 63]) == [10, 21, 42]
    assert _one(spark, S.one_hot(F.lit(1), 3), n="x") == [0.0, 1.0, 0.0]


def test_config_lookup():
    c = {"a": None, "b": {"c": 3}, "crl": {"alpha": 0.2}}
    assert (lookup(c, "a", 5), lookup(c, "b.c"), lookup(c, ("zz", "alpha")), lookup(Config(), "alpha")) == (5, 3, 0.2, 0.1)
    cfg = Config.from_mapping({"momentum_windows": [5, 10], "alpha_21": 0.05, "crl": {"alpha": 0.2}, "unknown": 1})
    assert (cfg.windows, cfg.alpha_for(21), cfg.alpha_for(5), cfg.with_alpha(0.3).alpha_for(21)) == ((5, 10), 0.05, 0.2, 0.3)
    assert merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_quantiles(spark):
    arr = F.array(*[F.lit(float(v)) for v in (5, 1, 4, 2, 3)])
    assert [_one(spark, Q.finite_sample_quantile(arr, q), x=1) for q in (0.0, 0.5, 0.9, 1.0)] == [1.0, 3.0, 5.0, 5.0]
    assert _one(spark, Q.finite_sample_quantile(F.array().cast("array<double>"), 0.9), x=1) == 0.0
    rows = [(1, v, w) for v, w in ((1.0, 1.0), (2.0, 1.0), (3.0, 2.0))] + [(2, 7.0, 0.0), (2, 9.0, -1.0)]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.g: r.q for r in Q.weighted_quantile(df, ["g"], "v", "w", q).collect()}
        import numpy as np

        assert got == {1: policy.weighted_quantile(np.array([1.0, 2, 3]), np.array([1.0, 1, 2]), q), 2: 9.0}


def test_tails():
    from math import comb

    for n in (5, 30):
        for p in (0.1, 0.5, 0.9):
            mass = [comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
            for k in range(n + 1):
                assert abs(stats._binomial_tail(k, n, p) - sum(m for m in mass if m <= mass[k] * (1 + 1e-7))) < 1e-12
    assert abs(stats._t_tail(2.0, 10) - 0.07338803477074) < 1e-12 and stats._t_tail(0.0, 4) == pytest.approx(1.0)
    assert math.isnan(stats._t_tail(float("nan"), 3))


def test_ranks_by_counts(spark):
    import random

    from quillon.functions.quantiles import kth_smallest

    draw = random.Random(4)
    rows = [(draw.choice([0.0, 0.0, draw.random(), draw.random() * 1e6]), -draw.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double")
    for k in (1, 2, 900, 1700, 2999, 3000):
        for bins, few in ((7, 5), (1024, 10_000)):
            got = kth_smallest(df, {"a": k, "b": 3001 - k}, bins, few)
            assert got == {"a": sorted(r[0] for r in rows)[k - 1], "b": sorted(r[1] for r in rows)[3000 - k]}
    assert kth_smallest(spark.createDataFrame([(1.5,)] * 9, "a double"), {"a": 4}) == {"a": 1.5}
