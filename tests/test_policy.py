import datetime
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.plans import policy as P

CFG = Config(windows=(10, 21), horizons=(3, 6), warmup=3, pretrain_rows=20, conf_window=30)
DAYS = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(30)]


def _slice(seed=0, ids=4):
    draw, rows = np.random.default_rng(seed), []
    y = draw.normal(0, 0.02, (len(DAYS), ids, 2))
    for i, d in enumerate(DAYS):
        for k in range(ids):
            row = {"date": d, "id": f"s{k}", "x": np.r_[1.0, np.random.default_rng(i * 9 + k).normal(size=9)]}
            for j, h in enumerate(CFG.horizons):
                row |= {f"y_h{h}": y[i, k, j], f"alive_h{h}": int(i + h < len(DAYS)), f"mat_date_h{h}": DAYS[i + h] if i + h < len(DAYS) else None}
            rows.append(row)
    return pd.DataFrame(rows)


def _all(spark, frame, runs, sigma=None, train=12):
    """The logs of runs over a slice, by name, each as rows of plain values."""
    rows = frame.assign(x=frame["x"].map(lambda x: [float(v) for v in x]))
    kinds = "".join(f", y_h{h} double, alive_h{h} int, mat_date_h{h} date" for h in CFG.horizons)
    names = ["date", "id", "x", *[f"{p}_h{h}" for h in CFG.horizons for p in ("y", "alive", "mat_date")]]
    table = spark.createDataFrame(list(rows[names].itertuples(index=False, name=None)), "date date, id string, x array<double>" + kinds).repartition(3)
    sample = [(np.asarray(r["x"], dtype=float), {h: r[f"y_h{h}"] for h in CFG.horizons}) for r in frame.head(train).to_dict("records")]
    out = {r.name: [] for r in runs}
    for r in P.run_slice(table, sample, runs, sigma or {3: 0.02, 6: 0.02}).collect():
        out[r["run"]].append(r.asDict())
    return out


RUNS = [P.Run("bandit", "bandit", CFG), P.Run("random", "random", CFG), P.Run("mom_w10 h6", "fixed", CFG, ("mom_w10", 6)), P.Run("mom_w21 h3", "fixed", CFG, ("mom_w21", 3))]


@pytest.fixture(scope="module")
def logs(spark):
    return _all(spark, _slice(), RUNS)


def test_runs_respect_what_is_alive(logs):
    for a in logs.values():
        assert a and all(r["l"] <= r["u"] and r["date"] < DAYS[-r["h"]] for r in a)
        assert all(r["qhat"] == 0 for r in a if r["buffer"] < CFG.warmup)
        assert len({(r["date"], r["id"]) for r in a}) == len(a)
    fixed = logs["mom_w10 h6"]
    assert {r["momentum"] for r in fixed} == {"mom_w10"} and 6 in {r["h"] for r in fixed}


def test_outcomes_change_nothing_before_they_mature(spark, logs):
    moved = _slice()
    for h in CFG.horizons:
        moved.loc[moved["date"] >= DAYS[15], f"y_h{h}"] = 9.0
    early = lambda log: sorted((r["date"], r["id"], r["momentum"], r["h"], r["l"], r["u"]) for r in log if r["date"] <= DAYS[15])
    changed = _all(spark, moved, RUNS)
    assert all(early(log) == early(changed[name]) for name, log in logs.items())


def test_a_run_is_several_tasks_and_needs_one_row_per_id_and_date(spark):
    from quillon.sources import intermediate

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _all(spark, _slice(5, 12), RUNS[:1])
        written = [p for p in intermediate._written[spark.sparkContext.applicationId] if "/slice-" in p][-1]
        assert spark.read.parquet(written).where("date = date'2020-01-05'").select(F.input_file_name()).distinct().count() >= 1
        assert spark.read.parquet(written).select(F.input_file_name()).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    twice = _slice()
    twice.loc[twice["date"] == DAYS[4], "mat_date_h3"] = DAYS[4]
    with pytest.raises(Exception, match="several rows on a date"):
        _all(spark, twice, RUNS[3:])


def test_an_empty_slice_gives_an_empty_log(spark):
    assert _all(spark, _slice().head(0), RUNS, train=0) == {r.name: [] for r in RUNS}


def test_arm_survives_bad_matrices():
    rng = np.random.default_rng(1)
    arm = P.ThompsonArm(1.0, 0.01)
    arm.precision = np.diag([1e12] + [1e-3] * 9)
    assert np.isfinite(arm.draw(rng)).all()
    arm.precision = -np.eye(10)
    assert np.isfinite(arm.draw(rng)).all() and np.linalg.eigvalsh(arm.precision).min() > 0
    arm.precision = np.full((10, 10), np.nan)
    assert np.isfinite(arm.draw(rng)).all()


def test_arm_is_checked_every_so_many_updates():
    arm = P.ThompsonArm(1.0, 0.01)
    arm.precision = np.diag([1.0] * 9 + [-0.5])
    arm.updates = P.CHECK_EVERY
    arm.draw(np.random.default_rng(1))
    # The check lifts what is indefinite; between checks the stronger ridge is tried first.
    assert np.linalg.eigvalsh(arm.precision).min() >= P.LEAST_EIGENVALUE * 0.99
    slightly = P.ThompsonArm(1.0, 0.01)
    slightly.precision = np.diag([1.0] * 9 + [-1e-6])
    slightly.draw(np.random.default_rng(1))
    assert np.allclose(np.diag(slightly.precision)[:9], 1 + P.STRONG_RIDGE, atol=2e-6)


def test_head_and_calibrator():
    head = P.QuantileHead(CFG)
    x = np.ones(10)
    for y in np.linspace(-1, 1, 400):
        head.update(x, y)
        low, high = head.predict(x)
        assert low <= high
    cal = P.Calibrator(5, 3)
    for i in range(40):
        assert cal.widening(0.1) == (0.0 if i < 3 else P.weighted_quantile(np.array(cal.scores), np.ones(len(cal.scores)), 0.9))
        cal.update(float(i), 0.0, 1.0)
    assert len(cal.scores) == 30
    recent = P.Calibrator(5, 3, 1.0)
    recent.scores = [9.0, 0.1, 0.1, 0.1]
    assert recent.widening(0.1) == 0.1


def test_runs_side_by_side(spark):
    frame = _slice()
    frame["x"] = frame["x"].map(lambda x: [float(v) for v in x])
    train = frame.assign(date=[d - datetime.timedelta(60) for d in frame["date"]]).drop(columns=[c for c in frame if c.startswith(("alive", "mat"))])
    cfg = replace(CFG, train_end="2019-12-31", test_start="2020-01-01")
    rows = pd.concat([train, frame.drop(columns=[c for c in frame if c.startswith(("alive", "mat"))])])
    features = spark.createDataFrame(rows)
    log = P.run_policies(features, [P.Run("crl", "bandit", cfg), *P.baseline_runs(cfg)], cfg).toPandas()
    assert set(log["run"]) == {"crl", "random", *(f"fixed_mom_w{w}_h{h}" for w in cfg.windows for h in cfg.horizons)}
    again = P.run_policies(features.repartition(7), [P.Run("crl", "bandit", cfg)], cfg).toPandas()
    key = ["date", "id"]
    assert log[log["run"] == "crl"].sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_heads_move_as_row_by_row():
    rng = np.random.default_rng(4)
    for cap, scale in ((1e3, 1.0), (0.05, 1.0), (1e3, 300.0)):
        one, many = P.QuantileHead(CFG, cap=cap), P.QuantileHead(CFG, cap=cap)
        x, y = rng.normal(size=(500, 10)) * scale, rng.normal(size=500)
        for a, b in zip(x, y, strict=True):
            one.update(a, b)
        for a in range(0, 500, 130):
            P.move_head(many, x[a : a + 130], y[a : a + 130])
        assert np.allclose(one.low, many.low, rtol=1e-7, atol=1e-12) and np.allclose(one.high, many.high, rtol=1e-7, atol=1e-12)


def test_nothing_is_learned_after_the_last_decision(spark):
    # Runs that learn first decide on 24 of 30 dates, in 8 blocks of 3: 7 of them have something to learn.
    from quillon.sources import intermediate

    written = lambda: sum("/matured-" in p for p in intermediate._written[spark.sparkContext.applicationId])
    _all(spark, _slice().head(0), RUNS[2:3], train=0)
    before = written()
    _all(spark, _slice(), RUNS[2:3])
    assert written() - before == 7
