"""Folds by horizon, what is left over by them, and the value function by date, against plain Python."""

import datetime
import json
import math
from dataclasses import asdict

from quillon.config import Config
from quillon.operators.splits import fold_bounds, fold_roles
from quillon.plans import causal, ope
from quillon.plans.causal import CONTEXT, value_function

DAY = datetime.date(2020, 1, 6)


def _dates(n):
    return [DAY + datetime.timedelta(7 * i) for i in range(n)]


def _plain_roles(sizes, steps, k, least, partly):
    """`sizes`: rows by group and date."""
    out = set()
    for i, (g, (purge, embargo)) in enumerate(steps.items()):
        dates = sorted(sizes.get(g, {}))
        tested = set()
        for f, (low, high) in enumerate(fold_bounds(len(dates), k) if len(dates) >= k else []):
            train = [d for p, d in enumerate(dates) if p < low - purge or p > high + embargo]
            if train and sum(sizes[g][d] for d in train) >= least:
                tested.update(dates[low : high + 1])
                out |= {(g, d, f, i * (k + 1) + f, "train") for d in train} | {(g, d, f, i * (k + 1) + f, "test") for d in dates[low : high + 1]}
        left = [d for d in dates if d not in tested] if partly or not tested else []
        out |= {(g, d, None, i * (k + 1) + k, "test") for d in left} | {(g, d, None, i * (k + 1) + k, "train") for d in dates if left}
    return out


def test_fold_roles(spark):
    # Groups of many dates, of few, of fewer than folds, of none, and one that is not asked for.
    sizes = {5: dict(zip(_dates(30), [1 + i % 4 for i in range(30)], strict=True)), 7: dict.fromkeys(_dates(7), 2), 9: dict.fromkeys(_dates(2), 3), 8: dict.fromkeys(_dates(4), 1)}
    rows = spark.createDataFrame([(g, d) for g, of in sizes.items() for d, n in of.items() for _ in range(n)], "h int, date date")
    wanted = {g: v for g, v in sizes.items() if g != 8}
    for steps in ({5: (2, 3), 7: (1, 1), 9: (0, 0), 11: (1, 1)}, {5: (12, 0), 7: (9, 9), 9: (0, 0)}):
        for least in (1, 40, 10_000):
            for partly in (False, True):
                found = [tuple(r) for r in fold_roles(rows, "h", steps, 3, least, partly).select("h", "date", "fold", "model", "role").collect()]
                assert len(found) == len(set(found)) and set(found) == _plain_roles(wanted, steps, 3, least, partly)
    assert fold_roles(rows.where("false"), "h", {5: (1, 1)}, 3).count() == 0


def test_steps_of_settings():
    assert [Config().fold_steps(h) for h in (2, 63)] == [(4, 4)] * 2
    purged = Config.from_mapping({"crl": {"max_purge_steps": 21, "n_splits_value": 4}})
    assert [purged.fold_steps(h) for h in (10, 63)] == [(21, 21), (63, 63)]
    assert (purged.purge, purged.folds, purged.value_least, purged.ope_least) == (21, 4, 100, 200)
    assert Config(purge=None, embargo=None).fold_steps(10) == (10, 10) and Config(embargo=None).fold_steps(10) == (4, 4)
    assert Config.from_mapping({"max_purge_steps": 5, "value_least": 7, "embargo": 9}).fold_steps(6) == (6, 9)
    for cfg in (Config(), purged, Config(purge=None, embargo=None)):
        assert Config.from_mapping(json.loads(json.dumps(asdict(cfg)))) == cfg


def _labelled(spark, n=40, ids=9):
    """Features on n dates, labels of horizon 2 on all of them, of 5 on fewer, of 8 on three."""
    rows = []
    for i, d in enumerate(_dates(n)):
        for k in range(ids):
            x = [math.sin(i * 1.3 + k * (j + 1)) for j in range(len(CONTEXT) - 1)]
            rows.append((d, f"s{k}", float(k), *x, (1.0 + k) / 45, *[h * (0.2 * x[0] + 0.01 * ((i * 7 + k) % 5)) if i < m else None for h, m in ((2, n), (5, 30), (8, 3))]))
    named = ", ".join(f"{c} double" for c in CONTEXT)
    return spark.createDataFrame(rows, f"date date, id string, mom_w3_z double, {named}, y_h2 double, y_h5 double, y_h8 double")


def test_values_are_means_of_dates(spark, monkeypatch):
    features = _labelled(spark)
    choices = features.selectExpr("date", "'mom_w3' as momentum", "2 as h").distinct()
    cfg = Config(windows=(3,), horizons=(2, 5, 8), folds=3, purge=1, embargo=1, purge_horizon=True, value_least=20, top_fraction=0.5)
    kept = []
    real = causal.crossfit
    monkeypatch.setattr(causal, "crossfit", lambda *a, **k: kept.append(real(*a, **k)) or kept[-1])
    for pointwise in (True, False):
        kept.clear()
        told = {r.h: r for r in value_function(features, choices, cfg, pointwise, trees=3).collect()}
        rows, want = kept[0].collect(), {}
        for h in {r.h for r in rows}:
            by_date = {}
            for r in rows:
                if r.h == h and r.oof is not None:
                    by_date.setdefault(r.date, []).append(r)
            pairs = [tuple(sum(x.weight * x[c] for x in of) / sum(x.weight for x in of) for c in ("label", "oof")) for of in by_date.values()]
            y, p = (math.fsum(v) / len(pairs) for v in zip(*pairs, strict=True))
            # A forest of three dates is one leaf: its predictions differ by rounding only, and their correlation is not compared.
            cov, vy, vp = (math.fsum((a - y) ** s * (b - p) ** t for a, b in pairs) for s, t in ((1, 1), (2, 0), (0, 2)))
            want[h] = (y, p, cov / math.sqrt(vy * vp) if vy * vp else None, len(pairs), sum(map(len, by_date.values())))
        assert told.keys() == want.keys() == {2, 5, 8}
        for h, (y, p, corr, dates, n) in want.items():
            r = told[h]
            assert math.isclose(r.mean_y, y, abs_tol=1e-9) and math.isclose(r.mean_oof, p, abs_tol=1e-9) and (r.n_dates, r.n) == (dates, n)
            assert h == 8 or math.isclose(r.corr, corr, abs_tol=1e-6)
        assert {h: (r.n_dates, r.folds, r.fallback) for h, r in told.items()} == ({2: (40, 3, False), 5: (30, 3, False), 8: (3, 0, True)} if pointwise else {2: (40, 3, False), 5: (30, 0, True), 8: (3, 0, True)})


def test_rows_without_fold_have_a_forest_of_all(spark):
    features = _labelled(spark, 24, 6)
    rows = features.selectExpr("date", "id", "'mom_w3' as mom_b", "if(cast(substr(id, 2) as int) % 2 = 0, 2, 5) as h_b", "'mom_w3' as mom_e", "2 as h_e", "y_h2 as y", "2 as support")
    cfg = Config(windows=(3,), horizons=(2, 5), ope_folds=3, purge=8, embargo=8)
    for least, fitted in ((1, {0, 2}), (10_000, set())):
        scored, total = ope.evaluate_forest(rows, features, Config(**{**asdict(cfg), "ope_least": least}), trees=3)
        got = scored.collect()
        assert len(got) == 24 * 6 and all(None not in (r.q_b, r.q_e, r.DR_hat) for r in got)
        assert {r.fold for r in got} == fitted | {None}
        assert total.where("h_e is null").first().n == 24 * 6
