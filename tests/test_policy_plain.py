"""Whole policy runs against a plain version: one row and one number at a time, in the order that the rules state."""

import math
from dataclasses import replace

import numpy as np
import pytest

from quillon.plans import policy as P
from tests.test_policy import CFG, _all, _slice

SIGMA = {3: 0.02, 6: 0.03}


def _dot(a, b):
    return math.fsum(float(x) * float(y) for x, y in zip(a, b, strict=True))


class _Head:
    def __init__(self, cfg):
        rng = np.random.default_rng(23)
        self.w = {"low": [float(v) for v in rng.normal(0, 0.01, 10)], "high": [float(v) for v in rng.normal(0, 0.01, 10)]}
        self.w["low"][0] -= 0.001
        self.w["high"][0] += 0.001
        self.cfg = cfg

    def bounds(self, x):
        return sorted((_dot(self.w["low"], x), _dot(self.w["high"], x)))

    def learn(self, x, y):
        before = {side: _dot(self.w[side], x) for side in self.w}
        for side, tau in (("low", self.cfg.tau_low), ("high", self.cfg.tau_high)):
            slope = 1 - tau if y < before[side] else -tau
            self.w[side] = [min(1e3, max(-1e3, (1 - self.cfg.eta * self.cfg.lam_head) * w - self.cfg.eta * slope * v)) for w, v in zip(self.w[side], x, strict=True)]
        a, b = _dot(self.w["low"], x), _dot(self.w["high"], x)
        if a > b:
            middle = (a + b) / 2
            self.w["low"] = [w + 0.1 * (middle - before["low"]) * v for w, v in zip(self.w["low"], x, strict=True)]
            self.w["high"] = [w + 0.1 * (before["high"] - middle) * v for w, v in zip(self.w["high"], x, strict=True)]


def _widening(scores, cfg, alpha):
    if len(scores) < cfg.warmup:
        return 0.0
    weights = [math.exp(-cfg.lambda_recency * (len(scores) - i)) if cfg.lambda_recency > 0 else 1.0 for i in range(len(scores))]
    total, run = sum(weights), 0.0
    for score, weight in sorted(zip(scores, weights, strict=True), key=lambda p: p[0]):
        run += weight
        if run > (1 - alpha) * total * (1 + 1e-15):
            return score
    return max(scores)


def _plain(run, train, test, sigma):
    cfg = run.cfg
    arms = [(f"mom_w{w}", h) for w in cfg.windows for h in cfg.horizons]
    heads, scores = {a: _Head(cfg) for a in arms}, {h: [] for h in cfg.horizons}
    a_of, b_of = {a: cfg.lam_bandit * np.eye(10) for a in arms}, {a: np.zeros(10) for a in arms}

    def note(h, y, low, high):
        scores[h] = [*scores[h], max(low - y, y - high, 0.0)][-max(30, cfg.conf_window) :]

    rng = np.random.default_rng(cfg.seed)
    for row in train.to_dict("records"):
        arm = arms[int(rng.integers(0, len(arms)))]
        y, bound = row[f"y_h{arm[1]}"], cfg.bound_cap * sigma[arm[1]]
        if y is not None and math.isfinite(y):
            heads[arm].learn(row["x"], y)
            low, high = heads[arm].bounds(row["x"])
            note(arm[1], y, max(low, -bound), min(high, bound))

    log, waiting = [], []

    def mature(date):
        nonlocal waiting
        due = sorted((w for w in waiting if w["due"] == date), key=lambda w: (w["date"], w["id"]))
        waiting = [w for w in waiting if w["due"] != date]
        for w in due:
            y, arm = w["y"], (w["momentum"], w["h"])
            if y is None or not math.isfinite(y):
                continue
            covered, width = int(w["l"] <= y <= w["u"]), w["u"] - w["l"]
            loss = max(width, 0) + 2 / w["alpha"] * (max(w["l"] - y, 0) + max(y - w["u"], 0))
            heads[arm].learn(w["x"], y)
            note(w["h"], y, w["raw"][0], w["raw"][1])
            a_of[arm] = a_of[arm] + np.outer(w["x"], w["x"])
            b_of[arm] = b_of[arm] + (-loss + cfg.lambda_cov * (covered - 0.9 if covered else -0.1) - cfg.lambda_width * 0.1 * width) * np.asarray(w["x"])
            scale = {"none": 1, "per_h": 1 / w["h"], "per_sqrt_h": 1 / math.sqrt(w["h"]), "per_sigma": 1 / sigma[w["h"]]}[cfg.scale_mode]
            log.append({k: w[k] for k in ("date", "id", "momentum", "h", "alpha", "l", "u", "qhat", "buffer", "support")} | {"y": y, "covered": covered, "width": width, "loss": loss, "width_scaled": width * scale, "loss_scaled": loss * scale})

    dates = sorted(set(test["date"]))
    if run.kind != "bandit" and len(dates) > max(cfg.horizons):
        dates = dates[: -max(cfg.horizons)]
    for day, date in enumerate(dates):
        if run.kind != "bandit":
            mature(date)
        rows = test[test["date"] == date].to_dict("records")
        if run.kind == "bandit":
            theta = []
            for k, arm in enumerate(arms):
                a = (a_of[arm] + a_of[arm].T) / 2
                if np.linalg.cond(a) > 1e10:
                    a = a + 1e-6 * np.eye(10)
                z = np.random.Generator(np.random.Philox(key=[cfg.seed, day * len(arms) + k])).normal(size=10)
                theta.append(np.linalg.inv(a) @ b_of[arm] + math.sqrt(cfg.noise) * np.linalg.inv(np.linalg.cholesky(a).T) @ z)
        luck = P.luck(cfg.seed, day, [row["id"] for row in rows]) if run.kind == "random" else None
        for i, row in enumerate(rows):
            live = [a for a in arms if row[f"alive_h{a[1]}"]]
            if not live:
                continue
            if run.kind == "bandit":
                arm = max(live, key=lambda a: (round(_dot(theta[arms.index(a)], row["x"]), 12), -arms.index(a)))
            elif run.kind == "random":
                arm = live[min(int(luck[i] * len(live)), len(live) - 1)]
            else:
                arm = run.arm if run.arm in live else (run.arm[0], next(h for h in cfg.horizons if row[f"alive_h{h}"]))
            h, cold = arm[1], len(scores[arm[1]]) < cfg.warmup
            low, high = heads[arm].bounds(row["x"])
            if cold and run.kind == "bandit":
                middle, half = (low + high) / 2, min(max(high - low, cfg.min_width), cfg.max_width) / 2
                low, high = middle - half, middle + half
            elif cold:
                bound = cfg.bound_cap * sigma[h]
                low, high = min(max(low, -bound), bound), min(max(high, -bound), bound)
            alpha = cfg.alpha_for(h)
            q = _widening(scores[h], cfg, alpha)
            waiting.append({"date": date, "id": row["id"], "momentum": arm[0], "h": h, "alpha": alpha, "x": row["x"], "raw": (low, high), "l": low - q, "u": high + q, "qhat": q, "buffer": len(scores[h]), "support": len(live), "due": row[f"mat_date_h{h}"], "y": row[f"y_h{h}"]})
        if run.kind == "bandit":
            mature(date)
    if run.kind != "bandit":
        for date in sorted({w["due"] for w in waiting}):
            mature(date)
    return log


VARIANTS = {
    "plain": CFG,
    "recency": replace(CFG, lambda_recency=0.05, scale_mode="per_h"),
    "strict": CFG.with_alpha(0.2),
    "rewards": replace(CFG, lambda_cov=0.5, lambda_width=0.3, lam_bandit=0.5, scale_mode="per_sigma"),
}


POLICIES = [("bandit", None), ("random", None), ("fixed", ("mom_w10", 3)), ("fixed", ("mom_w21", 6))]
RUNS = {(v, k, arm): P.Run(f"{v} {k} {arm}", k, cfg, arm) for v, cfg in VARIANTS.items() for k, arm in POLICIES}


def _frame():
    frame = _slice(3, 5)
    frame.loc[frame.index % 17 == 0, "y_h6"] = float("nan")
    return frame


@pytest.fixture(scope="module")
def logs(spark):
    return _all(spark, _frame(), list(RUNS.values()), SIGMA, 40)


@pytest.mark.parametrize("variant", VARIANTS)
@pytest.mark.parametrize("kind,arm", POLICIES)
def test_every_column_of_a_run(logs, kind, arm, variant):
    run, frame = RUNS[variant, kind, arm], _frame()
    key = lambda r: (r["date"], r["id"])
    got = sorted(logs[run.name], key=key)
    want = sorted(_plain(run, frame.head(40), frame, SIGMA), key=key)
    assert len(got) == len(want) > 50
    for a, b in zip(got, want, strict=True):
        for column, value in b.items():
            assert a[column] == pytest.approx(value, rel=1e-8, abs=1e-10) if isinstance(value, float) else a[column] == value, column
