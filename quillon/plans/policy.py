"""Policies that choose an arm (momentum, horizon) per security and date, and learn when outcomes mature.

Time goes in blocks of dates, as many as the shortest horizon has rows. What matures in a block was decided
before it, so at its start everything that its dates learn is known, and a block is a few Spark jobs over
all runs (policies, variants) at once:

* Outcomes that mature in the block are summed per run, arm and date: outer products and moments of the
  posteriors are additive, so Spark adds them up in parts. Quantile heads move row by row, which is one
  stream per horizon, whose rows all runs share; calibrators take each date's last scores from it.
* The driver holds each run's parameters, none of which grows with the rows, steps them from date to date
  and draws a posterior's parameters once per arm and date, from a stream keyed by (seed, date, arm).
* The block's rows, however many tasks they lie in, are decided with the parameters of their date and
  written under the block in which they mature: a row per horizon that any run chose, with its inputs once
  and each such run's arm and bounds. What else a log says follows from run, date and horizon.

Outcomes apply in order of maturity, decision date and id; nothing that decides reads one.
"""

from __future__ import annotations

import copy
import hashlib
import math
import pickle
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.operators.splits import sample_rows
from quillon.plans.features import split_dates, test_slice
from quillon.sources.intermediate import cut, fresh_path

DIM = 10
# How heads start, how far weights may go, how crossed bounds are drawn together.
HEAD_SEED, HEAD_SPREAD, HEAD_OFFSET, HEAD_CAP, DRAW_TOGETHER = 23, 0.01, 0.001, 1e3, 0.1
# When a posterior is checked, when it is too ill-conditioned, and what mends it.
CHECK_EVERY, MOST_CONDITION, RIDGE, STRONG_RIDGE, LEAST_EIGENVALUE = 1000, 1e10, 1e-6, 1e-5, 1e-6
#: Half the width given to an interval whose adjusted bounds cross.
HALF_CROSSED = 1e-6


class QuantileHead:
    """A linear lower and upper quantile, moved by pinball gradients."""

    def __init__(self, cfg: Config, dim: int = DIM, cap: float = HEAD_CAP):
        draw = np.random.default_rng(HEAD_SEED)
        self.low, self.high = draw.normal(0, HEAD_SPREAD, dim), draw.normal(0, HEAD_SPREAD, dim)
        self.low[0] -= HEAD_OFFSET
        self.high[0] += HEAD_OFFSET
        self.cfg, self.cap = cfg, cap

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds in order, for one row or many."""
        a, b = x @ self.low, x @ self.high
        return np.minimum(a, b), np.maximum(a, b)

    def update(self, x: np.ndarray, y: float) -> None:
        c, was = self.cfg, (float(self.low @ x), float(self.high @ x))
        shrink = 1 - c.eta * c.lam_head
        self.low = np.clip(shrink * self.low - c.eta * ((1 - c.tau_low) if y < was[0] else -c.tau_low) * x, -self.cap, self.cap)
        self.high = np.clip(shrink * self.high - c.eta * ((1 - c.tau_high) if y < was[1] else -c.tau_high) * x, -self.cap, self.cap)
        a, b = float(self.low @ x), float(self.high @ x)
        if a > b:
            middle = (a + b) / 2
            self.low = self.low + DRAW_TOGETHER * (middle - was[0]) * x
            self.high = self.high + DRAW_TOGETHER * (was[1] - middle) * x


def move_head(head: QuantileHead, x: np.ndarray, y: np.ndarray) -> None:
    """`head.update` over rows in order, on plain numbers: a row costs a few microseconds, as no array is made for it.

    Weights are clipped only once they may have reached the cap, which no step does that stays below it in sum.
    """
    if not len(x):
        return
    c, cap = head.cfg, head.cap
    shrink, under_low, over_low = 1 - c.eta * c.lam_head, c.eta * (1 - c.tau_low), -c.eta * c.tau_low
    under_high, over_high = c.eta * (1 - c.tau_high), -c.eta * c.tau_high
    l0, l1, l2, l3, l4, l5, l6, l7, l8, l9 = head.low.tolist()
    u0, u1, u2, u3, u4, u5, u6, u7, u8, u9 = head.high.tolist()
    largest = lambda: max(map(abs, (l0, l1, l2, l3, l4, l5, l6, l7, l8, l9, u0, u1, u2, u3, u4, u5, u6, u7, u8, u9)))
    clip = lambda v: min(max(v, -cap), cap)
    reach = largest()
    for (x0, x1, x2, x3, x4, x5, x6, x7, x8, x9), far, target in zip(x.tolist(), np.abs(x).max(axis=1).tolist(), y.tolist(), strict=True):
        was_low = l0 * x0 + l1 * x1 + l2 * x2 + l3 * x3 + l4 * x4 + l5 * x5 + l6 * x6 + l7 * x7 + l8 * x8 + l9 * x9
        was_high = u0 * x0 + u1 * x1 + u2 * x2 + u3 * x3 + u4 * x4 + u5 * x5 + u6 * x6 + u7 * x7 + u8 * x8 + u9 * x9
        d, e = under_low if target < was_low else over_low, under_high if target < was_high else over_high
        l0, l1, l2, l3, l4 = shrink * l0 - d * x0, shrink * l1 - d * x1, shrink * l2 - d * x2, shrink * l3 - d * x3, shrink * l4 - d * x4
        l5, l6, l7, l8, l9 = shrink * l5 - d * x5, shrink * l6 - d * x6, shrink * l7 - d * x7, shrink * l8 - d * x8, shrink * l9 - d * x9
        u0, u1, u2, u3, u4 = shrink * u0 - e * x0, shrink * u1 - e * x1, shrink * u2 - e * x2, shrink * u3 - e * x3, shrink * u4 - e * x4
        u5, u6, u7, u8, u9 = shrink * u5 - e * x5, shrink * u6 - e * x6, shrink * u7 - e * x7, shrink * u8 - e * x8, shrink * u9 - e * x9
        reach += far * c.eta
        if not reach < cap:
            l0, l1, l2, l3, l4, l5, l6, l7, l8, l9 = map(clip, (l0, l1, l2, l3, l4, l5, l6, l7, l8, l9))
            u0, u1, u2, u3, u4, u5, u6, u7, u8, u9 = map(clip, (u0, u1, u2, u3, u4, u5, u6, u7, u8, u9))
            reach = largest()
        a = l0 * x0 + l1 * x1 + l2 * x2 + l3 * x3 + l4 * x4 + l5 * x5 + l6 * x6 + l7 * x7 + l8 * x8 + l9 * x9
        b = u0 * x0 + u1 * x1 + u2 * x2 + u3 * x3 + u4 * x4 + u5 * x5 + u6 * x6 + u7 * x7 + u8 * x8 + u9 * x9
        if a > b:
            d, e = DRAW_TOGETHER * ((a + b) / 2 - was_low), DRAW_TOGETHER * (was_high - (a + b) / 2)
            l0, l1, l2, l3, l4 = l0 + d * x0, l1 + d * x1, l2 + d * x2, l3 + d * x3, l4 + d * x4
            l5, l6, l7, l8, l9 = l5 + d * x5, l6 + d * x6, l7 + d * x7, l8 + d * x8, l9 + d * x9
            u0, u1, u2, u3, u4 = u0 + e * x0, u1 + e * x1, u2 + e * x2, u3 + e * x3, u4 + e * x4
            u5, u6, u7, u8, u9 = u5 + e * x5, u6 + e * x6, u7 + e * x7, u8 + e * x8, u9 + e * x9
            reach += far * max(abs(d), abs(e))
    head.low, head.high = np.array([l0, l1, l2, l3, l4, l5, l6, l7, l8, l9]), np.array([u0, u1, u2, u3, u4, u5, u6, u7, u8, u9])


class Calibrator:
    """The last scores of a horizon, and how far they say that an interval must be widened."""

    def __init__(self, window: int, warmup: int, rate: float = 0.0):
        self.size, self.warmup, self.rate, self.scores = max(30, window), warmup, rate, []

    def update(self, y: float, low: float, high: float) -> None:
        self.scores.append(max(low - y, y - high, 0.0))
        del self.scores[: -self.size]

    def widening(self, alpha: float) -> float:
        """The weighted quantile of the scores at 1 - alpha; 0 until there are enough."""
        n = len(self.scores)
        if n < self.warmup:
            return 0.0
        v = np.asarray(self.scores)
        w = np.exp(-self.rate * np.arange(n, 0, -1)) if self.rate > 0 else np.ones(n)
        return weighted_quantile(v, w, 1 - alpha)


def weighted_quantile(v: np.ndarray, w: np.ndarray, q: float) -> float:
    """The first value in ascending order at which the weight up to it exceeds q of all; without weight the last."""
    order = np.argsort(v, kind="stable")
    total = np.cumsum(np.clip(w[order], 0, None))
    if total[-1] <= 0:
        return float(v[order][-1])
    return float(v[order][min(int(np.searchsorted(total, q * total[-1], side="right")), len(v) - 1)])


def _root(a: np.ndarray) -> np.ndarray | None:
    """The lower Cholesky factor; None for what is not positive definite."""
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return None


def _lifted(a: np.ndarray) -> np.ndarray:
    """The nearest symmetric matrix without eigenvalues below the least one."""
    values, vectors = np.linalg.eigh(a)
    out = (vectors * np.maximum(values, LEAST_EIGENVALUE)) @ vectors.T
    return (out + out.T) / 2


class ThompsonArm:
    """A linear posterior: precision and moment sums, both additive over outcomes."""

    def __init__(self, lam: float, noise: float, dim: int = DIM):
        self.precision, self.moment, self.noise, self.updates = lam * np.eye(dim), np.zeros(dim), noise, 0

    def _mend(self) -> np.ndarray:
        """Make the precision finite, symmetric and positive definite by the least change that does; its root."""
        a = np.nan_to_num((self.precision + self.precision.T) / 2, nan=0.0, posinf=0.0, neginf=0.0)
        one = np.eye(len(a))
        if self.updates and self.updates % CHECK_EVERY == 0 and _root(a) is None:
            a = _lifted(a)
        if not np.linalg.cond(a) <= MOST_CONDITION:
            a = a + RIDGE * one
        # As it is, else with a stronger ridge, else with its eigenvalues lifted.
        for make in (lambda: a, lambda: a + STRONG_RIDGE * one, lambda: _lifted(a + STRONG_RIDGE * one)):
            self.precision = make()
            root = _root(self.precision)
            if root is not None:
                return root
        raise np.linalg.LinAlgError("the precision cannot be mended")

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        """Parameters from the posterior."""
        root = self._mend()
        return np.linalg.solve(self.precision, self.moment) + math.sqrt(self.noise) * np.linalg.solve(root.T, rng.normal(size=len(root)))

    def update(self, x: np.ndarray, reward: float) -> None:
        self.precision += np.outer(x, x)
        self.moment += reward * x
        self.updates += 1


@dataclass(frozen=True)
class Run:
    """One run: its name, its kind, its parameters, and the order of a date's steps.

    kind: 'bandit', 'random', or 'fixed' with an arm. The bandit decides before it learns what matured
    that day and clamps widths while it is cold; baselines learn first and clamp levels.
    """

    name: str
    kind: str
    cfg: Config
    arm: tuple[str, int] | None = None

    @property
    def learns_first(self) -> bool:
        return self.kind != "bandit"


class State:
    """A run's parameters: heads and posteriors by arm, calibrators by horizon. Their size doesn't depend on the rows."""

    def __init__(self, run: Run, sigma: dict[int, float]):
        c = run.cfg
        self.run, self.sigma = run, sigma
        self.arms = [(f"mom_w{w}", h) for w in c.windows for h in c.horizons]
        self.heads = [QuantileHead(c) for _ in self.arms]
        self.posterior = [ThompsonArm(c.lam_bandit, c.noise) for _ in self.arms]
        self.calibrators = {h: Calibrator(c.conf_window, c.warmup, c.lambda_recency) for h in c.horizons}

    def pretrain(self, rows: list[tuple[np.ndarray, dict[int, float]]]) -> None:
        """Each row trains a drawn arm's head, then its horizon's calibrator."""
        draw = np.random.default_rng(self.run.cfg.seed)
        for x, targets in rows:
            k = int(draw.integers(0, len(self.arms)))
            h = self.arms[k][1]
            y = targets.get(h)
            if y is None or not math.isfinite(y):
                continue
            self.heads[k].update(x, y)
            low, high = (float(v) for v in self.heads[k].predict(x))
            bound = self.run.cfg.bound_cap * self.sigma.get(h, 1.0)
            self.calibrators[h].update(y, max(low, -bound), min(high, bound))

    def known(self, day: int) -> Known:
        """What the run decides with on a date."""
        c = self.run.cfg
        theta = None
        if self.run.kind == "bandit":
            theta = np.stack([p.draw(np.random.Generator(np.random.Philox(key=[c.seed, day * len(self.arms) + k]))) for k, p in enumerate(self.posterior)])
        cals = [self.calibrators[h] for h in c.horizons]
        return Known(
            np.stack([h.low for h in self.heads]),
            np.stack([h.high for h in self.heads]),
            theta,
            np.array([cal.widening(c.alpha_for(h)) for h, cal in zip(c.horizons, cals, strict=True)]),
            np.array([len(cal.scores) for cal in cals]),
        )

    def absorb(self, learned: Learned, day: int) -> None:
        """Take over what matured on a date."""
        name = self.run.name
        for k in range(len(self.arms)):
            head = learned.heads.get((name, k, day))
            if head is not None:
                self.heads[k].low, self.heads[k].high = head
            sums = learned.sums.get((name, k, day))
            if sums is not None:
                n, products, moments = sums
                self.posterior[k].precision += products
                self.posterior[k].moment += moments
                self.posterior[k].updates += n
        for h, cal in self.calibrators.items():
            cal.scores = (cal.scores + learned.scores.get((name, h, day), []))[-cal.size :]


@dataclass(frozen=True)
class Known:
    """A date's parameters of a run: heads and drawn parameters by arm, widenings and scores held by horizon."""

    low: np.ndarray
    high: np.ndarray
    theta: np.ndarray | None
    widening: np.ndarray
    held: np.ndarray


@dataclass(frozen=True)
class Learned:
    """What matures in a block, by run, arm (or horizon) and date: heads after it, sums, the last scores in order."""

    heads: dict
    sums: dict
    scores: dict


def luck(seed: int, day: int, ids: Sequence[str]) -> np.ndarray:
    """A number from 0 to 1 for each id on a date, the same wherever the row lies."""
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{day}:{i}".encode(), digest_size=7).digest(), "big") for i in ids]) / 2.0**56


def choose(run: Run, known: Known, day: int, ids: Sequence[str], x: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The arm of each row; `valid` tells by arm whether its horizon is alive."""
    arms = [(f"mom_w{w}", h) for w in run.cfg.windows for h in run.cfg.horizons]
    if run.kind == "bandit":
        return np.where(valid, x @ known.theta.T, -np.inf).argmax(axis=1)
    if run.kind == "random":
        n = valid.sum(axis=1)
        rank = np.minimum((luck(run.cfg.seed, day, ids) * n).astype(int), n - 1)
        return np.argmax(np.cumsum(valid, axis=1) == (rank + 1)[:, None], axis=1)
    wanted = arms.index(run.arm)
    first = np.argmax(valid[:, : len(run.cfg.horizons)], axis=1)
    moved = np.array([arms.index((run.arm[0], h)) for h in run.cfg.horizons])[first]
    return np.where(valid[:, wanted], wanted, moved)


def bounds(run: Run, known: Known, sigma: dict[int, float], x: np.ndarray, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Clamped bounds of the chosen heads, and the same adjusted by the calibrators."""
    c = run.cfg
    at = choice % len(c.horizons)
    one, other = (x * known.low[choice]).sum(axis=1), (x * known.high[choice]).sum(axis=1)
    low, high = np.minimum(one, other), np.maximum(one, other)
    cold = known.held[at] < c.warmup
    if run.kind == "bandit":
        middle, half = (low + high) / 2, np.clip(high - low, c.min_width, c.max_width) / 2
        low, high = np.where(cold, middle - half, low), np.where(cold, middle + half, high)
    else:
        bound = c.bound_cap * np.array([sigma.get(h, 1.0) for h in c.horizons])[at]
        low, high = np.where(cold, np.clip(low, -bound, bound), low), np.where(cold, np.clip(high, -bound, bound), high)
    l_adj, u_adj = low - known.widening[at], high + known.widening[at]
    middle, crossed = (l_adj + u_adj) / 2, l_adj > u_adj
    return low, high, np.where(crossed, middle - HALF_CROSSED, l_adj), np.where(crossed, middle + HALF_CROSSED, u_adj)


_DECISION = "date date, id string, x array<double>, h int, y double, support int, due int, made array<struct<run: int, k: int, l_raw: double, u_raw: double>>, block int"
#: What a run knew of a horizon on a date; runs go by number.
_FACT = "run int, date date, h int, alpha double, qhat double, buffer int, factor double"
_MOVED = "run int, h int, k int, due int, low array<double>, high array<double>, scores array<double>"
LOG = "run string, date date, id string, momentum string, h int, alpha double, y double, l double, u double, covered int, width double, loss double, width_scaled double, loss_scaled double, qhat double, buffer int, support int"


def _decider(shared, horizons: Sequence[int], size: int, keep: Sequence[str] = ()):  # noqa: ANN001, ANN202
    """For mapInArrow over a block's rows: a row per horizon that any run chose, with the runs that did and the block in which it matures."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, sigma, known, day_of, last = shared.value
        every = np.array(sorted(day_of), "datetime64[D]")
        number = np.array([day_of[d] for d in sorted(day_of)])
        named = any(run.kind == "random" for _, run in runs)

        def at_day(v: pa.Array) -> np.ndarray:
            """The numbers of dates; -1 for none."""
            found = v.to_numpy(zero_copy_only=False).astype("datetime64[D]")
            place = np.minimum(np.searchsorted(every, found), len(every) - 1)
            if (~np.isnat(found) & (every[place] != found)).any():
                raise ValueError("a row is due on a date that is not in the slice")
            return np.where(np.isnat(found), -1, number[place])

        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            ids, days = column("id").to_pylist() if named else [""] * batch.num_rows, at_day(column("date"))
            x = column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            per_h = lambda p, f: np.stack([f(column(f"{p}_h{h}")) for h in horizons], axis=1)
            alive = per_h("alive", lambda v: v.fill_null(0).to_numpy(zero_copy_only=False) != 0)
            due = per_h("mat_date", at_day)
            y = per_h("y", lambda v: v.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False))
            for day in np.unique(days).tolist():
                rows = np.flatnonzero((days == day) & alive.any(axis=1))
                acting = [(i, run) for i, run in runs if day <= last[run.name]]
                if not acting or not len(rows):
                    continue
                own, live = x[rows], alive[rows]
                choice, low, high = (np.empty((len(rows), len(acting)), t) for t in (np.int32, float, float))
                for c, (_, run) in enumerate(acting):
                    now = known[run.name, day]
                    choice[:, c] = choose(run, now, day, [ids[i] for i in rows] if run.kind == "random" else (), own, np.tile(live, len(run.cfg.windows)))
                    low[:, c], high[:, c] = bounds(run, now, sigma, own, choice[:, c])[:2]
                at, who = choice % len(horizons), np.broadcast_to(np.array([i for i, _ in acting], np.int32), choice.shape)
                for j, h in enumerate(horizons):
                    when, target = due[rows, j], y[rows, j]
                    chosen = at == j
                    if (chosen.any(axis=1) & (when // size <= day // size)).any():
                        raise ValueError("an outcome matures in the block of its decision: an id has several rows on a date")
                    # Outcomes that are absent or not finite are neither learned from nor scored.
                    on = np.flatnonzero(chosen.any(axis=1) & np.isfinite(target))
                    if not len(on):
                        continue
                    chosen, n, taken = chosen[on], len(on), pa.array(rows[on])
                    made = pa.StructArray.from_arrays([pa.array(v[on][chosen]) for v in (who, choice, low, high)], names=["run", "k", "l_raw", "u_raw"])
                    arrays = {
                        "date": column("date").take(taken),
                        "id": column("id").take(taken),
                        "x": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(own[on].reshape(-1))),
                        "h": pa.array(np.full(n, h), pa.int32()),
                        "y": pa.array(target[on], pa.float64()),
                        "support": pa.array(live[on].sum(axis=1) * len(acting[0][1].cfg.windows), pa.int32()),
                        "due": pa.array(when[on], pa.int32()),
                        "made": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(chosen.sum(axis=1))], pa.int32()), made),
                        "block": pa.array(when[on] // size, pa.int32()),
                        **{c: column(c).take(taken) for c in keep},
                    }
                    yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return work


def _mover(shared, arms: int, size: int):  # noqa: ANN001, ANN202
    """For mapInArrow over (h, due, x, y, run, k, score), a row per outcome and lists of the runs that chose it, sorted by h, due, date and id.

    Gives `_MOVED`: an arm's head after each date on which it moved, and (k null) a run's last scores of a horizon and date.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {key: copy.copy(head) for key, head in shared.value.items()}
        acting = np.array(sorted({run for run, _ in heads}), np.int64)
        now: tuple[int, int] | None = None
        moved: set[tuple[int, int]] = set()
        scores: dict[int, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            h, due = now  # noqa: B023
            rows = [(run, h, k, due, heads[run, k].low.tolist(), heads[run, k].high.tolist(), None) for run, k in sorted(moved)]
            rows += [(run, h, None, due, None, None, v.tolist()) for run, v in sorted(scores.items())]
            kinds = (*[pa.int32()] * 4, *[pa.list_(pa.float64())] * 3)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _MOVED.split(", ")])
            moved.clear()
            scores.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            h, due, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            run, k, score = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (4, 5, 6))
            of = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False))
            edges = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (due[1:] != due[:-1]), True])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if now != (int(h[a]), int(due[a])):
                    if now is not None:
                        yield from told()
                    now = int(h[a]), int(due[a])
                part = slice(*np.searchsorted(of, [a, b]))
                some = np.flatnonzero(np.isin(run[part], acting)) + part.start
                some = some[np.argsort(run[some].astype(np.int64) * arms + k[some], kind="stable")]
                key = run[some].astype(np.int64) * arms + k[some]
                ends = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
                for c, d in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    mine, which = of[some[c:d]], divmod(int(key[c]), arms)
                    move_head(heads[which], x[mine], y[mine])
                    moved.add(which)
                # A run's scores of all its arms, in order of its rows.
                some = np.sort(some)
                some = some[np.argsort(run[some], kind="stable")]
                ends = np.flatnonzero(np.r_[True, run[some][1:] != run[some][:-1], True]) if len(some) else np.zeros(1, np.int64)
                for c, d in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    who = int(run[some[c]])
                    scores[who] = np.concatenate([scores.get(who, score[:0]), score[some[c:d]][-size:]])[-size:]
        if now is not None:
            yield from told()

    return work


def _scored(decisions: DataFrame, facts: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """A row per run and decision, with what the run knew, its adjusted bounds, and covered, width and loss."""
    others = [c for c in decisions.columns if c != "made"]
    one = decisions.select(*others, F.inline("made")).join(F.broadcast(facts), ["run", "date", "h"])  # facts: a row per run, date and horizon
    name = F.element_at(F.array(*[F.array(*[F.lit(f"mom_w{w}") for w in r.cfg.windows]) for r in runs]), F.col("run") + 1)
    arm = F.element_at(name, F.floor(F.col("k") / len(runs[0].cfg.horizons)).cast("int") + 1)
    one = one.withColumns({"momentum": arm, "l": F.col("l_raw") - F.col("qhat"), "u": F.col("u_raw") + F.col("qhat")})
    middle, crossed = (F.col("l") + F.col("u")) / 2, F.col("l") > F.col("u")
    one = one.withColumns({"l": F.when(crossed, middle - HALF_CROSSED).otherwise(F.col("l")), "u": F.when(crossed, middle + HALF_CROSSED).otherwise(F.col("u"))})
    y, low, high = F.col("y"), F.col("l"), F.col("u")
    zero, price = F.lit(0.0), F.lit(2.0) / F.col("alpha")
    loss = F.greatest(high - low, zero) + price * F.greatest(low - y, zero) + price * F.greatest(y - high, zero)
    return one.withColumns({"covered": y.between(low, high).cast("int"), "width": high - low, "loss": loss})


def _learn(matured: DataFrame, facts: DataFrame, runs: Sequence[Run], states: dict[str, State]) -> Learned:
    """Heads, posterior sums and last scores by date, from the outcomes that mature in a block."""
    spark, of = matured.sparkSession, {r.name: i for i, r in enumerate(runs)}
    heads = spark.sparkContext.broadcast({(of[n], k): head for n, s in states.items() for k, head in enumerate(s.heads)})  # two weights vectors a run and arm
    size = max(cal.size for s in states.values() for cal in s.calibrators.values())
    score = F.transform("made", lambda m: F.greatest(m["l_raw"] - F.col("y"), F.col("y") - m["u_raw"], F.lit(0.0)))
    narrow = matured.select("h", "due", "x", "y", F.col("made.run"), F.col("made.k"), score.alias("score"), "date", "id").repartition("h").sortWithinPartitions("h", "due", "date", "id")
    jobs = {"moved": lambda: cut(narrow.mapInArrow(_mover(heads, max(len(s.arms) for s in states.values()), size), _MOVED), "matured").collect()}

    bandits = [s.run for s in states.values() if s.run.kind == "bandit"]
    if bandits:
        of_run = lambda f: F.element_at(F.create_map(*[F.lit(v) for r in bandits for v in (of[r.name], float(f(r.cfg)))]), F.col("run"))
        bonus = F.when(F.col("covered") == 1, F.col("covered") - 0.9).otherwise(-0.1)
        reward = -F.col("loss") + of_run(lambda c: c.lambda_cov) * bonus - of_run(lambda c: c.lambda_width) * 0.1 * F.col("width")
        rows = _scored(matured, facts, runs).where(F.col("run").isin([of[r.name] for r in bandits])).select("run", "k", "due", "x", reward.alias("reward"))
        entry = lambda i: F.col("x")[i]
        products = [F.sum(entry(i) * entry(j)).alias(f"p{i}_{j}") for i in range(DIM) for j in range(i, DIM)]
        jobs["sums"] = rows.groupBy("run", "k", "due").agg(F.count(F.lit(1)).alias("n"), *products, *[F.sum(entry(i) * F.col("reward")).alias(f"m{i}") for i in range(DIM)]).collect
    with ThreadPoolExecutor(len(jobs)) as pool:  # two small jobs over one table, side by side
        found = dict(zip(jobs, pool.map(lambda job: job(), jobs.values()), strict=True))

    upper = np.triu_indices(DIM)

    def matrix(r) -> np.ndarray:  # noqa: ANN001
        out = np.zeros((DIM, DIM))
        out[upper] = [r[f"p{i}_{j}"] for i, j in zip(*upper, strict=True)]
        return out + np.triu(out, 1).T

    return Learned(
        {(runs[r["run"]].name, r["k"], r["due"]): (np.array(r["low"]), np.array(r["high"])) for r in found["moved"] if r["k"] is not None},
        {(runs[r["run"]].name, r["k"], r["due"]): (r["n"], matrix(r), np.array([r[f"m{i}"] for i in range(DIM)])) for r in found.get("sums", [])},
        {(runs[r["run"]].name, r["h"], r["due"]): r["scores"] for r in found["moved"] if r["k"] is None},
    )


def last_decision(run: Run, dates: Sequence) -> Any:
    """The last of the ascending test dates on which a run decides; runs that learn first leave out the longest horizon."""
    n = max(run.cfg.horizons)
    return dates[-n - 1 if run.learns_first and len(dates) > n else -1] if len(dates) else None


def _started(spark: SparkSession, runs: Sequence[Run], sigma: dict[int, float], sample: list[tuple[np.ndarray, dict[int, float]]]) -> dict[str, State]:
    """Each run's state after its training rows, a task a run; the sample is bounded by `pretrain_rows`."""
    shared = spark.sparkContext.broadcast((list(runs), sigma, sample))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, spread, rows = shared.value
        for frame in frames:
            for i in frame["number"]:
                state = State(every[i], spread)
                state.pretrain(rows)
                yield pd.DataFrame({"number": [i], "state": [pickle.dumps(state)]})

    numbered = spark.range(len(runs), numPartitions=len(runs)).select(F.col("id").alias("number"))
    return {(s := pickle.loads(r["state"])).run.name: s for r in sorted(numbered.mapInPandas(work, "number long, state binary").collect(), key=lambda r: r["number"])}


def run_slice(rows: DataFrame, sample: list[tuple[np.ndarray, dict[int, float]]], runs: Sequence[Run], sigma: dict[int, float]) -> DataFrame:
    """Score logs of all runs over a test slice: date, id, x, and y_h, alive_h, mat_date_h by horizon, a row per id and date.

    The slice is written once, in order of date. `sample` has the training rows, `sigma` the targets' deviations;
    runs share their horizons and the number of their windows. Rows without a live horizon are not decided, outcomes that
    are null or not finite teach nothing and are not scored, and an empty slice gives an empty log. A slice with
    `index_weight` has it in the log. The driver lists the dates, and what runs know of a horizon on each.
    """
    spark, horizons = rows.sparkSession, list(runs[0].cfg.horizons)
    if len({len(r.cfg.windows) for r in runs}) > 1:
        raise ValueError("runs need as many windows each")
    keep = [c for c in ("index_weight",) if c in rows.columns]
    decision = ", ".join([_DECISION, *(f"{c} double" for c in keep)])
    rows = cut(rows.withColumns({c: F.col(c).cast("double") for c in keep}).repartitionByRange("date", "id").sortWithinPartitions("date", "id"), "slice")
    dates = [r["date"] for r in rows.select("date").distinct().orderBy("date").collect()]
    if not dates:
        return spark.createDataFrame([], ", ".join([LOG, *(f"{c} double" for c in keep)]))
    size = min(horizons)
    day_of = {d: i for i, d in enumerate(dates)}
    last = {r.name: day_of[last_decision(r, dates)] for r in runs}
    states = _started(spark, runs, sigma, sample)
    number = {r.name: i for i, r in enumerate(runs)}
    scales = {(r.name, h): {"none": 1.0, "per_h": 1 / h, "per_sqrt_h": h**-0.5, "per_sigma": 1 / sigma.get(h, 1.0)}[r.cfg.scale_mode] for r in runs for h in horizons}
    path, facts = fresh_path(spark, "decisions"), []
    told = lambda: spark.createDataFrame(facts, _FACT)
    # What matures after a run's last decision teaches it nothing that it could use.
    for first in range(0, max(last.values()) + 1, size):
        days = range(first, min(first + size, max(last.values()) + 1))
        acting = {n: s for n, s in states.items() if last[n] >= first}
        learned = Learned({}, {}, {})
        if first:
            matured = spark.read.schema(decision).parquet(path).where((F.col("block") == first // size) & (F.col("due") <= days[-1]))
            learned = _learn(matured, told(), runs, acting)
        known = {}
        for day in days:
            for name, state in acting.items():
                if state.run.learns_first:
                    state.absorb(learned, day)
                if day <= last[name]:
                    now = known[name, day] = state.known(day)
                    facts += [(number[name], dates[day], h, state.run.cfg.alpha_for(h), float(now.widening[j]), int(now.held[j]), scales[name, h]) for j, h in enumerate(horizons)]
                if not state.run.learns_first:
                    state.absorb(learned, day)
        shared = spark.sparkContext.broadcast(([(number[n], s.run) for n, s in acting.items()], sigma, known, day_of, last))  # parameters by run and date of the block
        own = rows.where(F.col("date").between(F.lit(dates[days[0]]), F.lit(dates[days[-1]])))
        own.mapInArrow(_decider(shared, horizons, size, keep), decision).write.partitionBy("block").mode("append").parquet(path)

    scored = _scored(spark.read.schema(decision).parquet(path), told(), runs)
    names = F.element_at(F.array(*[F.lit(r.name) for r in runs]), F.col("run") + 1)
    scaled = scored.withColumns({"run": names, "width_scaled": F.col("width") * F.col("factor"), "loss_scaled": F.col("loss") * F.col("factor")})
    return scaled.select(*[f.split()[0] for f in LOG.split(", ")], *keep)


def baseline_runs(cfg: Config) -> list[Run]:
    """The random policy and every fixed arm."""
    return [Run("random", "random", cfg)] + [Run(f"fixed_mom_w{w}_h{h}", "fixed", cfg, (f"mom_w{w}", h)) for w in cfg.windows for h in cfg.horizons]


def variant_runs(cfg: Config) -> list[Run]:
    """The base bandit and its ablations."""
    changes = {
        "alpha=0.05": cfg.with_alpha(0.05),
        "alpha=0.2": cfg.with_alpha(0.2),
        "conf_window=125": replace(cfg, conf_window=125),
        "conf_window=500": replace(cfg, conf_window=500),
        "lambda_recency=0.01": replace(cfg, lambda_recency=0.01),
        "lambda_recency=0.02": replace(cfg, lambda_recency=0.02),
        "lam_bandit=0.5": replace(cfg, lam_bandit=0.5),
    }
    return [Run("base", "bandit", cfg), *(Run(name, "bandit", c) for name, c in changes.items())]


def run_policies(features: DataFrame, runs: Sequence[Run], cfg: Config = Config(), weights: bool = False) -> DataFrame:
    """Score logs of all runs, from the feature table: its test slice, and a sample of its training rows. With `weights`, logs have its index weight."""
    columns = ["date", "id", "x", *(["index_weight"] if weights else []), *(f"{p}_h{h}" for p in ("y", "alive", "mat_date") for h in cfg.horizons)]
    train, _ = split_dates(features, cfg)
    spread = train.agg(*[F.stddev_samp(f"y_h{h}").alias(str(h)) for h in cfg.horizons]).first()
    sigma = {h: float(spread[str(h)] or 1.0) or 1.0 for h in cfg.horizons}
    drawn = sample_rows(train.where(" or ".join(f"y_h{h} is not null" for h in cfg.horizons)), cfg.pretrain_rows, cfg.seed)
    rows = drawn.select("date", "id", "x", *[f"y_h{h}" for h in cfg.horizons]).orderBy("date", "id").collect()  # pretrain_rows at most
    sample = [(np.array(r["x"], dtype=float), {h: r[f"y_h{h}"] for h in cfg.horizons}) for r in rows]
    return run_slice(test_slice(features, cfg).select(*columns), sample, list({r.name: r for r in runs}.values()), sigma)


def daily_choices(scores: DataFrame, features: DataFrame) -> DataFrame:
    """(date, momentum, h, ctx_*): the modal arm of each date and the means of its context."""
    from quillon.operators.aggregates import policy_mode

    context = features.groupBy("date").agg(F.avg("ret_vol20").alias("ctx_retvol20"), F.avg("spread").alias("ctx_spread"), F.avg("duration").alias("ctx_duration"))
    return policy_mode(scores.select("date", "id", "momentum", "h")).join(context, "date")


def calibrator_audit(scores: DataFrame, warmup: int) -> DataFrame:
    """(run, date, h, alpha, buffer_len, warmup_min, qhat, clamp_applied): what calibrators knew at each decision date."""
    return scores.select("run", "date", "h", "alpha", F.col("buffer").alias("buffer_len"), F.lit(warmup).alias("warmup_min"), "qhat", (F.col("buffer") < warmup).alias("clamp_applied")).distinct()
