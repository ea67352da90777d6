"""Scalar functions on columns: parsing, clipping, scaling, interval scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard scores are clipped here.
CLIP_Z = 8.0


def parse_date(c: Column) -> Column:
    """A date from a date, timestamp or text; unreadable text gives null."""
    return F.to_date(F.try_to_timestamp(c.cast("string")))


def parse_number(c: Column) -> Column:
    """A finite double, else null."""
    x = c.cast("string").try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def parse_percent(c: Column) -> Column:
    """`1,25%` or `1.25` as 0.0125; text with both marks or none readable gives null."""
    return parse_number(F.translate(F.regexp_replace(c.cast("string"), "%", ""), ",", ".")) / 100


def clip(c: Column, low: float, high: float) -> Column:
    """`c` inside [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def safe(c: Column, default: float) -> Column:
    """`c`, or `default` if it is null or not finite."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(default)).otherwise(c)


def standardize(c: Column, mean: Column, sd: Column) -> Column:
    """(c - mean) / sd, null as 0, clipped."""
    return clip(F.coalesce((c - mean) / sd, F.lit(0.0)), -CLIP_Z, CLIP_Z)


def context_vector(v: Column, idx_v: Column, spread: Column, duration: Column, autocorr: Column, spread_pct: Column, vol_pct: Column) -> Column:
    """The ten context features: bias, five scores, two percentiles, two products."""
    a, b, s, d, ac = (clip(safe(x, 0.0), -CLIP_Z, CLIP_Z) for x in (v, idx_v, spread, duration, autocorr))
    return F.array(F.lit(1.0), a, b, s, d, ac, safe(spread_pct, 0.5), safe(vol_pct, 0.5), s * d, a * b)


def interval_score(y: Column, low: Column, high: Column, alpha: Column | float) -> Column:
    """Width plus 2 / alpha times the distance outside the interval."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    zero = F.lit(0.0)
    return F.greatest(high - low, zero) + (2 / a) * F.greatest(low - y, zero) + (2 / a) * F.greatest(y - high, zero)


def covered(y: Column, low: Column, high: Column) -> Column:
    """1 if y lies in the closed interval, else 0."""
    return y.between(low, high).cast("int")


def nonconformity(y: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """How far y is below, above, and outside the interval; never below 0."""
    below, above = F.greatest(low - y, F.lit(0.0)), F.greatest(y - high, F.lit(0.0))
    return below, above, F.greatest(below, above)


def horizon_factor(h: Column, mode: str, sigma: Mapping[int, float] | None = None) -> Column:
    """1, 1/h, 1/sqrt(h) or 1/sigma_h; a horizon of 0 or less gives 1. Unknown modes raise ValueError."""
    if mode == "none":
        return F.lit(1.0)
    if mode == "per_h":
        return F.when(h > 0, 1.0 / h).otherwise(F.lit(1.0))
    if mode == "per_sqrt_h":
        return F.when(h > 0, 1.0 / F.sqrt(h)).otherwise(F.lit(1.0))
    if mode == "per_sigma":
        if not sigma:
            raise ValueError("per_sigma needs a sigma for each horizon")
        known = F.create_map(*[F.lit(x) for h_, s in sigma.items() for x in (int(h_), float(s))])
        return 1.0 / F.coalesce(F.nullif(F.try_element_at(known, h), F.lit(0.0)), F.lit(1.0))
    raise ValueError(f"unknown scale mode: {mode}")


def clamp_width(low: Column, high: Column, least: float, most: float) -> tuple[Column, Column]:
    """Bounds with a width in [least, most] about their middle; swapped bounds are put in order first."""
    a, b = F.least(low, high), F.greatest(low, high)
    middle, half = (a + b) / 2, F.greatest(F.least(b - a, F.lit(most)), F.lit(least)) / 2
    return middle - half, middle + half


def clamp_level(c: Column, sigma: Column, k: float = 50.0) -> Column:
    """`c` inside +-k sigma."""
    return F.greatest(F.least(c, k * sigma), -k * sigma)


def uncross(low: Column, high: Column, how: str = "swap", gap: float = 1e-6) -> tuple[Column, Column]:
    """Bounds in order: swapped, collapsed to the middle, or put `gap` about it."""
    middle = (low + high) / 2
    if how == "swap":
        return F.least(low, high), F.greatest(low, high)
    room = 0.0 if how == "collapse" else gap
    return F.when(low > high, middle - room).otherwise(low), F.when(low > high, middle + room).otherwise(high)


def recency_weight(age: Column, rate: float) -> Column:
    """exp(-rate * age); the newest has age 1."""
    return F.exp(-rate * age)


def alpha_for(h: Column, by_h: Mapping[int, float], default: float) -> Column:
    """The horizon's own miss rate, or the general one."""
    if not by_h:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in by_h.items() for x in (int(k), float(v))]), h), F.lit(default))


def action_key(momentum: Column, h: Column) -> Column:
    """An arm as text."""
    return F.concat(momentum, F.lit("|h="), h.cast("string"))


def one_hot(index: Column, n: int) -> Column:
    """An array of n doubles with a 1 at `index`."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == index).cast("double"))


def propensity(support: Column) -> Column:
    """1 over the number of valid arms, inside [1e-6, 1]."""
    return F.least(F.greatest(1.0 / F.greatest(support, F.lit(1)), F.lit(1e-6)), F.lit(1.0))


def regime(c: Column, low: Column, high: Column) -> Column:
    """Low, Mid or High by two thresholds; null stays null."""
    return F.when(c < low, "Low").when(c < high, "Mid").when(c.isNotNull(), "High")


def fixed_arm(name: Column) -> tuple[Column, Column]:
    """Momentum and horizon in `fixed_<momentum>_h<horizon>`."""
    return F.nullif(F.regexp_extract(name, r"^fixed_(.+)_h\d+$", 1), F.lit("")), F.regexp_extract(name, r"_h(\d+)$", 1).try_cast("int")


def window_number(column: Column) -> Column:
    """The window in a name such as `mom_w21`."""
    return F.regexp_extract(column, r"w(\d+)", 1).try_cast("int")


def nearest_windows(windows: Sequence[int], targets: Sequence[int] = (10, 21, 42)) -> list[int]:
    """For each target the nearest window; of two as near, the one listed first."""
    return [min(windows, key=lambda w: abs(w - t)) for t in targets]
