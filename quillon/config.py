"""Run parameters and how they are looked up."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

#: Default miss rate of an interval.
ALPHA = 0.10


def lookup(config: Any, keys: str | Iterable[str], default: Any = None) -> Any:
    """The first of `keys` that has a value other than None, else `default`.

    `config` is a mapping or an object. A key is tried as it is, as a dotted path, and inside a nested
    block named `crl`.
    """
    for key in [keys] if isinstance(keys, str) else keys:
        for path in ([key], key.split("."), ["crl", *key.split(".")]):
            value = config
            for step in path:
                value = value.get(step) if isinstance(value, Mapping) else getattr(value, step, None)
                if value is None:
                    break
            if value is not None:
                return value
    return default


def merge(base: Mapping, changes: Mapping) -> dict:
    """`base` with `changes` laid over it, nested mappings merged."""
    out = dict(base)
    for key, value in changes.items():
        out[key] = merge(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


@dataclass(frozen=True)
class Config:
    """Parameters of features, policies, calibration and evaluation."""

    train_end: str = "1999-12-31"
    test_start: str = "2000-01-01"
    seed: int = 42
    windows: tuple[int, ...] = (10, 21, 42, 63)
    horizons: tuple[int, ...] = (10, 21, 42, 63)
    scale_mode: str = "per_h"
    alpha: float = ALPHA
    alpha_by_h: Mapping[int, float] = field(default_factory=dict)
    conf_window: int = 250
    lambda_recency: float = 0.0
    warmup: int = 20
    min_width: float = 0.002
    max_width: float = 0.05
    bound_cap: float = 50.0
    tau_low: float = 0.05
    tau_high: float = 0.95
    eta: float = 0.02
    lam_head: float = 1e-4
    lam_bandit: float = 1.0
    noise: float = 0.01
    pretrain_rows: int = 10_000
    folds: int = 3
    value_trees: int = 400
    value_depth: int = 12
    value_leaf: int = 10
    ope_folds: int = 5
    ope_trees: int = 600
    ope_depth: int = 14
    ope_leaf: int = 8
    purge: int | None = 4
    embargo: int | None = 4
    purge_horizon: bool = False
    value_least: int = 1
    ope_least: int = 1
    top_fraction: float = 0.2
    min_selected: int = 5
    placebo_shifts: tuple[int, ...] = (20,)
    lambda_cov: float = 0.0
    lambda_width: float = 0.0
    weight_default: float = 1.0

    def alpha_for(self, h: int) -> float:
        """The miss rate of a horizon, or the general one."""
        return float(self.alpha_by_h.get(h, self.alpha))

    def fold_steps(self, h: int) -> tuple[int, int]:
        """Dates purged before and embargoed after a test fold of a horizon's labels; none given means the horizon.

        With `purge_horizon` neither is less than the horizon, so no training label reaches into the test.
        """
        purge = h if self.purge is None else self.purge
        embargo = purge if self.embargo is None else self.embargo
        return (max(purge, h), max(embargo, h)) if self.purge_horizon else (purge, embargo)

    def with_alpha(self, alpha: float) -> Config:
        """The same with one miss rate for all horizons, pinned ones included."""
        return replace(self, alpha=alpha, alpha_by_h={})

    @staticmethod
    def from_mapping(values: Mapping) -> Config:
        """From keys as a settings file names them, or as a run saves them; unknown keys are left out.

        Horizons may be text, as JSON has them; `alpha_<h>` beside `alpha_by_h` goes before it. `max_purge_steps`
        is the least purge and embargo of any horizon, with folds of too few rows left out, unless the settings
        name those fields themselves.
        """
        names = {"momentum_windows": "windows", "horizon_scale_mode": "scale_mode", "calib_warmup_min": "warmup", "raw_min_width": "min_width", "raw_max_width": "max_width", "raw_bound_cap_k": "bound_cap", "eta_q": "eta", "n_splits_value": "folds", "n_splits_ope": "ope_folds", "q_n_trees": "ope_trees", "q_max_depth": "ope_depth", "q_min_leaf": "ope_leaf", "max_purge_steps": "purge"}
        flat = {**values, **(values.get("crl") or {})}
        taken: dict[str, Any] = {}
        per_h = {}
        for key, value in flat.items():
            name = names.get(key, key)
            if value is None and key not in ("purge", "embargo"):
                continue
            if key.startswith("alpha_") and key[6:].isdigit():
                per_h[int(key[6:])] = float(value)
            elif name == "alpha_by_h":
                per_h = {**{int(h): float(a) for h, a in value.items()}, **per_h}
            elif name in Config.__dataclass_fields__:
                taken[name] = tuple(value) if isinstance(value, list) else value
        if flat.get("max_purge_steps") is not None:
            # The least training rows of a fold, for the value function and for off-policy evaluation.
            taken = {"embargo": None, "purge_horizon": True, "value_least": 100, "ope_least": 200} | taken
        return Config(**taken, alpha_by_h=per_h)


def parse_yaml(text: str) -> dict:
    """Settings as a mapping; a text that holds none gives an empty one."""
    import yaml

    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError:
        return {}
    return found if isinstance(found, dict) else {}


def load_yaml(path: str) -> dict:
    """A settings file on this machine as a mapping."""
    with open(path, encoding="utf-8") as f:
        return parse_yaml(f.read())
