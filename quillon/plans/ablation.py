"""Ablations: variants of the bandit in one job, each compared with the base on common keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from quillon.config import Config
from quillon.operators.aggregates import security_to_index, with_weights
from quillon.plans.policy import Run, run_policies, variant_runs
from quillon.plans.stats import compare_variant, paired_differences
from quillon.sources.intermediate import cut


def variant_tag(changes: Mapping) -> str:
    """A variant's canonical name: `key=value` pairs in order of key."""
    return "__".join(f"{k}={changes[k]}" for k in sorted(changes))


def select_variants(runs: Sequence[Run], wanted: Sequence[str | Mapping] | None) -> list[Run]:
    """The base and the wanted variants, by name or by their changes; all if none are named."""
    names = {variant_tag(w) if isinstance(w, Mapping) else w for w in wanted or []}
    return [r for r in runs if not names or r.name == "base" or r.name in names]


def overview(scores: DataFrame, panel: DataFrame | None, draws: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(overview, differences) of every run in the log against `base`; a log without variants raises ValueError.

    Weights are the panel's, or the log's own where none is given.
    """
    # A row per run, date and horizon, read by every table below; the runs behind it are not repeated.
    index = cut(security_to_index(with_weights(scores, panel), ("run", "date", "h")), "index")
    base, variants = index.where("run = 'base'"), index.where("run <> 'base'").withColumnRenamed("run", "variant")
    diffs = paired_differences(base, variants, ["variant"]).select("date", "h", "d_loss_scaled", "variant")
    return compare_variant(base, variants, ["variant"], draws=draws), diffs


def run_ablation(features: DataFrame, cfg: Config = Config(), wanted: Sequence[str | Mapping] | None = None, draws: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Run base and variants side by side and compare them."""
    scores = run_policies(features, select_variants(variant_runs(cfg), wanted), cfg, weights=True)
    return overview(scores, None, draws)
