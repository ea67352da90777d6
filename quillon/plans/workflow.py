"""All steps in order, each once: a finished step is noted and not run again."""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.operators import aggregates as A
from quillon.plans import ablation, causal, ope, report, stats
from quillon.plans.features import feature_table
from quillon.plans.policy import Run, baseline_runs, calibrator_audit, daily_choices, run_policies
from quillon.sources.files import exists, file_sizes, read_json, remove, rename, write_json
from quillon.sources.intermediate import cut, released


class Checkpoint:
    """Which steps are done, and with what: a step is done only by its entry in the manifest.

    A step's tables are written under fresh names, put in place when all of them are whole, and noted last,
    by a manifest that replaces the old one in one step. Whatever stops a run before that, the step is run
    again. An entry holds the fingerprint of settings and input; another fingerprint, like an absent, empty
    or corrupt manifest, means that the step isn't done. Steps after one that ran are run again as well.
    """

    def __init__(self, path: str, spark: SparkSession, fingerprint: str = ""):
        self.path, self.spark, self.fingerprint = path, spark, fingerprint
        self.folder = path.rpartition("/")[0]
        self.done = {k: v for k, v in dict(read_json(path, {}, spark).get("completed") or {}).items() if isinstance(v, dict)}
        self.fresh: dict[str, str] = {}
        self._ran = False

    def is_done(self, step: str) -> bool:
        return self.done.get(step, {}).get("fingerprint") == self.fingerprint

    def place(self, table: str) -> str:
        """Where a table is to be read now: as the step at work wrote it, else in its place."""
        return self.fresh.get(table, f"{self.folder}/{table}.parquet")

    def write(self, df: DataFrame, table: str) -> None:
        """A table of the step at work."""
        path = f"{self.folder}/_fresh/{table}-{uuid.uuid4().hex}.parquet"
        df.write.parquet(path)
        self.fresh[table] = path

    def _save(self) -> None:
        write_json({"completed": self.done}, self.path, self.spark)

    def run(self, step: str, work: Callable[[], None], force: bool = False) -> bool:
        """Run a step unless it is done; whether it ran."""
        if self.is_done(step) and not force and not self._ran:
            return False
        if self.done.pop(step, None) is not None:
            self._save()  # from here on its tables may be a mixture
        self._ran, self.fresh = True, {}
        work()
        for table, path in self.fresh.items():
            rename(self.spark, path, f"{self.folder}/{table}.parquet")
        tables, self.fresh = sorted(self.fresh), {}
        self.done[step] = {"at": datetime.datetime.now(datetime.UTC).isoformat(), "fingerprint": self.fingerprint, "tables": tables}
        self._save()
        return True


def fingerprint(settings: Mapping, panel: DataFrame) -> str:
    """One text for settings and input: it changes with any setting, column, row or value, not with the rows' order."""
    own = panel.select(F.xxhash64(*sorted(panel.columns)).alias("h"))
    told = own.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s")).first()
    document = json.dumps([settings, sorted(panel.dtypes), list(told)], sort_keys=True, default=str)
    return hashlib.sha256(document.encode()).hexdigest()


def report_row(df: DataFrame) -> dict:
    """The first row of a table as a document."""
    row = df.first()
    return row.asDict() if row else {}


def run_all(spark: SparkSession, panel: DataFrame, results: str, cfg: Config = Config(), with_ablation: bool = False, force: bool = False, panel_path: str | None = None) -> dict[str, str]:
    """Features, bandit, baselines, counterfactuals, off-policy evaluation, ablation and report under `results`.

    Each step reads what earlier ones wrote, so a restart goes on where the last run stopped; other settings or
    another panel start anew (see `Checkpoint`). The settings are saved beside the results, with the panel's path
    if it is given, for `files.load_settings` and `files.resolve_panel_path`.
    """
    results = results.rstrip("/")
    note = lambda document, name: write_json(document, f"{results}/{name}.json", spark)
    settings = {**asdict(cfg), "alpha_by_h": dict(cfg.alpha_by_h)}
    note({**settings, **({"panel_path": panel_path} if panel_path else {})}, "config_resolved")
    mark = Checkpoint(f"{results}/checkpoint.json", spark, fingerprint(settings, panel))
    path = {n: f"{results}/{n}.parquet" for n in ("features", "policy_scores", "policy_choices", "baseline_scores", "calibrator_audit", "causal_summary", "ope_rows", "ope_summary", "ablation_overview", "ablation_diff", "leaderboard")}
    read = lambda n: spark.read.parquet(mark.place(n))
    write = mark.write

    def bandit() -> None:
        write(run_policies(read("features"), [Run("crl", "bandit", cfg)], cfg), "policy_scores")
        write(daily_choices(read("policy_scores"), read("features")), "policy_choices")
        overall = A.summary(read("policy_scores")).where("h is null").first().asDict()
        weighted = A.overall_loss(A.with_weights(read("policy_scores"), read("features"), 0.0)).first().asDict()
        note({**overall, **weighted}, "analysis")
        note(report.falsification_document(read("policy_scores")), "falsification")

    def baselines() -> None:
        write(run_policies(read("features"), baseline_runs(cfg), cfg).withColumn("baseline", F.col("run")), "baseline_scores")
        write(calibrator_audit(read("baseline_scores"), cfg.warmup), "calibrator_audit")
        write(A.leaderboard(A.with_weights(read("baseline_scores"), read("features"), 0.0)), "leaderboard")

    def counterfactuals() -> None:
        write(causal.policy_metrics(causal.policy_baskets(read("features"), read("policy_choices"), cfg)), "causal_summary")
        note({"policies": read("causal_summary").count(), "dates": read("policy_choices").count(), "top_fraction": cfg.top_fraction, **report_row(causal.outperformance(read("causal_summary")))}, "causal_meta")

    def off_policy() -> None:
        behaviour = read("baseline_scores").where("run = 'random'")
        if behaviour.isEmpty():
            return remove(spark, f"{results}/ope_meta.json")
        rows = ope.align_actions(behaviour, read("policy_scores"))
        scored, total = ope.evaluate_forest(rows, read("features"), cfg)
        write(scored, "ope_rows")
        write(total, "ope_summary")
        note({"rows": read("ope_rows").count(), "folds": cfg.ope_folds, "scale_mode": cfg.scale_mode, "behaviour": "random"}, "ope_meta")
        return None

    def ablations() -> None:
        overview, diff = ablation.run_ablation(read("features"), cfg)
        write(overview, "ablation_overview")
        write(diff, "ablation_diff")
        note({"variants": sorted(r[0] for r in read("ablation_overview").select("variant").distinct().collect()), "rows": read("ablation_diff").count()}, "ablation_meta")

    def reporting() -> None:
        scores, weighted = read("policy_scores"), A.with_weights(read("policy_scores"), read("features"))
        index = cut(A.security_to_index(weighted), "index")
        board, base = read("leaderboard"), A.with_weights(read("baseline_scores"), read("features"))
        models = cut(A.security_to_index(base, ("baseline", "date", "h")), "models")
        loss = A.overall_loss(weighted).first()["overall_weighted"]
        days = lambda df, *by: df.groupBy(*by, "date").agg(F.avg("loss_scaled").alias("loss"))
        every = models.select(F.col("baseline").alias("model"), "date", "h", "loss_scaled").unionByName(index.select(F.lit("policy").alias("model"), "date", "h", "loss_scaled"))
        sections = {
            "Overall": A.summary(scores),
            "By horizon": A.by_horizon(scores).orderBy("h"),
            "Calibration": report.calibration_gap(index).orderBy("h"),
            "Coverage": A.coverage_statistics(scores).orderBy("h"),
            "Observations": A.observation_counts(scores),
            "Best and worst securities": A.top_bottom(A.per_security(scores), 10),
            "Baselines": board.orderBy("mean_loss_scaled"),
            "Improvement": report.improvements(board, loss),
            "Significance": stats.significance_table(days(index), days(models, "baseline")).orderBy("baseline"),
            "Performance": stats.performance_table(every).orderBy("mean_loss"),
            "Counterfactuals": read("causal_summary").orderBy("policy"),
            **({"Off-policy evaluation": read("ope_summary").orderBy("h_e")} if mark.is_done("ope") and exists(spark, f"{results}/ope_meta.json") else {}),
            **({"Ablation": read("ablation_overview").orderBy("variant", "scope")} if mark.is_done("ablation") else {}),
        }
        note(report.coverage_document(scores, cfg.alpha), "coverage_statistics")
        note(report_row(A.observation_counts(scores)), "observation_counts")
        report.write_report(f"{results}/report.md", "Results", sections, spark)
        note(file_sizes(spark, results), "manifest")

    mark.run("features", lambda: write(feature_table(panel, cfg), "features"), force)
    steps = [("bandit", bandit), ("baselines", baselines), ("causal", counterfactuals), ("ope", off_policy), *([("ablation", ablations)] if with_ablation else []), ("report", reporting)]
    for name, work in steps:
        with released(spark):  # what a step writes for itself is gone with it
            mark.run(name, work, force)
    remove(spark, f"{results}/_fresh")
    return path
