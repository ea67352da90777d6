import datetime
import json
import math

import pytest

from quillon.config import Config
from quillon.plans.workflow import Checkpoint, fingerprint, run_all
from quillon.sources import files


def test_settings_come_back_as_they_were_saved(spark, tmp_path):
    from dataclasses import asdict

    cfg = Config(alpha_by_h={10: 0.05, 63: 0.2}, windows=(5, 7), horizons=(10, 63), train_end="1998-01-01", seed=3)
    for session in (None, spark):
        files.write_json({**asdict(cfg), "panel_path": "s3://somewhere/p.parquet"}, str(tmp_path / "config_resolved.json"), session)
        assert files.load_settings(str(tmp_path), session) == cfg
        assert files.resolve_panel_path(str(tmp_path), spark=session) == "s3://somewhere/p.parquet"
        assert files.resolve_panel_path("file://" + str(tmp_path), "none", spark) == "s3://somewhere/p.parquet"
    assert Config.from_mapping({"alpha_by_h": {"10": 0.3}, "alpha_10": 0.2}).alpha_by_h == {10: 0.2}
    assert files.load_settings(str(tmp_path / "nowhere"), spark) == Config()
    (tmp_path / "y").mkdir()
    (tmp_path / "y/config_resolved.yaml").write_text("data:\n  panel_path: here.parquet\n")
    assert files.resolve_panel_path(str(tmp_path / "y"), spark=spark) == files.resolve_panel_path(str(tmp_path / "y")) == "here.parquet"


@pytest.mark.parametrize("text", ["", "{", "[1, 2]", '{"completed": null}', '{"completed": {"a": "2024-01-01"}}'])
def test_a_broken_manifest_means_that_nothing_is_done(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    assert Checkpoint(str(tmp_path / "c.json"), spark).done == {}
    assert Checkpoint(str(tmp_path / "absent.json"), spark).done == {}


def test_a_step_stopped_between_writing_and_noting_runs_again(spark, tmp_path):
    path, value = str(tmp_path / "c.json"), lambda n: spark.range(n)
    one = Checkpoint(path, spark, "f")
    assert one.run("a", lambda: one.write(value(3), "t")) and not Checkpoint(path, spark, "f").run("a", lambda: None)

    def stopped() -> None:
        two.write(value(5), "t")
        assert spark.read.parquet(two.place("t")).count() == 5
        raise KeyboardInterrupt

    two = Checkpoint(path, spark, "f")
    with pytest.raises(KeyboardInterrupt):
        two.run("a", stopped, force=True)
    # The old table stands, but nothing says that the step is done.
    three = Checkpoint(path, spark, "f")
    assert spark.read.parquet(three.place("t")).count() == 3 and not three.is_done("a")
    assert three.run("a", lambda: three.write(value(7), "t")) and spark.read.parquet(three.place("t")).count() == 7
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("_c.json")] == []


def test_other_settings_and_other_rows_run_steps_again(spark, tmp_path):
    panel, path = spark.range(4).selectExpr("id", "id * 2 as v"), str(tmp_path / "c.json")
    same = fingerprint({"a": 1}, panel)
    assert same == fingerprint({"a": 1}, panel.repartition(3)) and len({same, fingerprint({"a": 2}, panel), fingerprint({"a": 1}, panel.where("id > 0")), fingerprint({"a": 1}, panel.selectExpr("id", "id * 2 + 1 as v"))}) == 4
    ran = []
    for mark in ("f", "f", "g"):
        run = Checkpoint(path, spark, mark)
        for step in ("a", "b"):
            run.run(step, lambda step=step: ran.append((mark, step)))
    assert ran == [("f", "a"), ("f", "b"), ("g", "a"), ("g", "b")]
    again = Checkpoint(path, spark, "g")
    assert again.run("a", lambda: None, force=True) and again.run("b", lambda: None)


def test_all_steps_of_a_run(spark, tmp_path):
    cfg = Config(windows=(10, 21, 42), horizons=(2, 4), warmup=5, pretrain_rows=60, conf_window=30, train_end="2020-12-31", test_start="2021-01-01", folds=2, purge=2, embargo=2)
    start, rows = datetime.date(2019, 1, 7), []
    for i in range(150):
        for k in range(12):
            ret = 0.01 * math.sin(i * 0.7 + k) + 0.002 * math.cos(i * k)
            rows.append((start + datetime.timedelta(7 * i), f"s{k:02d}", ret, 1 / 12, 0.001 * math.sin(i), 0.01 + 0.001 * k, 2.0 + 0.1 * k, k % 3, 1, 0.5))
    panel = spark.createDataFrame(rows, "date date, id string, ret double, index_weight double, index_return double, spread double, duration double, sector_id int, active int, ttm double")
    results = str(tmp_path / "results")
    path = run_all(spark, panel, results, cfg, panel_path="somewhere/panel.parquet")
    assert files.resolve_panel_path(results) == "somewhere/panel.parquet"
    done = json.loads((tmp_path / "results/checkpoint.json").read_text())["completed"]
    assert list(done) == ["features", "bandit", "baselines", "causal", "ope", "report"]
    for name in ("analysis", "falsification", "causal_meta", "ope_meta", "coverage_statistics", "observation_counts", "manifest"):
        assert json.loads((tmp_path / f"results/{name}.json").read_text())
    text = (tmp_path / "results/report.md").read_text()
    assert all(f"## {s}" in text for s in ("Overall", "Coverage", "Significance", "Performance", "Counterfactuals", "Off-policy evaluation", "Improvement"))
    assert spark.read.parquet(path["policy_scores"]).count() > 100
    again = run_all(spark, panel, results, cfg)
    assert again == path and json.loads((tmp_path / "results/checkpoint.json").read_text())["completed"] == done
