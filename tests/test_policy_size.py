"""What runs write and send: a row per horizon that any run chose, not one per run; index series in one pass."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import aggregates as A
from quillon.plans import policy as P
from quillon.sources import intermediate
from tests.test_policy import CFG, RUNS, _all, _slice


def _run(spark, frame, runs):
    """The table of a slice with index weights, and the log of runs over it."""
    rows = frame.assign(x=frame["x"].map(lambda x: [float(v) for v in x]), index_weight=[0.5 + i % 7 for i in range(len(frame))])
    names, kinds = ["date", "id", "x", "index_weight"], "date date, id string, x array<double>, index_weight double"
    for h in CFG.horizons:
        names += [f"y_h{h}", f"alive_h{h}", f"mat_date_h{h}"]
        kinds += f", y_h{h} double, alive_h{h} int, mat_date_h{h} date"
    table = spark.createDataFrame(list(rows[names].itertuples(index=False, name=None)), kinds)
    sample = [(r["x"], {h: r[f"y_h{h}"] for h in CFG.horizons}) for r in frame.head(12).to_dict("records")]
    return table, P.run_slice(table, sample, runs, {3: 0.02, 6: 0.02})


def _written(spark, label):
    return [p for p in intermediate._written[spark.sparkContext.applicationId] if f"/{label}-" in p]


def test_inputs_are_written_once_per_horizon_however_many_runs(spark):
    # Inputs used to be written, and sent to the heads, once per run.
    frame = _slice(6)
    frame.loc[frame.index % 5 == 0, "y_h6"] = float("nan")
    runs = [*RUNS, *(P.Run(f"again {i}", "fixed", CFG, ("mom_w21", 6)) for i in range(20))]
    table, log = _run(spark, frame, runs)
    decided = spark.read.parquet(_written(spark, "decisions")[-1])
    assert decided.groupBy("date", "id", "h").count().where("count > 1").isEmpty()
    assert decided.count() <= len(CFG.horizons) * len(frame) < log.count() == decided.select(F.sum(F.size("made"))).first()[0]
    # What is written of a block is what was learned: a row per run, arm and date, and one per run, horizon and date.
    rows = [spark.read.parquet(p).count() for p in _written(spark, "matured")[-6:]]
    assert max(rows) <= len(runs) * (4 + 2) * min(CFG.horizons)
    weights = {(r.date, r.id): r.index_weight for r in table.collect()}
    assert all(r.index_weight == weights[r.date, r.id] for r in log.collect())
    again = sorted((r.date, r.id, r.h, r.l, r.u) for r in log.where("run = 'again 7'").collect())
    assert again == sorted((r.date, r.id, r.h, r.l, r.u) for r in log.where("run = 'again 19'").collect()) and len(again) > 50


def test_runs_are_the_same_alone_and_side_by_side(spark):
    together, frame = _all(spark, _slice(7, 3), RUNS), _slice(7, 3)
    for run in RUNS[:2]:
        key = lambda r: (r["date"], r["id"])
        for a, b in zip(sorted(together[run.name], key=key), sorted(_all(spark, frame, [run])[run.name], key=key), strict=True):
            assert {k: v for k, v in a.items() if not isinstance(v, float)} == {k: v for k, v in b.items() if not isinstance(v, float)}
            assert all(a[k] == pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in b.items() if isinstance(v, float))


def test_index_series_and_leaderboard_take_one_pass(spark):
    # Rows used to be sent and sorted by group for their shares of its weight, after a join for the weights.
    some = spark.range(60).selectExpr("concat('p', id % 2) as baseline", "date_add(date'2020-01-01', cast(id % 3 as int)) as date", "cast(id % 4 as int) as h", "id % 7 / 8D as index_weight", "cast(id as double) as y", "1D as l", "2D as u", "id / 3D as width_scaled", "id * id / 9D as loss_scaled", "cast(id % 2 as int) as covered", "0.1D as alpha")
    for made in (A.leaderboard(A.with_weights(some, None, 0.0)), A.security_to_index(some, ("baseline", "date", "h"))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
    rows, groups = some.toPandas(), {}
    for r in rows.itertuples():
        groups.setdefault((r.baseline, r.date, r.h), []).append(r)
    for r in A.security_to_index(some, ("baseline", "date", "h")).collect():
        own = groups[r.baseline, r.date, r.h]
        assert r.loss_scaled == pytest.approx(sum(o.loss_scaled * o.index_weight for o in own) / sum(o.index_weight for o in own))
    for r in A.leaderboard(some).collect():
        daily = [sum(o.loss_scaled * o.index_weight for o in own) / (sum(o.index_weight for o in own) + 1e-12) for k, own in groups.items() if k[0] == r.baseline]
        assert r.mean_loss_scaled == pytest.approx(sum(daily) / len(daily)) and r.n_predictions == 30
    assert A.with_weights(some.withColumn("index_weight", F.lit(None).cast("double")), None, 0.25).select("index_weight").distinct().collect()[0][0] == 0.25
