"""Decisions and outcomes as streams: pairing by key and time, and a keyed score state with timers."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SCORED = "key string, id string, date timestamp, l double, u double, y double, covered int, buffer int, qhat double, coverage double"


def pair_outcomes(decisions: DataFrame, outcomes: DataFrame, wait: str = "90 days", delay: str = "1 day") -> DataFrame:
    """Decisions (id, date, mat_ts, l, u) joined with outcomes (id, mat_ts, y).

    An outcome is awaited for `wait` after its decision. A decision without one then leaves with a null y and
    its state is dropped, so nothing stays for good and nothing vanishes.
    """
    d = decisions.withWatermark("date", delay).alias("d")
    o = outcomes.withWatermark("mat_ts", delay).alias("o")
    near = F.expr(f"d.id = o.id AND d.mat_ts = o.mat_ts AND o.mat_ts >= d.date AND o.mat_ts <= d.date + INTERVAL {wait}")
    return d.join(o, near, "left_outer").select("d.id", "d.date", "d.mat_ts", "d.l", "d.u", "o.y")


class RollingCalibrator(StatefulProcessor):
    """Per key: holds decisions until event time passes their maturity, scores them, and keeps the last scores
    and the last flags of coverage, whose mean goes out with each score.

    Rows are (key, id, date, mat_ts, l, u, y). A key may be an id, or a horizon with the decisions of all ids: what
    matures at one time is scored in order of date and id. Decisions lie under their time of maturity, so a timer
    reads and removes its own only. Rows with a null or non-finite bound, date or maturity are dropped. A decision
    whose outcome is null or not finite, or that matures later than `wait` after its date, leaves at that time, or
    when the wait ends, with a null y: it teaches nothing, and no state of it is left.
    """

    def __init__(self, window: int = 250, warmup: int = 20, alpha: float = 0.1, flags: int = 60, wait: str = "3650 days"):
        self.window, self.warmup, self.alpha, self.kept = max(30, window), warmup, alpha, max(10, flags)
        self.wait = int(pd.Timedelta(wait).total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "at long", "rows string")
        self.scores = handle.getListState("scores", "s double")
        self.flags = handle.getListState("flags", "f int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for frame in rows:
            whole = frame.dropna(subset=["date", "mat_ts", "l", "u"])
            due: dict[int, list] = {}
            for r in whole[np.isfinite(whole[["l", "u"]].astype(float)).all(axis=1)].itertuples():
                made, at = int(pd.Timestamp(r.date).timestamp() * 1e6), int(pd.Timestamp(r.mat_ts).timestamp() * 1000)
                given_up = made // 1000 + self.wait
                y = None if r.y is None or not math.isfinite(r.y) or at > given_up else float(r.y)
                due.setdefault(min(at, given_up), []).append([made, r.id, float(r.l), float(r.u), y])
            for at, own in due.items():
                held = json.loads(self.pending.getValue((at,))[0]) if self.pending.containsKey((at,)) else []
                self.pending.updateValue((at,), (json.dumps(held + own),))
                self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        at = (expiredTimerInfo.getExpiryTimeInMs(),)
        if not self.pending.containsKey(at):
            return
        due = sorted(json.loads(self.pending.getValue(at)[0]), key=lambda r: (r[0], r[1] or ""))
        self.pending.removeKey(at)
        scores, flags, out = [s[0] for s in self.scores.get()], [f[0] for f in self.flags.get()], []
        for made, name, low, high, y in due:
            q = sorted(scores)[min(int(len(scores) * (1 - self.alpha)), len(scores) - 1)] if len(scores) >= self.warmup else 0.0
            n = len(scores)
            covered = None if y is None else int(low - q <= y <= high + q)
            if y is not None:
                flags = [*flags, covered][-self.kept :]
                scores = [*scores, max(low - y, y - high, 0.0)][-self.window :]
            out.append((str(key[0]), name, pd.Timestamp(made, unit="us"), low - q, high + q, y, covered, n, q, sum(flags) / len(flags) if flags else None))
        if scores:
            self.scores.put([(s,) for s in scores])
            self.flags.put([(f,) for f in flags])
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in SCORED.split(", ")])
        yield frame.astype({"y": "float64", "coverage": "float64", "covered": "Int32"})

    def close(self) -> None:
        pass


def score_stream(rows: DataFrame, delay: str = "1 day", by: str = "id", **options) -> DataFrame:  # noqa: ANN003
    """Calibrated scores of a stream of (id, date, mat_ts, l, u, y), as they mature. Needs the RocksDB state store.

    `by` names the column that shares a calibrator: the id, or the horizon for one over all ids.
    """
    keyed = rows.withWatermark("date", delay).select(F.col(by).cast("string").alias("key"), "id", "date", "mat_ts", "l", "u", "y").groupBy("key")
    return keyed.transformWithStateInPandas(RollingCalibrator(**options), SCORED, "Append", "EventTime")


def closing_row(spark: SparkSession, at: str) -> DataFrame:
    """A row that ends the input of `score_stream`: its date moves event time to `at`, so all that matures before
    goes out; it matures never itself. What would mature later stays undecided, as it does in a run over tables."""
    null = F.lit(None)
    return spark.range(1).select(
        F.lit("").alias("id"), F.lit(at).cast("timestamp").alias("date"), null.cast("timestamp").alias("mat_ts"), *[null.cast("double").alias(c) for c in ("l", "u", "y")]
    )


def run_to_table(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream scores to a Parquet table until its present input is used up.

    State, watermark and files read are kept under `checkpoint` (a folder that all executors share), so
    the next start goes on where this one, or one that was cut short, stopped.
    """
    query = scored.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
