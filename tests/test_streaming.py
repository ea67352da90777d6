import datetime

from quillon.streaming import events, maturity

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _write(spark, path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=3 * i + (i % 7)), i % 4, "ab"[i % 2], float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(path)
    late = [(1000, start + datetime.timedelta(days=60), 0, "z", 0.0)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return df


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams_agree_with_tables(spark, tmp_path):
    path = str(tmp_path / "e")
    table = _write(spark, path)
    rows = lambda d: sorted(map(str, d.where("event_type <> 'z'").collect() if "event_type" in d.columns else d.collect()))
    stream = lambda: events.event_stream(spark, path, SCHEMA)
    assert rows(_drain(events.tumbling(stream(), "1 day", "1 day"), "t1")) == rows(events.tumbling(table))
    assert rows(_drain(events.sliding(stream(), delay="1 day"), "t2")) == rows(events.sliding(table))
    assert rows(_drain(events.sessions(stream(), "10 hours", "1 day"), "t3")) == rows(events.sessions(table, "10 hours"))
    assert _drain(events.without_repeats(stream().union(stream())), "t4").where("event_type <> 'z'").count() == 120


def test_outcomes_meet_decisions(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"s{i % 3}", start + datetime.timedelta(i), start + datetime.timedelta(i + 5), -1.0, 1.0, float(i % 4 - 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, date timestamp, mat_ts timestamp, l double, u double, y double")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "d"))
    paired = maturity.pair_outcomes(source().select("id", "date", "mat_ts", "l", "u"), source().select("id", "mat_ts", "y"))
    assert _drain(paired, "p1").count() == 40


def test_scores_wait_for_their_timers(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    path = str(tmp_path / "m")
    schema = "id string, date timestamp, mat_ts timestamp, l double, u double, y double"
    bad = [("a", start, None, -1.0, 1.0, 0.0), ("a", start, start, -1.0, 1.0, None), ("a", start, start, float("nan"), 1.0, 0.0)]
    make = lambda days: [("a", start + datetime.timedelta(i), start + datetime.timedelta(i + 2), -1.0, 1.0, float(i)) for i in days]
    spark.createDataFrame(make(range(30)) + bad, schema).coalesce(1).write.parquet(path)
    spark.createDataFrame(make(range(90, 92)), schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame(make(range(200, 201)), schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = _drain(maturity.score_stream(stream, warmup=5), "m1").orderBy("date").collect()
    # A decision whose outcome is none leaves without a score.
    assert [r.covered for r in got if r.y is None] == [None]
    got = [r for r in got if r.y is not None]
    assert len(got) >= 30 and [r.buffer for r in got[:30]] == list(range(30))
    assert all(r.qhat == 0 for r in got[:5]) and got[29].qhat > 0
    flags = [r.covered for r in got]
    assert [r.coverage for r in got] == [sum(flags[: i + 1][-60:]) / len(flags[: i + 1][-60:]) for i in range(len(got))]


def test_a_restarted_query_goes_on_and_the_end_drains_it(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    schema = "id string, date timestamp, mat_ts timestamp, l double, u double, y double"
    rows = [(f"s{i % 2}", start + datetime.timedelta(i), start + datetime.timedelta(i + 4), -1.0, 1.0, float(i % 5 - 2)) for i in range(40)]
    path = str(tmp_path / "in")
    stream = lambda: maturity.score_stream(spark.readStream.schema(schema).parquet(path), warmup=3)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    spark.createDataFrame(rows[:22], schema).coalesce(1).write.parquet(path)
    maturity.run_to_table(stream(), out, mark)
    first = spark.read.schema(maturity.SCORED).parquet(out).count()
    spark.createDataFrame(rows[22:], schema).coalesce(1).write.mode("append").parquet(path)
    maturity.run_to_table(stream(), out, mark)
    maturity.closing_row(spark, "2025-01-01").coalesce(1).write.mode("append").parquet(path)
    maturity.run_to_table(stream(), out, mark)
    got = spark.read.parquet(out).orderBy("id", "date").collect()
    assert first < 22 and len(got) == 40
    for name in ("s0", "s1"):
        own, scores = [r for r in got if r.id == name], []
        for r, (_, date, _, low, high, y) in zip(own, [x for x in rows if x[0] == name], strict=True):
            q = sorted(scores)[min(int(len(scores) * 0.9), len(scores) - 1)] if len(scores) >= 3 else 0.0
            assert (r.date, r.y, r.buffer, r.qhat, r.l, r.u) == (date, y, len(scores), q, low - q, high + q)
            scores.append(max(low - y, y - high, 0.0))


def test_a_decision_without_outcome_leaves_as_such(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    made = [(f"s{i % 3}", start + datetime.timedelta(i), start + datetime.timedelta(i + 5), -1.0, 1.0) for i in range(20)]
    told = [(r[0], r[2], 0.5) for i, r in enumerate(made) if i % 4]
    far = start + datetime.timedelta(400)
    d = spark.createDataFrame(made, "id string, date timestamp, mat_ts timestamp, l double, u double")
    o = spark.createDataFrame(told, "id string, mat_ts timestamp, y double")
    for name, df, last in (("d", d, [("end", far, far, 0.0, 0.0)]), ("o", o, [("end", far, 0.0)])):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        spark.createDataFrame(last, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    source = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    got = _drain(maturity.pair_outcomes(source("d", d), source("o", o), "30 days"), "never").where("id <> 'end'").collect()
    assert sorted((r.id, r.date, r.y) for r in got if r.y is not None) == sorted((r[0], r[1], 0.5) for i, r in enumerate(made) if i % 4)
    assert sorted((r.id, r.date) for r in got if r.y is None) == sorted((r[0], r[1]) for i, r in enumerate(made) if i % 4 == 0)


def test_a_wait_that_ends_leaves_no_state(spark, tmp_path):
    start, path = datetime.datetime(2024, 1, 1), str(tmp_path / "in")
    schema = "id string, date timestamp, mat_ts timestamp, l double, u double, y double"
    rows = [("a", start + datetime.timedelta(i), start + datetime.timedelta(i + (2 if i % 3 else 5000)), -1.0, 1.0, 3.0) for i in range(12)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    maturity.closing_row(spark, "2025-01-01").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    maturity.run_to_table(maturity.score_stream(stream, wait="20 days"), out, mark)
    got = spark.read.parquet(out).orderBy("date").collect()
    assert [r.y for r in got] == [3.0 if i % 3 else None for i in range(12)] and [r.covered for r in got] == [0 if i % 3 else None for i in range(12)]
    left = spark.read.format("statestore").option("path", mark).option("stateVarName", "pending").load()
    assert left.count() == 0


def test_a_horizons_calibrator_over_all_ids_is_that_of_a_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillon.operators.ranges import trailing_quantile

    start, path = datetime.datetime(2024, 1, 1), str(tmp_path / "in")
    rows = [(f"s{k}", start + datetime.timedelta(i), start + datetime.timedelta(i + h), -1.0, 1.0, float((i * 7 + k * 3 + h) % 9 - 4), h) for i in range(30) for k in range(4) for h in (2, 5)]
    schema = "id string, date timestamp, mat_ts timestamp, l double, u double, y double, h int"
    table = spark.createDataFrame(rows, schema)
    table.repartition(1).write.parquet(path)
    maturity.closing_row(spark, "2025-01-01").withColumn("h", F.lit(0)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    maturity.run_to_table(maturity.score_stream(stream, by="h", window=40, warmup=5), out, mark)
    score = F.greatest(F.col("l") - F.col("y"), F.col("y") - F.col("u"), F.lit(0.0))
    want = {(str(r.h), r.id, r.date): r.q for r in trailing_quantile(table, ["h"], ["date", "id"], score, 40, 0.9, 5, "q").collect()}
    got = {(r.key, r.id, r.date): r.qhat for r in spark.read.parquet(out).collect()}
    assert got == want and len(got) == len(rows)
