"""Operators over ranges against plain lists, with one key, many keys, ties, nulls and ranges shorter than the window."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions.quantiles import index_quantile
from quillon.operators import ranges as R
from quillon.operators.windows import percentile_rank


@pytest.fixture(scope="module")
def many(spark):
    """Small partitions, so that ranges are many and some keys lie in several."""
    names = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _rows(seed, n, keys):
    draw = random.Random(seed)
    return [(draw.choice(keys), i, draw.choice([None, *[round(draw.gauss(0, 1), 1) for _ in range(6)]]), i % 7) for i in range(n)]


SCHEMA = "k string, i int, v double, other int"


@pytest.mark.parametrize("keys", [["a"], ["a", "b", None], [str(i) for i in range(40)]])
def test_running_totals(many, keys):
    rows = _rows(1, 300, keys)
    got = {r.i: (r.before, r.total) for r in R.running_total(many.createDataFrame(rows, SCHEMA).repartition(5), ["k"], ["i"], "other").collect()}
    for k, i, _, _ in rows:
        own = [r for r in rows if r[0] == k]
        assert got[i] == (sum(r[3] for r in own if r[1] < i), sum(r[3] for r in own))


@pytest.mark.parametrize("keys", [["a"], ["a", "b", None]])
def test_percentiles_of_groups_and_of_all(many, keys):
    rows = _rows(2, 400, keys) + [("only null", 1000, None, 0), ("a", 1001, float("nan"), 0)]
    shares, names = (0.0, 0.25, 0.5, 0.99, 1.0), ("p0", "p25", "p50", "p99", "p100")
    found = R.percentiles(many.createDataFrame(rows, SCHEMA), ["k"], "v", shares, names, rollup=True).collect()
    groups = [[r[2] for r in rows if r[0] == k and r[2] is not None and r[2] == r[2]] for k in keys] + [[r[2] for r in rows if r[2] is not None and r[2] == r[2]]]
    want = sorted([tuple(np.round(np.quantile(g, shares), 9)) for g in groups])
    assert sorted(tuple(np.round([r[n] for n in names], 9)) for r in found) == want
    assert R.percentiles(many.createDataFrame([], SCHEMA), ["k"], "v", shares, names, rollup=True).count() == 0


@pytest.mark.parametrize("keys", [["2020-01-01"], ["2020-01-01", "2020-01-02", "2020-01-03"]])
def test_ranks_from_counts_are_those_of_windows(many, keys):
    df = many.createDataFrame(_rows(3, 240, keys) + [("2020-02-01", 900 + i, float(i), 0) for i in range(9)], SCHEMA).withColumnRenamed("k", "date")
    got = {r.i: (r.a, r.b) for r in R.percentile_ranks(df, {"a": "v", "b": "other"}).collect()}
    want = {r.i: (r.a, r.b) for r in df.select("i", percentile_rank(F.col("v")).alias("a"), percentile_rank(F.col("other")).alias("b")).collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-12 for i in want for x, y in zip(got[i], want[i], strict=True))


@pytest.mark.parametrize("keys", [["a"], ["a", "b", None], [str(i) for i in range(40)]])
@pytest.mark.parametrize("n", [1, 5, 120])
def test_trailing_frames(many, keys, n):
    """120 rows are more than a range holds, so rows of several ranges stand before one."""
    df = many.createDataFrame(_rows(4, 300, keys), SCHEMA).repartition(6)
    frame = lambda spec: {"total": F.sum("v").over(spec.rowsBetween(-n, 0)), "lag": F.lag("i", n).over(spec)}
    got = R.trailing(df, ["k"], ["i"], n, {c: (lambda spec, c=c: frame(spec)[c]) for c in ("total", "lag")})
    want = df.withColumns(frame(Window.partitionBy("k").orderBy("i")))
    rounded = lambda t: {r.i: (r.k, r.v, None if r.total is None else round(r.total, 9), r.lag) for r in t.collect()}
    assert rounded(got) == rounded(want) and len(rounded(got)) == 300
    written = R.with_rows_before(df, ["k"], ["i"], n)
    assert written.select("__at").distinct().count() > 3


@pytest.mark.parametrize("keys", [["a"], ["a", "b"]])
def test_trailing_quantiles(many, keys):
    df = many.createDataFrame(_rows(5, 400, keys), SCHEMA).repartition(6)
    got = {r.i: r.q for r in R.trailing_quantile(df, ["k"], ["i"], F.col("v"), 50, 0.9, 20, "q").collect()}
    values = F.collect_list("v").over(Window.partitionBy("k").orderBy("i").rowsBetween(-50, -1))
    want = {r.i: r.q for r in df.select("i", F.when(F.size(values) >= 20, index_quantile(values, 0.9)).otherwise(0.0).alias("q")).collect()}
    assert got == want and len(got) == 400
    assert R.trailing_quantile(df.limit(0), ["k"], ["i"], F.col("v"), 50, 0.9, 20, "q").count() == 0
