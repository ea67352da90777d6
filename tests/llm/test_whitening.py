"""Whitening against numpy's eigenvectors of exactly summed rows."""

from fractions import Fraction

import numpy as np
import pytest

from quillon.llm.whitening import identity_error, whiten, whitening_digest

SCHEMA = "vec_id long, embedding array<float>, label int"


def _plain(vectors):
    """n, deviations, whitened up to sign, explained shares: in exact numbers as far as they can be."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviations = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    centred = np.array([[float(Fraction(n * r[j] - sums[j], n)) for j in range(d)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values > max(values.max(), 1e-300) * 1e-12).sum())
    return n, deviations, centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def _check(frame, vectors, limit=32):
    n, deviations, white, shares = _plain(vectors)
    k = min(limit, white.shape[1])
    rows = frame.sort_values(["vec_id", "component"])
    assert len(rows) == n * k and set(rows.n) == {n} and list(rows.component[:k]) == list(range(1, k + 1))
    got = rows.whitened.to_numpy().reshape(n, k)
    sign = np.sign((got * white[:, :k]).sum(axis=0))
    assert np.abs(got * sign - white[:, :k]).max() < 1e-6
    assert [int(v) for v in rows.deviation[::k]] == deviations
    assert np.allclose(rows.explained[:k], shares[:k], rtol=1e-9)
    assert rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-6


@pytest.mark.parametrize("rows, dims, seed", [(60, 5, 1), (200, 40, 2), (90, 110, 3)])
def test_same_as_plain(spark, rows, dims, seed):
    draw = np.random.default_rng(seed)
    vectors = (draw.normal(size=(rows, dims)) * np.linspace(1, 3, dims)).astype(np.float32).tolist()
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    _check(whitening_digest(table).toPandas(), vectors)


def test_odd_rows(spark):
    draw = np.random.default_rng(4)
    good = draw.normal(size=(30, 3)).astype(np.float32).tolist()
    good += [good[0]] * 20  # a hot vector
    nan, inf = float("nan"), float("inf")
    bad = [None, [1.0, None, 2.0], [nan, 1.0, 2.0], [inf, 1.0, 2.0], [1.0, -inf, 0.0], [], [1.0, 2.0], [3e38, 1.0, 1.0]]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(1000 + i, v, 0) for i, v in enumerate(bad)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as z", "3 as w", "4 as v", "5 as deviation")
    _check(whitening_digest(table).toPandas(), good)


def test_repeated_and_null_ids_stay(spark):
    vectors = [[float(i), float(i * i % 7)] for i in range(9)]
    rows = [(None if i % 3 else 5, v, 0) for i, v in enumerate(vectors)]
    out = whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(out) == 9 and out.vec_id.isna().sum() == 6 and out.identity_error.iloc[0] < 1e-9


def test_large_entries_keep_exact_deviations(spark):
    # 64-bit arithmetic would overflow: deviations that don't fit a long are null, the rest is exact.
    vectors = [[float(2**31 * (i % 3)), float(i)] for i in range(12)]
    rows = whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)).toPandas().sort_values("vec_id")
    _, deviations, _, shares = _plain(vectors)
    assert [None if np.isnan(v) else int(v) for v in rows.deviation] == [v if v < 1 << 63 else None for v in deviations]
    assert np.allclose(rows.explained.iloc[0][0], shares[0])


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [None, []]])
def test_without_variance_there_is_no_component(spark, vectors):
    out = whitening_digest(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_fewer_components_than_asked(spark):
    # Three dimensions of which one is twice another: two directions vary.
    draw = np.random.default_rng(5)
    a, b = draw.integers(-9, 9, 40), draw.integers(-9, 9, 40)
    vectors = [[float(x), float(2 * x), float(y)] for x, y in zip(a, b, strict=True)]
    out = whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)).toPandas()
    assert {len(w) for w in out.whitened} == {2} and out.identity_error.iloc[0] < 1e-8


def test_identity_error_sees_a_wrong_scale(spark):
    rows = spark.createDataFrame([(i, [2.0 * (-1) ** i]) for i in range(10)], "i int, w array<double>")
    assert abs(identity_error(rows, 10) - 3.0) < 1e-12
