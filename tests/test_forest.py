"""Forests against a plain version that grows one tree at a time, on small and large nodes, and on hostile rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from quillon.operators.forest import Growth, bag, crossfit
from quillon.sources.intermediate import released

NAMES = ["a", "b", "c"]


def _rows(spark, n=420, models=2):
    """Whole-number labels and inputs, so that sums are exact; a third of the rows tests, the rest trains."""
    rng = np.random.default_rng(5)
    out = []
    for m in range(models):
        for i in range(n):
            a, b, c = int(rng.integers(0, 40)), int(rng.integers(0, 7)), int(rng.integers(0, 2))
            out.append((m, "test" if i % 3 == 0 else "train", i, float(a), float(b), float(c), float(int(a > 17) * 8 + b * c + rng.integers(0, 3)), float(1 + i % 2)))
    return spark.createDataFrame(out, "model int, role string, id long, a double, b double, c double, y double, w double").repartition(3)


def _plain_tree(rows, depth, leaf, level=0):
    """rows: (x, y, weight); the tree that lowers squared error most, cuts between values, first input and value on ties."""
    weight, total = sum(r[2] for r in rows), sum(r[1] * r[2] for r in rows)
    best = (1e-12 * total * total / weight, None)
    if level < depth:
        for i in range(len(NAMES)):
            for v in sorted({r[0][i] for r in rows})[:-1]:
                left, right = [r for r in rows if r[0][i] <= v], [r for r in rows if r[0][i] > v]
                if min(len(left), len(right)) < leaf:
                    continue
                gain = sum(sum(r[1] * r[2] for r in s) ** 2 / sum(r[2] for r in s) for s in (left, right)) - total * total / weight
                if gain > best[0] * (1 + 1e-9) + 1e-9 * (best[1] is not None):
                    best = (gain, (i, v))
    if best[1] is None:
        return total / weight
    i, v = best[1]
    return i, v, _plain_tree([r for r in rows if r[0][i] <= v], depth, leaf, level + 1), _plain_tree([r for r in rows if r[0][i] > v], depth, leaf, level + 1)


def _plain(rows, g, inputs=NAMES):
    keys = {r.id: k for r, k in rows}
    told = {}
    for m in {r.model for r, _ in rows}:
        train = [r for r, _ in rows if r.model == m and r.role == "train"]
        trees = []
        for t in range(g.trees):
            times = bag(np.array([keys[r.id] for r in train], np.int64), t, g.seed)
            trees.append(_plain_tree([((r.a, r.b, r.c), r.y, r.w * k) for r, k in zip(train, times.tolist(), strict=True) if k], g.depth, g.leaf))
        for r in [r for r, _ in rows if r.model == m and r.role == "test"]:
            total = []
            for tree in trees:
                while isinstance(tree, tuple):
                    tree = tree[2] if r[inputs[tree[0]]] <= tree[1] else tree[3]
                total.append(tree)
            told[m, r.id] = math.fsum(total) / g.trees
    return told


def _told(df, name="oof"):
    return {(r.model, r.id): r[name] for r in df.collect()}


def _same(a, b):
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-9) for k in a)


def test_bags_are_poisson_and_depend_on_key_tree_and_seed():
    keys = np.arange(200_000, dtype=np.int64) * 7919 - 5
    times = bag(keys, 3, 42)
    for k in range(4):
        assert abs((times == k).mean() - math.exp(-1) / math.factorial(k)) < 0.004
    assert (times[::-1] == bag(keys[::-1], 3, 42)).all()
    for other in (bag(keys, 4, 42), bag(keys, 3, 43)):
        assert abs(np.corrcoef(times, other)[0, 1]) < 0.01


def test_same_as_one_tree_at_a_time_wherever_nodes_are_grown(spark):
    with released(spark):
        rows = _rows(spark)
        g = Growth(trees=28, depth=4, leaf=9, bins=256)
        want = _plain([(r, r.k) for r in rows.withColumn("k", F.xxhash64("id")).collect()], g)
        local = _told(crossfit(rows, NAMES, "y", ["id"], "w", g=g))
        assert _same(local, want)
        # Nodes of more than 60 rows level by level, in several blocks of trees; then all nodes level by level.
        for rows_at_most, cuts in ((60, 60_000), (0, 1 << 20)):
            large = _told(crossfit(rows, NAMES, "y", ["id"], "w", g=Growth(trees=28, depth=4, leaf=9, bins=256, local_rows=rows_at_most or 1, cut_bytes=cuts)))
            assert _same(large, want)


def test_one_model_large_and_one_small(spark):
    with released(spark):
        rows = _rows(spark).where("model = 0 or id < 90")
        both = _told(crossfit(rows, NAMES, "y", ["id"], "w", g=Growth(trees=6, depth=5, leaf=3, local_rows=100)))
        assert _same(both, _told(crossfit(rows, NAMES, "y", ["id"], "w", g=Growth(trees=6, depth=5, leaf=3))))


def test_further_predictions_from_other_columns(spark):
    with released(spark):
        rows = _rows(spark, 200, 1).withColumn("z", 1 - F.col("c"))
        out = crossfit(rows, NAMES, "y", ["id"], also={"same": NAMES, "other": ["a", "b", "z"]}, g=Growth(trees=5, depth=4, leaf=4))
        turned = crossfit(rows.withColumn("c", F.when(F.col("role") == "test", F.col("z")).otherwise(F.col("c"))), NAMES, "y", ["id"], g=Growth(trees=5, depth=4, leaf=4))
        assert _same(_told(out), _told(out, "same")) and _same(_told(out, "other"), _told(turned))
        assert any(abs(v - _told(out)[k]) > 0.5 for k, v in _told(out, "other").items())


def test_nulls_ties_repeats_and_models_without_rows(spark):
    with released(spark):
        some = [(0, "train", i % 4, None if i == 3 else 1.0, 2.0, 0.0, None if i == 5 else 3.0, 0.0 if i == 7 else 1.0) for i in range(60)]
        some += [(0, "test", 100, None, 2.0, 0.0, None, None), (0, "test", 100, 1.0, 2.0, 0.0, 3.0, 1.0), (1, "test", 101, 1.0, 2.0, 0.0, 3.0, 1.0)]
        rows = spark.createDataFrame(some, "model int, role string, id long, a double, b double, c double, y double, w double")
        out = crossfit(rows, NAMES, "y", ["id"], "w", g=Growth(trees=3, depth=3, leaf=2))
        assert sorted((r.model, r.id, r.oof) for r in out.collect() if r.oof is not None) == [(0, 100, 3.0), (0, 100, 3.0)]
        assert out.where("oof is null").count() == 1
        none = crossfit(rows.where("role = 'test'"), NAMES, "y", ["id"], g=Growth(trees=3))
        assert none.count() == 3 and none.where("oof is not null").isEmpty()
        assert crossfit(rows.limit(0), NAMES, "y", ["id"], g=Growth(trees=3)).isEmpty()


def test_means_beat_the_overall_mean_out_of_fold(spark):
    with released(spark):
        out = crossfit(_rows(spark, 900, 1), NAMES, "y", ["id"], "w", g=Growth(trees=40, depth=6, leaf=5)).select("y", "oof").toPandas()
        assert ((out.y - out.oof) ** 2).mean() < 0.2 * out.y.var()


def test_wide_models_travel_once_per_group_of_trees(spark, monkeypatch):
    # Models of more than 200,000 rows used to send each node's rows once per tree.
    from quillon.operators import forest

    monkeypatch.setattr(forest, "_level", None)
    with released(spark):
        rows = spark.range(200_200).selectExpr("0 as model", "case when id < 200 then 'test' else 'train' end as role", "id", "cast(id % 50 as double) as a", "cast(id % 7 as double) as b", "0.0 as c", "cast(id % 50 as double) as y")
        rows = rows.unionByName(rows.where("role = 'train'").limit(400).withColumn("id", F.col("id") + 1_000_000))
        out = crossfit(rows, NAMES, "y", ["id"], g=Growth(trees=3, depth=8, leaf=5)).select("y", "oof").toPandas()
        assert len(out) == 200 and (out.y - out.oof).abs().max() < 1e-9


def test_larger_child_is_the_difference(monkeypatch):
    from quillon.operators import forest

    rng = np.random.default_rng(2)
    bins, y, w = rng.integers(0, 9, (900, 3)).astype(np.uint8), rng.normal(size=900), rng.integers(1, 4, 900) * 0.1
    offsets, g = np.array([0, 9, 18, 27]), Growth(depth=7, leaf=4)
    want = forest.grow(bins, y, w, offsets, Growth(depth=7, leaf=4), 1)
    monkeypatch.setattr(forest, "CELLS", 1)  # no parents' sums are held: every node is added up
    plain = forest.grow(bins, y, w, offsets, g, 1)
    assert all((a == b).all() for a, b in zip(want[:3], plain[:3], strict=True)) and np.allclose(want[3], plain[3])


def test_rows_alike_and_one_hot_inputs_are_added_up_once(monkeypatch):
    # Every row and every one-hot input used to be added up by itself, for every tree and level.
    from quillon.operators import forest

    rng = np.random.default_rng(8)
    kinds, arm = rng.integers(0, 6, (300, 3)).astype(np.uint8), rng.integers(0, 5, 300)
    some = np.concatenate([kinds, (arm[:, None] == np.arange(1, 5)).astype(np.uint8), np.zeros((300, 1), np.uint8)], axis=1)
    bins = np.concatenate([some] * 12)[rng.permutation(3600)]
    offsets, g = np.array([0, 6, 12, 18, 20, 22, 24, 26, 27]), Growth(depth=9, leaf=3)
    for y, w in ((rng.integers(-9, 9, 3600).astype(float), np.ones(3600)), (rng.normal(size=3600), rng.integers(1, 9, 3600) * 0.125)):
        times = bag(np.arange(3600), 5, 42)
        monkeypatch.setattr(forest, "JOINED", 1 << 40)
        plain = forest.Prepared(bins, y, w, offsets)
        assert plain.columns.shape == (4, 3600) and not plain.joint
        want = plain.grow(times, g)
        monkeypatch.setattr(forest, "JOINED", 1)
        rows = forest.Prepared(bins, y, w, offsets)
        assert rows.columns.shape == (4, len(np.unique(some, axis=0))) and len(rows.joint) == 2
        got = rows.grow(times, g)
        assert len(want[0]) > 100 and all((a == b).all() for a, b in zip(want[:3], got[:3], strict=True)) and np.allclose(want[3], got[3])
        # Each leaf has the mean of its rows in the bag, and no fewer than it must keep.
        node = np.ones(3600, np.int64)
        cuts = {n: (c, b) for n, c, b in zip(*[v.tolist() for v in got[:3]], strict=True)}
        for _ in range(g.depth):
            node = np.array([2 * n + (r[cuts[n][0]] > cuts[n][1]) if cuts[n][0] >= 0 else n for n, r in zip(node.tolist(), bins, strict=True)])
        for n, mean in zip(got[0].tolist(), got[3].tolist(), strict=True):
            on = (node == n) & (times > 0)
            if on.any():
                assert cuts[n][0] < 0 and on.sum() >= 3 and np.isclose(mean, np.average(y[on], weights=(w * times)[on]))
    assert forest.alike(bins[:1]) is None and forest.alike(rng.integers(0, 255, (50, 8)).astype(np.uint8)) is None


def test_bags_are_those_of_the_search():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 300_000)
    mixed = keys.astype(np.uint64) ^ np.uint64((43 * 0x9E3779B97F4A7C15 + 8 * 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    share = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    assert (bag(keys, 7, 42) == np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(17)]), share, side="right")).all()
