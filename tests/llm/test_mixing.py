import random

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import mixing
from tests.llm.common import documents, odd_texts, parallelism, words


def _naive(weights, seats, limits):
    got = [0] * len(weights)
    for _ in range(min(seats, sum(limits))):
        i = min((i for i in range(len(weights)) if got[i] < limits[i]), key=lambda i: (-weights[i] / (2 * got[i] + 1), i))
        got[i] += 1
    return got


def test_highest_quotients():
    draw = random.Random(3)
    for _ in range(200):
        n = draw.randint(1, 6)
        weights = [draw.choice([0, 1, 2, 5, draw.random() * 50]) for _ in range(n)]
        limits = [draw.randint(0, 40) if w else 0 for w in weights]
        seats = draw.randint(0, 90)
        assert mixing.sainte_lague(weights, seats, limits) == _naive(weights, seats, limits)


def test_capped_targets():
    assert mixing.capped_targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    targets = mixing.capped_targets([100, 1, 50], [1, 2, 3])
    assert targets[1] == 3 and abs(sum(targets) - 151) < 1e-9
    assert mixing.capped_targets([0, 4], [1, 2]) == [0.0, 4.0]


def test_shares_come_near_targets(spark):
    draw = random.Random(1)
    rows = [(i, " ".join("w" * draw.randint(1, 5) for _ in range(draw.randint(1, 300))), ["a", "b", "c", None][min(i % 9, 3)]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_digest(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    assert (found["size"] == found["text"].map(lambda t: len(words(t)))).all()
    assert (found["taken"] <= 3 * found["size"]).all() and (found["taken"] >= 0).all()
    for _, g in found.groupby("source", dropna=False):
        assert g["size"].sum() == g["source_size"].iloc[0]
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.02 * g["target"].iloc[0] + 64
    again = mixing.mix_digest(docs.repartition(5)).toPandas()
    assert found.set_index("doc_id")["taken"].sort_index().equals(again.set_index("doc_id")["taken"].sort_index())


def test_the_whole_query_against_a_plain_version(spark):
    """Sizes and targets by capped_targets; quotas by plain quotients; taken word by word, for every document."""
    draw = random.Random(6)
    rows = [(i, " ".join("w" * draw.randint(1, 5) for _ in range(draw.randint(0, 400))), draw.choice(["z", "é", "a", None, "b"] if i % 50 else [f"rare{i}"])) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_digest(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    names = sorted({r[2] for r in rows if r[2] is not None}, key=str.encode) + [None]
    size = [sum(len(words(r[1])) for r in rows if r[2] == name) for name in names]
    targets = mixing.capped_targets(size, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    for name, n, target in zip(names, size, targets, strict=True):
        own = found[found["source"].isna()] if name is None else found[found["source"] == name]
        assert (own["source_size"] == n).all() and (own["target"] - target).abs().max() < 1e-6
        assert abs(own["taken"].sum() - target) <= mixing.BLOCK_WORDS
    # Every source's shards, every shard's words one by one: its block, and how often the block is taken.
    hashed = docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id", "text"), 20).alias("at"), F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("order"))
    order = {r.doc_id: (r.at, r.order) for r in hashed.collect()}
    lists = {}
    for i, text, name in rows:
        shards = -(-sum(r[2] == name for r in rows) // mixing.ROWS_PER_SHARD)
        lists.setdefault((names.index(name), order[i][0] % shards), []).append((order[i][1], i, len(words(text))))
    held = {k: sum(n for *_, n in v) for k, v in lists.items()}
    blocks = {k: max(1, int(n / mixing.BLOCK_WORDS + 0.5)) for k, n in held.items() if n}
    per_source = {s: sum(b for k, b in blocks.items() if k[0] == s) for s in {k[0] for k in blocks}}
    weights = {s: targets[s] / size[s] * b for s, b in per_source.items()}
    numbers = sorted(weights)
    seats = dict(zip(numbers, _naive([weights[s] for s in numbers], round(sum(weights.values())), [3 * per_source[s] for s in numbers]), strict=True))
    taken = {i: 0 for i, *_ in rows}
    for s in numbers:
        cells = sorted(k for k in blocks if k[0] == s)
        for key, quota in zip(cells, _naive([held[k] for k in cells], seats[s], [3 * blocks[k] for k in cells]), strict=True):
            b, c = blocks[key], held[key]
            salt = mixing.mix(mixing.mix(np.array([s], dtype=np.uint64), mixing.SEED) ^ np.array([key[1]], dtype=np.uint64))
            put = mixing.permuted(np.arange(b), np.full(b, b), np.repeat(salt, b))
            times = [quota // b + (put[j] < quota % b) for j in range(b)]
            at, block = 0, 0
            for _, i, n in sorted(lists[key]):
                for word in range(at, at + n):
                    while word >= (block + 1) * c // b:
                        block += 1
                    taken[i] += int(times[block])
                at += n
    assert found.set_index("doc_id")["taken"].to_dict() == taken
    assert (found["size"] == found["text"].map(lambda t: len(words(t)))).all() and (found["taken"] <= 3 * found["size"]).all()


def test_seats_of_a_table_agree_with_the_plain_rule(spark):
    draw = random.Random(9)
    for n in (1, 3, 40):
        weights = [draw.choice([0.0, 1.0, 2.0, 7.5, draw.random() * 90]) for _ in range(n)]
        limits = [draw.randint(0, 60) for _ in range(n)]
        table = spark.createDataFrame(list(zip(range(n), weights, limits, strict=True)), "number long, weight double, most long")
        for seats in (0, 1, round(sum(weights)), 10_000):
            got = [r.seats for r in mixing._seats(table, seats).orderBy("number").collect()]
            want = [m if w else 0 for w, m in zip(weights, limits, strict=True)]
            assert got == mixing.sainte_lague(weights, seats, want)


def test_a_seeded_permutation():
    for n in (1, 2, 5, 64, 1000, 1025):
        at = np.arange(n)
        assert sorted(mixing.permuted(at, np.full(n, n), np.full(n, 77, dtype=np.uint64)).tolist()) == at.tolist()


def test_copies_keep_the_quota_of_each_source(spark):
    draw = random.Random(12)
    rows = [(i, " ".join("w" * draw.randint(1, 5) for _ in range(draw.randint(1, 300))), draw.choice("abcd")) for i in range(800)] + [(5000, "v " * 300, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.source: r.t for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    got = {r.source: r.t for r in mixing.mixed_copies(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("t")).collect()}
    assert all(abs(got.get(s, 0) - t) <= 300 for s, t in taken.items())


def test_odd_rows(spark):
    docs = documents(spark, odd_texts()).withColumn("taken", F.lit("x"))
    found = mixing.mix_sources(docs)
    assert found.count() == len(odd_texts()) and dict(found.dtypes)["taken"] == "bigint"
    assert found.where("text is null").first()["size"] == 0
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert set(mixing.mixed_copies(docs).columns) == set(docs.columns)
    one = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (None, None, None)], "doc_id long, text string, source string")
    assert mixing.mix_digest(one).agg(F.sum("taken")).first()[0] == 4


def test_the_input_may_be_cut_otherwise_while_it_is_read(spark, tmp_path):
    """No row is lost, doubled or given another's share when files are cut anew between two reads."""
    draw = random.Random(13)
    rows = [(i, " ".join("w" * draw.randint(1, 5) for _ in range(draw.randint(1, 200))), draw.choice("abc"), f"own{i}") for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, other string").repartition(9).write.parquet(str(tmp_path / "t"))
    with parallelism(spark, 4):
        docs = spark.read.parquet(str(tmp_path / "t"))
        mixed, copies, plain = mixing.mix_sources(docs), mixing.mixed_copies(docs), mixing.mix_digest(docs)
    with parallelism(spark, 2):
        found, taken = mixed.toPandas(), {r.doc_id: r.taken for r in plain.collect()}
        got = copies.toPandas()
    assert sorted(found.doc_id) == list(range(1000)) and (found.other == "own" + found.doc_id.astype(str)).all()
    assert (found["size"] == found.text.map(lambda t: len(t.split()))).all() and dict(zip(found.doc_id, found.taken, strict=True)) == taken
    assert (got.other == "own" + got.doc_id.astype(str)).all()
    for source, g in found.groupby("source"):
        assert abs(got[got.source == source].text.map(lambda t: len(t.split())).sum() - g.taken.sum()) <= 200
