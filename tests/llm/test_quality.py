import random

import numpy as np

from quillon.llm import quality
from tests.llm.common import documents, odd_texts


def _tables(spark):
    draw, texts, labels = random.Random(4), [], []
    for i in range(260):
        good = i % 3 > 0
        w = [f"{draw.choice('abcdefgh')}{draw.choice('aeiou')}{draw.choice('nrst')}" for _ in range(draw.randint(20, 80))]
        texts.append(" ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w))
        labels.append((i + 1, int(good), 0))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = _tables(spark)
    found = quality.quality_digest(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = found[found["held_out"]]
    assert len(held) > 20 and (held["predicted"] == held["quality"]).mean() > 0.95
    assert ((found["score"] >= 0.7).astype(int) == found["predicted"]).all() and found["score"].between(0, 1).all()


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = _tables(spark)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality", "toxic")
    a = {r.doc_id: r.score for r in quality.quality_digest(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in quality.quality_digest(docs, flipped).collect()}


def test_odd_rows(spark):
    docs, labels = _tables(spark)
    odd = documents(spark, odd_texts()).withColumnRenamed("lang", "score")
    scored = quality.score_quality(odd, quality.learn(docs, labels))
    assert scored.count() == len(odd_texts()) and scored.where("score is null").count() == 0
    assert quality.quality_digest(odd.limit(0), labels).count() == 0
    nothing = quality.quality_digest(odd.drop("score"), labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}


def test_scores_against_a_plain_vote_and_in_any_batch(spark):
    docs, labels = _tables(spark)
    voters = quality.learn(docs, labels)
    texts = [r.text for r in docs.orderBy("doc_id").limit(120).collect()] + ["", "one"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    counts = quality.term_counts(data, np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))))
    got = quality.vote(voters, counts)
    assert got.tolist() == [float(quality.vote(voters, counts[i : i + 1])[0]) for i in range(len(texts))]
    x = quality._unit(quality._weighted(counts, voters.rarity) @ voters.basis)
    for i, row in enumerate((x @ voters.vectors.T).astype(float)):
        near = sorted(range(len(row)), key=lambda j: (-round(row[j] * 65536), j))[: quality.NEIGHBOURS]
        weights = [(max(round(row[j] * 65536), 0) / 65536) ** 8 for j in near]
        want = sum(w * voters.labels[j] for w, j in zip(weights, near, strict=True)) / sum(weights) if counts[i].sum() else voters.prior
        assert abs(got[i] - want) < 2e-3


def test_the_whole_query_against_a_plain_vote_in_full_space(spark):
    """With fewer labelled texts than latent dimensions the latent space is all they span: cosines are those of plain vectors."""
    docs, labels = _tables(spark)
    few = labels.where("doc_id <= 50")
    texts = {r.doc_id: r.text for r in docs.collect()}

    def vector(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return quality.term_counts(data, np.array([0, len(data)]))[0].astype(np.float64)

    fold = {r.doc_id: r.f for r in docs.select("doc_id", quality.fold_of(docs.doc_id).alias("f")).collect()}
    learned = [(vector(texts[r.doc_id]), r.quality) for r in few.collect() if fold[r.doc_id] != quality.HELD_OUT]
    assert len(learned) < quality.DIMENSIONS
    rarity = np.log((1 + len(learned)) / (1 + sum((c > 0).astype(float) for c, _ in learned))) + 0.3

    def weigh(c):
        x = np.log1p(200 * c / max(c.sum(), 1)) * rarity
        return x / np.linalg.norm(x)

    rows = np.array([weigh(c) for c, _ in learned])
    basis = np.linalg.qr(rows.T)[0]
    unit = lambda x: x / np.linalg.norm(x)
    held = [(unit(basis.T @ r), q) for r, (_, q) in zip(rows, learned, strict=True)]
    for row in quality.quality_digest(docs, few).collect():
        x = unit(basis.T @ weigh(vector(texts[row.doc_id])))
        near = sorted(((float(x @ v), q) for v, q in held), reverse=True)
        best, edge = near[: quality.NEIGHBOURS], near[quality.NEIGHBOURS - 1][0] - near[quality.NEIGHBOURS][0]
        want = sum(max(c, 0) ** 8 * q for c, q in best) / sum(max(c, 0) ** 8 for c, _ in best)
        assert row.held_out == (fold[row.doc_id] == 2) and row.predicted == int(row.score >= 0.7)
        assert abs(row.score - want) < 2e-4 or edge < 1e-4
