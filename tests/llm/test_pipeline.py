import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import langid, mixing, queries
from tests.llm import test_decontam, test_neardup
from tests.llm.common import documents, odd_texts, words


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    texts = [f"the common words of text {i} and its tail {i * 7} stay here" for i in range(60)] + ["the quick brown fox jumps over the lazy dog and runs far away"] * 3 + odd_texts()
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs far away")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    result = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(result) and set(columns) < set(result.columns)
    assert not result["text"].str.contains("quick brown").any() and result["text"].notna().all()
    for _, g in result.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_against_plain_stages(spark, tmp_path):
    """What each stage keeps, by the plain versions of its operator; then the laws of mixing and sharding."""
    draw = random.Random(7)
    common = [f"c{i}" for i in range(400)]
    texts = [" ".join(draw.choice(common) for _ in range(draw.randint(20, 120))) for _ in range(90)]
    for i in range(0, 60, 3):
        w = texts[i].split()
        w[draw.randrange(len(w))] = "changed"
        texts.append(" ".join(w) if i % 2 else texts[i])
    item = " ".join(draw.choice(common) for _ in range(30))
    texts += [item, f"{texts[0]} {item}", f"{' '.join(draw.choice(common) for _ in range(900))} {' '.join(item.split()[:13])}", "123 456", *odd_texts()]
    documents(spark, texts).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i + 1, t) for i, t in enumerate(texts) if t is not None and any(c.isalpha() for c in t)]
    told = test_neardup._plain([t for _, t in kept])
    kept = [kept[i - 1] for i, _, _, first in told if first]
    hit = test_decontam._plain(kept, [(1, item)])
    kept = [(i, t) for i, t in kept if not hit[i][-1]]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, _ in kept)
    result = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    copies, sources = Counter(result["doc_id"]), dict(zip(result["doc_id"], result["source"], strict=True))
    size = {i: len(words(t)) for i, t in kept}
    assert set(copies) <= set(size) and max(copies.values()) <= mixing.MAX_REPEATS
    names = sorted({f"src{(i - 1) % 3}" for i in size})
    total = [sum(n for i, n in size.items() if f"src{(i - 1) % 3}" == name) for name in names]
    for name, target in zip(names, mixing.capped_targets(total, mixing.WEIGHTS[: len(names)]), strict=True):
        assert abs(sum(size[i] * n for i, n in copies.items() if sources[i] == name) - target) <= max(size.values()) + mixing.BLOCK_WORDS
    bytes_of = result.groupby("shard")["size"].sum()
    assert (result["size"] == result["text"].map(lambda t: len(t.encode()) + 1)).all()
    assert abs(bytes_of - result["size"].sum() / 8).max() <= result["size"].max()
    for _, g in result.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_nothing_is_learned_from_nothing(spark):
    docs = documents(spark, ["some words"]).withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_known_languages(docs).count() == 0 and langid.train(docs) is None


def test_every_operator_is_registered_once():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) < set(names)
