import zlib

import pandas as pd

from quillon.llm import sharding
from tests.llm.common import documents, odd_texts, parallelism


def _laws(found: pd.DataFrame, slack: float) -> None:
    for _, g in found.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sizes = found.groupby("shard")["size"].sum().reindex(range(8), fill_value=0)
    assert (sizes - sizes.mean()).abs().max() <= slack


def test_near_equal_bytes_and_gapless_slots(spark):
    texts = [f"text {i} " * (1 + i % 40) for i in range(600)]
    docs = documents(spark, texts)
    found = sharding.shard_digest(docs, 8).toPandas()
    assert len(found) == 600 and set(found["law"]) == {"bytes"} and found["grown_shard"].isna().all()
    _laws(found, max(len(t) for t in texts) + 0.01 * found["size"].sum() / 8)
    again = sharding.shard_digest(docs.repartition(7), 8).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert found.sort_values("doc_id")[key].values.tolist() == again.sort_values("doc_id")[key].values.tolist()


def test_a_hot_group_is_split_and_small_groups_stay_whole(spark):
    texts = ["hot text of one third"] * 300 + [f"pair {i // 2} of equal texts" for i in range(600)]
    found = sharding.shard_digest(documents(spark, texts), 8).toPandas()
    _laws(found, 0.02 * found["size"].sum() / 8 + 60)
    small = found[found["doc_id"] > 300]
    split = small.groupby("text_crc32")["shard"].nunique()
    assert (split > 1).sum() <= 7


def test_rows_that_repeat_are_cut_as_well(spark):
    rows = [(None, None)] * 4000 + [(i, f"text {i}") for i in range(4000)] + [(7, "one row many times over")] * 3000
    found = sharding.shard_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).toPandas()
    assert len(found) == len(rows)
    _laws(found, 0.01 * found["size"].sum() / 8 + 30)


def test_against_the_rows_themselves(spark):
    """Sizes, checksums and the order inside each shard, computed plainly."""
    texts = [f"{'é' * (i % 7)} text {i % 50}" for i in range(500)] + odd_texts()
    found = sharding.shard_digest(documents(spark, texts), 8).toPandas().set_index("doc_id")
    raw = [(t or "").encode() for t in texts]
    assert found["size"].sort_index().tolist() == [len(x) + 1 for x in raw]
    assert found["text_crc32"].sort_index().tolist() == [zlib.crc32(x) for x in raw]
    assert found.groupby("text_crc32")["shard"].nunique().gt(1).sum() <= 7


def test_odd_rows_and_names(spark):
    docs = documents(spark, odd_texts())
    found = sharding.shard_digest(docs, 8).toPandas().set_index("doc_id")
    assert found.loc[1, "size"] == 1 and found.loc[1, "text_crc32"] == 0 and len(found) == len(odd_texts())
    repeated = docs.union(docs).withColumnRenamed("lang", "shard").withColumnRenamed("source", "__range")
    full = sharding.shard_documents(repeated, 3)
    assert full.count() == 2 * len(odd_texts()) and "text" in full.columns
    assert sharding.shard_digest(docs.limit(0), 8).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a"), (5, None)], "doc_id long, text string")
    assert sharding.shard_digest(nulls, 2).count() == 3


def test_the_input_may_be_cut_otherwise_while_it_is_read(spark, tmp_path):
    """Slots stay gapless when a lost executor changes how files are cut between two reads."""
    spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'one row many times over' as text").repartition(9).write.parquet(str(tmp_path / "t"))
    with parallelism(spark, 4):
        placed = sharding.shard_digest(spark.read.parquet(str(tmp_path / "t")), 8)
    with parallelism(spark, 2):
        found = placed.toPandas()
    assert len(found) == 20_000
    _laws(found, 0.01 * found["size"].sum() / 8 + 30)
