import random

import numpy as np

from quillon.llm import components, neardup
from tests.llm.common import documents, lower, odd_texts, words


def _set(text):
    w = words(lower(text or ""))
    return {tuple(w)} if len(w) == 1 else {tuple(w[i : i + 2]) for i in range(len(w) - 1)}


def _plain(texts):
    sets = [_set(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return sorted((i + 1, len(sets[i]), root(i) + 1, root(i) == i) for i in range(len(sets)))


def _texts(seed):
    draw = random.Random(seed)
    bases = [[f"t{draw.randint(0, 400)}" for _ in range(draw.randint(3, 90))] for _ in range(12)]
    out = []
    for _ in range(110):
        w = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 2, 4, 8])):
            w[draw.randrange(len(w))] = f"e{draw.randint(0, 50)}"
        out.append(" ".join(w).upper() if draw.random() < 0.2 else " ".join(w))
    return out


def _found(docs):
    return sorted(tuple(r) for r in neardup.near_duplicate_digest(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_against_a_plain_version(spark):
    texts = _texts(1) + odd_texts()
    assert _found(documents(spark, texts).repartition(3)) == _plain(texts)


def test_leftovers_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE", 3)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 150)
    monkeypatch.setattr(neardup, "LOAD_SHINGLES", 40)
    texts = _texts(2)
    assert _found(documents(spark, texts)) == _plain(texts)


def test_band_and_sketch_chances():
    assert (1 - 0.8**neardup.BAND_ROWS) ** neardup.BANDS < 1e-7
    assert neardup.BANDS * neardup.BAND_ROWS == 2 * neardup.PERMUTATIONS


def test_pairs_just_similar_enough_are_retrieved_and_not_ruled_out():
    """Sets of similarity 0.80 to 0.83 of all sizes: bands shared, and sketch bits in which they differ."""
    draw = np.random.default_rng(5)
    for union in (5, 6, 10, 20, 50, 200, 1000):
        sets = []
        for _ in range(200 if union > 200 else 1000):
            x = draw.integers(0, 1 << 63, union, dtype=np.int64).astype(np.uint64)
            both = int(np.ceil(0.8 * union))
            half = both + (union - both) // 2
            sets += [np.sort(x[:half]), np.sort(np.concatenate([x[:both], x[half:]]))]
        keys, sketch = neardup.band_keys(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
        shared = (keys[0::2] == keys[1::2]).sum(axis=1)
        apart = np.bitwise_count(sketch[0::2] ^ sketch[1::2]).sum(axis=1)
        assert shared.min() > 0 and apart.max() <= neardup.MOST_DIFFERENT
        # The chances that the docstrings state need these means: 32 * 0.8 ** 4 bands, 128 * 0.1 bits.
        assert abs(shared.mean() - 13.1) < 0.6 or union == 6
        assert abs(apart.mean() - 12.8) < 0.6 or union == 6


def test_patterns_of_letters_are_no_copies(spark):
    thue = lambda n, flip: "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))
    texts = [f"{thue(n, flip)} {thue(n, flip)}" for n in (64, 1024, 4096) for flip in (0, 1)]
    assert _found(documents(spark, texts)) == _plain(texts)


def test_dropping_and_odd_tables(spark):
    docs = documents(spark, ["a b c d e", "a b c d e", None, None, "z"]).withColumnRenamed("lang", "id").withColumnRenamed("source", "th")
    kept = neardup.drop_near_duplicates(docs.union(docs.limit(1)))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert neardup.near_duplicate_digest(docs.limit(0)).count() == 0
    unnamed = spark.createDataFrame([(None, "a b c"), (None, "d e f"), (None, "d e f"), (7, "g h"), (7, "i j")], "doc_id long, text string")
    assert sorted(r.text for r in neardup.drop_near_duplicates(unnamed).collect()) == ["a b c", "d e f", "g h", "i j"]
    nulls = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicate_digest(nulls).collect()) == [("7", "7", True), ("7", "None", False), ("None", "None", True)]


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 100), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}
    assert components.components(links.limit(0)).count() == 0


def test_the_smallest_long_is_an_id_and_null_is_none(spark):
    rows = [(-(1 << 63), "a b c d"), (None, "e f g h"), (None, "e f g h"), (3, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in neardup.near_duplicate_digest(docs).collect()), key=str)
    assert found == sorted([(-(1 << 63), 3, -(1 << 63), True), (None, 3, None, True), (None, 3, None, True), (3, 2, 3, True)], key=str)
    kept = sorted((tuple(r) for r in neardup.drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([rows[0], rows[1], rows[3]], key=str)
