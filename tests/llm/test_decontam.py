import hashlib

from quillon.llm import decontam
from tests.llm.common import ALNUM, documents, lower, odd_texts, random_texts


def _plain(docs, items):
    tokens = lambda t: ALNUM.findall(lower(t or ""))
    out = {}
    for i, text in docs:
        own, hit, found = tokens(text), set(), set()
        for item, body in items:
            w = tokens(body)
            m = min(13, len(w))
            windows = {tuple(w[j : j + m]) for j in range(len(w) - m + 1)} if m else set()
            for j in range(len(own) - m + 1):
                if tuple(own[j : j + m]) in windows:
                    hit.update(range(j, j + m))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i] = (len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own))
    return out


ITEMS = [(1, " ".join(f"W{i % 12}" for i in range(30))), (2, "w1 w2"), (10, "w3"), (3, "w5, w6-w7 w8"), (4, None), (5, ""), (6, "W1 W2"), (7, " ".join(["w0"] * 14)), (2, "w1 w2")]


def test_against_a_plain_version(spark, monkeypatch):
    texts = [*random_texts(5, 60), *odd_texts(), "W1, w2!", " ".join(f"w{i % 12}" for i in range(9000))]
    docs = documents(spark, texts)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = _plain([(i + 1, t) for i, t in enumerate(texts)], ITEMS)
    for part_bytes, at_once in ((decontam.PART_BYTES, 8), (60, 8), (60, 1), (40, 2)):
        monkeypatch.setattr(decontam, "PARTS_AT_ONCE", at_once)
        rows = decontam.scan_contamination(docs, bench, ["doc_id"], part_bytes).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == want


def test_empty_tables_and_clashing_names(spark):
    docs = documents(spark, ["w1 w2 w3", None]).withColumnRenamed("lang", "n_hit").withColumnRenamed("source", "item_id")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination_digest(docs, bench).where("contaminated").count() == 0
    assert decontam.contamination_digest(docs.limit(0), bench).count() == 0
    kept = decontam.decontaminate(docs, spark.createDataFrame([(1, "w2")], "item_id long, text string"))
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] == [None]


def test_patterns_of_letters_do_not_collide(spark):
    thue = lambda n, flip: "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))
    items = [(n, thue(n, 0)) for n in (64, 1024, 4096)]
    docs = documents(spark, [thue(n, flip) for n in (64, 1024, 4096) for flip in (0, 1)])
    found = decontam.contamination_digest(docs, spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_hit for r in found] == [1, 0] * 3
