import itertools
import random
import re

import numpy as np

from quillon.llm import langid
from tests.llm.common import SCHEMA, documents, odd_texts

VOICES = {"aa": ["ba", "bo", "bi"], "bb": ["kro", "kri", "kru"], "cc": ["ñe", "ño", "ñu"]}


def _text(draw, lang, n):
    return " ".join("".join(draw.choice(VOICES[lang]) for _ in range(draw.randint(1, 4))) for _ in range(n))


def _table(spark, seed=1, n=160):
    draw = random.Random(seed)
    rows = [(i, _text(draw, lang, draw.randint(5, 60)), lang, "s", 0) for i in range(n) for lang in [draw.choice(list(VOICES))]]
    return spark.createDataFrame(rows, SCHEMA)


def test_marginals_against_all_paths():
    draw = np.random.default_rng(1)
    pot, t = draw.normal(size=(7, 3)), draw.normal(size=(3, 3))
    first = np.array([0, 5, 5, 7])
    got = langid.marginals(pot, first, t, stretch=2)
    for a, b in ((0, 5), (5, 7)):
        sums = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            score = np.log(np.exp(t[:, path[0]]).sum()) + sum(pot[a + i, y] for i, y in enumerate(path)) + sum(t[p, q] for p, q in itertools.pairwise(path))
            for i, y in enumerate(path):
                sums[i, y] += np.exp(score)
        assert np.allclose(got[a:b], sums / sums.sum(axis=1, keepdims=True))


def test_held_out_accuracy_and_mixed_texts(spark):
    docs = _table(spark)
    found = langid.language_digest(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    held = found[found["held_out"]]
    assert len(held) > 10 and (held["lang_pred"] == held["lang"]).mean() > 0.95 and held["score"].between(0, 1).all()
    tagger = langid.train(docs)
    draw = random.Random(8)
    mixed = _text(draw, "aa", 20) + " " + _text(draw, "bb", 20)
    data = np.frombuffer(mixed.encode(), dtype=np.uint8)
    share, _ = langid.word_marginals(tagger, data, np.array([0, len(data)]))
    best = [tagger.labels[i] for i in share.argmax(axis=1)]
    assert best[:18].count("aa") >= 16 and best[22:].count("bb") >= 16


def test_labels_are_no_input_of_a_prediction(spark):
    docs = _table(spark)
    tagger = langid.train(docs)
    swapped = docs.selectExpr("doc_id + 7 as doc_id", "text", "'zz' as lang", "null as source", "n_chars")
    a = sorted((r.text, r.lang_pred, r.score) for r in langid.label_languages(docs, tagger).collect())
    assert a == sorted((r.text, r.lang_pred, r.score) for r in langid.label_languages(swapped, tagger).collect())


def test_odd_rows(spark):
    docs = documents(spark, odd_texts())
    found = {r.doc_id: r for r in langid.language_digest(docs).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 3, 8)) and found[4].lang_pred == "en"
    assert langid.language_digest(docs.limit(0)).count() == 0
    kept = langid.keep_known_languages(docs.withColumnRenamed("source", "score"))
    assert "score" in kept.columns and {r.doc_id for r in kept.collect()} == set(range(4, 14)) - {8}


def test_long_texts_and_rare_languages_are_learned_from(spark):
    draw = random.Random(2)
    rows = [(i, _text(draw, "aa", 20), "aa", "s", 0) for i in range(400)]
    rows += [(1000 + i, _text(draw, "bb", 12_000), "bb", "s", 0) for i in range(12)]
    rows += [(2000 + i, "ñeñoñu ñuñe", "aa" if i % 3 else "cc", "s", 0) for i in range(30)]
    found = {r.doc_id: r.lang_pred for r in langid.language_digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[1000 + i] == "bb" for i in range(12)) and all(found[i] == "aa" for i in range(400))
    # Of one text's labels the one that most rows have counts.
    assert found[2000] == "aa"


def test_the_whole_query_against_a_plain_forward_backward(spark):
    """Every document's language and score, word by word in 64-bit logarithms over its whole text."""
    docs = _table(spark, 5).union(documents(spark, [*odd_texts(), "bobi krokri ñeño " * 90, "Ba1bo-KRO"], 500))
    tagger = langid.train(docs)
    k, known = len(tagger.labels), {int(h): i for i, h in enumerate(tagger.lexicon)}

    def potential(word):
        data = np.frombuffer(word, dtype=np.uint8)
        starts, ends = np.array([0]), np.array([len(data)])
        name = langid.hashes(data, starts, ends)
        features, _ = langid._features(data, starts, ends, tagger.lexicon, name)
        assert features[-1] == (4 << langid.GRAM_BITS) + known.get(int(name[0]), len(known))
        return tagger.weights[features].astype(np.float64).sum(axis=0)

    t, texts = tagger.transitions.astype(np.float64), {r.doc_id: r.text for r in docs.collect()}
    for row in langid.language_digest(docs).collect():
        text = texts[row.doc_id]
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        found = re.findall(rb"[A-Za-z\x80-\xff]+", low)
        if not any(c.isalpha() for c in text or ""):
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        if len(found) > 2000:
            continue  # the long ones repeat one word; their marginals are checked in stretches above
        p = np.array([potential(w) for w in found])
        ahead, back = np.zeros((len(p), k)), np.zeros((len(p), k))
        ahead[0] = np.logaddexp.reduce(t, axis=0) + p[0]
        for i in range(1, len(p)):
            ahead[i] = np.logaddexp.reduce(ahead[i - 1][:, None] + t, axis=0) + p[i]
        for i in range(len(p) - 2, -1, -1):
            back[i] = np.logaddexp.reduce(t + (p[i + 1] + back[i + 1])[None], axis=1)
        joint = ahead + back
        mean = np.exp(joint - np.logaddexp.reduce(joint, axis=1)[:, None]).mean(axis=0)
        assert abs(row.score - mean.max()) < 1e-3 and (tagger.labels[int(mean.argmax())] == row.lang_pred or np.sort(mean)[-1] - np.sort(mean)[-2] < 2e-3)
