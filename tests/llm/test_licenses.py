import random

import numpy as np
import pyarrow as pa

from quillon.llm import licenses
from quillon.llm.words import blocks
from tests.llm.common import documents, odd_texts, words


def _sets(texts):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    out = []
    for part, data, offsets in blocks(batch):
        own, bounds = licenses.shingles(*licenses.normal_words(data, offsets))
        out += [own[bounds[i] : bounds[i + 1]] for i in range(part.num_rows)]
    return out


def test_planted_and_edited_templates(spark):
    draw = random.Random(2)
    filler = lambda n: " ".join(f"f{draw.randint(0, 3000)}" for _ in range(n))
    texts, want = [], []
    for name, template in licenses.TEMPLATES * 3:
        w = template.split()
        if len(w) > 40:
            w[draw.randrange(len(w))] = "changed"
        texts.append(f"{filler(draw.randint(0, 300))} {' '.join(w).upper()} {filler(draw.randint(0, 300))}")
        want.append(name)
    texts.append(filler(5000))
    found = {r.doc_id: r.licenses.split(",") for r in licenses.license_digest(documents(spark, texts)).collect()}
    assert all(name in found[i + 1] for i, name in enumerate(want)) and found[len(texts)] == [""]


def test_matches_are_exact_on_windows():
    template = " ".join(f"t{i}" for i in range(24))
    scanner = licenses.Scanner((("T", template),))
    draw, wanted = random.Random(5), set(_sets([template])[0].tolist())
    for _ in range(80):
        w = template.split()
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(24)] = f"e{draw.randint(0, 9)}"
        text = " ".join([f"a{i}" for i in range(draw.randint(0, 40))] + w + [f"b{i}" for i in range(draw.randint(0, 40))])
        share = len(wanted & set(_sets([text])[0].tolist())) / len(wanted)
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        found = scanner.scan(data, np.array([0, len(data)]))[1][0]
        assert bool(found) == (share >= 0.8)


def test_bands_meet_the_wanted_chance():
    for s in (0.1, 0.3, 0.7, 0.99):
        for rows in (1, 2):
            assert (1 - s**rows) ** licenses.bands_needed(s, rows) <= licenses.MISS * 1.0001


def test_odd_rows(spark):
    docs = documents(spark, odd_texts()).withColumnRenamed("lang", "matches").withColumnRenamed("source", "n_words")
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == len(odd_texts()) and all(r.matches == [] for r in rows)
    assert max(r.n_words for r in rows) == len(words("word " * 30_000))
    assert licenses.license_digest(docs.limit(0)).count() == 0


def test_words_put_into_a_notice():
    draw, scanner = random.Random(11), licenses.Scanner()
    for number, inserted in ((12, (10, 10)), (9, (20,)), (3, (12,)), (13, (20,)), (12, (130,))):
        name, template = licenses.TEMPLATES[number]
        wanted, hit = set(_sets([template])[0].tolist()), 0
        for _ in range(60):
            w = template.split()
            for n in inserted:
                at = draw.randrange(1, len(w))
                w[at:at] = [f"x{draw.randint(0, 9999)}" for _ in range(n)]
            text = " ".join([f"a{i}" for i in range(draw.randint(0, 200))] + w + [f"b{i}" for i in range(draw.randint(0, 200))])
            share = len(wanted & set(_sets([text])[0].tolist())) / len(wanted)
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            found = {n: c for n, _, _, c in scanner.scan(data, np.array([0, len(data)]))[1][0]}
            assert (found.get(number, 0.0) == share) if share >= 0.8 else number not in found
            hit += share >= 0.8
        assert hit > 5, name


def test_a_passage_longer_than_its_reach_is_no_match():
    # Up to four words at the ends can go without losing the share.
    template = [f"t{i}" for i in range(44)]
    scanner = licenses.Scanner((("T", " ".join(template)),))
    for inserted, found in ((0, True), (88, True), (93, False), (500, False)):
        for before in range(60):
            text = " ".join([f"a{i}" for i in range(before)] + template[:22] + [f"x{i}" for i in range(inserted)] + template[22:] + ["z"] * 70)
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            matches = scanner.scan(data, np.array([0, len(data)]))[1][0]
            assert [(s, e) for _, s, e, _ in matches] == ([(before, before + 44 + inserted)] if found else [])


def test_every_occurrence_is_given(spark):
    template = licenses.TEMPLATES[3][1]
    for gap in (0, 5, 400):
        text = f"start {template} {'gap ' * gap}{template} end"
        found = [m for m in licenses.scan_licenses(documents(spark, [text])).first().matches if m.license == "BSD-2-Clause"]
        n = len(licenses.normal_words(*(np.frombuffer(template.encode(), dtype=np.uint8), np.array([0, len(template)])))[0])
        assert [(m.first_word, m.end_word, m.containment) for m in found] == [(1, 1 + n, 1.0), (1 + n + gap, 1 + 2 * n + gap, 1.0)]


def test_the_query_against_all_templates_counted_plainly(spark):
    draw, texts = random.Random(3), []
    for i in range(60):
        name, template = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        w = template.split()
        for _ in range(draw.choice([0, 0, 1, 2, 6])):
            w[draw.randrange(len(w))] = "other"
        texts.append(" ".join([f"a{j}" for j in range(draw.randint(0, 30))] + w + [f"b{j}" for j in range(draw.randint(0, 30))]))
    sets, own = [set(s.tolist()) for s in _sets([t for _, t in licenses.TEMPLATES])], [set(s.tolist()) for s in _sets(texts)]
    for r in licenses.license_digest(documents(spark, texts)).collect():
        # Texts hold one template and filler, so all of a template's shingles lie within its reach.
        shares = {n: len(s & own[r.doc_id - 1]) / len(s) for n, s in enumerate(sets)}
        names = sorted({licenses.TEMPLATES[n][0] for n, share in shares.items() if share >= 0.8 - 1e-12})
        assert (r.licenses, r.n_licenses) == (",".join(names), len(names))
        assert abs(r.containment - max([s for s in shares.values() if s >= 0.8 - 1e-12], default=0.0)) < 1e-12
