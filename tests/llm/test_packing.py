"""Packing against the tokenizer text by text, and the laws of sequences."""

import zlib

import numpy as np
import pytest

from quillon.llm.packing import TOKENIZER, Encoder, last_stretches, pack_documents, packing_digest, piece_lengths, sequences
from tests.llm.common import documents, odd_texts, random_texts

TRICKY = [
    "The cat's hat, it'll do; we've 'tis rock'n'roll x's,y 's 'st ''s",
    "A1b2,c3!d é É ẖ H̱ ≮ ≠ a,́b  x y",
    "ΣΑΣ ΟΔΟΣ. Straße İstanbul ǅ ﬁ Å Å",
    "漢字かな混じり文 한국어 \U0001f600\U0001f468‍\U0001f469 ---***===",
    "x\x0by\x0cz\x1c\x1d\x00q\x7f|pipe|pipe `tick` ~^",
    "https://Example.com/a?b=c&d=E#f 3.14159 1,000,000 v2.0-rc1",
    "words <|endoftext|> and <|startoftext|>,x <|EndOfText|>",
]


def _laws(rows, texts_by_id, encoder, capacity=2048, end_id=1):
    """Every id in one piece, sums of checks, sequences without gaps; gives the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts_by_id.keys()
    for key, text in texts_by_id.items():
        ids, at = np.append(encoder.plain(text or ""), end_id).astype("<u4"), 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= capacity
        padding, total = padding + (0 if at & (at - 1) == 0 else capacity - at), total + at
    return padding / max(total, 1)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(TOKENIZER)


def test_words_once_are_texts_whole(encoder):
    texts = [*TRICKY, *[t or "" for t in odd_texts()], *random_texts(3, 40)]
    for group in (texts[:6], texts[7:], texts):
        raw = [t.encode() for t in group]
        ids, upto = encoder.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        for i, t in enumerate(group):
            assert ids[upto[i] : upto[i + 1]].tolist() == encoder.plain(t).tolist(), t[:60]


def test_a_small_memory_forgets(encoder):
    small, texts = Encoder(TOKENIZER, 3), ["one two three four", "five six one", "seven"]
    for t in texts:
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        assert small.encode(raw, np.array([0, len(raw)]))[0].tolist() == encoder.plain(t).tolist()
    assert len(small._known) <= 4


def test_piece_lengths_are_reciprocal_shares():
    for capacity in (1, 7, 64, 2048):
        for n in range(3 * capacity + 1):
            parts = piece_lengths(n, capacity)
            assert sum(parts) == n and all(capacity // (capacity // p) == p for p in parts) and parts == sorted(parts, reverse=True)
    assert max(len(piece_lengths(n)) for n in range(2048)) <= 6


def test_last_stretches_need_no_padding():
    assert last_stretches(5000) == [2048, 2048, 512, 256, 128, 8] and last_stretches(0) == []


def test_laws_on_odd_and_plain_texts(spark, encoder):
    texts = [*odd_texts(), *TRICKY, *random_texts(5, 150), *["same text again and again"] * 300]
    table = documents(spark, texts).repartition(4).selectExpr("*", "1 as key", "2 as ids", "3 as task", "4 as number", "5 as place", "6 as held", "7 as k")
    out = packing_digest(table)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert _laws(out.collect(), dict(enumerate(texts, 1)), encoder) < 0.002


@pytest.mark.parametrize("capacity", [8, 100])
def test_small_capacity(spark, encoder, capacity):
    texts = random_texts(6, 120)
    out = pack_documents(documents(spark, texts).repartition(5), capacity=capacity, end_id=49407)
    _laws(out.collect(), dict(enumerate(texts, 1)), encoder, capacity, 49407)


def test_sequences_hold_the_ids(spark, encoder):
    texts = random_texts(7, 60)
    pieces = pack_documents(documents(spark, texts).repartition(3), capacity=128)
    held = {}
    for r in sequences(pieces).collect():
        ids = np.frombuffer(bytes(r["ids"]), dtype="<u4")
        assert len(ids) == r["tokens"] <= 128
        for p in r["pieces"]:
            held.setdefault(p["key"], {})[p["start"]] = ids[p["offset"] : p["offset"] + p["length"]].tolist()
    for i, t in enumerate(texts, 1):
        assert sum((held[i][s] for s in sorted(held[i])), []) == [*encoder.plain(t).tolist(), 1]


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "a b c", "en", "s", 5), (3, None, "en", "s", 0), (3, None, "en", "s", 0), (3, "x", "en", "s", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = packing_digest(table).collect()
    assert sorted(sum(r["length"] for r in out if r["doc_id"] is k) for k in (None,)) == [4]
    assert sum(r["length"] for r in out) == 4 + 1 + 1 + 2 and all(r["offset"] >= 0 for r in out)
    assert packing_digest(table.limit(0)).count() == 0
