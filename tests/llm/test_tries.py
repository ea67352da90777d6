"""The trie of conversations against one built node by node, and its shards by walking them."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quillon.llm.tries import build, prefix_trie, rebuilt, trie_digest, trie_shards, unpack
from tests.llm.common import words

SCHEMA = "conv_id long, turn long, role string, text string"


def _rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def _plain(rows):
    members = {}
    for c, turns in _rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append((c, d == len(turns)))
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = set()
    low = {n: min(c for c, _ in m) for n, m in members.items()}
    for node, m in members.items():
        below, stack = [], [node]
        while stack:
            x = stack.pop()
            below.append(x)
            stack += kids.get(x, [])
        saved = sum((len(members[x]) - 1) * (len(words(x[-1][1])) if x else 0) for x in below)
        ends = ",".join(str(c) for c in sorted(c for c, e in m if e))
        out.add((low[node], len(node), low[node[:-1]] if node else None, len(m), len(kids.get(node, [])), sum(x not in kids for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _found(frame):
    rows = [tuple(r) for r in frame.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _conversations(seed, n):
    draw = random.Random(seed)
    turns = [("user", "a b"), ("assistant", "c"), ("user", ""), (None, "d e f"), ("", "d e f"), ("system", None)]
    hot = [draw.choice(turns) for _ in range(6)]
    rows = []
    for c in draw.sample(range(-60, 200), n):
        own = hot if draw.random() < 0.4 else hot[: draw.randint(0, 5)] + [draw.choice(turns) for _ in range(draw.randint(1, 6))]
        at = list(range(len(own)))
        if draw.random() < 0.2:
            at[0] = None
        rows += [(c, t, *x) for t, x in zip(at, own, strict=True)]
    return rows


@pytest.mark.parametrize("seed, n, limit, batch", [(1, 60, 250_000, 10_000), (2, 90, 12, 3), (3, 120, 40, 5), (4, 100, 8, 2)])
def test_same_as_plain(spark, seed, n, limit, batch):
    rows = _conversations(seed, n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert _found(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), limit)) == _plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_input(spark):
    rows = [(None, 1, "user", "x"), (40, None, None, None), (41, 0, "user", "x " * 40_000), (41, 1, "user", None), (43, 5, None, "é ü"), (47, 5, "a", "b"), (47, 6, "a:", "b"), (48, 5, "a", "b")]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as path", "2 as label", "3 as own", "4 as t", "5 as h", "6 as key")
    assert _found(trie_digest(table)) == _plain(rows)
    assert trie_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_are_turns(spark):
    rows = [(20, 0, "user", "x y")] * 3 + [(40, 0, "user", "x y")]
    assert _found(trie_digest(spark.createDataFrame(rows, SCHEMA))) == _plain(rows)


def test_turns_of_one_number_have_a_fixed_order(spark):
    rows = [(20, 0, "user", t) for t in "abcdef"]
    one, two = (trie_digest(spark.createDataFrame(r, SCHEMA).repartition(3)) for r in (rows, rows[::-1]))
    assert _found(one) == _found(two)


def test_many_members_of_one_node(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 6000) for t in range(2)]
    found = _found(trie_digest(spark.createDataFrame(rows, SCHEMA)))
    assert found == _plain(rows)


def test_a_conversation_longer_than_a_shard(spark):
    # All of both paths may be shared, so every round hands on as many nodes as it got, until one shard holds them.
    rows = [(c, t, "user", f"t{t % 7}") for c in (20, 40) for t in range(60 + c)]
    assert _found(prefix_trie(spark.createDataFrame(rows, SCHEMA), 10)) == _plain(rows)


def test_louds_of_small_paths():
    paths = [b"", b"a", b"ab", b"ac", b"b", b"bcd"]
    label = lambda x: bytes([x]) * 20
    entries = np.frombuffer(b"".join(label(x) for p in paths for x in p), dtype=np.uint32).reshape(-1, 5)
    trie, depth, _, upto = build(entries, np.array([len(p) for p in paths]))
    assert "".join("10"[not b] for b in trie.bits) == "10" + "110" + "110" + "10" + "0" + "0" + "10" + "0"
    assert trie.parents().tolist() == [-1, 0, 0, 1, 1, 2, 5] and depth.tolist() == [0, 1, 1, 2, 2, 2, 3] and upto.tolist() == [1, 2, 3, 4, 5, 7]
    assert trie.child(0, label(98)) == 2 and trie.child(2, label(99)) == 5 and trie.child(3, label(99)) == -1


def test_shards_hold_all_paths(spark):
    rows = _conversations(6, 60)
    table = spark.createDataFrame(rows, SCHEMA)
    paths = {bytes(r["path"]) for r in rebuilt(table).collect()}
    found = set()
    for r in trie_shards(table, 30).where("round = 0").collect():
        trie = unpack(r["n_nodes"], bytes(r["bits"]), bytes(r["labels"]))
        parent, names = trie.parents(), [b""]
        for i in range(1, r["n_nodes"]):
            names.append(names[parent[i]] + trie.labels[i - 1].tobytes())
        found |= set(names)
    assert found == {p[: 20 * d] for p in paths for d in range(len(p) // 20 + 1)}
