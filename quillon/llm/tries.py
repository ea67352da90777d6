"""The prefix trie of conversations, built as succinct level-order tries per prefix shard.

A conversation is a path of turns, each a label of 20 bytes: 16 of a hash of role and text, 4 of its words.
Different paths, each with the conversations that end there, are sorted and cut into shards; numpy builds a
shard's trie in level order as a LOUDS bitvector (a node's children as ones, then a zero) with an array of
labels, and reads parents from it. A reverse breadth-first pass adds up what stands below each node.

Nodes that neighbouring shards may share lie on a shard's first or last path. These upper levels, heavy as
they may be, leave the shard as at most two rows, each a path with what the shard knows of its nodes, and are
merged apart: they are sorted, cut and built again in the same way, until one shard holds what is left. So no
task holds more than a shard, and a node's members are never gathered, only counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.mixing import word_count
from quillon.llm.storage import cut
from quillon.llm.words import ranges

#: Entries (turns and roots of paths) that one shard holds, give or take a batch.
SHARD_ENTRIES = 250_000
#: Conversations c take turns from c - c % FAMILY, crc32(c) % HEADS of them.
FAMILY, HEADS = 20, 4
#: Ids in one piece of text on the way to a digest.
IDS_PER_PIECE = 4096
#: Bytes of a label, and of those what tells turns apart; the rest are the words.
LABEL_BYTES = 20
_EMPTY = hashlib.sha256(b"").hexdigest()
_NONE = (1 << 63) - 1


@dataclass(frozen=True)
class Louds:
    """A trie in level order: `bits` begin with 10 for the node above the root; node j is the j-th one.

    `labels` has a row per node but the root, `starts` the first node of each level and, last, their number.
    """

    bits: np.ndarray
    labels: np.ndarray
    starts: np.ndarray

    def parents(self) -> np.ndarray:
        """Each node's parent (the root's: -1): the zeros before its one, less the one above the root."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        """Children of each node: ones between neighbouring zeros."""
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def child(self, node: int, label: bytes) -> int:
        """The child of a node with a label, or -1."""
        zeros = np.flatnonzero(~self.bits)
        first, count = int(zeros[node]) - node, int(zeros[node + 1] - zeros[node]) - 1
        for j in range(first, first + count):
            if self.labels[j - 1].tobytes() == label:
                return j
        return -1

    def packed(self) -> tuple[bytes, bytes]:
        """Bits, eight to a byte, and labels."""
        return np.packbits(self.bits).tobytes(), self.labels.tobytes()


def build(entries: np.ndarray, lengths: np.ndarray) -> tuple[Louds, np.ndarray, np.ndarray, np.ndarray]:
    """The trie of sorted paths that lie one after the other in `entries`, a label a row.

    Also: each node's depth, the sorted keys depth * nodes + preorder, and how many nodes the paths up to each
    one have (by which `locate` finds nodes).
    """
    rows, starts = len(lengths), np.cumsum(lengths) - lengths
    shared = np.zeros(rows, dtype=np.int64)
    if rows > 1:
        common = np.minimum(lengths[1:], lengths[:-1])
        differs = (entries[ranges(starts[:-1], common)] != entries[ranges(starts[1:], common)]).any(axis=1)
        at = np.concatenate([[0], np.cumsum(common)])
        wrong = np.flatnonzero(differs)
        first = np.searchsorted(wrong, at[:-1])
        found = (first < len(wrong)) & (np.append(wrong, at[-1])[first] < at[1:])
        shared[1:] = np.where(found, np.append(wrong, 0)[first] - at[:-1], common)
    new = lengths - shared
    upto = 1 + np.cumsum(new)
    n = int(upto[-1])
    depth = np.concatenate([[0], ranges(shared + 1, new)])
    entry = ranges(starts + shared, new)
    # Level order: by depth, then as the paths come.
    order = np.argsort(depth, kind="stable")
    level = depth[order]
    keys = level * n + order
    level_starts = np.searchsorted(level, np.arange(int(level[-1]) + 2))
    last_of_level = np.append(level[1:] != level[:-1], True)
    after = np.where(last_of_level, n, np.append(order[1:], n))
    degree = np.searchsorted(keys, (level + 1) * n + after) - np.searchsorted(keys, (level + 1) * n + order)
    bits = np.ones(2 * n + 1, dtype=bool)
    bits[1] = False
    bits[2 + np.cumsum(degree) + np.arange(n)] = False
    return Louds(bits, entries[entry[order[1:] - 1]], level_starts), level, keys, upto


def locate(keys: np.ndarray, upto: np.ndarray, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The node at a depth of a row's path: the last of that depth among the nodes of the paths up to it."""
    return np.searchsorted(keys, depth * len(keys) + upto[row] - 1, side="right") - 1


_SUMS = ("convs", "kids", "leaves", "saved")
_NODE = ("conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens")
_SPINE = "chunk long, side long, path binary, convs array<long>, low array<long>, kids array<long>, leaves array<long>, saved array<long>, sha array<string>"
_ROUND = f"kind int, {_SPINE}, " + ", ".join(f"{c} long" for c in _NODE) + ", ends string, up_chunk long, up_side long, up long, bits binary, labels binary"
_IN_NODE, _IN_SPINE, _IN_ANSWER, _IN_TRIE = 0, 1, 2, 3


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


class _Shard:
    """One shard's rows, its trie, and what is told of its nodes."""

    def __init__(self, batches: list[pa.RecordBatch], whole: bool) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: table.column(name).chunk(0)
        path = column("path")
        offsets = np.frombuffer(path.buffers()[1], dtype=np.int32)[path.offset : path.offset + len(path) + 1].astype(np.int64)
        raw = path.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
        self.length = np.diff(offsets) // LABEL_BYTES
        self.path, self.owner = path, (column("chunk").to_numpy(), column("side").to_numpy())
        entries = np.frombuffer(data.tobytes(), dtype=np.uint32).reshape(-1, LABEL_BYTES // 4)
        self.trie, self.depth, self.keys, self.upto = build(entries, self.length)
        self.n, self.parent, self.degree = len(self.keys), self.trie.parents(), self.trie.degrees()
        self.words = np.zeros(self.n, dtype=np.int64)
        self.words[1:] = self.trie.labels[:, -1].byteswap()  # the label's last four bytes, the major one first
        # What the rows bring stands at the end of their paths.
        given = np.diff(column("convs").offsets.to_numpy())
        row = np.repeat(np.arange(len(given)), given)
        node = locate(self.keys, self.upto, row, ranges(self.length + 1 - given, given))
        self.sums = {c: np.zeros(self.n, dtype=np.int64) for c in _SUMS}
        for c in _SUMS:
            np.add.at(self.sums[c], node, column(c).flatten().to_numpy())
        self.low = np.full(self.n, _NONE, dtype=np.int64)
        np.minimum.at(self.low, node, column("low").flatten().to_numpy())
        self.sha = np.full(self.n, None, dtype=object)
        for i, s in zip(node.tolist(), column("sha").flatten().to_pylist(), strict=True):
            if s is not None:
                self.sha[i] = s
        # Nodes that other shards may have as well: those of the first and of the last path.
        self.first = self._spine(0)
        self.last = self._spine(len(self.length) - 1)
        self.open = np.zeros(self.n, dtype=bool)
        if not whole:
            self.open[self.first], self.open[self.last] = True, True
        self._roll_up()

    def _spine(self, row: int) -> np.ndarray:
        depth = np.arange(self.length[row] + 1)
        return locate(self.keys, self.upto, np.full(len(depth), row), depth)

    def _roll_up(self) -> None:
        """Reverse breadth-first sums; what is below an open node's open children isn't known yet."""
        s, starts = self.sums, self.trie.starts
        levels = [np.arange(a, b)[~self.open[a:b]] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for nodes in reversed(levels[1:]):
            np.add.at(s["convs"], self.parent[nodes], s["convs"][nodes])
            np.minimum.at(self.low, self.parent[nodes], self.low[nodes])
        for depth, nodes in reversed(list(enumerate(levels))):
            s["leaves"][nodes] += (self.degree[nodes] == 0) & (s["kids"][nodes] == 0)
            s["saved"][nodes] += (s["convs"][nodes] - 1) * self.words[nodes]
            if depth:
                np.add.at(s["kids"], self.parent[nodes], 1)
                np.add.at(s["leaves"], self.parent[nodes], s["leaves"][nodes])
                np.add.at(s["saved"], self.parent[nodes], s["saved"][nodes])

    def nodes(self) -> dict:
        """Rows of the nodes that no other shard has; a parent that may be shared is told by spine and depth."""
        here = np.flatnonzero(~self.open)
        above = self.parent[here]
        apart = (above >= 0) & self.open[above]
        on_first = np.zeros(self.n, dtype=bool)
        on_first[self.first] = True
        parent = pa.array(self.low[above], pa.int64(), mask=apart | (above < 0))
        told = [self.low[here], self.depth[here], None, self.sums["convs"][here], self.sums["kids"][here], self.sums["leaves"][here], self.sums["saved"][here]]
        out = {c: pa.array(v, pa.int64()) if v is not None else parent for c, v in zip(_NODE, told, strict=True)}
        out["ends"] = pa.array([_EMPTY if x is None else x for x in self.sha[here]], pa.string())
        out["up_side"] = pa.array(np.where(on_first[above], 0, 1), pa.int64(), mask=~apart)
        out["up"] = pa.array(self.depth[above], pa.int64(), mask=~apart)
        return out

    def spines(self) -> dict:
        """The first and the last path with what is known of their nodes; shared ones count in the first."""
        common = int(np.minimum(len(self.first), len(self.last)))
        same = int((self.first[:common] == self.last[:common]).sum())
        rows, nodes = ([0], [self.first]) if len(self.length) == 1 else ([0, len(self.length) - 1], [self.first, self.last[same:]])
        counts, every = [len(x) for x in nodes], np.concatenate(nodes)
        out = {"side": pa.array(range(len(rows)), pa.int64()), "path": self.path.take(pa.array(rows))}
        out |= {c: _lists(self.sums[c][every], counts, pa.int64()) for c in _SUMS}
        out |= {"low": _lists(self.low[every], counts, pa.int64()), "sha": _lists(self.sha[every].tolist(), counts, pa.string())}
        return out

    def answers(self) -> dict:
        """For each row that came from a shard before: the smallest members along its path, as far as they are known here."""
        row, depth = np.repeat(np.arange(len(self.length)), self.length + 1), ranges(np.zeros(len(self.length)), self.length + 1)
        node = locate(self.keys, self.upto, row, depth)
        known = ~self.open[node]
        unknown = np.bincount(row[~known], minlength=len(self.length))
        on_first = np.zeros(self.n, dtype=bool)
        on_first[self.first] = True
        deepest = locate(self.keys, self.upto, np.arange(len(self.length)), np.maximum(unknown - 1, 0))
        return {
            "chunk": pa.array(self.owner[0], pa.int64()),
            "side": pa.array(self.owner[1], pa.int64()),
            "low": _lists(self.low[node[known]], np.bincount(row[known], minlength=len(self.length)), pa.int64()),
            "up_side": pa.array(np.where(on_first[deepest], 0, 1), pa.int64()),
            "up": pa.array(unknown, pa.int64()),
        }


def _builder(limit: int, whole: bool, first_round: bool, keep_tries: bool):  # noqa: ANN202
    """For mapInArrow over sorted rows: shards of some `limit` entries, or one of all (`whole`)."""
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("side", pa.int64()), ("path", pa.binary())])
    for c in ("convs", "low", "kids", "leaves", "saved"):
        schema = schema.append(pa.field(c, pa.list_(pa.int64())))
    schema = schema.append(pa.field("sha", pa.list_(pa.string())))
    for c in _NODE:
        schema = schema.append(pa.field(c, pa.int64()))
    for c, kind in (("ends", pa.string()), ("up_chunk", pa.int64()), ("up_side", pa.int64()), ("up", pa.int64()), ("bits", pa.binary()), ("labels", pa.binary())):
        schema = schema.append(pa.field(c, kind))

    def told(kind: int, columns: dict, n: int) -> pa.RecordBatch:
        columns = {"kind": pa.array(np.full(n, kind, dtype=np.int32)), **columns}
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def of_shard(batches: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        shard, chunk = _Shard(batches, whole), (TaskContext.get().partitionId() << 32) + number
        numbered = lambda n: pa.array(np.full(n, chunk), pa.int64())
        nodes = shard.nodes()
        n = len(nodes["conv_id"])
        yield told(_IN_NODE, {**nodes, "up_chunk": numbered(n)}, n)
        if not whole:
            spines = shard.spines()
            n = len(spines["side"])
            yield told(_IN_SPINE, {**spines, "chunk": numbered(n)}, n)
        if not first_round:
            answers = shard.answers()
            n = len(answers["chunk"])
            yield told(_IN_ANSWER, {**answers, "up_chunk": numbered(n)}, n)
        if keep_tries:
            bits, labels = shard.trie.packed()
            yield told(_IN_TRIE, {"chunk": numbered(1), "n_convs": pa.array([shard.n], pa.int64()), "bits": pa.array([bits], pa.binary()), "labels": pa.array([labels], pa.binary())}, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries, number = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                entries += batch.column(batch.schema.get_field_index("path")).nbytes // LABEL_BYTES + batch.num_rows
                if entries >= limit and not whole:
                    yield from of_shard(held, number)
                    held, entries, number = [], 0, number + 1
        if held:
            yield from of_shard(held, number)

    return run


def rebuilt(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """(conv_id, path): the labels of each rebuilt conversation, one after the other, written.

    Turns go by number, null first, those of one number by a hash of role and text. Rows without a conv_id belong
    to no conversation. Texts are read once and don't travel; a conversation's labels, 20 bytes a turn, are held
    in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    same = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    label = F.concat(F.substring(same, 1, 2 * (LABEL_BYTES - 4)), F.lpad(F.lower(F.hex(word_count(text))), 8, "0"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), label.alias("label")).alias("t"))
    own = cut(turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["label"]).alias("own")), "conversations")
    base = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = own.withColumn("h", h).join(base, F.col("conv_id") - F.col("conv_id") % family == F.col("base"), "left")
    taken = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array().cast("array<string>")), 1, F.col("h"))).otherwise(F.array().cast("array<string>"))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    path = F.unhex(F.array_join(F.concat(taken, rest), ""))
    return cut(joined.select("conv_id", path.alias("path"), F.unhex(F.substring(F.sha2(path, 256), 1, 32)).alias("key")), "paths")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) to (key, low, n, ids): stretches of a key's ids, comma-joined."""
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        cuts = sorted({j for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True) for j in range(a, b, IDS_PER_PIECE)})
        ends = [*cuts[1:], len(keys)]
        columns = [pa.array([keys[a] for a in cuts], pa.binary()), pa.array([ids[a] for a in cuts], pa.int64()), pa.array([b - a for a, b in zip(cuts, ends, strict=True)], pa.int64())]
        columns.append(pa.array([",".join(map(str, ids[a:b])) for a, b in zip(cuts, ends, strict=True)], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=["key", "low", "n", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (key, low, n, sha), a row a key; the ids pass through the hash and aren't kept."""
    now, out = None, []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names, kinds = ["key", "low", "n", "sha"], [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for key, low, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and now[0] == key:
                now[2] += n
                now[3].update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((*now[:3], now[3].hexdigest()))
            now = [key, low, n, hashlib.sha256(ids.encode())]
        if out:
            yield batch_of(out)
            out = []
    if now is not None:
        yield batch_of([(*now[:3], now[3].hexdigest())])


def _ending(paths: DataFrame) -> DataFrame:
    """(path, low, n, sha): different paths with the smallest, the number and the digest of the conversations that are it."""
    pieces = paths.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, low long, n long, ids string")
    told = pieces.repartition("key").sortWithinPartitions("key", "low").mapInArrow(_digests, "key binary, low long, n long, sha string")
    of_low = paths.select(F.col("key"), F.col("conv_id").alias("low"), "path")
    return told.join(of_low, ["key", "low"]).select("path", "low", "n", "sha")


def _rounds(paths: DataFrame, limit: int, keep_tries: bool = False) -> list[DataFrame]:
    """Tables of `_builder`, from the shards of all paths to the one in which the last shared nodes meet."""
    one = lambda c: F.array(F.col(c) if isinstance(c, str) else c)
    zero = F.lit(0).cast("long")
    rows = _ending(paths).select(F.lit(-1).cast("long").alias("chunk"), zero.alias("side"), "path", one("n").alias("convs"), one("low").alias("low"), one(zero).alias("kids"), one(zero).alias("leaves"), one(zero).alias("saved"), one("sha").alias("sha"))
    tables: list[DataFrame] = []
    while True:
        whole = False
        if tables:
            entries = rows.agg(F.sum(F.octet_length("path") / LABEL_BYTES + 1)).first()[0] or 0
            whole = entries <= limit
        dealt = rows.coalesce(1) if whole else rows.repartitionByRange("path") if not tables else rows.repartitionByRange(max(1, int(entries // limit)), "path")
        tables.append(cut(dealt.sortWithinPartitions("path").mapInArrow(_builder(limit, whole, not tables, keep_tries), _ROUND), "trie"))
        if whole:
            return tables
        rows = tables[-1].where(F.col("kind") == _IN_SPINE).select("chunk", "side", "path", "convs", "low", "kids", "leaves", "saved", "sha")
        limit *= 1 if len(tables) == 1 else 2  # paths longer than a shard would else come back as they went


def prefix_trie(conversations: DataFrame, limit: int = SHARD_ENTRIES) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are told apart by 128 bits of SHA-256. Null roles and texts are empty, null turns come first, turns of one
    number in a fixed order; repeated rows are turns of their own. Rows without a conv_id are passed over, other
    columns left out; an empty table has no node, not even a root.
    """
    tables = _rounds(rebuilt(conversations), limit)
    plain = lambda t: t.where((F.col("kind") == _IN_NODE) & F.col("up").isNull())
    columns = [*_NODE, "ends"]
    found, lows = plain(tables[-1]).select(*columns), None
    for table, below in zip(reversed(tables), [*reversed(tables[:-1]), None], strict=True):
        answers = table.where(F.col("kind") == _IN_ANSWER).select("chunk", "side", "low", "up_chunk", "up_side", "up")
        if lows is not None and below is not None:
            answers = answers.join(lows, ["up_chunk", "up_side"], "left").withColumn("low", F.when(F.col("up") > 0, F.concat(F.slice("lows", 1, F.greatest(F.col("up").cast("int"), F.lit(1))), "low")).otherwise(F.col("low")))
        if below is None:
            break
        lows = answers.select(F.col("chunk").alias("up_chunk"), F.col("side").alias("up_side"), F.col("low").alias("lows"))
        # A shard's rows meet the two spines of that shard: no key has more rows than a shard has nodes.
        waiting = below.where((F.col("kind") == _IN_NODE) & F.col("up").isNotNull()).select(*columns, "up_chunk", "up_side", "up")
        met = waiting.join(lows, ["up_chunk", "up_side"]).withColumn("parent", F.element_at("lows", F.col("up").cast("int") + 1))
        found = found.unionByName(met.select(*columns)).unionByName(plain(below).select(*columns))
    return found.withColumnsRenamed({"parent": "parent_conv_id", "ends": "ends_sha256"})


def trie_shards(conversations: DataFrame, limit: int = SHARD_ENTRIES) -> DataFrame:
    """(round, shard, n_nodes, bits, labels): the tries themselves, round 0 those of the paths; read one with `unpack`."""
    out = None
    for i, table in enumerate(_rounds(rebuilt(conversations), limit, keep_tries=True)):
        part = table.where(F.col("kind") == _IN_TRIE).select(F.lit(i).alias("round"), F.col("chunk").alias("shard"), F.col("n_convs").alias("n_nodes"), "bits", "labels")
        out = part if out is None else out.unionByName(part)
    return out


def unpack(n_nodes: int, bits: bytes, labels: bytes) -> Louds:
    """The trie behind a row of `trie_shards`."""
    flags = np.unpackbits(np.frombuffer(bits, dtype=np.uint8))[: 2 * n_nodes + 1].astype(bool)
    rows = np.frombuffer(labels, dtype=np.uint32).reshape(-1, LABEL_BYTES // 4)
    trie = Louds(flags, rows, np.zeros(0, dtype=np.int64))
    depth, parent = np.zeros(n_nodes, dtype=np.int64), trie.parents()
    for i in range(1, n_nodes):
        depth[i] = depth[parent[i]] + 1
    return Louds(flags, rows, np.searchsorted(depth, np.arange(int(depth[-1]) + 2)))


def trie_digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns for every node; odd input as in `prefix_trie`."""
    longs = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return prefix_trie(conversations).select(*[F.col(c).cast("long").alias(c) for c in longs], "ends_sha256")
