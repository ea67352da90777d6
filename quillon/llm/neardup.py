"""Near-duplicates by min-max hashing.

A document is the set of its distinct 2-word shingles. Each of 64 permutations is evaluated once for
a shingle and gives two signature values, the minimum and the maximum over the set, so 128 values
cost 64 evaluations. 32 bands of 4 values each retrieve candidates; two sets of Jaccard similarity
0.8 share no band with a chance of (1 - 0.8 ** 4) ** 32, under 1 in 10 million.

Documents with equal sets form one class, told from exact fingerprints; classes bear numbers, and one
member's text stands for each. In a bucket, each class is compared with the bucket's first one, on full
sets, unless sizes or sketches (a bit of each signature value) rule a link out. Buckets whose classes
have not all come together then compare what is left: each class outside the bucket's largest component
with every class of another component (in blocks, by an index of their shingles, where that would make
many pairs). So every pair that shares a band is compared, ruled out by its sizes and sketches, or
connected already, whatever its bucket's size. Links are contracted to components by rounds of joins.

Texts move once to the classes that share a bucket, and once more for each pair; a leader's text is sent
once for a bounded load of members, and what is compared streams through a task, sorted by leader.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.storage import cut, drop_cut
from quillon.llm.words import LOWER, NOT_BLANK, as_signed, blocks, hashes, mix, ranges, sequence_hashes, split

#: Words in a shingle, and the similarity (in hundredths) from which documents are linked.
SHINGLE, PERCENT = 2, 80
PERMUTATIONS, BAND_ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // BAND_ROWS
#: Bits in which the sketches of two sets may differ at most to be compared on the sets themselves.
MOST_DIFFERENT = 33
#: Pairs that a bucket leaves from which they are compared in blocks.
LARGE = 2000
#: Shingles in a block, and of the members that are compared with one copy of a leader's text (one class may have more).
BLOCK_SHINGLES, LOAD_SHINGLES = 200_000, 50_000
#: Keys over which the pairs of a leader with several loads are spread when they are dealt.
SALTS = 64

_DRAW = np.random.Generator(np.random.PCG64(7))
_FACTOR = _DRAW.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_ADD = _DRAW.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_NO_ID = -(1 << 63)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and where each text's begin."""
    low = LOWER[data]
    starts, ends, first = split(low, offsets, NOT_BLANK)
    words = hashes(low, starts, ends)
    n = np.diff(first)
    many = sequence_hashes(words, np.arange(max(len(words) - SHINGLE + 1, 0)), np.arange(max(len(words) - SHINGLE + 1, 0)) + SHINGLE)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    whole = dict(zip(short.tolist(), sequence_hashes(words, first[short], first[short + 1]).tolist(), strict=True)) if len(short) else {}
    sets = []
    for i in range(len(n)):
        if i in whole:
            sets.append(np.array([whole[i]], dtype=np.uint64))
        elif n[i]:
            own = np.sort(many[first[i] : first[i + 1] - SHINGLE + 1])
            keep = np.ones(len(own), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own[keep])
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    bounds = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=bounds[1:])
    return np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64), bounds


def band_keys(members: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty set (a row each) its 32 band keys, and its sketch of a bit per signature value.

    A band hashes 4 minima or 4 maxima; a sketch's two numbers hold the bits of minima and of maxima.
    """
    heads = bounds[:-1][np.diff(bounds) > 0]
    x = (members >> np.uint64(32)).astype(np.uint32)
    values = np.empty((2, PERMUTATIONS, len(heads)), dtype=np.uint64)
    for i in range(PERMUTATIONS):
        y = x * _FACTOR[i] + _ADD[i]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        values[0, i], values[1, i] = np.minimum.reduceat(y, heads), np.maximum.reduceat(y, heads)
    flat = values.reshape(BANDS, BAND_ROWS, len(heads))
    keys = np.empty((len(heads), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(heads), b + 1, dtype=np.uint64)
        for r in range(BAND_ROWS):
            key = mix(key ^ flat[b, r], r)
        keys[:, b] = key
    sketch = np.zeros((len(heads), 2), dtype=np.uint64)
    for side in range(2):
        for i in range(PERMUTATIONS):
            sketch[:, side] |= (mix(values[side, i], 90) & np.uint64(1)) << np.uint64(i)
    return keys, sketch


def _fingerprints(members: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the members of each set that together tell sets apart."""
    out = []
    for salt in (21, 22):
        total = np.zeros(len(members) + 1, dtype=np.uint64)
        np.cumsum(mix(members, salt), out=total[1:])
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]], salt))
    return out[0], out[1]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch):
            members, bounds = shingle_sets(data, offsets)
            n = np.diff(bounds)
            a, b = _fingerprints(members, bounds)
            keys, sketch = band_keys(members, bounds)
            sketches = np.zeros((len(n), 2), dtype=np.uint64)
            sketches[n > 0] = sketch
            lists = np.zeros(len(n) + 1, dtype=np.int32)
            np.cumsum((n > 0) * BANDS, out=lists[1:])
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column(0),
                    "th": part.column(1),
                    "n": pa.array(n, pa.int64()),
                    "a": pa.array(as_signed(a)),
                    "b": pa.array(as_signed(b)),
                    "s1": pa.array(as_signed(sketches[:, 0])),
                    "s2": pa.array(as_signed(sketches[:, 1])),
                    "bands": pa.ListArray.from_arrays(pa.array(lists), pa.array(as_signed(keys.ravel()))),
                }
            )


def _intersection(one: np.ndarray, other: np.ndarray) -> int:
    """How many numbers two ascending arrays without repeats share."""
    if not len(one) or not len(other):
        return 0
    return int((one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other).sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows (leader, member, text) in which a leader's own text precedes its members'."""
    held = np.zeros(0, dtype=np.uint64)
    for batch in batches:
        for part, data, offsets in blocks(batch):
            members, bounds = shingle_sets(data, offsets)
            leader, member = (part.column(i).to_numpy() for i in range(2))
            good = np.zeros(part.num_rows, dtype=bool)
            for i in range(part.num_rows):
                own = members[bounds[i] : bounds[i + 1]]
                if leader[i] == member[i]:
                    held = own.copy()
                else:
                    both = _intersection(held, own)
                    good[i] = both > 0 and 100 * both >= PERCENT * (len(own) + len(held) - both)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (leader, member, n: the member's size) that hold on full sets, as links (a, b).

    Members are dealt to groups of about LOAD_SHINGLES for each leader, so a leader of very many members
    is no hot key; each group gets the leader's text once, and its rows are compared as they stream by.
    """
    hash_ = F.xxhash64("member")
    load = pairs.groupBy("leader").agg(F.ceil(F.sum("n") / LOAD_SHINGLES).alias("groups")).where("groups > 1")
    load = load.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = pairs.withColumn("salt", F.pmod(F.shiftright(hash_, 32), F.lit(SALTS))).join(load, ["leader", "salt"], "left")
    dealt = salted.select("leader", "member", F.pmod(hash_, F.coalesce("groups", F.lit(1))).alias("part"))
    rows = dealt.unionByName(dealt.select("leader", F.col("leader").alias("member"), "part").distinct())
    with_text = rows.join(texts.withColumnRenamed("rep", "member"), "member").select("leader", "member", "text", "part", (F.col("leader") != F.col("member")).alias("later"))
    return with_text.repartition("leader", "part").sortWithinPartitions("leader", "part", "later").select("leader", "member", "text").mapInArrow(_verify, "a long, b long")


def _fits(one: str, other: str) -> str:
    """Whether two sets (columns with these prefixes) can be similar enough, from their sizes and sketches.

    Sizes rule out exactly. The 128 bits of two sketches differ in 12.8 places on average at a similarity
    of 0.8 (each in one of ten), and in more than MOST_DIFFERENT with a chance of 1 in 10 million.
    """
    n, m = f"{one}n", f"{other}n"
    apart = " + ".join(f"bit_count({one}{s} ^ {other}{s})" for s in ("s1", "s2"))
    return f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m}) and {apart} <= {MOST_DIFFERENT}"


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, th, text): a null id counts as the smallest long; th tells apart texts under one id, and that long from null."""
    return docs.select(*_key(), F.col("text"))


def _key() -> tuple[Column, Column]:
    """id and th of a row; the last bit of th is set for null ids, so that the smallest long may be an id as well."""
    th = F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), th.alias("th")


def _unkeyed(id_: str, th: str) -> Column:
    """The id that a key stands for."""
    return F.when((F.col(id_) != _NO_ID) | (F.col(th).bitwiseAND(F.lit(1)) == 0), F.col(id_))


def _told(pairs: DataFrame, classes: DataFrame, ends: tuple[str, str] = ("leader", "member")) -> DataFrame:
    """`pairs` whose two classes fit, with the second's size as n."""
    for end, prefix in zip(ends, "xy", strict=True):
        pairs = pairs.join(classes.select(F.col("rep").alias(end), *[F.col(c).alias(f"{prefix}{c}") for c in ("n", "s1", "s2")]), end)
    return pairs.where(_fits("x", "y")).select(*ends, F.col("yn").alias("n"))


def _pairs_left(open_rows: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs not yet tried: in each bucket, classes outside its main component with those of other components."""
    columns = ("rep", "n", "s1", "s2", "c")
    outside = open_rows.where("c <> main").select("key", *[F.col(c).alias(f"x{c}") for c in columns])
    anyone = open_rows.select("key", *[F.col(c).alias(f"y{c}") for c in columns])
    crossed = outside.join(anyone, "key").where(f"xc <> yc and {_fits('x', 'y')}")
    size = F.when(F.col("xrep") > F.col("yrep"), F.col("xn")).otherwise(F.col("yn"))
    pairs = crossed.select(F.least("xrep", "yrep").alias("leader"), F.greatest("xrep", "yrep").alias("member"), size.alias("n")).distinct()
    return pairs.join(tried.select("leader", "member"), ["leader", "member"], "left_anti")


def _block_links(open_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of what is left in buckets that would make many pairs: their classes outside the main
    component, with any class that shares a bucket of that component.

    The classes of a component's buckets are dealt to blocks of about BLOCK_SHINGLES, and the outside
    ones to slices of as many; each block meets each slice in a group of its own. A block indexes its
    members by shingle and counts every outside set's exact intersections with all of them at once, so
    no pair is a row: only links come out, one for each outside class and component met in a block.
    """
    spread = open_rows.groupBy("main", "rep").agg(*[F.min(c).alias(c) for c in ("c", "n", "s1", "s2")])
    asked = F.when(F.col("c") != F.col("main"), F.col("n")).otherwise(0)
    count = lambda n: F.greatest(F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")
    dealt = spread.join(spread.groupBy("main").agg(count(F.sum("n")).alias("blocks"), count(F.sum(asked)).alias("slices")), "main")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    member = dealt.withColumns({"block": deal("blocks"), "slice": every("slices"), "query": F.lit(False)})
    query = dealt.where("c <> main").withColumns({"block": every("blocks"), "slice": deal("slices"), "query": F.lit(True)})
    rows = member.unionByName(query).select("main", "block", "slice", "query", "rep", "c", "s1", "s2")
    return rows.join(texts, "rep").groupBy("main", "block", "slice").applyInArrow(_compare_block, "a long, b long")


def _compare_block(block: pa.Table) -> pa.Table:
    """All links of a block's outside classes with its members of other components, one per component met."""
    sets: list[np.ndarray] = []
    block = block.combine_chunks()
    for batch in block.to_batches():
        for part, data, offsets in blocks(batch):
            members, bounds = shingle_sets(data, offsets)
            sets += [members[bounds[i] : bounds[i + 1]] for i in range(part.num_rows)]
    ids, parts, asks, s1, s2 = (block.column(c).to_numpy() for c in ("rep", "c", "query", "s1", "s2"))
    held = np.flatnonzero(~asks)
    size = np.array([len(sets[i]) for i in held], dtype=np.int64)
    flat = np.concatenate([sets[i] for i in held]) if len(held) else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(held)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    left, right = [], []
    for q in np.flatnonzero(asks):
        own = sets[q]
        low, high = np.searchsorted(flat, own, side="left"), np.searchsorted(flat, own, side="right")
        both = np.bincount(owner[ranges(low, high - low)], minlength=len(held))
        near = np.flatnonzero((100 * both >= PERCENT * (len(own) + size - both)) & (both > 0) & (parts[held] != parts[q]))
        at = held[near]
        at = at[np.bitwise_count(s1[at] ^ s1[q]).astype(int) + np.bitwise_count(s2[at] ^ s2[q]) <= MOST_DIFFERENT]
        if len(at):
            _, once = np.unique(parts[at], return_index=True)
            left += [ids[q]] * len(once)
            right += ids[at[once]].tolist()
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _class_components(docs: DataFrame, features: DataFrame) -> DataFrame:
    """(n, a, b, component) of every class: component is the smallest (id, th) of all that its links reach."""
    grouped = features.where("n > 0").groupBy("n", "a", "b").agg(F.min(F.struct("id", "th", "s1", "s2", "bands")).alias("f"))
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("rep"), "n", "a", "b", "f.*"), "classes")

    # Buckets of several classes, and the first class of each.
    buckets = classes.select(F.explode("bands").alias("key"), "rep")
    found = buckets.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = cut(buckets.join(found.select("key", "leader"), "key"), "buckets")
    wanted = shared.select("rep").distinct().join(classes.select("rep", "id", "th"), "rep")
    texts = cut(_keyed(docs).join(wanted, ["id", "th"]).dropDuplicates(["id", "th"]).select("rep", "text"), "texts")
    stars = shared.where("rep <> leader").select("leader", F.col("rep").alias("member")).distinct()
    tried = cut(_told(stars, classes), "pairs")
    links = cut(_linked(tried, texts), "verified")
    reached = components(links)

    # What the stars leave: buckets that hold classes of several components.
    labelled = shared.join(reached.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    parts = labelled.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("k", "c")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("all")).where("parts > 1 and all > 2")
    left = labelled.join(mixed.select("key", F.col("main.c").alias("main"), ((F.col("all") - F.col("main.k")) * F.col("all") >= LARGE).alias("large")), "key")
    open_rows = cut(left.join(classes.select("rep", "n", "s1", "s2"), "rep"), "open")
    rest = cut(_pairs_left(open_rows.where("not large"), tried), "rest")
    late = cut(_linked(rest, texts).unionByName(_block_links(open_rows.where("large"), texts)).distinct(), "verified")
    more = late

    # Those links join components that are known already.
    for end in ("a", "b"):
        known = reached.select(F.col("node").alias(end), F.col("component").alias("in"))
        more = more.join(known, end, "left").withColumn(end, F.coalesce("in", end)).drop("in")
    again = components(more)
    first = classes.join(reached.withColumnRenamed("node", "rep"), "rep", "left").withColumn("node", F.coalesce("component", "rep")).drop("component")
    placed = first.join(again, "node", "left").select("n", "a", "b", "id", "th", F.coalesce("component", "node").alias("c"))
    lowest = placed.groupBy("c").agg(F.min(F.struct("id", "th")).alias("component"))
    named = cut(placed.join(lowest, "c").select("n", "a", "b", "component"), "components")
    drop_cut(classes, shared, texts, tried, links, open_rows, rest, late)
    return named


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(id, th, n, component) for every row: id (null: the smallest long), text hash, set size, component.

    A component is named by its smallest (id, th). A row without words has an empty set and a component
    of its own. Rows that share an id are judged each by its own text; rows alike in both share all. An
    empty table gives an empty one. Columns other than doc_id and text are not read.
    """
    features = cut(_keyed(docs).mapInArrow(_features, "id long, th long, n long, a long, b long, s1 long, s2 long, bands array<long>"), "features")
    named = _class_components(docs, features)
    placed = features.select("id", "th", "n", "a", "b").join(named, ["n", "a", "b"], "left")
    return placed.select("id", "th", "n", F.coalesce("component", F.struct("id", "th")).alias("component"))


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document; nulls and repeated rows as in `near_duplicates`."""
    mine, component = _unkeyed("id", "th"), _unkeyed("component.id", "component.th")
    return near_duplicates(docs).select(mine.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), mine.eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of `docs`, that of the smallest id, in the columns of `docs`.

    Texts without words are linked with nothing and stay; of rows alike in id and text one stays. Texts
    under a null id or one that repeats count each for itself.
    """
    # Which rows stay is known from keys alone; whole rows are compared only where several are alike in id and text.
    own = near_duplicates(docs).where(F.struct("id", "th") == F.col("component"))
    chosen = cut(own.groupBy("id", "th").agg(F.count(F.lit(1)).alias("alike")), "chosen")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in docs.columns], *_key())
    once = rows.join(chosen.where("alike = 1").select("id", "th"), ["id", "th"], "left_semi")
    if not chosen.where("alike > 1").isEmpty():
        once = once.unionByName(rows.join(chosen.where("alike > 1").select("id", "th"), ["id", "th"], "left_semi").dropDuplicates(["id", "th"]))
    return once.select(*[F.col(f"`c_{c}`").alias(c) for c in docs.columns])
