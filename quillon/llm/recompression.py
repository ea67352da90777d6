"""Removal of repeated passages by recompression.

A text is a sequence of word hashes. Rounds name runs of one word, then pairs of neighbours: a round
gives each symbol a side from its name, and a left symbol joins a right one that follows it. A name
is a hash of what it stands for, so equal strings get equal names in every document with no exchange
of names. Each symbol carries the stretch of words that its making depends on; wherever the same words
stand again, the same symbol stands over them. The exchange between tasks is of these symbols only.

A window of 20 words chooses, among the symbols whose stretch it holds whole, one of the highest level,
ties to the smallest name; so equal windows choose the same symbol at the same place. Single words are
level 0, so every window has a choice. Names that occur once drop out. Where a name stands again in
the same surroundings (all words of the windows that chose it), those windows are repeats at once.
Where surroundings differ, the first place of each is checked window by window. Surroundings and
windows are each told apart by 91 bits of their own, names not counted; documents and starts give the order.

A task remembers the bearers of common names, so of a passage that stands everywhere each task sends
about one row: later places are settled where they are read, and no name is a hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.words import NOT_BLANK, as_signed, blocks, hashes, mix, owners, ranges, sequence_hashes, split

#: Words in a window.
WINDOW = 20
#: Rounds of pair naming after the round of runs.
ROUNDS = 4
_NO_ID = -(1 << 63)


def parse(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of each level as (name, first word, end word) of the stretch of words each depends on.

    Only symbols whose stretch fits into a window are given. A stretch that depends on where a text
    ends fits into none.
    """
    n = len(words)
    text = owners(first)
    at = np.arange(n, dtype=np.int64)
    levels = [(words, at, at + 1)]
    if not n:
        return levels

    # Runs: a maximal run of one word is one symbol; it depends on the word before and after it.
    same = np.zeros(n, dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    heads = np.flatnonzero(~same)
    ends = np.append(heads[1:], n)
    length = (ends - heads).astype(np.uint64)
    name = np.where(length > 1, mix(words[heads] ^ mix(length, 31), 32), words[heads])
    low, high, text = heads - 1, ends + 1, text[heads]
    for level in range(1, rounds + 1):
        if len(name) > 0:
            fits = high - low <= window
            levels.append((mix(name[fits], 40 + level), low[fits], high[fits]))
        # Sides: left symbols (bit 0) join the right symbol (bit 1) that follows.
        right = (mix(name, 60 + level) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(name), dtype=bool)
        joins[:-1] = ~right[:-1] & right[1:] & (text[:-1] == text[1:])
        joined = np.zeros(len(name), dtype=bool)
        joined[1:] = joins[:-1]
        # A right symbol alone depends on what stands before it, a left one alone on what follows.
        new_low, new_high = low.copy(), high.copy()
        alone_right = np.flatnonzero(right & ~joined)
        before = np.maximum(alone_right - 1, 0)
        inner = (alone_right > 0) & (text[before] == text[alone_right])
        new_low[alone_right] = np.where(inner, np.minimum(low[before], low[alone_right]), low[alone_right] - window)
        alone_left = np.flatnonzero(~right & ~joins)
        after = np.minimum(alone_left + 1, len(name) - 1)
        inner = (alone_left < len(name) - 1) & (text[after] == text[alone_left])
        new_high[alone_left] = np.where(inner, np.maximum(high[after], high[alone_left]), high[alone_left] + window)
        lead = np.flatnonzero(joins)
        pair = mix(name[lead] * np.uint64(0x9E3779B97F4A7C15) + name[lead + 1], 50 + level)
        new_name = name.copy()
        new_name[lead] = pair
        new_high[lead] = np.maximum(high[lead], high[lead + 1])
        new_low[lead] = np.minimum(low[lead], low[lead + 1])
        keep = ~joined
        name, low, high, text = new_name[keep], new_low[keep], new_high[keep], text[keep]
    fits = high - low <= window
    levels.append((mix(name[fits], 41 + rounds), low[fits], high[fits]))
    return levels


def choose(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbol that each window chooses: (window's first word, name, symbol's place in the window).

    The name covers all words of the symbol's stretch.
    """
    n = len(words)
    count = np.maximum(np.diff(first) - window + 1, 0)
    starts = ranges(first[:-1], count)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64), starts
    chosen = np.zeros(n, dtype=np.uint64)
    place = np.zeros(n, dtype=np.int64)
    open_ = np.zeros(n, dtype=bool)
    open_[starts] = True
    for level, (name, low, high) in reversed(list(enumerate(parse(words, first, window=window)))):
        live = np.flatnonzero(open_)
        if not len(live):
            break
        if not len(name):
            continue
        ok = (low >= 0) & (high <= n) & (high - low <= window)
        waiting = np.concatenate(([0], np.cumsum(open_)))
        # A window that starts at s holds a stretch if high - window <= s <= low.
        begin = np.maximum(high - window, 0)
        ok &= waiting[np.minimum(low + 1, n)] > waiting[np.minimum(begin, n)]
        name, low, high, begin = name[ok], low[ok], high[ok], begin[ok]
        if not len(name):
            continue
        full = mix(sequence_hashes(words, low, high), level)
        count = low - begin + 1
        s, symbol = ranges(begin, count), np.repeat(np.arange(len(low)), count)
        live = open_[s]
        s, symbol = s[live], symbol[live]
        best = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(best, s, full[symbol])
        equal = full[symbol] == best[s]
        s, symbol = s[equal], symbol[equal]
        where = np.full(n, n, dtype=np.int64)
        np.minimum.at(where, s, low[symbol])
        chosen[s], place[s], open_[s] = best[s], where[s], False
    return starts, chosen[starts], place[starts]


# A run of windows is packed into a long: 27 more bits of its hash, then its first window's place in the
# text (32 bits), then the number of windows (5 bits; a symbol serves 20 at most).
_COUNT_BITS, _PLACE_BITS = 5, 37
#: What is known of a row of symbols: nothing yet, that its windows stand earlier, that they need a check.
_OPEN, _LATER, _CHECK = 0, 1, 2


class Slots:
    """Rows that a task remembers, by a slot of their key; those found again are kept longest."""

    BITS = 18

    def __init__(self, kinds: tuple[type, ...]):
        n = 1 << self.BITS
        self.columns = [np.zeros(n, dtype=kind) for kind in kinds]
        self.filled, self.wanted = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)

    def look(self, key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Slots, and what they hold."""
        slot = (mix(key, 75) >> np.uint64(64 - self.BITS)).astype(np.int64)
        return slot, [c[slot] for c in self.columns]

    def put(self, slot: np.ndarray, rows: tuple[np.ndarray, ...], found: np.ndarray, fresher: np.ndarray) -> None:
        """Remember rows: those `fresher` than what was found, and others whose slots are not wanted any more."""
        at = np.flatnonzero(fresher | (~found & ~self.wanted[slot]))
        self.wanted[slot[~found]] = False
        self.wanted[slot[found]] = True
        for column, row in zip(self.columns, rows, strict=True):
            column[slot[at]] = row[at]
        self.filled[slot[at]] = True


class Bearers(Slots):
    """Rows (name, hash, more bits of it, document, start) that a task has given under their own names."""

    def __init__(self) -> None:
        super().__init__((np.uint64, np.uint64, np.int64, np.int64, np.int64))

    def later(self, *rows: np.ndarray) -> np.ndarray:
        """Which rows stand later than one remembered that is alike; the others may be remembered."""
        slot, held = self.look(rows[0] * np.uint64(3) + rows[1])
        same = self.filled[slot] & np.logical_and.reduce([h == r for h, r in zip(held[:3], rows[:3], strict=True)])
        after = same & ((held[3] < rows[3]) | ((held[3] == rows[3]) & (held[4] < rows[4])))
        self.put(slot, rows, same, same & ~after)
        return after


class Names(Slots):
    """Names that a task has given, each with its first surroundings, and whether others have been given too."""

    def __init__(self) -> None:
        super().__init__((np.uint64, np.uint64, np.int64, bool))

    def told(self, name: np.ndarray, around: np.ndarray, more: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Which rows bear a name that the task has given as one to check already: in two surroundings, or marked so.

        No two of the rows share a name; `check` says which are marked themselves.
        """
        slot, held = self.look(name)
        same = self.filled[slot] & (held[0] == name)
        other = same & (check | (held[1] != around) | (held[2] != more))
        self.put(slot, (name, around, more, check), same, np.zeros(len(name), dtype=bool))
        mine = other & (self.columns[0][slot] == name)  # a slot may have gone to another of the rows
        self.columns[3][slot[mine]] = True
        return other & held[3]


def _own(names: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Names that rows bear alone, from their documents, texts and places."""
    for i, part in enumerate(place):
        names = mix(names ^ part.astype(np.uint64), 71 + i)
    return names


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, around, x, id, th, known): a row per symbol that windows of a text choose.

    around is 64 bits of all words of those windows (the surroundings), x packs 27 more with their
    place. In a block of texts a name is borne by one row only. Others of the same surroundings stand
    later; those of other surroundings need a check, and so do all of that name. They bear names of
    their own, as do rows that stand later than one that the task remembers, and rows to check of a name
    that it has given in two surroundings already.
    """
    bearers, given = Bearers(), Names()
    for batch in batches:
        for part, data, offsets in blocks(batch):
            begins, ends, first = split(data, offsets, NOT_BLANK)
            words = hashes(data, begins, ends)
            starts, name, place = choose(words, first)
            if not len(starts):
                continue
            # Windows that choose one symbol are one row, from the first to the last of them.
            fresh = np.ones(len(starts), dtype=bool)
            fresh[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (name[1:] != name[:-1])
            heads = np.flatnonzero(fresh)
            end_of = starts[np.append(heads[1:], len(starts)) - 1]
            order = np.lexsort((starts[heads], place[heads], name[heads]))
            heads, end_of = heads[order], end_of[order]
            new = np.ones(len(heads), dtype=bool)
            new[1:] = (name[heads][1:] != name[heads][:-1]) | (place[heads][1:] != place[heads][:-1])
            at = np.flatnonzero(new)
            low, high, names = starts[heads[at]], np.maximum.reduceat(end_of, at), name[heads[at]]
            around = sequence_hashes(words, low, high + WINDOW, 6)
            more = (sequence_hashes(words, low, high + WINDOW, 4) >> np.uint64(_PLACE_BITS)).astype(np.int64)
            ids, hashed = (part.column(i).to_numpy() for i in range(2))
            text = np.searchsorted(first, low, side="right") - 1
            own, start = ids[text], low - first[text]
            order = np.lexsort((start, own, more, around, names))
            low, high, names, around, more, text, own, start = (z[order] for z in (low, high, names, around, more, text, own, start))
            same_name, same = np.zeros(len(names), dtype=bool), np.zeros(len(names), dtype=bool)
            same_name[1:] = names[1:] == names[:-1]
            same[1:] = same_name[1:] & (around[1:] == around[:-1]) & (more[1:] == more[:-1])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(names))))
            later = same & ((own != own[head]) | (start != start[head]))
            # Rows alike in document and text share what is found, so one of them is enough.
            twin = same & ~later & (hashed[text] == hashed[text][head])
            group = np.cumsum(~same_name) - 1
            several = np.bincount(group, weights=same_name & ~later & ~twin) > 0
            known = np.where(later, _LATER, np.where(several[group], _CHECK, _OPEN))
            alone = np.flatnonzero(~same_name & (known == _OPEN))
            after = bearers.later(*(z[alone] for z in (names, around, more, own, start)))
            known[alone[after]] = _LATER
            apart = np.flatnonzero(~same_name & (known != _LATER))
            apart = apart[given.told(names[apart], around[apart], more[apart], known[apart] == _CHECK)]
            known[apart] = _CHECK
            own_name = same_name
            own_name[alone[after]] = own_name[apart] = True
            names = np.where(own_name, _own(names, own, hashed[text], start), names)
            x = (more << _PLACE_BITS) | (start << _COUNT_BITS) | (high - low + 1)
            names, around, x, own, text, known = (z[~twin] for z in (names, around, x, own, text, known))
            yield pa.RecordBatch.from_pydict(
                {
                    "name": pa.array(as_signed(names)),
                    "around": pa.array(as_signed(around)),
                    "x": pa.array(x),
                    "id": pa.array(own),
                    "th": pa.array(hashed[text]),
                    "known": pa.array(known.astype(np.int8)),
                }
            )


def _marked(part: pa.RecordBatch, column: str, first: np.ndarray, window: int) -> np.ndarray:
    """First words (in the block) of the windows that a text's list of runs names, ascending."""
    lists = part.column(part.schema.get_field_index(column))
    runs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    count = runs & ((1 << _COUNT_BITS) - 1)
    s = ranges(first[:-1][text] + (runs >> _COUNT_BITS), count)
    return np.unique(s[s + window <= first[1:][np.repeat(text, count)]])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, x, id, th, known) of the windows to check: 64 bits of the window's hash, 27 more packed with its place.

    Of a window that a block of texts holds several times, the first bears its hash; the others stand
    later, so they are marked and bear hashes of their own, as do those later than a bearer remembered.
    """
    bearers = Bearers()
    for batch in batches:
        for part, data, offsets in blocks(batch):
            begins, ends, first = split(data, offsets, NOT_BLANK)
            words = hashes(data, begins, ends)
            at = _marked(part, "found", first, WINDOW)
            if not len(at):
                continue
            w = sequence_hashes(words, at, at + WINDOW, 1)
            more = (sequence_hashes(words, at, at + WINDOW, 2) >> np.uint64(_PLACE_BITS)).astype(np.int64)
            ids, hashed = (part.column(i).to_numpy() for i in range(2))
            text = np.searchsorted(first, at, side="right") - 1
            own, start = ids[text], at - first[text]
            order = np.lexsort((start, own, more, w))
            w, more, own, start, text, at = (z[order] for z in (w, more, own, start, text, at))
            alike = np.zeros(len(w), dtype=bool)
            alike[1:] = (w[1:] == w[:-1]) & (more[1:] == more[:-1])
            head = np.maximum.accumulate(np.where(alike, 0, np.arange(len(w))))
            later = alike & ((own != own[head]) | (start != start[head]))
            alone = np.flatnonzero(~alike)
            later[alone] = bearers.later(*(z[alone] for z in (w, w, more, own, start)))
            w = np.where(later, _own(w, own, hashed[text], start), w)
            x = (more << _PLACE_BITS) | (start << _COUNT_BITS) | 1
            yield pa.RecordBatch.from_pydict(
                {"w": pa.array(as_signed(w)), "x": pa.array(x), "id": pa.array(own), "th": pa.array(hashed[text]), "known": pa.array((later * _LATER).astype(np.int8))}
            )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_words, n_removed, kept words joined by a space) of every text."""
    for batch in batches:
        for part, data, offsets in blocks(batch):
            begins, _, first = split(data, offsets, NOT_BLANK)
            s = _marked(part, "found", first, WINDOW)
            edge = np.zeros(len(begins) + 1, dtype=np.int64)
            np.add.at(edge, s, 1)
            np.add.at(edge, s + WINDOW, -1)
            keep = np.cumsum(edge[:-1]) == 0
            removed = np.concatenate(([0], np.cumsum(~keep)))
            gone = removed[first[1:]] - removed[first[:-1]]
            raw, texts = data.tobytes(), []
            for i in range(part.num_rows):
                own = raw[offsets[i] : offsets[i + 1]].split()
                texts.append(b" ".join(compress(own, keep[first[i] : first[i + 1]].tolist()) if gone[i] else own))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column(0),
                    "n_words": pa.array(np.diff(first), pa.int64()),
                    "n_removed": pa.array(gone, pa.int64()),
                    "kept": pa.array(texts, pa.binary()),
                }
            )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same with the kept text's SHA-256 in its place, so that only digests leave the task."""
    for part in _kept(batches):
        digests = [hashlib.sha256(x).hexdigest() for x in part.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(digests, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])


def _remove(docs: DataFrame, finish, schema: str) -> DataFrame:  # noqa: ANN001
    # Rows that share an id are told apart by their text's hash; rows alike in both share their repeats.
    # Ids of one text need no hash: a 0 in its place takes no room in the exchanges.
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("th"), F.col("text"))
    shared = base.groupBy("id").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").select("id", F.lit(True).alias("shared"))
    if shared.isEmpty():
        base = base.withColumn("th", F.lit(0).cast("long"))
    else:
        base = base.join(shared, "id", "left").select("id", F.when(F.col("shared"), F.col("th")).otherwise(F.lit(0)).alias("th"), "text")
    bits, run = F.shiftright("x", _PLACE_BITS), F.col("x").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    place = F.struct("id", "run")

    # Symbols: of equal names with equal surroundings all but the first stand later; names with
    # several surroundings need a check of the first of each.
    # Rows are unpacked behind the exchange, so that they travel packed.
    symbols = base.mapInArrow(_symbols, "name long, around long, x long, id long, th long, known byte").repartition("name").withColumns({"bits": bits, "run": run})
    same_name, same = Window.partitionBy("name"), Window.partitionBy("name", "around", "bits")
    several = [F.min(c).over(same_name) != F.max(c).over(same_name) for c in ("around", "bits")]
    judged = symbols.withColumn("several", several[0] | several[1] | (F.max("known").over(same_name) == _CHECK))
    judged = judged.withColumn("first", F.min(place).over(same))
    later = (F.col("known") == _LATER) | (place > F.col("first"))
    judged = judged.select("id", "th", "run", later.alias("later"), "several").where("later or several")
    candidates = judged.where("not later").groupBy("id", "th").agg(F.collect_list("run").alias("found"))

    windows = base.join(candidates, ["id", "th"]).mapInArrow(_windows, "w long, x long, id long, th long, known byte").repartition("w").withColumns({"bits": bits, "run": run})
    first = F.min(place).over(Window.partitionBy("w", "bits"))
    checked = windows.withColumn("first", first).where((F.col("known") == _LATER) | (place > F.col("first"))).select("id", "th", "run")
    repeats = judged.where("later").select("id", "th", "run").unionByName(checked).groupBy("id", "th").agg(F.collect_list("run").alias("found"))
    return base.join(repeats, ["id", "th"], "left").drop("th").mapInArrow(finish, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): `docs` without words of windows that stand earlier too.

    A null text has no words. A null id counts as the smallest. Of rows that share an id, a window at
    the same place in both is in neither earlier than in the other. A text shorter than a window is
    kept whole, and an empty table gives an empty one. Other columns are not read.
    """
    return _remove(docs, _kept, "id long, n_words long, n_removed long, kept binary").select(
        F.nullif(F.col("id"), F.lit(_NO_ID)).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept")
    )


def remove_repeats_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document; nulls and repeated rows as in `remove_repeats`."""
    return _remove(docs, _hashed, "id long, n_words long, n_removed long, kept_sha256 string").select(
        F.nullif(F.col("id"), F.lit(_NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept_sha256"
    )
