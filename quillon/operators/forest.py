"""Regression forests of many models grown side by side.

A row belongs to a model (a number) as training or test row. All trees of all models are grown in one job:

* Inputs are binned by each model's own training quantiles, so a row is a byte per input.
* A tree's bag is drawn by hash of (seed, row key, tree): Poisson counts of mean 1, the same wherever and
  whenever the row is read.
* Nodes with more than `local_rows` rows of the bag are split level by level: tasks add up histograms keyed by
  (model, tree, node) over input and bin, one task a node picks the best cut. Only such nodes' cuts pass the
  driver, in blocks of trees whose cuts stay below `cut_bytes`.
* A node of at most `local_rows` rows goes to one task, which grows the rest of its subtree from the same
  histograms. Trees of a model that has no larger node share one copy of its rows per group of trees; groups are
  as large as leaves every core some, so the copies are few and no row travels once per tree.

Both ways choose the same cuts: `local_rows` changes where work is done, not its result (but for the last bits
of sums). Trees stay in a table; rows to predict travel once and meet all trees of their model. Rows alike in all
bins are one row to every cut: a task adds them up once a bag, and predicts them once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.intermediate import cut

#: Trees that at least share one copy of a model's rows, and one task; rows up to which no more do.
GROUP, FEW = 25, 200_000
#: Tasks a core over which trees are dealt, and rows that one task predicts.
DEALT, TOLD = 4, 1 << 22
#: Cells (node, input, bin) whose sums a task holds at a time.
CELLS = 1 << 21
#: Rows that meet a tree at a time.
BLOCK = 1 << 14
#: Rows of a node from which its sums are made of joint codes; what rows and whole weights stay below to be added up as one.
JOINED, PACKED = 1 << 13, 1 << 26
#: Bytes of histograms that a task holds before it passes them on.
HELD = 64 << 20


@dataclass(frozen=True)
class Growth:
    """How trees grow: their number and depth, rows of the bag a leaf keeps, bins of an input, seed, rows of a node that one task takes, bytes of cuts on the driver."""

    trees: int = 400
    depth: int = 12
    leaf: int = 10
    bins: int = 64
    seed: int = 42
    local_rows: int = 1 << 24
    cut_bytes: int = 64 << 20


def bag(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bag: Poisson of mean 1, from a mix of key, tree and seed."""
    # The constants of the splitmix64 finaliser.
    mixed = keys.astype(np.uint64) ^ np.uint64(((seed + 1) * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % 2**64)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    share = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    upto = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(np.arange(17), 1.0)))
    # Most of 4,096 stretches of shares have one count; only shares in the others are searched for.
    low, high = (np.searchsorted(upto, (np.arange(4096) + k) / 4096.0, side="right") for k in (0, 1))
    stretch = (share * 4096.0).astype(np.int64)
    times = low[stretch]
    open_ = np.flatnonzero((low != high)[stretch])
    times[open_] = np.searchsorted(upto, share[open_], side="right")
    return times


def alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(first row of each group of equal rows, group of each row); None if groups are more than half the rows.

    Rows are told apart by a hash, and each is compared with the first of its group.
    """
    mixed = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        mixed = (mixed ^ rows[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, first, group = np.unique(mixed, return_index=True, return_inverse=True)
    if 2 * len(first) > len(rows) or not (rows[first[group]] == rows).all():
        return None
    return first, group


def histograms(place: np.ndarray, nodes: int, bins: np.ndarray, offsets: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(3, nodes, cells): rows, weight and weighted label by node and by input's bin."""
    sums, kinds = np.empty((3, nodes, int(offsets[-1]))), (None, w, w * y)
    whole = [np.bincount(place, v, nodes) for v in kinds]
    first: dict[int, np.ndarray] = {}
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a == 2:  # an input with two values, as one-hot ones are: only rows of the second are added up
            on = np.flatnonzero(bins[:, i])
            for kind, v in enumerate(kinds):
                sums[kind, :, a + 1] = np.bincount(place[on], v if v is None else v[on], nodes)
                sums[kind, :, a] = whole[kind] - sums[kind, :, a + 1]
            continue
        if b - a not in first:
            first[b - a] = place * (b - a)
        flat = first[b - a] + bins[:, i]
        for kind, v in enumerate(kinds):
            sums[kind, :, a:b] = np.bincount(flat, v, nodes * (b - a)).reshape(nodes, b - a)
    return sums


def best_cuts(sums: np.ndarray, offsets: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node the input (-1: none) and the last bin of its left side that lower squared error most, the node's mean, and rows of the left side.

    Both sides keep `leaf` rows; equal gains (to nine digits, so that no order of sums tells) go to the first input and bin.
    """
    nodes = sums.shape[1]
    first = sums[:, :, : offsets[1]]
    total = first.sum(axis=2)
    mean = total[2] / np.maximum(total[1], 1e-300)
    most, chosen, last, size = np.zeros(nodes), np.full(nodes, -1, np.int16), np.zeros(nodes, np.int16), np.zeros(nodes, np.int64)
    whole = total[2] * mean
    scale, every = 1e-12 * np.abs(whole), np.arange(nodes)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b - a < 2:
            continue
        left = np.cumsum(sums[:, :, a : b - 1], axis=2)
        right = total[:, :, None] - left
        fits = (left[0] >= leaf) & (right[0] >= leaf) & (left[1] > 0) & (right[1] > 0)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            gain = left[2] * left[2]
            gain /= left[1]
            other = right[2] * right[2]
            other /= right[1]
            gain += other
            gain -= whole[:, None]
        gain[~fits] = 0.0
        at = gain.argmax(axis=1)
        found = gain[every, at]
        better = np.flatnonzero(found > most * (1 + 1e-9) + scale)
        most[better], chosen[better], last[better], size[better] = found[better], i, at[better], left[0][better, at[better]]
    return chosen, last, mean, size


class Prepared:
    """A model's rows by columns, made once for all trees that a task grows of them.

    Two-valued inputs that no row has together (one-hot ones) share a column: its code says which of them a row
    has, 0 none. Inputs of one bin have no column. Neighbouring columns have a joint code as well, of which large
    nodes' sums are made: half as many are added up, and each input's are the margins. Rows alike in all bins, which
    no cut tells apart, are added up once a bag and go on as one, where that leaves at most half of them.
    """

    def __init__(self, bins: np.ndarray, y: np.ndarray, w: np.ndarray, offsets: np.ndarray):
        self.y, self.w, self.offsets, self.group = y, w, offsets, None
        # Whole weights and rows are added up as one number, which holds both exactly.
        self.whole = bool((w == np.floor(w)).all())
        same = alike(bins) if len(y) >= JOINED else None
        if same is not None:
            bins, self.group = bins[same[0]], same[1]
        plain, shared = [], []
        for i, width in enumerate(np.diff(offsets).tolist()):
            if width > 2:
                plain.append((np.ascontiguousarray(bins[:, i]), [i]))
            elif width == 2:
                own = np.array(bins[:, i])
                for code, inputs in shared:
                    if len(inputs) < 255 and not (own.astype(bool) & (code > 0)).any():
                        inputs.append(i)
                        code += own * np.uint8(len(inputs))
                        break
                else:
                    shared.append((own, [i]))
        both = plain + shared
        self.inputs = [inputs for _, inputs in both]
        self.columns = np.stack([c for c, _ in both]) if both else np.empty((0, len(bins)), np.uint8)
        self.width = [int(offsets[i[0] + 1] - offsets[i[0]]) if k < len(plain) else len(i) + 1 for k, i in enumerate(self.inputs)]
        # Where a row with each input stands: its column, and the codes (low, high] that go right after a cut at bin 0.
        self.column, self.code = np.zeros(len(offsets), np.int64), np.full(len(offsets), -1)
        for k, inputs in enumerate(self.inputs):
            self.column[inputs] = k
            if k >= len(plain):
                self.code[inputs] = np.arange(len(inputs))
        self.joint = [(k, self.columns[k].astype(np.uint16) * np.uint16(self.width[k + 1]) + self.columns[k + 1]) for k in range(0, len(both) - 1, 2)] if len(bins) >= JOINED else []

    def add(self, at: np.ndarray, nodes: int, columns: Sequence[np.ndarray], joint: Sequence[np.ndarray], kinds: Sequence[np.ndarray]) -> np.ndarray:
        """(3, nodes, cells): rows, weight and weighted label by node and by input's bin. `kinds`: packed and label, or all three."""
        sums = np.empty((3, nodes, int(self.offsets[-1])))
        into = sums[3 - len(kinds) :]
        first: dict[int, np.ndarray] = {}

        def count(code: np.ndarray, width: int) -> list[np.ndarray]:
            if width not in first:
                first[width] = at * width
            flat = first[width] + code
            return [np.bincount(flat, v, nodes * width) for v in kinds]

        found: list[list[np.ndarray]] = []
        for (k, _), code in zip(self.joint, joint, strict=False):
            a, b = self.width[k : k + 2]
            both = [v.reshape(nodes, a, b) for v in count(code, a * b)]
            found += [[v.sum(axis=2) for v in both], [v.sum(axis=1) for v in both]]
        for k in range(len(found), len(self.inputs)):
            found.append([v.reshape(nodes, -1) for v in count(columns[k], self.width[k])])
        for inputs, of_kinds, code in zip(self.inputs, found, [self.code[i[0]] for i in self.inputs], strict=True):
            for kind, v in enumerate(of_kinds):
                if code < 0:
                    into[kind, :, self.offsets[inputs[0]] : self.offsets[inputs[0] + 1]] = v
                    continue
                low = self.offsets[inputs]
                into[kind][:, low + 1] = v[:, 1:]
                into[kind][:, low] = v.sum(axis=1, keepdims=True) - v[:, 1:]
        none = np.flatnonzero(np.diff(self.offsets) == 1)
        if len(none):
            for kind, v in enumerate(kinds):
                into[kind][:, self.offsets[none]] = np.bincount(at, v, nodes)[:, None]
        if len(kinds) == 2:
            np.floor(sums[1] / PACKED, out=sums[0])
            sums[1] -= sums[0] * PACKED
        return sums

    def grow(self, times: np.ndarray, g: Growth, root: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The subtree below a node as (node, input or -1, bin, mean) from a bag; a node's children are 2 n and 2 n + 1.

        Histograms are made of nodes that can still be cut: above the last level, with rows for two leaves. Where the
        parents' are held, only the smaller child's rows are added up and the larger one's are the difference. Rows
        in leaves stand in a place past all nodes until they are a fifth of all.
        """
        times = np.asarray(times)
        rows, w = (times > 0).astype(float), self.w * times
        wy = w * self.y
        if self.group is not None:
            rows, w, wy = (np.bincount(self.group, v) for v in (rows, w, wy))
        on = np.flatnonzero(rows)
        if not len(on):
            return (np.empty(0, np.int64),) * 4
        rows, w, wy = rows[on], w[on], wy[on]
        cells, leaf, n_rows = int(self.offsets[-1]), 2 * g.leaf, rows.sum()
        kinds = [rows * PACKED + w, wy] if self.whole and max(w.sum(), n_rows) < PACKED else [rows, w, wy]
        columns, joint = self.columns.take(on, axis=1), [c[on] for _, c in self.joint]
        every = np.arange(len(on))
        out: list[tuple] = []
        ids, place, size = np.array([root], np.int64), np.zeros(len(on), np.int64), np.array([n_rows], np.int64)
        above: np.ndarray | None = None  # sums of the parents, whose children are 2 k and 2 k + 1
        while len(ids):
            n = len(ids)
            chosen, last, mean, left = np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n), np.zeros(n, np.int64)
            wanted = (size >= leaf) & (ids < 1 << g.depth)
            # Sums are held where nodes have so many rows that a difference costs less than adding up.
            held = np.empty((3, n, cells)) if n * cells <= min(CELLS, len(place) * len(columns) // 2) else None

            def direct(nodes: np.ndarray) -> np.ndarray:
                if len(nodes) == n == 1:  # noqa: B023
                    return self.add(place, 1, columns, joint, kinds)  # noqa: B023
                rank = np.full(n + 1, -1, np.int64)  # noqa: B023
                rank[nodes] = np.arange(len(nodes))
                at = rank.take(place)  # noqa: B023
                here = np.flatnonzero(at >= 0)
                wide = joint if len(here) >= JOINED * len(nodes) else []  # noqa: B023
                return self.add(at.take(here), len(nodes), [c if k < 2 * len(wide) else c.take(here) for k, c in enumerate(columns)], [c.take(here) for c in wide], [v.take(here) for v in kinds])  # noqa: B023

            if held is not None and above is not None:
                pairs = np.flatnonzero(wanted.reshape(-1, 2).any(axis=1))
                small = 2 * pairs + (size[2 * pairs + 1] < size[2 * pairs])
                if len(pairs):
                    held[:, small] = direct(small)
                    rest = above[:, pairs] - held[:, small]
                    rest[:, rest[0] == 0] = 0.0  # what is left of equal sums would break ties of empty bins
                    held[:, small ^ 1] = rest
            open_ = np.flatnonzero(wanted)
            step = max(1, CELLS // cells)
            for a in range(0, len(open_), step):
                nodes = open_[a : a + step]
                if held is None:
                    sums = direct(nodes)
                elif above is None:
                    sums = held[:, nodes] = direct(nodes)
                else:
                    sums = held[:, nodes]
                chosen[nodes], last[nodes], mean[nodes], left[nodes] = best_cuts(sums, self.offsets, g.leaf)
            cut_ = np.flatnonzero(chosen >= 0)
            # Rows whose node is a leaf are added up as they are.
            leaves = chosen < 0
            if leaves.any():
                ends = np.flatnonzero(np.append(leaves, False).take(place))
                stands = place.take(ends)
                mean[leaves] = (np.bincount(stands, kinds[-1].take(ends), n) / np.maximum(np.bincount(stands, w.take(ends), n), 1e-300))[leaves]
            out.append((ids, chosen, last, mean))
            # Children in order of number: those of the k-th node that is cut are 2 k and 2 k + 1, and both have rows.
            above = held[:, cut_] if held is not None else None
            onto, low, high = np.full(n + 1, 2 * len(cut_), np.int64), np.full(n + 1, 255, np.uint8), np.full(n + 1, 255, np.uint8)
            by = np.zeros(n + 1, np.int64)
            of = chosen[cut_]
            onto[cut_], by[cut_] = 2 * np.arange(len(cut_)), self.column[of] * len(place)
            low[cut_] = np.where(self.code[of] < 0, last[cut_], self.code[of])  # a code is right of its input alone
            high[cut_] = np.where(self.code[of] < 0, 255, self.code[of] + 1)
            if not len(cut_):
                break
            code = by.take(place)
            code += every
            code = columns.ravel().take(code)
            right = code > low.take(place)
            if (high < 255).any():
                right &= code <= high.take(place)
            place = onto.take(place)
            place += right
            size = np.stack([left[cut_], size[cut_] - left[cut_]], axis=1).ravel()
            ids = (2 * ids[cut_][:, None] + np.arange(2)).ravel()
            if size.sum() < 0.8 * n_rows:
                n_rows, live = size.sum(), np.flatnonzero(place < len(ids))
                place, columns, w, joint = place[live], columns.take(live, axis=1), w[live], [c[live] for c in joint]
                kinds, every = [v[live] for v in kinds], every[: len(live)]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, offsets: np.ndarray, g: Growth, root: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The subtree below a node from rows that are all in the bag; see `Prepared.grow`."""
    return Prepared(bins, y, w, offsets).grow(np.ones(len(y), np.int64), g, root)


class _Cuts:
    """Cuts of nodes found level by level: by (model, tree) dense arrays over node numbers."""

    def __init__(self) -> None:
        self.of: dict[tuple[int, int], dict[int, tuple[int, int, float]]] = {}

    def add(self, model: int, tree: int, node: int, chosen: int, last: int, mean: float) -> None:
        self.of.setdefault((model, tree), {})[node] = (chosen, last, mean)

    def place(self, model: int, tree: int, bins: np.ndarray) -> np.ndarray:
        """The node in which each row stands so far; 0 where it stands in a leaf."""
        node = np.ones(len(bins), np.int64)
        found = self.of.get((model, tree))
        if not found:
            return node
        chosen, last = np.full(max(found) + 1, -2), np.zeros(max(found) + 1, np.int64)
        for n, (c, b, _) in found.items():
            chosen[n], last[n] = c, b
        while True:
            known = chosen[np.minimum(node, len(chosen) - 1)]
            go = (node < len(chosen)) & (known >= 0)
            if not go.any():
                return np.where((node < len(chosen)) & (known == -1), 0, node)
            node[go] = 2 * node[go] + (bins[go, known[go]] > last[node[go]])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _edges(training: DataFrame, width: int, bins: int) -> dict[int, list[np.ndarray]]:
    """By model and input, the values above which a new bin begins: training quantiles (a bounded sketch), each once."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = training.groupBy("model").agg(*[F.percentile_approx(F.col("x")[i], shares, 10_000).alias(f"q{i}") for i in range(width)]).collect()  # a row per model
    return {r["model"]: [np.unique(np.array(r[f"q{i}"] or [], float)) for i in range(width)] for r in found}


def _binned(edges: dict[int, list[np.ndarray]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model, part in batch.groupby("model", sort=False):
                x = np.stack(part["x"].to_numpy()).astype(float)
                coded = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges[model])], axis=1).astype(np.uint8)
                yield part.drop(columns="x").assign(bins=[r.tobytes() for r in coded])

    return run


def _offsets(edges: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])]).astype(np.int64)


def _level(training: DataFrame, active: dict[tuple[int, int], set[int]], cuts: _Cuts, offsets: dict[int, np.ndarray], g: Growth) -> list:
    """One level of large nodes: (model, tree, node, chosen, last, mean, left, right) of each active one."""
    shared = training.sparkSession.sparkContext.broadcast((active, cuts))  # bounded by `cut_bytes`

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        active, cuts = shared.value
        trees_of: dict[int, list[int]] = {}
        for m, t in active:
            trees_of.setdefault(m, []).append(t)
        held: dict[tuple[int, int, int], np.ndarray] = {}

        def out() -> pd.DataFrame:
            frame = pd.DataFrame([(*k, v.tobytes()) for k, v in held.items()], columns=["model", "tree", "node", "sums"])
            held.clear()
            return frame

        size = 0
        for batch in batches:
            for model, part in batch.groupby("model", sort=False):
                bins, keys, y, w = _matrix(part["bins"]), part["key"].to_numpy(), part["y"].to_numpy(), part["w"].to_numpy()
                for tree in trees_of.get(model, ()):
                    times, node = bag(keys, tree, g.seed), cuts.place(model, tree, bins)
                    for n in active[model, tree] & set(np.unique(node).tolist()):
                        here = (node == n) & (times > 0)
                        sums = histograms(np.zeros(here.sum(), np.int64), 1, bins[here], offsets[model], (w * times)[here], y[here])
                        if (model, tree, n) in held:
                            held[model, tree, n] += sums
                        else:
                            held[model, tree, n], size = sums, size + sums.nbytes
                if size > HELD:
                    yield out()
                    size = 0
        if held:
            yield out()

    def choose(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        model, tree, node = map(int, key)
        at = offsets[model]
        sums = sum(np.frombuffer(b).reshape(3, 1, int(at[-1])) for b in parts["sums"])
        chosen, last, mean = (v[0] for v in best_cuts(sums, at, g.leaf)[:3])
        chosen = -1 if node >= 1 << g.depth else int(chosen)
        here = sums[0, 0, at[max(chosen, 0)] : at[max(chosen, 0) + 1]]
        left = here[: last + 1].sum()
        return pd.DataFrame([(model, tree, node, chosen, int(last), float(mean), int(left), int(here.sum() - left))], columns=["model", "tree", "node", "chosen", "last", "mean", "left", "right"])

    sums = training.mapInPandas(count, "model int, tree int, node long, sums binary")
    done = sums.groupBy("model", "tree", "node").applyInPandas(choose, "model int, tree int, node long, chosen int, last int, mean double, left long, right long").collect()  # large nodes of a block of trees
    shared.unpersist()
    return done


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """By key over four tasks a core: the rows are few bytes and much work, so they should not be drawn together."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


_TREES = "model int, part int, tree int, node binary, chosen binary, last binary, mean binary"


def _tree_row(model: int, tree: int, nodes: Sequence[np.ndarray]) -> tuple:
    kinds = (np.int32, np.int16, np.int16, float)
    return (model, tree // GROUP, tree, *[np.asarray(v).astype(k).tobytes() for v, k in zip(nodes, kinds, strict=True)])


def _rest(training: DataFrame, small: dict[int, int], trees: range, cuts: _Cuts, offsets: dict[int, np.ndarray], g: Growth) -> DataFrame:
    """Subtrees of all nodes that one task takes, in `_TREES`; a model in `small` sends its rows once per group of as many trees as it says there."""
    shared = training.sparkSession.sparkContext.broadcast(cuts)

    def pack(part: pd.DataFrame) -> list[bytes]:
        return [b"".join(part["bins"]), *(part[c].to_numpy().tobytes() for c in ("key", "y", "w"))]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["model", "low", "node", "bins", "key", "y", "w"]
        for batch in batches:
            for model, part in batch.groupby("model", sort=False):
                if model in small:
                    packed = pack(part)
                    yield pd.DataFrame([(model, low, 1, *packed) for low in trees[:: small[model]]], columns=names)
                    continue
                bins, keys = _matrix(part["bins"]), part["key"].to_numpy()
                for tree in trees:
                    node = np.where(bag(keys, tree, g.seed) > 0, shared.value.place(model, tree, bins), 0)
                    yield pd.DataFrame([(model, tree, n, *pack(part[node == n])) for n in np.unique(node) if n], columns=names)

    def finish(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        model, low, root = map(int, key)
        keys, y, w = (np.frombuffer(b"".join(parts[c]), t) for c, t in (("key", np.int64), ("y", float), ("w", float)))
        bins = np.frombuffer(b"".join(parts["bins"]), np.uint8).reshape(len(y), -1)
        order = np.lexsort((w, y, keys))
        keys, y, w, bins = keys[order], y[order], w[order], bins[order]
        out, rows = [], Prepared(bins, y, w, offsets[model])
        for tree in range(low, min(low + small[model], trees.stop)) if model in small else [low]:
            times = bag(keys, tree, g.seed)
            times = times if times.any() else np.ones(len(keys), np.int64)
            out.append(_tree_row(model, tree, rows.grow(times, g, root)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _TREES.split(", ")])

    sent = training.mapInPandas(send, "model int, low int, node long, bins binary, key binary, y binary, w binary")
    return _spread(sent, "model", "low", "node").groupBy("model", "low", "node").applyInPandas(finish, _TREES)


def fit(training: DataFrame, edges: dict[int, list[np.ndarray]], g: Growth = Growth()) -> DataFrame:
    """Forests of all models as a table of nodes. `training`: (model, key, bins, y, w), read several times."""
    spark, offsets = training.sparkSession, {m: _offsets(e) for m, e in edges.items()}
    rows = {r["model"]: r["count"] for r in training.groupBy("model").count().collect()}
    # A bag of n Poisson counts holds at most n rows.
    small = {m: GROUP for m, n in rows.items() if n <= g.local_rows}
    # Trees of wide models are dealt so that each core has some tasks; every group is a copy of the model's rows.
    wide = [m for m in small if rows[m] > FEW]
    share = math.ceil(len(wide) * g.trees / (DEALT * spark.sparkContext.defaultParallelism))
    small |= {m: max(GROUP, math.ceil(g.trees / math.ceil(g.trees / max(1, share)))) for m in wide}
    large = {m: n for m, n in rows.items() if m not in small}
    done = []
    if small:
        done.append(_rest(training.where(F.col("model").isin(sorted(small))), small, range(g.trees), _Cuts(), offsets, g))
    if large:
        part = training.where(F.col("model").isin(sorted(large)))
        widest = sum(min(2 ** (g.depth + 1), 4 * n // g.local_rows + 1) for n in large.values()) * 64  # bytes of a tree's cuts in all models
        step = max(1, g.cut_bytes // widest)
        for low in range(0, g.trees, step):
            trees, cuts = range(low, min(low + step, g.trees)), _Cuts()
            active = {(m, t): {1} for m in large for t in trees}
            while active:
                found, active = _level(part, active, cuts, offsets, g), {}
                for r in found:
                    cuts.add(r.model, r.tree, r.node, r.chosen, r["last"], r.mean)
                    if r.chosen >= 0:
                        for child, n in ((2 * r.node, r.left), (2 * r.node + 1, r.right)):
                            if n > g.local_rows:
                                active.setdefault((r.model, r.tree), set()).add(child)
            upper = [_tree_row(m, t, list(zip(*[(n, *v) for n, v in nodes.items()], strict=True))) for (m, t), nodes in cuts.of.items()]
            done += [spark.createDataFrame(upper, _TREES), cut(_rest(part, {}, trees, cuts, offsets, g), "subtrees")]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return cut(out, "trees")


def predict(rows: DataFrame, forest: DataFrame, g: Growth = Growth()) -> DataFrame:
    """(n, set, value): the mean of a model's trees. `rows`: (model, n, set, bins); (n, set) names a row once."""
    counts = {r["model"]: r["count"] for r in rows.groupBy("model").count().collect()}  # a row per model
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    pieces = {m: max(math.ceil(n / TOLD), min(math.ceil(n / 10_000), math.ceil(tasks / len(counts)))) for m, n in counts.items()}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            piece = batch["n"].to_numpy() % batch["model"].map(pieces).to_numpy()
            yield pd.DataFrame([(m, k, s, p["n"].to_numpy().tobytes(), b"".join(p["bins"])) for (m, k, s), p in batch.groupby(["model", piece, "set"], sort=False)], columns=["model", "piece", "set", "n", "bins"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece in range(max(pieces.values(), default=0)):
                yield batch[batch["model"].map(pieces).fillna(0) > piece].assign(piece=piece)

    def walk(key: tuple, packed: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if packed.empty:
            return pd.DataFrame({"n": [], "set": [], "value": []})
        n = np.frombuffer(b"".join(packed["n"]), np.int64)
        sets = np.repeat(packed["set"].to_numpy(), packed["n"].map(len).to_numpy() // 8)
        bins, size = np.frombuffer(b"".join(packed["bins"]), np.uint8).reshape(len(n), -1), 2 << g.depth
        same = alike(bins)  # rows that all trees predict alike go as one
        bins = bins if same is None else bins[same[0]]
        total, flat, wide = np.zeros(len(bins)), bins.ravel(), bins.shape[1]
        for _, one in trees.sort_values("tree").groupby("tree"):
            # A leaf is its own left child, and nothing stands right of its cut.
            onto, chosen, last, mean = np.arange(size), np.zeros(size, np.int64), np.full(size, 255, np.uint8), np.zeros(size)
            deep = 1
            for t in one.itertuples(index=False):
                at, by = np.frombuffer(t.node, np.int32), np.frombuffer(t.chosen, np.int16)
                mean[at] = np.frombuffer(t.mean)
                at, bin_, by = at[by >= 0], np.frombuffer(t.last, np.int16)[by >= 0], by[by >= 0]
                onto[at], chosen[at], last[at] = 2 * at, by, bin_
                deep = max(deep, int(at.max(initial=1)))
            for a in range(0, len(bins), BLOCK):
                row = np.arange(a, min(a + BLOCK, len(bins))) * wide
                node = np.ones(len(row), np.int64)
                for _ in range(deep.bit_length()):
                    right = flat.take(row + chosen.take(node)) > last.take(node)
                    node = onto.take(node)
                    node += right
                total[a : a + BLOCK] += mean.take(node)
        total = total if same is None else total[same[1]]
        return pd.DataFrame({"n": n, "set": sets, "value": total / g.trees})

    packed = _spread(rows.mapInPandas(pack, "model int, piece int, set string, n binary, bins binary"), "model", "piece")
    dealt = _spread(forest.mapInPandas(deal, f"{_TREES}, piece int"), "model", "piece")
    return packed.groupBy("model", "piece").cogroup(dealt.groupBy("model", "piece")).applyInPandas(walk, "n long, set string, value double")


def crossfit(placed: DataFrame, inputs: Sequence[str], label: str, keys: Sequence[str], weight: str | None = None, also: dict[str, Sequence[str]] | None = None, g: Growth = Growth()) -> DataFrame:
    """The test rows of `placed` with `oof`, each predicted by the forest of its model.

    `placed` has (model int, role 'train' or 'test') per row and model. `keys` name a row, for its bags. `also`
    names further predictions from other columns, in order of `inputs`, by the same forests. Null inputs, or
    rows without label or with a weight that is not above 0, do not train; null inputs are 0 in predictions.
    A model without training rows predicts null. Inputs have at most 256 bins.
    """
    if not 2 <= g.bins <= 256:
        raise ValueError("an input has 2 to 256 bins")
    sets = {"oof": list(inputs), **{k: list(v) for k, v in (also or {}).items()}}

    def vector(columns: Sequence[str], fill: bool = True):  # noqa: ANN202
        return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if fill else F.col(c).cast("double") for c in columns])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    train = placed.where("role = 'train'").select(F.col("model").cast("int").alias("model"), F.xxhash64(*keys).alias("key"), vector(inputs, False).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
    train = train.where("w > 0 and y is not null and not exists(x, v -> v is null)")
    edges = _edges(train, len(inputs), g.bins)
    test = cut(placed.where("role = 'test'").withColumn("__n", F.monotonically_increasing_id()), "held")
    if not edges:
        return test.drop("__n", "role").withColumns({name: F.lit(None).cast("double") for name in sets})
    coded = cut(train.mapInPandas(_binned(edges), "model int, key long, y double, w double, bins binary"), "binned")
    forest = fit(coded, edges, g)
    wanted = test.where(F.col("model").isin(sorted(edges))).select(F.col("model").cast("int").alias("model"), F.col("__n").alias("n"), F.explode(F.array(*[F.struct(F.lit(k).alias("set"), vector(c).alias("x")) for k, c in sets.items()])).alias("s")).select("model", "n", "s.*")
    told = predict(wanted.mapInPandas(_binned(edges), "model int, n long, set string, bins binary"), forest, g)
    told = cut(told, "predicted")
    wide = told.groupBy(F.col("n").alias("__n")).agg(*[F.max(F.when(F.col("set") == k, F.col("value"))).alias(k) for k in sets])
    return test.join(wide, "__n", "left").drop("__n", "role")
