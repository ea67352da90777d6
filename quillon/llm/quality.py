"""Quality classification by nearest-neighbour voting in a latent semantic space.

A text is a vector of hashed byte bigrams, word beginnings and word shapes, and of words that follow
as they did before in the text. Counts are damped and weighted by rarity, and a truncated singular
value decomposition of the labelled texts' vectors gives the latent space. The labelled vectors, a
bounded sample, are broadcast; every document's cosine products with all of them are computed in
blocks, exactly, and its nearest neighbours vote for their labels with weights from their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.langid import HELD_OUT, fold_of
from quillon.llm.words import LOWER, NOT_BLANK, blocks, hashes, mix, ranges, split

#: Labelled documents to learn from at most: the bound of what is broadcast.
MAX_LABELLED = 4096
#: Hashed features, latent dimensions, neighbours that vote, and the power of their similarity.
FEATURES, DIMENSIONS, NEIGHBOURS, POWER = 2048, 48, 25, 8
THRESHOLD = 0.7
#: Rows that are multiplied at once, always as many, so that a score does not depend on its neighbours in a batch.
_ROWS = 256

# Bytes of a word's shape. Fixed classes: small, capital, digit, beyond ASCII, sentence mark, other.
_SHAPE = np.full(256, 5, dtype=np.uint64)
_SHAPE[0x61:0x7B], _SHAPE[0x41:0x5B], _SHAPE[0x30:0x3A], _SHAPE[0x80:] = 0, 1, 2, 3
_SHAPE[[ord(c) for c in ".,;:!?'\"()-"]] = 4


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of hashed feature counts (float32) for each text."""
    n = len(offsets) - 1
    out = np.zeros(n * FEATURES, dtype=np.float32)
    size = np.diff(offsets)
    half = np.uint64(FEATURES // 2 - 1)
    at = ranges(offsets[:-1], np.maximum(size - 1, 0))
    text = np.repeat(np.arange(n), np.maximum(size - 1, 0))
    if len(at):
        pair = mix(data[at].astype(np.uint64) * np.uint64(256) + data[at + 1], 81) & half
        out += np.bincount(text * FEATURES + pair.astype(np.int64), minlength=n * FEATURES).astype(np.float32)
    starts, ends, first = split(data, offsets, NOT_BLANK)
    if len(starts):
        owner = np.repeat(np.arange(n), np.diff(first))
        length = ends - starts
        quarter = np.uint64(FEATURES // 4 - 1)
        # A word's shape: classes of its first bytes and of its last three, and its length up to 12.
        shape = np.zeros(len(starts), dtype=np.uint64)
        for j in range(3):
            shape = shape * np.uint64(8) + _SHAPE[data[np.minimum(starts + j, ends - 1)]]
            shape = shape * np.uint64(8) + _SHAPE[data[np.maximum(ends - 1 - j, starts)]]
        shape = mix(shape * np.uint64(16) + np.minimum(length, 12).astype(np.uint64), 82) & quarter
        out += np.bincount(owner * FEATURES + FEATURES // 2 + shape.astype(np.int64), minlength=n * FEATURES).astype(np.float32)
        # Words that follow the word they followed before, by how often that has been; and common words.
        name = hashes(LOWER[data], starts, ends)
        pair = mix(name, 83)
        pair[1:] ^= name[:-1]
        key = pair ^ mix(owner.astype(np.uint64), 84)
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        heads = np.flatnonzero(new)
        times = np.arange(len(key)) - np.repeat(heads, np.diff(np.append(heads, len(key))))
        again = np.zeros(len(key), dtype=np.int64)
        again[order] = np.minimum(times, 7)
        slot = FEATURES * 3 // 4 + again
        out += np.bincount(owner * FEATURES + slot, minlength=n * FEATURES).astype(np.float32)
        word = (mix(name, 85) % np.uint64(FEATURES // 4 - 8)).astype(np.int64) + FEATURES * 3 // 4 + 8
        out += np.bincount(owner * FEATURES + word, minlength=n * FEATURES).astype(np.float32)
    return out.reshape(n, FEATURES)


@dataclass(frozen=True)
class Voters:
    """Feature weights, the latent basis, labelled vectors of length 1, their labels, the labels' mean."""

    rarity: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    x = np.log1p(200 * share) * rarity
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(counts: np.ndarray, labels: np.ndarray, seed: int = 5) -> Voters:
    """The latent space of labelled count rows, and their vectors in it."""
    if not len(counts):
        return Voters(np.ones(FEATURES, dtype=np.float32), np.zeros((FEATURES, 1), dtype=np.float32), np.zeros((0, 1), dtype=np.float32), labels.astype(np.float32), 0.5)
    rarity = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.3).astype(np.float32)
    x = _weighted(counts, rarity).astype(np.float32)
    k = min(DIMENSIONS, *x.shape)
    # Randomised subspace iteration for the leading right singular vectors.
    q = np.random.default_rng(seed).normal(size=(FEATURES, min(k + 16, FEATURES))).astype(np.float32)
    for _ in range(5):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ v.T)[:, :k].astype(np.float32)
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(k)] < 0, -1, 1).astype(np.float32)
    return Voters(rarity, basis, _unit(x @ basis).astype(np.float32), labels.astype(np.float32), float(labels.mean()))


def vote(voters: Voters, counts: np.ndarray) -> np.ndarray:
    """The score of each count row (_ROWS at most): its neighbours' labels, weighted by their similarity.

    Similarities are taken to 2 ** -16, and of equally near vectors those of smaller number vote.
    """
    n = len(counts)
    if not len(voters.vectors):
        return np.full(n, voters.prior)
    full = np.zeros((_ROWS, FEATURES), dtype=np.float32)
    full[:n] = counts
    vectors = _unit(_weighted(full, voters.rarity).astype(np.float32) @ voters.basis)
    likeness = np.rint((vectors @ voters.vectors.T)[:n] * 65536).astype(np.int64)
    order = likeness * likeness.shape[1] + np.arange(likeness.shape[1])[::-1]
    k = min(NEIGHBOURS, likeness.shape[1])
    near = np.argpartition(-order, k - 1, axis=1)[:, :k] if k < likeness.shape[1] else np.broadcast_to(np.arange(k), (n, k))
    near = np.sort(near, axis=1)
    weight = (np.maximum(np.take_along_axis(likeness, near, axis=1), 0) / 65536.0) ** POWER
    total = weight.sum(axis=1)
    score = np.where(total > 1e-9, (weight * voters.labels[near]).sum(axis=1) / np.maximum(total, 1e-9), voters.prior)
    return np.clip(np.where(counts.sum(axis=1) > 0, score, voters.prior), 0, 1)


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Count rows of the texts, a bounded number at a time."""
    for at in range(0, len(offsets) - 1, _ROWS):
        own = offsets[at : at + _ROWS + 1]
        yield term_counts(data[own[0] : own[-1]], own - own[0])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch):
            rows = [x.tobytes() for counts in _slices(data, offsets) for x in counts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["quality", "h", "counts"])


def _scores(shared, columns: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for batch in batches:
            for part, data, offsets in blocks(batch, "__text"):
                found = [vote(voters, counts) for counts in _slices(data, offsets)]
                arrays = [part.column(i) for i in range(columns)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate(found), pa.float64())], names=[*part.schema.names[:columns], "__score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Voters:
    """Voters from at most `max_labelled` labelled documents outside the held-out fold, chosen by a hash of the id."""
    known = labels.where("quality is not null and doc_id is not null").where(fold_of(F.col("doc_id")) != HELD_OUT)
    picked = known.select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "quality").limit(max_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("quality", "h", "text")  # max_labelled rows of three numbers
    rows = texts.mapInArrow(_count, "quality int, h long, counts binary").orderBy("h", "quality", "counts").limit(max_labelled).collect()
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in rows), dtype=np.float32).reshape(-1, FEATURES)
    return fit(counts, np.array([r["quality"] for r in rows], dtype=np.float32))


def score_quality(docs: DataFrame, voters: Voters) -> DataFrame:
    """`docs` with score and predicted. A text without features gets the labels' mean; nulls count as empty.

    Columns of the input named score or predicted are replaced; rows that repeat get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    plain = docs.drop("score", "predicted")
    named = plain.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(plain.columns)], F.col("text").alias("__text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields[:-1])
    out = named.mapInArrow(_scores(shared, len(plain.columns)), f"{schema}, __score double")
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(plain.columns)]
    return out.select(*kept, F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document; nulls, repeated rows and empty tables as in `score_quality`.

    Without a labelled document outside the held-out fold every score is 0.5.
    """
    narrow = docs.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    return score_quality(narrow, learn(docs, labels)).select("doc_id", "held_out", "score", "predicted")
