"""Language identification of words in code-switched text by a linear-chain conditional random field.

Every word gets a distribution over languages from forward-backward over the whole text. A word's
potential sums learned weights of its affixes, its byte n-grams and its entry in a lexicon of the
training words; learned transitions tie neighbouring words. A document's language is the one with
the largest share of its words, and its score is that share.

The model is fitted in one task on a sample of labelled documents, bounded in rows by language, of any
length. Pieces of each, shuffled and laid end to end, make training sequences in which languages switch,
so that transitions between languages are learned as well. Labels, sources and ids take no part in a
prediction.

Long texts are cut into stretches that are run side by side: each stretch's transfer matrix is found
first, stretches are chained, and then marginals follow inside each, exactly as in one long pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.storage import cut, drop_cut
from quillon.llm.words import LOWER, blocks, hashes, mix, ranges, split

#: Documents to fit on, dealt evenly to the languages, and how many each language may have at least.
MAX_TRAINING_DOCS, LEAST_PER_LANGUAGE = 800, 40
#: Words in a piece: texts are learned whole, their pieces shuffled, so that words of two languages meet.
PIECE_WORDS = (6, 60)
#: Words in a training sequence, and in a stretch of a text that is run side by side.
STRETCH = 64
STEPS, RATE, RIDGE = 45, 0.15, 1e-5
#: Numbers in one array of the fit at most: sequences are worked in slabs of this size.
_SLAB = 1 << 20
GRAM_BITS = 14
#: Rows whose crc32(doc_id) mod 4 is this are held out.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True
_ASCII_LETTERS = _LETTERS.copy()
_ASCII_LETTERS[0x80:] = False


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


@dataclass(frozen=True)
class Tagger:
    """Weights (a row per feature), transition weights, the lexicon's word hashes, and the labels."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word, one word after the other, and where each word's begin.

    Bigrams and trigrams of the word between boundary marks, prefixes and suffixes of 2 to 4 bytes,
    and the word's place in the lexicon (the last number if it has none).
    """
    n, length = len(starts), ends - starts
    padded = length + 2
    begin = np.cumsum(padded) - padded
    chars = np.full(int(padded.sum()), 1, dtype=np.uint64)
    chars[ranges(begin + 1, length)] = data[ranges(starts, length)]
    chars[begin + length + 1] = 2
    mask, kinds = np.uint64((1 << GRAM_BITS) - 1), []

    def put(values: np.ndarray, kind: int) -> np.ndarray:
        return ((mix(values, kind) & mask) + np.uint64(kind << GRAM_BITS)).astype(np.int64)

    grams = [(padded - 1, 2), (padded - 2, 3)]
    for kind, (count, size) in enumerate(grams):
        at = ranges(begin, count)
        value = chars[at].copy()
        for j in range(1, size):
            value = value * np.uint64(257) + chars[at + j]
        kinds.append((put(value, kind), count))
    one = np.ones(n, dtype=np.int64)
    for size in (2, 3, 4):
        head, tail = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        for j in range(size):
            head = head * np.uint64(257) + chars[begin + 1 + np.minimum(j, length)]
            tail = tail * np.uint64(257) + chars[begin + length + 1 - 1 - np.minimum(j, length)]
        kinds += [(put(head, 2), one), (put(tail * np.uint64(3) + np.uint64(size), 3), one)]
    slot = np.searchsorted(lexicon, names)
    known = (slot < len(lexicon)) & (lexicon[np.minimum(slot, max(len(lexicon) - 1, 0))] == names) if len(lexicon) else np.zeros(n, dtype=bool)
    kinds.append((np.where(known, slot, len(lexicon)) + (4 << GRAM_BITS), one))
    total = np.sum([c for _, c in kinds], axis=0)
    bounds = np.concatenate(([0], np.cumsum(total))).astype(np.int64)
    out, at = np.empty(int(bounds[-1]), dtype=np.int64), bounds[:-1].copy()
    for values, count in kinds:
        out[ranges(at, count)] = values
        at = at + count
    return out, bounds


def _unique_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different words, one place where each stands, and the number of each word's."""
    return np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)


def _sum_rows(weights: np.ndarray, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[features], bounds[:-1], axis=0) if len(bounds) > 1 else np.zeros((0, weights.shape[1]), dtype=weights.dtype)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-30)


def marginals(potentials: np.ndarray, first: np.ndarray, transitions: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """The distribution over labels at each word of each text, by forward-backward.

    potentials: a row of log weights per word; first: where each text's words begin.
    """
    n, k = potentials.shape
    e = np.exp(potentials - potentials.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    words = np.diff(first)
    per_text = -(-words // stretch)
    head = np.cumsum(per_text) - per_text
    text = np.repeat(np.arange(len(words)), per_text)
    number = ranges(np.zeros(len(words), dtype=np.int64), per_text)
    begin = first[:-1][text] + number * stretch
    size = np.minimum(stretch, first[1:][text] - begin)
    # The transfer matrix of each stretch, longest first so that those still running lie in front.
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(stretch)]
    m = len(order)
    matrix = np.broadcast_to(np.eye(k, dtype=e.dtype), (m, k, k)).copy()
    for t in range(stretch):
        if not (r := live[t]):
            break
        matrix[:r] = (matrix[:r].reshape(-1, k) @ step).reshape(r, k, k) * e[begin[:r] + t][:, None, :]
        matrix[:r] /= np.maximum(matrix[:r].sum(axis=(1, 2), keepdims=True), 1e-30)
    enter, leave = np.full((m, k), 1 / k, dtype=e.dtype), np.ones((m, k), dtype=e.dtype)
    longest = int(per_text.max()) if len(per_text) else 0
    for j in range(1, longest):
        t = np.flatnonzero(per_text > j)
        now, before = rank[head[t] + j], rank[head[t] + j - 1]
        enter[now] = _scaled(np.einsum("ij,ijk->ik", enter[before], matrix[before]))
    for j in range(longest - 2, -1, -1):
        t = np.flatnonzero(per_text > j + 1)
        now, after = rank[head[t] + j], rank[head[t] + j + 1]
        leave[now] = _scaled(np.einsum("ijk,ik->ij", matrix[after], leave[after]))
    out = np.empty((n, k), dtype=e.dtype)
    state = enter
    for t in range(stretch):
        if not (r := live[t]):
            break
        state[:r] = _scaled((state[:r] @ step) * e[begin[:r] + t])
        out[begin[:r] + t] = state[:r]
    for t in range(stretch - 1, -1, -1):
        if not (r := live[t]):
            continue
        at = begin[:r] + t
        out[at] = _scaled(out[at] * leave[:r])
        leave[:r] = _scaled((leave[:r] * e[at]) @ step.T)
    return out


def fit(rows: list[tuple[str, list[str]]], seed: int = 11) -> Tagger | None:
    """Fit to (language, pieces of text) rows by gradient ascent on the likelihood of the shuffled pieces."""
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    pieces = [(piece, labels.index(lang)) for lang, own in rows for piece in own]
    order = np.random.default_rng(seed).permutation(len(pieces))
    raw = [pieces[i][0].encode() for i in order]
    data = LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    starts, ends, first = split(data, np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64), _LETTERS)
    k = len(labels)
    if not len(starts):
        return Tagger(labels, np.zeros(((4 << GRAM_BITS) + 1, k), dtype=np.float32), np.zeros((k, k), dtype=np.float32), np.zeros(0, dtype=np.uint64))
    word_names, place, inverse = _unique_words(data, starts, ends)
    truth = np.repeat(np.array([pieces[i][1] for i in order]), np.diff(first))
    # The last sequence is filled up with words from the beginning.
    size = min(STRETCH, len(truth))
    n = -(-len(truth) // size)
    at = np.arange(n * size) % len(truth)
    inverse, truth = inverse.ravel()[at].reshape(n, size), truth[at].reshape(n, size)
    lexicon = word_names[np.bincount(inverse.ravel(), minlength=len(word_names)) >= 2]
    features, bounds = _features(data, starts[place], ends[place], lexicon, word_names)
    owner = np.repeat(np.arange(len(word_names)), np.diff(bounds))
    width = (4 << GRAM_BITS) + len(lexicon) + 1
    weights, transitions = np.zeros((width, k)), np.zeros((k, k))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    seen = np.bincount(truth[:, :-1].ravel() * k + truth[:, 1:].ravel(), minlength=k * k).reshape(k, k)
    slab = max(1, _SLAB // (size * k))
    for turn in range(1, STEPS + 1):
        per_word = _sum_rows(weights, features, bounds)
        flat, pairs = np.zeros((len(word_names), k)), np.zeros((k, k))
        for low in range(0, n, slab):
            _expect(per_word, transitions, inverse[low : low + slab], truth[low : low + slab], flat, pairs)
        up = np.stack([np.bincount(features, flat[owner, y], width) for y in range(k)], axis=1) / n - RIDGE * weights
        up_t = (seen - pairs) / n - RIDGE * transitions
        for value, gradient, a, b in ((weights, up, moments[0], moments[1]), (transitions, up_t, moments[2], moments[3])):
            a += 0.1 * (gradient - a)
            b += 0.01 * (gradient * gradient - b)
            value += RATE * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.99**turn)) + 1e-6)
    weights[-1] = 0  # a word that no lexicon entry covers
    return Tagger(labels, weights.astype(np.float32), transitions.astype(np.float32), lexicon)


def _expect(per_word: np.ndarray, transitions: np.ndarray, inverse: np.ndarray, truth: np.ndarray, flat: np.ndarray, pairs: np.ndarray) -> None:
    """Add to `flat` the labels that each word has less those expected, and to `pairs` the transitions expected."""
    (n, size), k = inverse.shape, len(transitions)
    p = per_word[inverse]
    e, step = np.exp(p - p.max(axis=2, keepdims=True)), np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(e), np.empty_like(e)
    state = np.full((n, k), 1 / k)
    for t in range(size):
        state = _scaled((state @ step) * e[:, t])
        alpha[:, t] = state
    state = np.ones((n, k))
    for t in range(size - 1, -1, -1):
        beta[:, t] = state
        back = state * e[:, t]
        if t:
            joint = alpha[:, t - 1, :, None] * step[None] * back[:, None, :]
            pairs += (joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-30)).sum(axis=0)
        state = _scaled(back @ step.T)
    gain = -_scaled(alpha * beta)
    gain[np.arange(n)[:, None], np.arange(size)[None], truth] += 1
    for y in range(k):
        flat[:, y] += np.bincount(inverse.ravel(), gain[:, :, y].ravel(), len(flat))


def _label(shared, text: str, keep: list[str]):  # noqa: ANN001, ANN202
    """For mapInArrow: the columns `keep`, the language and the score of the column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger: Tagger | None = shared.value
        for batch in batches:
            for part, data, offsets in blocks(batch, text):
                predicted, score = classify(tagger, data, offsets)
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, pa.array(predicted, pa.string()), pa.array(score, pa.float64())], names=[*keep, "__lang", "__score"])

    return run


def word_marginals(tagger: Tagger, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distribution over labels of each word (a run of letters), and where each text's words begin."""
    low = LOWER[data]
    starts, ends, first = split(low, offsets, _LETTERS)
    if not len(starts):
        return np.zeros((0, len(tagger.labels)), dtype=np.float32), first
    names, place, number = _unique_words(low, starts, ends)
    features, bounds = _features(low, starts[place], ends[place], tagger.lexicon, names)
    return marginals(_sum_rows(tagger.weights, features, bounds)[number], first, tagger.transitions), first


def classify(tagger: Tagger | None, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; `und` and 0 if it has no letter or nothing was learned."""
    n = len(offsets) - 1
    score, predicted = np.zeros(n), [UNKNOWN] * n
    if tagger is None:
        return predicted, score
    share, first = word_marginals(tagger, data, offsets)
    words = np.diff(first)
    total = np.concatenate((np.zeros((1, share.shape[1])), np.cumsum(share, axis=0, dtype=np.float64)))
    plain = np.concatenate(([0], np.cumsum(_ASCII_LETTERS[data])))
    lettered = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(words):
        if not lettered[i] and not any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace")):
            continue
        mean = (total[first[i + 1]] - total[first[i]]) / words[i]
        best = int(np.argmax(mean))
        predicted[i], score[i] = tagger.labels[best], min(1.0, max(0.0, float(mean[best])))
    return predicted, score


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, lang, pieces): each different text, all of it, in pieces whose lengths are drawn by a seed from its hash."""
    low, high = PIECE_WORDS
    met: set[int] = set()  # of the drawn texts, which are bounded in number
    for batch in batches:
        fresh = []
        for h in batch.column(0).to_pylist():
            fresh.append(h not in met)
            met.add(h)
        for part, data, offsets in blocks(batch.filter(pa.array(fresh, pa.bool_()))):
            starts, ends, first = split(data, offsets, _LETTERS)
            raw, out = data.tobytes(), []
            for i, h in enumerate(part.column(0).to_pylist()):
                a, z = int(first[i]), int(first[i + 1])
                size = np.random.default_rng(h % (1 << 64)).integers(low, high + 1, (z - a) // low + 1)
                begin = a + np.concatenate(([0], np.cumsum(size)))
                begin = begin[begin < z]
                out.append([raw[starts[j] : ends[min(j + int(m), z) - 1]].decode(errors="replace") for j, m in zip(begin.tolist(), size, strict=False)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.list_(pa.string()))], names=["h", "lang", "pieces"])


def _fit_in_task(per_language: int):  # noqa: ANN202
    """For mapInArrow over one partition of (h, lang, pieces): the fitted model as one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, lang, own) for b in batches for h, lang, own in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: dict[str, int] = {}
        chosen = []
        for _, lang, own in rows:
            held[lang] = held.get(lang, 0) + 1
            if held[lang] <= per_language:
                chosen.append((lang, own))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(chosen))], pa.binary())})

    return run


def train(docs: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Tagger | None:
    """Fit on a sample of the labelled documents outside the held-out fold, in one task of the cluster.

    Languages get equal shares of `max_docs`, LEAST_PER_LANGUAGE at least, and of each language a draw by
    a hash of the text is taken, whatever its length. Equal texts count once, under the label that most
    of them have (ties: the smaller). No labelled text gives None, under which all documents are `und`.
    """
    spark = docs.sparkSession
    fits = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != HELD_OUT)).select(F.xxhash64("text").alias("h"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = fits.groupBy("h", "lang").agg((-F.count(F.lit(1))).alias("n"))
    votes = cut(counted.groupBy("h").agg(F.min(F.struct("n", "lang")).alias("v")).select("h", "v.lang"), "votes")
    sizes = votes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per label of the model
    if not sizes:
        return None
    each = max(LEAST_PER_LANGUAGE, max_docs // len(sizes))
    # Half as many again are drawn as are needed, so that hardly a language falls short of its share.
    draws = spark.createDataFrame([(r["lang"], int(min(1.0, 1.5 * each / r["n"]) * (1 << 30))) for r in sizes], "lang string, upto long")
    chosen = votes.join(F.broadcast(draws), "lang").where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.col("upto")).select("h", "lang")
    texts = fits.drop("lang").join(F.broadcast(chosen), "h").select("h", "lang", "text")  # some 1.5 * max_docs rows of two values
    pieces = texts.mapInArrow(_cut_pieces, "h long, lang string, pieces array<string>").dropDuplicates(["h"])
    found = pieces.repartition(1).mapInArrow(_fit_in_task(each), "model binary").collect()
    drop_cut(votes)
    return pickle.loads(found[0]["model"]) if found else None


def label_languages(docs: DataFrame, tagger: Tagger | None, keep: list[str] | None = None) -> DataFrame:
    """`docs` (columns `keep`, by default all) with lang_pred and score, which replace columns of those names.

    Null texts, and texts without letters, are `und` with score 0. Ids and labels are not looked at, so
    null ids and rows that repeat are labelled each by its text; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    wanted = [c for c in names if keep is None or c in keep]
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c in wanted or c == "text"])
    kinds = {f.name: f.dataType.simpleString() for f in numbered.schema.fields}
    inner = {c: f"c{names.index(c)}" for c in wanted}
    schema = "".join(f"{i} {kinds[i]}, " for i in inner.values())
    out = numbered.mapInArrow(_label(shared, f"c{names.index('text')}", list(inner.values())), f"{schema}__lang string, __score double")
    return out.select(*[F.col(i).alias(c) for c, i in inner.items()], F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def language_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document; nulls and repeated rows as in `label_languages`."""
    narrow = docs.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    return label_languages(narrow, train(docs), ["doc_id", "held_out"])


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language is told, in their own columns: those that are `und` go.

    Null and empty texts go, and all rows if nothing is labelled; rows that repeat are all kept.
    """
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"d_{c}") for c in names if c != "text"], "text")
    judged = label_languages(plain, train(docs))
    return judged.where(F.col("lang_pred") != UNKNOWN).select(*[F.col(f"`d_{c}`" if c != "text" else "text").alias(c) for c in names])
