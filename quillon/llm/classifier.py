"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A document is the mean of the vectors of its features; a softmax layer over the mean gives the
classes clean, low quality and toxic. Features are its words (runs between white space, case and
punctuation kept), a mark for each word that repeats the one before it, and the character n-grams of the lower-cased words between boundary marks, hashed
into two tables of BUCKETS rows. Hashing ties no memory to the vocabulary, and n-grams carry what
is learned to inflected and unseen words.

Training takes at most MAX_ROWS labelled documents, those with the least hash of their id: the
bound is a parameter. Minibatch gradients, step sizes by Adagrad. As the mean and the layer are
linear, scoring needs only each feature's contribution to each class: a table of BUCKETS * 2 rows
and three numbers goes to the workers, whatever the corpus.

A document is kept where the probability of clean is at least KEEP_FROM.
Scoring covers whole texts of all documents and is row by row, without a shuffle.

Defined results: of labels that share an id the toxic, then the low-quality one counts; labels with a null in any
column aren't used; without labels of two classes nothing is rejected (probability 1 of clean); a null
or empty text has no features and gets the class shares of the training rows' bias alone, and is kept;
repeated rows get equal scores; a null id is scored as any other. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import as_array, code_points, kept_rows, mix, powers, runs, slices, spans_hash

CLASSES = ("clean", "low", "toxic")
BUCKETS = 1 << 18
DIMENSIONS = 4
NGRAMS = (3, 4, 5)
MAX_ROWS = 6000
EPOCHS = 10
RATE = 2.0
KEEP_FROM = 0.75
BATCH = 64
SEED = 7


@dataclass
class Tokens:
    """The distinct words of some rows, their features, and how often each row has each word."""

    features: np.ndarray
    feature_to: np.ndarray
    row: np.ndarray
    word: np.ndarray
    times: np.ndarray


_space = np.zeros(0x110000, bool)
_space[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def tokens(texts: pa.Array) -> Tokens:
    _, points, offsets = code_points(texts)
    rows = len(offsets) - 1
    solid = ~_space[points]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < len(points)]
    begin[edge] |= solid[edge]
    stop = ~solid
    stop[edge] = True
    starts = np.flatnonzero(begin)
    stops = np.append(np.flatnonzero(stop), len(points))
    ends = stops[np.searchsorted(stops, starts, "right")]
    hashes, at, word = np.unique(spans_hash(points, starts, ends), return_index=True, return_inverse=True)
    row = np.repeat(np.arange(rows), np.diff(np.searchsorted(starts, offsets)))
    again = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1])) + 1
    width = len(hashes) + 1  # the last word stands for repetitions
    cell, times = np.unique(np.concatenate([row * width + word, row[again] * width + len(hashes)]), return_counts=True)
    # the distinct words between boundary marks, one after the other
    s, n = starts[at], ends[at] - starts[at]
    marked = np.zeros(int((n + 2).sum()), np.uint32)
    to = np.concatenate([[0], np.cumsum(n + 2)]).astype(np.int64)
    marked[to[:-1]], marked[to[1:] - 1] = 60, 62
    inner = points[runs(s, n)]
    marked[runs(to[:-1] + 1, n)] = np.where((inner >= 65) & (inner <= 90), inner + 32, inner)
    high = marked > 127
    if high.any():
        marked[high] = _lower(marked[high])
    power, inverse = powers(len(marked) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((marked.astype(np.uint64) + np.uint64(1)) * power[: len(marked)])])
    found, owner = [np.append(hashes & np.uint64(BUCKETS - 1), np.uint64(0))], [np.arange(width)]
    for k in NGRAMS:
        many = np.maximum(n + 3 - k, 0)
        i = runs(to[:-1], many)
        found.append((mix((sums[i + k] - sums[i]) * inverse[i] + np.uint64(k)) & np.uint64(BUCKETS - 1)) + np.uint64(BUCKETS))
        owner.append(np.repeat(np.arange(len(hashes)), many))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    features = np.concatenate(found).astype(np.int64)[order]
    feature_to = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=width))]).astype(np.int64)
    return Tokens(features, feature_to, cell // width, cell % width, times)


def _lower(points: np.ndarray) -> np.ndarray:
    some, back = np.unique(points, return_inverse=True)
    low = [ord(y) if len(y := chr(p).lower()) == 1 else p for p in some]
    return np.array(low, np.uint32)[back]


@dataclass
class Model:
    """Contribution of each feature to each class, and the bias of each class."""

    table: np.ndarray
    bias: np.ndarray

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        t, rows = tokens(texts), len(texts)
        logits = np.tile(self.bias.astype(np.float64), (rows, 1))
        if len(t.features):
            words = np.add.reduceat(self.table[t.features], t.feature_to[:-1]).astype(np.float64)
            size = np.diff(t.feature_to)
            total = np.bincount(t.row, t.times * size[t.word], rows)
            for c in range(len(CLASSES)):
                logits[:, c] += np.bincount(t.row, t.times * words[t.word, c], rows) / np.maximum(total, 1)
        x = np.exp(logits - logits.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def train(texts: list[str], classes: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Minibatch stochastic gradient descent on the softmax loss of mean feature vectors."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1, 1, (2 * BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer, bias = np.zeros((DIMENSIONS, len(CLASSES))), np.zeros(len(CLASSES))
    seen, seen_layer, seen_bias = np.full(2 * BUCKETS, 1e-12), np.full(layer.shape, 1e-6), np.full(bias.shape, 1e-6)
    share = np.bincount(classes, minlength=len(CLASSES)) / max(len(classes), 1)
    if np.count_nonzero(share) < 2:
        return Model(np.zeros((2 * BUCKETS, len(CLASSES)), np.float32), np.array([50.0, 0, 0]))
    order = rng.permutation(len(texts))
    batches = [_batch(texts, classes, order[at : at + BATCH]) for at in range(0, len(order), BATCH)]
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            b = batches[k]
            if not len(b.used):
                continue
            _, of_layer, of_bias, of_used = gradients(b, vectors[b.used], layer, bias)
            for value, gradient, total in ((layer, of_layer, seen_layer), (bias, of_bias, seen_bias)):
                total += gradient**2
                value -= pace * gradient / np.sqrt(total)
            seen[b.used] += (of_used**2).mean(axis=1)
            vectors[b.used] -= (pace * of_used / np.sqrt(seen[b.used])[:, None]).astype(np.float32)
    return Model((vectors @ layer).astype(np.float32), bias)


def gradients(b: _Batch, used: np.ndarray, layer: np.ndarray, bias: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The mean softmax loss of a minibatch and its gradients by the layer, the bias and the vectors of its features."""
    words = np.add.reduceat(used[b.place], b.feature_to)
    mean = _spread(b.row, b.weight, words[b.word], len(b.classes))
    logits = mean @ layer + bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    own = np.arange(len(p)), b.classes
    loss = -float(np.log(p[own]).mean())
    p[own] -= 1
    p /= len(p)
    back = p @ layer.T
    of_word = _spread(b.word, b.weight, back[b.row], len(b.size))
    return loss, mean.T @ p, p.sum(axis=0), _spread(b.place, None, np.repeat(of_word, b.size, axis=0), len(used))


@dataclass
class _Batch:
    """What each epoch needs of a minibatch: its distinct features, its words as runs of places among these, its cells."""

    classes: np.ndarray
    used: np.ndarray
    place: np.ndarray
    feature_to: np.ndarray
    size: np.ndarray
    row: np.ndarray
    word: np.ndarray
    weight: np.ndarray


def _batch(texts: list[str], classes: np.ndarray, some: np.ndarray) -> _Batch:
    t = tokens(pa.array([texts[k] for k in some], pa.string()))
    size = np.diff(t.feature_to)
    total = np.bincount(t.row, t.times * size[t.word], len(some)) if len(size) else np.ones(len(some))
    weight = t.times / np.maximum(total, 1)[t.row]
    used, place = np.unique(t.features, return_inverse=True)
    return _Batch(classes[some], used.astype(np.int32), place.astype(np.int32), t.feature_to[:-1].astype(np.int32), size.astype(np.int32), t.row.astype(np.int32), t.word.astype(np.int32), weight)


def _spread(key: np.ndarray, weight: np.ndarray | None, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of `values`, weighted, by key."""
    w = 1 if weight is None else weight
    return np.stack([np.bincount(key, w * values[:, d], n) for d in range(values.shape[1])], axis=1)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, class) of at most max_rows labelled texts, chosen by the hash of the id and so alike at every run."""
    labels = labels.where("doc_id is not null and quality is not null and toxic is not null")
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    chosen = labels.groupBy("doc_id").agg(F.max(kind).alias("class")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "class")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model of the training rows, made by one task in a worker: neither the rows nor what training needs come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("class", pa.int32())]))
        texts, ids = rows["text"].to_pylist(), rows["doc_id"].to_numpy()
        order = np.lexsort((np.array(texts, object), ids)) if len(texts) else np.zeros(0, np.int64)
        model = train([texts[k] for k in order], rows["class"].to_numpy()[order].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.bias.tolist()], pa.list_(pa.float64()))], ["table", "bias"])

    made = training_rows(docs, labels, max_rows).repartition(1).mapInArrow(run, "table binary, bias array<double>").collect()
    if not made:
        return train([], np.zeros(0, np.int64))
    return Model(np.frombuffer(made[0].table, np.float32).reshape(-1, len(CLASSES)), np.array(made[0].bias))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p_clean, p_low, p_toxic, kept) of every row; a row is kept where p_clean is KEEP_FROM at least or the text is null or empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, kept = _scored(as_array(batch.column(1)), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c]) for c in range(len(CLASSES))), kept], ["doc_id", *(f"p_{c}" for c in CLASSES), "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in CLASSES) + ", kept boolean")


def _scored(texts: pa.Array, model: Model) -> tuple[np.ndarray, pa.Array]:
    p = np.concatenate([np.zeros((0, len(CLASSES))), *(model.probabilities(part) for _, part in slices(texts))])
    empty = np.array([not x for x in texts.is_valid().to_pylist()]) if texts.null_count else np.zeros(len(texts), bool)
    empty |= pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) == 0
    return p, pa.array((p[:, 0] >= KEEP_FROM) | empty)


def without_rejected(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that the classifier keeps, columns as they were; decided row by row."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))
    return kept_rows(docs, lambda: lambda texts: _scored(texts, sent.value)[1])
