"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A word has a fixed sparse random index vector.  Its word vector is the normalised sum of the index vectors of the
words around it (`WINDOW` on either side); words are taken as written in lower case and, beside that, by their
shape (kinds of signs, first sign, length), which gives words never met before a vector too.  A document's input
is the mean of its word vectors and shape vectors, how alike neighbouring words are at distances 1 to `LAGS`, and
its length.  The network has one hidden layer; its logit is divided by a temperature fitted on rows that the
weights did not see.

Vectors, weights and temperature are fitted on the whole texts of the `SAMPLE` labelled documents of least hash,
whatever their length.  Tasks count the words and add up their neighbours; the vocabulary's sums and one input vector
for each document come to the driver, texts don't.  Scoring reads whole texts.

Null and empty texts are scored as texts without words.  Labels of null quality teach nothing; with no labels
every score is 0.5.  Equal texts get equal scores; repeated rows stay; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import least_hashed, remainder, remove, slices, written
from quillstone.llm.words import SHAPES, Words, words_of

SAMPLE = 5_000
#: Tasks over which the sample is dealt, where there are so many cores.
FIT_TASKS = 64
DIM, NONZERO, WINDOW, LAGS, VOCABULARY = 32, 4, 2, 3, 30_000
HIDDEN, EPOCHS, RATE, DECAY = 24, 80, 3e-3, 1e-4
THRESHOLD = 0.3


def index_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse random vectors that only depend on the hashes: NONZERO places with +1 or -1; equal places add up."""
    bits = hashes[:, None] >> (np.arange(NONZERO, dtype=np.uint64) * np.uint64(8))
    return (bits % np.uint64(DIM)).astype(np.int64), np.where(bits >> np.uint64(7) & np.uint64(1), 1.0, -1.0)


def _contexts(out: np.ndarray, numbers: np.ndarray, bounds: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to out the neighbours' index vectors by word number; the last number stands for rare words.

    An index vector is NONZERO places and signs, so that the sums are counts over (word, place).
    """
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for lag in range(1, WINDOW + 1):
        near = text[lag:] == text[:-lag]
        a, b = numbers[:-lag][near], numbers[lag:][near]
        x, y = np.concatenate([a, b]) * DIM, np.concatenate([b, a])
        for k in range(NONZERO):
            out += np.bincount(x + places[y, k], signs[y, k], out.size).reshape(out.shape)


def _normalised(sums: np.ndarray) -> np.ndarray:
    sums = sums.astype(np.float32)
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)


@dataclass
class Model:
    vocabulary: np.ndarray
    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float

    def inputs(self, found: Words) -> np.ndarray:
        return _inputs(found, self.vocabulary, self.words, self.shapes)

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = (self.inputs(words_of(texts)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(_logits(self.weights, x)[0] / self.temperature, -60, 60)))


def _numbers(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
    return np.where(vocabulary[at] == hashes, at, len(vocabulary)) if len(vocabulary) else np.zeros(len(hashes), np.int64)


def _pooled(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Means of each text's rows; zero where it has none."""
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), values.shape[1]))
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, bounds[:-1][some], axis=0) / sizes[some, None]
    return out


def _inputs(found: Words, vocabulary: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    hashes, kinds, bounds = found.hashes(), found.shapes(), found.bounds
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    same = np.zeros((len(hashes), LAGS), np.float32)
    for lag in range(1, LAGS + 1):
        same[lag:, lag - 1] = (hashes[lag:] == hashes[:-lag]) & (text[lag:] == text[:-lag])
    number = _numbers(hashes, vocabulary)
    by_shape = _pooled(shapes[kinds], bounds)
    return np.hstack([_pooled(words[number], bounds), by_shape, _pooled(same, bounds), np.log1p(np.diff(bounds))[:, None]])


def _logits(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = weights
    hidden = np.tanh(x @ w1 + b1)
    return hidden @ w2 + b2[0], hidden


def _train(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Adam on the logistic loss with weight decay."""
    rng = np.random.default_rng(1)
    weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            logit, hidden = _logits(weights, x[some])
            error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y[some]) / len(some)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            slopes = [x[some].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(slopes):
                g = g + DECAY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return weights


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least logistic loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    sign = np.where(y > 0, 1, -1)
    return float(min(grid, key=lambda t: np.logaddexp(0, -sign * logits / t).mean())) if len(y) else 1.0


def unsigned(hashed: str) -> Column:
    """A long column in the order of its bits as an unsigned number."""
    return F.col(hashed).bitwiseXOR(F.lit(-(1 << 63)))


def _vocabulary(drawn: DataFrame) -> np.ndarray:
    """Hashes of the VOCABULARY most frequent words that occur twice or more, ascending."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                values, c = np.unique(words_of(some.column("text")).hashes(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(c.astype(np.int64))], names=["word", "c"])

    counts = drawn.select("text").mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))
    top = counts.where("c > 1").orderBy(F.desc("c"), unsigned("word")).limit(VOCABULARY).select("word").toArrow()
    return np.sort(np.asarray(top.column("word")).view(np.uint64))


def _vectors(drawn: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the words, the last one of rare words, and of the shapes."""
    shared = drawn.sparkSession.sparkContext.broadcast(vocabulary)
    names = [f"v{k}" for k in range(DIM)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        rare = np.random.default_rng(2).integers(0, 1 << 64, SHAPES, np.uint64)
        of_words, of_shapes = index_places(np.append(vocabulary, np.uint64(0))), index_places(rare)
        words, shapes = (np.zeros((len(places), DIM)) for places, _ in (of_words, of_shapes))
        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                found = words_of(some.column("text"))
                _contexts(words, _numbers(found.hashes(), vocabulary), found.bounds, *of_words)
                _contexts(shapes, found.shapes(), found.bounds, *of_shapes)
        both = np.vstack([words, shapes])
        at = np.flatnonzero(both.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(both[at, k]) for k in range(DIM))], names=["at", *names])

    each = drawn.select("text").mapInArrow(add, "at long, " + ", ".join(f"{n} double" for n in names))
    found = each.groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # one row for each number
    sums = np.zeros((len(vocabulary) + 1 + SHAPES, DIM))
    if len(found):
        sums[np.asarray(found.column("at"))] = np.stack([np.asarray(found.column(n)) for n in names], axis=1)
    return _normalised(sums[: len(vocabulary) + 1]), _normalised(sums[len(vocabulary) + 1 :])


def in_order(rows: DataFrame) -> tuple[pa.Table, np.ndarray]:
    """The rows (doc_id, print, label and more, small ones; 2 * SAMPLE at most) and their labels, in an order that doesn't depend on the labels."""
    found = rows.orderBy(F.xxhash64("doc_id"), "print", "label").limit(2 * SAMPLE).toArrow()
    ids, prints, known = (found.column(c).to_pylist() for c in ("doc_id", "print", "label"))
    order = sorted(range(len(ids)), key=lambda k: (hash_of(ids[k]), prints[k], known[k]))
    return found.take(pa.array(order, pa.int64())), np.array([known[k] for k in order], np.int64)


def fit(drawn: DataFrame) -> Model | None:
    """The model of the rows of sample(), every fifth of which sets the temperature; None without rows."""
    vocabulary = _vocabulary(drawn)
    words, shapes = _vectors(drawn, vocabulary)
    shared = drawn.sparkSession.sparkContext.broadcast((vocabulary, words, shapes))

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                x = _inputs(words_of(some.column("text")), *shared.value)
                each = pa.ListArray.from_arrays(pa.array((np.arange(len(some) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "print", "label")), each], names=["doc_id", "print", "label", "x"])

    rows, y = in_order(drawn.mapInArrow(inputs, "doc_id long, print long, label int, x array<double>"))
    if not len(y):
        return None
    x = np.array(rows.column("x").to_pylist())
    y = y.astype(float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = (x - mean) / scale
    held = np.arange(len(y)) % 5 == 4
    weights = _train(x[~held], y[~held])
    return Model(vocabulary, words, shapes, mean, scale, weights, _temperature(_logits(weights, x[held])[0], y[held]))


def sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, print (the text's hash) and label of SAMPLE labels outside the held-out fold, those of least hash among the labels that have a document."""
    known = labels.where(F.col(label).isNotNull() & (remainder("doc_id", 5) != 0)).select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(remainder("doc_id", 5) != 0)
    same = F.col("label_id") == F.col("doc_id")
    few = least_hashed(known.join(texts.select("doc_id"), same, "left_semi"), "label_id", SAMPLE, "label_id", "label")
    drawn = texts.join(F.broadcast(few), same).select("doc_id", "text", F.xxhash64("text").alias("print"), "label")
    return written(drawn.repartition(min(FIT_TASKS, docs.sparkSession.sparkContext.defaultParallelism), "doc_id", "print"), "drawn")


def hash_of(n: int) -> int:
    return (n * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) >> 20


def score(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """The columns of docs, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for some in slices(batch, "score_text", 2 << 20):
                scores = model.scores(some.column("score_text")) if model else np.full(len(some), 0.5)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in columns), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=[*columns, "score", "predicted"])

    schema = docs.select(*columns).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(*columns, F.col("text").cast("string").alias("score_text")).mapInArrow(apply, f"{out}, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    drawn = sample(docs, labels, "quality")
    model = fit(drawn)
    remove(drawn)
    return model


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = learn(docs, labels)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    return score(source, model, ["doc_id", "held_out"])
