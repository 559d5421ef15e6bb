"""Toxicity by a classifier chain of linear models.

The categories, in the chain's order, each for a document that its label calls toxic:

    terms   holds a word of the lexicon (features that nearly only toxic training documents have)
    dense   holds three such words or more
    toxic   whatever it holds

Each category has a logistic model over the features of a text and the probabilities of the categories before it.
Later models are trained on earlier probabilities that come from models fitted without the row's fold: the features and
the lexicon of such a model, too, are chosen without the fold's labels.  Folds are taken from the hash of doc_id.

Features are words and word beginnings of 4, 5 and 6 bytes, present or not, so that length plays no part; the
`FEATURES` that tell the labels apart best, each in `LEAST_DOCS` documents at least, are kept.  All is fitted on
the whole texts of the `quality.SAMPLE` labelled documents of least hash, whatever their length; tasks count their
features, and one short row for each document comes to the driver.  Scoring reads whole texts.

Null and empty texts have no feature.  Labels of null toxic teach nothing; without labels every probability is 0.
Equal texts get equal probabilities; repeated rows stay; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import quality
from quillstone.llm.common import remainder, remove, slices, written
from quillstone.llm.words import words_of

CATEGORIES = ("terms", "dense", "toxic")
PREFIXES = (None, 4, 5, 6)
FEATURES, LEAST_DOCS, FOLDS, STEPS, DECAY = 1_000, 4, 4, 150, 2e-4
#: A feature is of the lexicon if so many of its documents are toxic, and so many documents have it.
PURE, LEXICON_DOCS = 0.97, 8
THRESHOLD = 0.3


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hash, text and word number of each word and word beginning."""
    found = words_of(texts, letters_only=True)
    text = np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))
    number = np.arange(len(text))
    hashes = [found.hashes(p) for p in PREFIXES]
    long = [np.ones(len(text), bool) if p is None else found.lengths >= p for p in PREFIXES]
    return np.concatenate([h[k] for h, k in zip(hashes, long, strict=True)]), np.concatenate([text[k] for k in long]), np.concatenate([number[k] for k in long])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the last one the intercept, by accelerated gradient steps on the decayed logistic loss."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weights, y = np.zeros(x.shape[1], x.dtype), np.asarray(y).astype(x.dtype)
    ahead, t = weights.copy(), 1.0
    rate = x.dtype.type(4 / max(np.square(x).sum(axis=1).mean(), 1e-9))
    for _ in range(STEPS):
        slope = ((sigmoid(x @ ahead) - y) @ x) / x.dtype.type(max(1, len(y))) + x.dtype.type(DECAY) * np.append(ahead[:-1], x.dtype.type(0))
        new, after = ahead - rate * slope, (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, weights, t = new + x.dtype.type((t - 1) / after) * (new - weights), new, after
    return weights


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Chain:
    features: np.ndarray
    lexicon: np.ndarray
    weights: list[np.ndarray]

    def rows(self, texts: pa.Array, lexicons: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which text has which feature, and the number of words of each text that each lexicon has (the chain's own, if none is given)."""
        lexicons = [self.lexicon] if lexicons is None else lexicons
        out, hits = np.zeros((len(texts), len(self.features)), np.float32), np.zeros((len(texts), len(lexicons)), np.int64)
        if not len(self.features):
            return out, hits
        hashes, text, word = occurrences(texts)
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        ok = self.features[at] == hashes
        out[text[ok], at[ok]] = 1
        for k, lexicon in enumerate(lexicons):
            bad = ok & lexicon[at]
            first = np.unique(word[bad], return_index=True)[1]
            np.add.at(hits[:, k], text[bad][first], 1)
        return out, hits

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """A column for each category."""
        x = self.rows(texts)[0]
        for w in self.weights:
            x = np.hstack([x, sigmoid(x @ w[:-1] + w[-1])[:, None]])
        return x[:, len(self.features) :].astype(float)


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(FOLDS)).cast("int")


def _counts(drawn: DataFrame) -> DataFrame:
    """feature, and for each fold f n<f>, bad<f>: how many of its documents have the feature, and how many of them are toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                hashes, text, _ = occurrences(some.column("text"))
                fold = some.column("fold").to_numpy()[text].astype(np.int64)
                order = np.lexsort((text, fold, hashes))
                hashes, text, fold = hashes[order], text[order], fold[order]
                first = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])) if len(hashes) else np.zeros(0, bool)
                hashes, text, fold = hashes[first], text[first], fold[first]
                bad = some.column("label").to_numpy()[text].astype(np.int64)
                start = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (fold[1:] != fold[:-1]))) if len(hashes) else []
                if len(start):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[start].view(np.int64)), pa.array(fold[start]), pa.array(np.diff(np.append(start, len(hashes)))), pa.array(np.add.reduceat(bad, start))], names=["feature", "fold", "n", "bad"])

    each = drawn.select("text", "label", "fold").mapInArrow(count, "feature long, fold long, n long, bad long")
    sums = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("n", "bad")]
    return each.groupBy("feature").agg(*sums)


def _chosen(counts: DataFrame, shares: dict[int, float], without: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The features that tell the labels of all folds but one apart best, ascending, and which of them are of the lexicon."""
    folds = [f for f in range(FOLDS) if f != without]
    n, bad = (sum((F.col(f"{c}{f}") for f in folds[1:]), F.col(f"{c}{folds[0]}")) for c in ("n", "bad"))
    share = min(max(shares[-1 if without is None else without], 1e-6), 1 - 1e-6)
    # log-likelihood ratio of a feature's documents against the share of toxic ones
    own = F.least(F.greatest(F.col("bad") / F.col("n"), F.lit(1e-6)), F.lit(1 - 1e-6))
    gain = F.col("n") * (own * F.log(own / share) + (1 - own) * F.log((1 - own) / (1 - share))) * F.when(own > share, 1.0).otherwise(0.25)
    kept = counts.select("feature", n.alias("n"), bad.alias("bad")).where(F.col("n") >= LEAST_DOCS).orderBy(gain.desc(), quality.unsigned("feature")).limit(FEATURES).toArrow()
    features, n, bad = (np.asarray(kept.column(c)) for c in ("feature", "n", "bad"))
    order = np.argsort(features.view(np.uint64))
    return features[order].view(np.uint64), (bad[order] >= PURE * n[order]) & (n[order] >= LEXICON_DOCS)


def fit(drawn: DataFrame) -> Chain | None:
    """The chain of the rows of quality.sample(); None without rows."""
    drawn = drawn.withColumn("fold", fold_of(F.col("doc_id")))
    found = drawn.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("bad")).collect()  # a row for each fold
    if not found:
        return None
    n, bad = {r["fold"]: r["n"] for r in found}, {r["fold"]: r["bad"] for r in found}
    rest = {f: (sum(n.values()) - n.get(f, 0), sum(bad.values()) - bad.get(f, 0)) for f in (-1, *range(FOLDS))}
    shares = {f: b / k if k else 0.0 for f, (k, b) in rest.items()}
    counts = written(_counts(drawn), "features")
    if counts.isEmpty():
        return Chain(np.zeros(0, np.uint64), np.zeros(0, bool), [np.zeros(k + 1) - 40 for k in range(len(CATEGORIES))])
    picks = [_chosen(counts, shares, f) for f in (*range(FOLDS), None)]  # the last one of all folds
    remove(counts)
    every = np.unique(np.concatenate([features for features, _ in picks]))
    chain = Chain(every, np.zeros(len(every), bool), [])
    lexicons = [np.isin(every, features[lexicon]) for features, lexicon in picks]
    shared = drawn.sparkSession.sparkContext.broadcast((chain, lexicons))

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, lexicons = shared.value
        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                x, hits = chain.rows(some.column("text"), lexicons)
                text, at = np.nonzero(x)
                ends = np.searchsorted(text, np.arange(len(some) + 1)).astype(np.int32)
                each = pa.ListArray.from_arrays(pa.array((np.arange(len(some) + 1) * len(lexicons)).astype(np.int32)), pa.array(hits.ravel()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "print", "label", "fold")), each, pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))], names=["doc_id", "print", "label", "fold", "hits", "at"])

    rows, y = quality.in_order(drawn.mapInArrow(inputs, "doc_id long, print long, label int, fold int, hits array<long>, at array<int>"))
    hits, fold = np.array(rows.column("hits").to_pylist()).reshape(len(y), len(picks)), np.asarray(rows.column("fold"))
    x = np.zeros((len(y), len(every)), np.float32)
    for k, some in enumerate(rows.column("at").to_pylist()):
        x[k, some] = 1
    columns = [np.searchsorted(every, features) for features, _ in picks]
    before = np.zeros((len(y), 0), np.float32)  # out-of-fold probabilities of the categories so far
    for k in range(len(CATEGORIES)):
        targets = [(y == 1) & (hits[:, p] >= (1, 3, 0)[k]) for p in range(len(picks))]
        chain.weights.append(logistic(np.hstack([x[:, columns[-1]], before]), targets[-1]))
        out = np.zeros(len(y), np.float32)
        for f in range(FOLDS):
            own, others = fold == f, fold != f
            inside = np.hstack([x[:, columns[f]], before])
            w = logistic(inside[others], targets[f][others])
            out[own] = sigmoid(inside[own] @ w[:-1] + w[-1])
        before = np.hstack([before, out[:, None]])
    return Chain(*picks[-1], chain.weights)


def learn(docs: DataFrame, labels: DataFrame) -> Chain | None:
    drawn = quality.sample(docs, labels, "toxic")
    chain = fit(drawn)
    remove(drawn)
    return chain


def score(docs: DataFrame, chain: Chain | None, columns: list[str]) -> DataFrame:
    """The columns of docs, p_terms, p_dense, p_toxic and toxic (1 from THRESHOLD on)."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for some in slices(batch, "score_text", 2 << 20):
                p = chain.probabilities(some.column("score_text")) if chain else np.zeros((len(some), len(CATEGORIES)))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in columns), *(pa.array(p[:, k]) for k in range(len(CATEGORIES))), pa.array((p[:, -1] >= THRESHOLD).astype(np.int32))], names=[*columns, *(f"p_{c}" for c in CATEGORIES), "toxic"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*columns, F.col("text").cast("string").alias("score_text")).mapInArrow(apply, f"{out}, {', '.join(f'p_{c} double' for c in CATEGORIES)}, toxic int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, p_terms, p_dense, p_toxic, toxic for every document."""
    chain = learn(docs, labels)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    return score(source, chain, ["doc_id", "held_out"])
