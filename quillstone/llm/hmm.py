"""A hidden Markov language model over whole texts, beside a smoothed unigram base.

Tokens are the lowered words of a text, then one end.  The base gives a token (c + 0.1) / (N + 0.1 (V + 1)), c being
its count in the training texts.  The model has `STATES` latent states.  A token's probability in a state is its base
probability times a ratio, so

    log10 P(text) = base score + log10 of the sum over state paths of products of (chance of the move * ratio),

which the scaled forward recursion computes exactly.

Training.  Counts of tokens are taken over all training texts.  While the states take shape, emissions are tied: each of
the `OWN` most frequent tokens is a class, all others share `BUCKETS` classes by their first three bytes.  The
states begin as kinds of classes that have like neighbours: vectors of neighbours are summed by class over all training
texts (`contexts`) and grouped; then come `ROUNDS` Baum-Welch rounds, each over all training texts, whose sums by class go to
the driver (a row for each class, whose number is a parameter).  A last pass over all training texts unties the emissions:
every task adds up the expected counts of every token, and their sums are a table with a row for each training
token, so what is learnt grows with the corpus.  A token's share of a state is that of its expected counts, drawn towards
its bucket's by `PULL` tokens' weight; the ratio is that share over the state's sum of (base probability * share), so each state's
probabilities of all training tokens and of one unknown one add up to 1.  An unknown token has the states' own shares.

Expected counts of a token travel as its count and its eight shares in 255ths (`packed`), which are summed as whole numbers.
Words are told apart by 64-bit hashes.  Counts and shares of the most frequent words, `FREQUENT` at most, are broadcast,
those of all others joined.  Forward and backward values are held for about `BLOCK` tokens at once; of a longer text
those at the beginnings of such blocks are kept and the others computed again.

Null and empty texts hold the end alone.  Equal texts get equal scores; repeated rows are counted as often as they
occur.  With no training text, or an empty table, N and V are 0.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import remainder, remove, slices, written
from quillstone.llm.words import words_of

STATES, OWN, BUCKETS, FREQUENT, ADDED = 8, 16_384, 8_192, 200_000, 0.1
ROUNDS = 2
#: Numbers of a class's context vector, rounds that group the classes by them, how much more likely a state's own kind is at first.
CONTEXT, KIND_ROUNDS, LIFT = 8, 20, 3.0
#: Weight of the base in a state's smoothed class probabilities, in tokens; stay: the first chance to keep a state.
PRIOR, STAY = 50.0, 0.95
#: Weight of the bucket's shares in a token's, and of the states' own shares in a bucket's, in tokens.
PULL, BUCKET_PULL = 4.0, 50.0
#: Tokens whose forward and backward values are held at once, and tokens of texts that are ordered by length together.
BLOCK, BUFFER = 300_000, 4_000_000
#: The end's hash, which no word has but by chance.
END = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Places of 64-bit keys, -1 for others: a few direct-mapped tables, each for what the one before had no room for."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys, self.bits, self.levels = keys, bits, []
        left = np.arange(len(keys))
        while len(left):
            slot = self._slots(keys[left], len(self.levels))
            table = np.full(1 << bits, -1, np.int32)
            table[slot[::-1]] = left[::-1]
            self.levels.append(table)
            left = left[table[slot] != left]

    def _slots(self, keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys * np.uint64(2 * level + 1)) >> np.uint64(64 - self.bits - level)).astype(np.int64) & ((1 << self.bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, table in enumerate(self.levels):
            at = table[self._slots(keys[open_], level)]
            hit = at >= 0
            hit[hit] = self.keys[at[hit]] == keys[open_[hit]]
            out[open_[hit]] = at[hit]
            open_ = open_[~hit]
        return out


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and buckets of all tokens, ends included, and the bounds of the texts."""
    found = words_of(texts)
    words, bounds = found.hashes(), found.bounds
    sizes = np.diff(bounds)
    ends = np.cumsum(sizes + 1)
    hashes, buckets = np.full(int(ends[-1]), END, np.uint64), np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(hashes), bool)
    inside[ends - 1] = False
    hashes[inside] = words
    buckets[inside] = (found.hashes(3) % np.uint64(BUCKETS)).astype(np.int64)
    return hashes, buckets, np.append(0, ends)


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, bucket, c over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            token, bucket, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            values, first, at = np.unique(token, return_index=True, return_inverse=True)
            return values, bucket[first], np.bincount(at, c, len(values)).astype(np.int64)

        def put(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], names=["token", "bucket", "c"])

        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                hashes, buckets, _ = tokens_of(some.column("text"))
                values, first, c = np.unique(hashes, return_index=True, return_counts=True)
                parts.append((values, buckets[first], c.astype(np.int64)))
                held += len(values)
                if held > 1_000_000:
                    parts = [merged()]
                    held = len(parts[0][0])
                    if held > 700_000:
                        yield put(parts[0])
                        parts, held = [], 0
        if parts:
            yield put(merged())

    each = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "token long, bucket int, c long")
    return each.groupBy("token").agg(F.first("bucket").alias("bucket"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """tokens: the most frequent, FREQUENT at most, with their counts; share: what the base gives each class, unknown words included.

    least: the size (see size_of) from which on all tokens are among them.
    """

    tokens: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray
    share: np.ndarray
    n: int
    v: int
    least: int

    @property
    def total(self) -> float:
        return self.n + ADDED * (self.v + 1)


def size_of(c: str) -> Column:
    """A whole number that grows with the logarithm of a count."""
    return F.floor(F.log2(c) * 64).cast("int")


def vocabulary(counts: DataFrame) -> Vocabulary:
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # how many tokens have about which count, a few thousand rows, tells from which count on there are no more than FREQUENT
    size = size_of("c")
    sizes = sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), reverse=True)
    within = np.flatnonzero(np.cumsum([0, *(r["n"] for r in sizes)]) <= FREQUENT)[-1]
    least = sizes[within - 1]["size"] if within else 1 << 30
    top = counts.where(size >= least).select("token", "bucket", "c").toArrow()
    token, bucket, c = (np.asarray(top.column(x)) for x in ("token", "bucket", "c"))
    order = np.lexsort((token, -c))
    token, bucket, c = token[order].view(np.uint64), bucket[order], c[order]
    total = whole["n"] + ADDED * (whole["v"] + 1)
    share = np.zeros(OWN + BUCKETS)
    share[: min(OWN, len(c))] = (c[:OWN] + ADDED) / total
    sums = counts.groupBy("bucket").agg(F.sum(F.col("c") + ADDED).alias("mass")).toArrow()  # one row for each bucket
    share[OWN + np.asarray(sums.column("bucket"))] = np.asarray(sums.column("mass")) / total
    np.subtract.at(share, OWN + bucket[:OWN], (c[:OWN] + ADDED) / total)
    share[OWN:] = np.maximum(share[OWN:], 0) + ADDED / total
    share[: OWN][share[:OWN] == 0] = ADDED / total  # classes that no token has
    return Vocabulary(token, bucket, c, share, whole["n"], whole["v"], least)


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, classes binary, others binary, rare array<long>, times array<int>, buckets array<int>"


def encode(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """The class of every token (two bytes each), the number of every token that is no class of its own (four bytes each), what the
    base gives the frequent ones, and the rare ones with how often they occur and their buckets.

    Numbers: places in the vocabulary; from FREQUENT on places among the text's rare tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        lookup, row = Lookup(known.tokens), TaskContext.get().partitionId() << 40
        given = np.append(np.log10((known.counts + ADDED) / known.total), 0.0)  # the last one for rare tokens
        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                hashes, buckets, bounds = tokens_of(some.column("text"))
                place = lookup(hashes)
                classes = np.where((place >= 0) & (place < OWN), place, OWN + buckets).astype("<u2")
                starts, sizes = bounds[:-1], np.diff(bounds)
                base = np.add.reduceat(given[place], starts)
                common = np.add.reduceat((place >= 0).astype(np.int64), starts)
                rare = np.flatnonzero(place < 0)
                text, token = np.repeat(np.arange(len(sizes)), sizes)[rare], hashes[rare]
                order = np.lexsort((token, text))
                text, token = text[order], token[order]
                new = np.append(True, (text[1:] != text[:-1]) | (token[1:] != token[:-1])) if len(text) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(text)))
                ends = np.searchsorted(text[first], np.arange(len(sizes) + 1)).astype(np.int32)
                number = place.copy()
                number[rare[order]] = FREQUENT + np.cumsum(new) - 1 - ends[text]
                other = (place < 0) | (place >= OWN)
                raw, at = classes.tobytes(), (bounds * 2).tolist()
                raw_others, others_at = number[other].astype("<u4").tobytes(), (np.append(0, np.cumsum(other))[bounds] * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(some))),
                        some.column("doc_id"),
                        some.column("held_out"),
                        pa.array(sizes),
                        pa.array(common),
                        pa.array(base),
                        pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                        pa.array([raw_others[a:b] for a, b in zip(others_at[:-1], others_at[1:], strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(token[first].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets[rare[order]][first].astype(np.int32))),
                    ],
                    names=[c.split(" ")[0] for c in ENCODED.split(", ")],
                )
                row += len(some)

    return docs.select("doc_id", "held_out", "text").mapInArrow(apply, ENCODED)


@dataclass
class Model:
    """start, move: chances of states; emit: chances of classes in a state, by class and state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def ratios(self, share: np.ndarray, kind: type) -> np.ndarray:
        return (self.emit / share[:, None]).astype(kind)


class Steps:
    """Sequences laid out by token number: at step t the t-th tokens of all long enough sequences, the longest first."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        self.active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right") if len(sizes) else np.zeros(0, np.int64)
        self.at = np.append(0, np.cumsum(self.active))
        inside = np.arange(self.at[-1]) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = self.at[inside] + np.repeat(np.arange(len(sizes)), sizes)
        self.classes = self.laid_out(sequences)

    def laid_out(self, sequences: list[np.ndarray]) -> np.ndarray:
        out = np.empty(self.at[-1], np.int32)
        if len(sequences):
            out[self.place] = np.concatenate([sequences[k] for k in self.order.tolist()])
        return out

    def spans(self) -> list[tuple[int, int]]:
        """Steps from, to with about BLOCK tokens together."""
        out, t = [], 0
        while t < len(self.active):
            to = max(t + 1, int(np.searchsorted(self.at, self.at[t] + 2 * BLOCK, side="right")) - 1)
            out.append((t, to))
            t = to
        return out

    def forward(self, model: Model, ratios: np.ndarray, t: int, to: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward values of steps t to `to`, after those of the step before, and the scales."""
        base = self.at[t]
        value = ratios[self.classes[base : self.at[to]]]
        move, start, scale = model.move.astype(value.dtype), model.start.astype(value.dtype), np.empty(len(value), value.dtype)
        for k in range(t, to):
            a, n = self.at[k] - base, self.active[k]
            now = value[a : a + n]
            now *= start if before is None else before[:n] @ move
            s = now.sum(axis=1)
            now /= s[:, None]
            scale[a : a + n] = s
            before = now
        return value, scale

    def log10(self, model: Model, ratios: np.ndarray) -> np.ndarray:
        """log10 of the sums over all paths, in the order in which the sequences were given; one step's values are held."""
        out, before = np.zeros(len(self.order)), None
        for t, n in enumerate(self.active.tolist()):
            now = ratios[self.classes[self.at[t] : self.at[t + 1]]]
            now *= model.start if before is None else before[:n] @ model.move
            s = now.sum(axis=1)
            now /= s[:, None]
            out[:n] += np.log10(s)
            before = now
        given = np.empty(len(out))
        given[self.order] = out
        return given

    def expected(self, model: Model, ratios: np.ndarray, use: Callable[[int, int, np.ndarray], None]) -> np.ndarray:
        """Expected counts of moves, a row for each state that is left, and of starts; use(a, b, p) gets the chances of the states of tokens a to b."""
        states, move = len(model.start), model.move.astype(ratios.dtype)
        out, spans, marks, before = np.zeros((states + 1, states)), self.spans(), [], None
        for t, to in spans:
            marks.append(before)
            if len(spans) > 1:
                last = self.at[to - 1] - self.at[t]
                before = self.forward(model, ratios, t, to, before)[0][last:].copy()
        back = np.ones((int(self.active[0]) if len(self.active) else 0, states), ratios.dtype)
        following = None  # ratios over scales of the step after
        for (t, to), mark in zip(reversed(spans), reversed(marks), strict=True):
            base = self.at[t]
            value, scale = self.forward(model, ratios, t, to, mark)
            given = ratios[self.classes[base : self.at[to]]] / scale[:, None]
            for k in range(to - 1, t - 1, -1):
                a, n = self.at[k] - base, int(self.active[k])
                if following is not None:
                    m = len(following)
                    ahead = following * back[:m]
                    out[:-1] += value[a : a + m].T @ ahead
                    back[:m] = ahead @ move.T
                    back[m:n] = 1
                following = given[a : a + n]
                value[a : a + n] *= back[:n]  # from here on the chance of each state
            use(base, self.at[to], value)
            if t == 0:
                out[-1] = value[: self.active[0]].sum(axis=0)
        out[:-1] *= model.move
        return out


def counted(steps: Steps, model: Model, ratios: np.ndarray) -> np.ndarray:
    """Expected counts: a row for each class, for each state that is left, and for the start."""
    states, n = len(model.start), len(ratios)
    out = np.zeros((n + states + 1, states))

    def use(a: int, b: int, p: np.ndarray) -> None:
        for k in range(states):
            out[:n, k] += np.bincount(steps.classes[a:b], p[:, k], n)

    out[n:] = steps.expected(model, ratios, use)
    return out


def updated(counts: np.ndarray, share: np.ndarray) -> Model:
    """The model of expected counts; the base smooths the classes, a tenth of a count the moves."""
    states = counts.shape[1]
    emit = counts[: len(share)] + PRIOR * (share / share.sum())[:, None]
    move = counts[len(share) : -1] + 0.1
    start = counts[-1] + 0.1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)) if states else Model(start, move, emit)


def _signs(n: int) -> np.ndarray:
    """A vector of small whole numbers for each class, whose sums over neighbours tell the contexts of classes apart."""
    return np.random.default_rng(5).integers(-127, 128, (n, CONTEXT))


def _contexts_of(sequences: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """For each class the sums of its neighbours' vectors, and its tokens; whole numbers, so their order doesn't matter."""
    n, out = len(signs), np.zeros((len(signs), CONTEXT + 1))
    if not sequences:
        return out
    x = np.concatenate(sequences).astype(np.int64)
    inside = np.ones(len(x), bool)
    inside[np.cumsum([len(s) for s in sequences])[:-1]] = False
    left, right = x[:-1][inside[1:]], x[1:][inside[1:]]
    for d in range(CONTEXT):
        out[:, d] = np.bincount(left, signs[right, d], n) + np.bincount(right, signs[left, d], n)
    out[:, CONTEXT] = np.bincount(x, minlength=n)
    return out


def contexts(training: DataFrame, n: int) -> np.ndarray:
    """_contexts_of over all rows of training (classes), n classes."""
    names = [f"v{k}" for k in range(CONTEXT + 1)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, total = _signs(n), np.zeros((n, CONTEXT + 1))
        for batch in batches:
            for part in slices(batch, "classes", BUFFER // 2):
                total += _contexts_of(_sequences(part), signs)
        at = np.flatnonzero(total[:, CONTEXT])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, k]) for k in range(CONTEXT + 1))], names=["at", *names])

    each = training.select("classes").mapInArrow(add, "at long, " + ", ".join(f"{x} double" for x in names))
    sums = each.groupBy("at").agg(*(F.sum(x).alias(x) for x in names)).toArrow()  # a row for each class
    out = np.zeros((n, CONTEXT + 1))
    if len(sums):
        out[np.asarray(sums.column("at"))] = np.stack([np.asarray(sums.column(x)) for x in names], axis=1)
    return out


def _kinds(sums: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The classes in STATES groups of like contexts, by k-means on directions, weighted by tokens."""
    weight, each = sums[:, CONTEXT], sums[:, :CONTEXT]
    usual = 2 * (weight @ signs) / max(1.0, weight.sum())
    way = (each - weight[:, None] * usual) / np.sqrt(weight + 20)[:, None]
    way /= np.maximum(np.linalg.norm(way, axis=1, keepdims=True), 1e-9)
    middles = way[[np.argmax(weight)]]
    for _ in range(STATES - 1):
        apart = np.min([np.square(way - m).sum(axis=1) for m in middles], axis=0)
        middles = np.vstack([middles, way[np.argmax(apart * np.sqrt(weight))]])
    for _ in range(KIND_ROUNDS):
        kind = np.argmax(way @ middles.T, axis=1)
        for k in range(STATES):
            if (kind == k).any():
                middles[k] = weight[kind == k] @ way[kind == k]
        middles /= np.maximum(np.linalg.norm(middles, axis=1, keepdims=True), 1e-9)
    return np.argmax(way @ middles.T, axis=1)


def begin(share: np.ndarray, training: list[np.ndarray] | DataFrame) -> Model:
    """A first model from all training texts (sequences, or rows with classes): each state prefers the classes of one kind of context."""
    signs = _signs(len(share))
    sums = _contexts_of(training, signs) if isinstance(training, list) else contexts(training, len(share))
    prefers = np.random.default_rng(7).uniform(0.9, 1.1, (len(share), STATES))  # kinds that no class is of would stay alike
    prefers[np.arange(len(share)), _kinds(sums, signs)] *= LIFT
    emit = (share / share.sum())[:, None] * prefers
    move = np.full((STATES, STATES), (1 - STAY) / (STATES - 1)) + np.eye(STATES) * (STAY - (1 - STAY) / (STATES - 1))
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


def blocks(sequences: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The sequences in descending length, in lists of about BLOCK tokens."""
    for some in numbered_blocks(list(map(len, sequences))):
        yield [sequences[k] for k in some]


def numbered_blocks(sizes: list[int]) -> Iterator[list[int]]:
    """The places of sequences in descending length, in lists of about BLOCK tokens."""
    some: list[int] = []
    held = 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        some.append(k)
        held += sizes[k]
        if held >= BLOCK:
            yield some
            some, held = [], 0
    if some:
        yield some


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in batch.column("classes").to_pylist()]


def _numbers(batch: pa.RecordBatch, own: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Classes of each row's tokens, and their numbers, as encode() has them."""
    classes, out = _sequences(batch), []
    for x, raw in zip(classes, batch.column("others").to_pylist(), strict=True):
        number = x.astype(np.int64)
        number[x >= own] = np.frombuffer(raw, "<u4")
        out.append(number)
    return classes, out


def baum_welch(encoded: DataFrame, model: Model, share: np.ndarray) -> Model:
    """One round over all rows of encoded (classes)."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, share))
    names = [f"s{k}" for k in range(STATES)]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, share = shared.value
        ratios, total, waiting, held = model.ratios(share, np.float32), None, [], 0

        def add() -> None:
            nonlocal total, waiting, held
            for some in blocks(waiting):
                found = counted(Steps(some), model, ratios)
                total = found if total is None else total + found
            waiting, held = [], 0

        for batch in batches:
            for x in _sequences(batch):
                waiting.append(x)
                held += len(x)
                if held >= BUFFER:
                    add()
        add()
        if total is not None:
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, k]) for k in range(STATES))], names=["at", *names])

    each = encoded.select("classes").mapInArrow(expect, "at long, " + ", ".join(f"{n} double" for n in names))
    sums = each.groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    counts = np.zeros((len(share) + STATES + 1, STATES))
    if len(sums):
        counts[np.asarray(sums.column("at"))] = np.stack([np.asarray(sums.column(n)) for n in names], axis=1)
    return updated(counts, share)


def packed(p: np.ndarray) -> np.ndarray:
    """Rows of eight shares as 255ths, one byte each."""
    return np.rint(255 * p / p.sum(axis=1, keepdims=True)).astype(np.uint8).view("<i8")[:, 0]


def unpacked(profile: np.ndarray) -> np.ndarray:
    p = np.ascontiguousarray(profile, "<i8").view(np.uint8).reshape(-1, STATES).astype(float)
    return p / p.sum(axis=1, keepdims=True)


PROFILES = "token long, bucket int, c long, profile long"


def token_profiles(training: DataFrame, known: Vocabulary, model: Model) -> DataFrame:
    """token, bucket, c, profile: the expected counts of every training token under the tied model."""
    shared = training.sparkSession.sparkContext.broadcast((model, known.share, known.tokens, known.buckets))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, share, tokens, buckets = shared.value
        ratios, dense, rare, held = model.ratios(share, np.float32), np.zeros((FREQUENT, STATES + 1)), [], 0  # the last column counts

        def put(token: np.ndarray, bucket: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            c = sums[:, STATES].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(bucket.astype(np.int32)), pa.array(c), pa.array(packed(sums[:, :STATES]))], names=["token", "bucket", "c", "profile"])

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            token, bucket, sums = (np.concatenate(x) for x in zip(*rare, strict=True))
            order = np.argsort(token, kind="stable")
            first = np.flatnonzero(np.append(True, token[order][1:] != token[order][:-1]))
            return token[order][first], bucket[order][first], np.add.reduceat(sums[order], first)

        for batch in batches:
            for part in slices(batch, "classes", BUFFER):
                classes, numbers = _numbers(part, OWN)
                lists = part.column("rare")
                ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
                token, bucket = lists.flatten().to_numpy(), part.column("buckets").flatten().to_numpy()
                for some in numbered_blocks(list(map(len, classes))):
                    steps = Steps([classes[k] for k in some])
                    sizes = ends[1:][some] - ends[:-1][some]
                    base = np.cumsum(sizes) - sizes
                    unit = steps.laid_out([np.where(numbers[k] >= FREQUENT, numbers[k] + b, numbers[k]) for k, b in zip(some, base.tolist(), strict=True)])
                    n = FREQUENT + int(sizes.sum())
                    own = np.zeros((int(sizes.sum()), STATES + 1))

                    def use(a: int, b: int, p: np.ndarray, unit: np.ndarray = unit, n: int = n, own: np.ndarray = own) -> None:
                        for k in range(STATES + 1):
                            sums = np.bincount(unit[a:b], p[:, k] if k < STATES else None, n)
                            dense[:, k] += sums[:FREQUENT]
                            own[:, k] += sums[FREQUENT:]

                    steps.expected(model, ratios, use)
                    at = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in some]).astype(np.int64)
                    if len(at):
                        rare.append((token[at], bucket[at], own))
                        held += len(at)
                if held > 400_000:
                    rare = [merged()]
                    held = len(rare[0][0])
                    if held > 250_000:
                        yield put(*rare[0])
                        rare, held = [], 0
        if rare:
            yield put(*merged())
        at = np.flatnonzero(dense.any(axis=1))
        if len(at):
            yield put(tokens[at], buckets[at], dense[at])

    each = training.select("classes", "others", "rare", "buckets").mapInArrow(expect, PROFILES)
    parts = [(F.sum(F.col("c") * F.shiftrightunsigned("profile", 8 * k).bitwiseAND(255))).alias(f"e{k}") for k in range(STATES)]
    # dealt out first, so that what is shuffled is the packed form
    sums = each.repartition("token").groupBy("token").agg(F.first("bucket").alias("bucket"), F.sum("c").alias("c"), *parts)
    total = sum((F.col(f"e{k}") for k in range(1, STATES)), F.col("e0"))
    shares = [F.shiftleft(F.rint(F.col(f"e{k}") * 255 / total).cast("long"), 8 * k) for k in range(STATES)]
    profile = shares[0]
    for x in shares[1:]:
        profile = profile.bitwiseOR(x)
    return sums.select("token", "bucket", "c", profile.alias("profile"))


@dataclass
class Emissions:
    """frequent: the ratios of the vocabulary's tokens by state; buckets: shares of states in each bucket; unknown: the ratios of unknown tokens; sums: the states' sums."""

    frequent: np.ndarray
    buckets: np.ndarray
    unknown: np.ndarray
    sums: np.ndarray

    def ratios(self, c: np.ndarray, bucket: np.ndarray, profile: np.ndarray) -> np.ndarray:
        own = unpacked(profile) if len(profile) else np.zeros((0, STATES))
        return (c[:, None] * own + PULL * self.buckets[bucket]) / (c[:, None] + PULL) / self.sums


def emissions(profiles: DataFrame, known: Vocabulary) -> Emissions:
    """What the driver needs of the profiles: sums by bucket, and the vocabulary's tokens."""
    bytes_ = [F.shiftrightunsigned("profile", 8 * k).bitwiseAND(255) for k in range(STATES)]
    total = bytes_[0]
    for x in bytes_[1:]:
        total = total + x
    base = (F.col("c") + ADDED) / F.lit(known.total)
    pulled = F.sum(base * PULL / (F.col("c") + PULL)).alias("a")
    own = [F.sum(base * F.col("c") / (F.col("c") + PULL) * x / total).alias(f"b{k}") for k, x in enumerate(bytes_)]
    seen = [F.sum(F.col("c") * x / total).alias(f"e{k}") for k, x in enumerate(bytes_)]
    rows = profiles.groupBy("bucket").agg(pulled, *own, *seen).toArrow()  # one row for each bucket
    at = np.asarray(rows.column("bucket"))
    a, b, e = np.zeros(BUCKETS), np.zeros((BUCKETS, STATES)), np.zeros((BUCKETS, STATES))
    a[at] = np.asarray(rows.column("a"))
    for k in range(STATES):
        b[at, k], e[at, k] = np.asarray(rows.column(f"b{k}")), np.asarray(rows.column(f"e{k}"))
    states = (e.sum(axis=0) + 1) / (e.sum() + STATES)
    buckets = (e + BUCKET_PULL * states) / (e.sum(axis=1, keepdims=True) + BUCKET_PULL)
    sums = b.sum(axis=0) + a @ buckets + ADDED / known.total * states
    out = Emissions(np.zeros((0, STATES)), buckets, states / sums, sums)
    top = profiles.where(size_of("c") >= known.least).toArrow()
    token, bucket, c, profile = (np.asarray(top.column(x)) for x in ("token", "bucket", "c", "profile"))
    order = np.lexsort((token, -c))
    if not np.array_equal(token[order].view(np.uint64), known.tokens):
        raise ValueError("the expected counts are not those of the vocabulary's texts")
    out.frequent = out.ratios(c[order].astype(float), bucket[order], profile[order])
    return out


def _scored(rows: DataFrame, model: Model, learnt: Emissions) -> DataFrame:
    """The rows with gain, the log10 of the model's probability over the base's; met: place, c, bucket, profile of a text's rare tokens that training texts have."""
    kept = [c for c in rows.columns if c not in ("classes", "others", "rare", "met")]
    shared = rows.sparkSession.sparkContext.broadcast((model, learnt))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, learnt = shared.value
        table = np.zeros((FREQUENT, STATES))
        table[: len(learnt.frequent)] = learnt.frequent
        for batch in batches:
            for part in slices(batch, "classes", 2 * BUFFER):
                _, numbers = _numbers(part, OWN)
                sizes, met = part.column("rare").to_numpy(zero_copy_only=False), part.column("met")
                found = pc.fill_null(met.value_lengths(), 0).to_numpy(zero_copy_only=False)
                flat = met.flatten()
                place, c, bucket, profile = (flat.field(k).to_numpy() for k in range(4))
                ratios, first, gain = learnt.ratios(c.astype(float), bucket, profile), np.cumsum(found) - found, np.zeros(len(part))
                for some in numbered_blocks(list(map(len, numbers))):
                    base = np.cumsum(sizes[some]) - sizes[some]
                    own = np.tile(learnt.unknown, (int(sizes[some].sum()), 1))
                    at = np.concatenate([np.arange(first[k], first[k] + found[k]) for k in some]).astype(np.int64)
                    own[np.repeat(base, found[some]) + place[at]] = ratios[at]
                    steps = Steps([np.where(numbers[k] >= FREQUENT, numbers[k] + b, numbers[k]) for k, b in zip(some, base.tolist(), strict=True)])
                    gain[some] = steps.log10(model, np.concatenate([table, own]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(gain)], names=[*kept, "gain"])

    out = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n in kept)
    return rows.mapInArrow(apply, f"{out}, gain double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder("doc_id", 10) == 0).alias("held_out"))
    counts = written(count_tokens(source.where("not held_out")), "counts", "none")
    known = vocabulary(counts)
    encoded = written(encode(source, known), "encoded")
    training = encoded.where("not held_out")
    model = begin(known.share, training)
    for _ in range(ROUNDS):
        model = baum_welch(training, model, known.share)
    profiles = written(token_profiles(training, known, model), "profiles")
    learnt = emissions(profiles, known)

    total = F.lit(known.total)
    rare = encoded.select("row", F.posexplode(F.arrays_zip("rare", "times")).alias("place", "x")).select("row", "place", F.col("x.rare").alias("rare"), F.col("x.times").alias("times"))
    met = rare.join(profiles, F.col("rare") == F.col("token"), "left")
    base, there = F.log10((F.coalesce("c", F.lit(0)) + ADDED) / total), F.col("c").isNotNull()
    added = met.groupBy("row").agg(
        F.sum(F.col("times") * base).alias("rare_base"), F.sum(F.when(there, F.col("times")).otherwise(0)).alias("rare_known"), F.collect_list(F.when(there, F.struct("place", "c", "bucket", "profile"))).alias("met"),
    ).withColumnRenamed("row", "rare_row")
    both = encoded.join(added, F.col("row") == F.col("rare_row"), "left")
    whole = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    given = both.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), whole.alias("base_score"), "classes", "others", F.size("rare").cast("long").alias("rare"), "met")
    result = _scored(given, model, learnt)
    kept = written(result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.n).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain")).alias("score")), "scored")
    for df in (encoded, counts, profiles):
        remove(df)
    return kept
