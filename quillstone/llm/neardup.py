"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Documents of equal shingle sets are one class, however many there are; all further work is on classes.
2. A class has `BANDS` bands of `ROWS` MinHash values.  Classes that share a band are candidates.  At the
   threshold similarity a pair shares none with probability (1 - 0.75 ** 4) ** 36, about 1e-6.
3. In each band bucket every class is compared with one pivot, so a bucket of n makes n - 1 pairs.
4. Signatures are compared in batches of `BATCH` values.  After each batch the posterior of the similarity (a
   uniform prior) drops the pair once P(similarity >= threshold) is below `MISS`.
5. Survivors are confirmed on their full shingle sets.
6. What these links leave in different components of one bucket is compared all against all (the exact rest) inside
   tasks, in blocks of `BLOCK` by `BLOCK` classes: a pair counts in its first common band only, passes the same
   sequential test, and is verified on the sets, which travel as 64-bit hashes.  A block gives one link for each two
   components that it joins, so no pairs are written out.  These links are confirmed on the full sets, too.

Joins on a bucket, a pivot, a digest or a root, of which one may hold a third of all rows, are salted for the heavy keys
(`heavy_join`) or all (`spread_join`).

Null and empty texts and texts without words have no shingle, link with nothing and stand for themselves.  Equal
texts and repeated rows are linked.  A null doc_id takes part, is never a component's id unless its component
has no other, and is kept only then.  An empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import WAVES, fewer, heavy_join, heavy_keys, slices, spread_join, written
from quillstone.llm.components import components
from quillstone.llm.shingles import shingle_hashes

PER_CENT = 75
BANDS, ROWS, BATCH, MISS, BLOCK = 36, 4, 16, 1e-5, 2_048
_LINE = np.random.default_rng(75).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes: the least upper halves of a * h + b for each of the pairs (a, b)."""
    out = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 512):
        np.minimum(out, (_LINE[0][:, None] * hashes[None, at : at + 512] + _LINE[1][:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def least_matches(threshold: float = PER_CENT / 100, miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer, P(similarity >= threshold) < miss under a uniform prior.

    The posterior after m matches in n is Beta(m + 1, n - m + 1), whose upper tail is that of a binomial.
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _signed(docs: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", 4 << 20):
                sets = shingle_hashes(some.column("text"))
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                met: dict[bytes, bytes] = {}
                for x, d in zip(sets, digests, strict=True):
                    if d not in met:
                        met[d] = signature(x).tobytes()
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text_hash"), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests, pa.binary()), pa.array([met[d] for d in digests], pa.binary())], names=["doc_id", "text_hash", "n", "digest", "sig"])

    return docs.mapInArrow(sign, "doc_id long, text_hash long, n long, digest binary, sig binary")


def _likely(pairs: DataFrame, classes: DataFrame, hot: DataFrame) -> DataFrame:
    """The pairs (a, b) that sequential verification keeps; hot: the b that very many pairs have."""
    needed = least_matches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(len(batch)), np.zeros(len(batch), np.int64)
            for n, m in needed:
                matches = matches + (left[alive, n - BATCH : n] == right[alive, n - BATCH : n]).sum(axis=1)
                keep = matches >= m
                alive, matches = alive[keep], matches[keep]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    def sigs(c: str) -> DataFrame:
        return classes.select(F.col("cid").alias(f"c_{c}"), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))

    both = heavy_join(pairs, sigs("b"), "b", "c_b", F.col("a"), heavy=hot).join(sigs("a"), F.col("a") == F.col("c_a"))
    fits = both.where(100 * F.least("n_a", "n_b") >= PER_CENT * F.greatest("n_a", "n_b"))
    return fits.select("a", "b", "sig_a", "sig_b").mapInArrow(verify, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, hot: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough; hot: the b that very many pairs have."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def sets_of(ids: list[int], texts: pa.Array) -> None:
            new = {c: k for k, c in enumerate(ids) if c not in known}
            if new:
                known.update(zip(new, shingle_hashes(texts.take(pa.array(list(new.values())))), strict=True))

        for batch in batches:
            for whole in slices(batch, "text_b", 4 << 20):
                for some in slices(whole, "text_a", 4 << 20):
                    a, b = some.column("a").to_pylist(), some.column("b").to_pylist()
                    sets_of(a, some.column("text_a"))
                    sets_of(b, some.column("text_b"))
                    ok = []
                    for x, y in zip(a, b, strict=True):
                        both = len(np.intersect1d(known[x], known[y], assume_unique=True))
                        ok.append(100 * both >= PER_CENT * (len(known[x]) + len(known[y]) - both))
                    yield some.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
                    while len(known) > 256:
                        known.popitem(last=False)

    both = heavy_join(pairs, texts.select(F.col("cid").alias("c_b"), F.col("text").alias("text_b")), "b", "c_b", F.col("a"), heavy=hot)
    both = both.join(texts.select(F.col("cid").alias("c_a"), F.col("text").alias("text_a")), F.col("a") == F.col("c_a"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def _sets(texts: DataFrame) -> DataFrame:
    """cid and the class's set as sorted 64-bit hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", 4 << 20):
                short = [x.astype("<u8").tobytes() for x in shingle_hashes(some.column("text"))]
                yield pa.RecordBatch.from_arrays([some.column("cid"), pa.array(short, pa.binary())], names=["cid", "words"])

    return texts.mapInArrow(sets, "cid long, words binary")


def _rest_links(rest: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components that share a bucket: rest has bucket, band, cid, root, main.

    A bucket's classes outside its main component are compared with all its others.
    """
    needed = least_matches()
    sizes = rest.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("y_n"), F.ceil(F.count_if(F.col("root") != F.col("main")) / BLOCK).cast("int").alias("x_n")).withColumnRenamed("bucket", "k")
    sized = heavy_join(rest, sizes, "bucket", "k", F.col("cid")).drop("k")
    piece = F.xxhash64("cid")
    x = sized.where("root <> main").withColumn("xp", F.pmod(piece, F.col("x_n")).cast("int")).withColumn("yp", F.explode(F.sequence(F.lit(0), F.col("y_n") - 1))).withColumn("side", F.lit(0))
    y = sized.withColumn("yp", F.pmod(piece, F.col("y_n")).cast("int")).withColumn("xp", F.explode(F.sequence(F.lit(0), F.col("x_n") - 1))).withColumn("side", F.lit(1))
    light = x.unionByName(y).select("bucket", "band", "xp", "yp", "side", "cid", "root", "main")
    full = light.join(classes.select(F.col("cid").alias("c"), "n", "sig"), F.col("cid") == F.col("c")).drop("c").join(sets.withColumnRenamed("cid", "c"), F.col("cid") == F.col("c")).drop("c")
    keys = ["bucket", "xp", "yp"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            block = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            starts = np.append(np.flatnonzero((block[1:] != block[:-1]).any(axis=1)) + 1, len(batch))
            at = 0
            if waiting and any(waiting[0].column(c)[0] != batch.column(c)[0] for c in keys):
                yield _block_links(waiting, needed)
                waiting = []
            for to in starts.tolist():
                waiting.append(batch.slice(at, to - at))
                at = to
                if to < len(batch):
                    yield _block_links(waiting, needed)
                    waiting = []
        if waiting:
            yield _block_links(waiting, needed)

    return full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "a long, b long")


def _block_links(parts: list[pa.RecordBatch], needed: list[tuple[int, int]]) -> pa.RecordBatch:
    """The links of one block that join components, one for each join."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    side, cid, root = (rows.column(c).to_numpy() for c in ("side", "cid", "root"))
    band, main, n = rows.column("band")[0].as_py(), rows.column("main")[0].as_py(), rows.column("n").to_numpy()
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u4").reshape(len(rows), -1)
    words = rows.column("words")
    known: dict[int, np.ndarray] = {}
    parent: dict[int, int] = {}

    def top(r: int) -> int:
        while parent.get(r, r) != r:
            r = parent[r]
        return r

    def set_of(k: int) -> np.ndarray:
        if k not in known:
            known[k] = np.frombuffer(words[k].as_py(), "<u8")
        return known[k]

    found: list[tuple[int, int]] = []
    xs, ys = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    # a pair of two classes outside the main component is met twice; the one with the smaller class first counts
    for x in xs.tolist():
        ok = (root[ys] != root[x]) & (100 * np.minimum(n[ys], n[x]) >= PER_CENT * np.maximum(n[ys], n[x])) & ((root[ys] == main) | (cid[ys] > cid[x]))
        to = ys[ok]
        matches, at = np.zeros(len(to), np.int64), 0
        for upto, least in needed:
            matches = matches + (sig[to, at:upto] == sig[x, at:upto]).sum(axis=1)
            keep = matches >= least
            to, matches, at = to[keep], matches[keep], upto
        if not len(to):
            continue
        same = (sig[to] == sig[x]).reshape(len(to), BANDS, ROWS).all(axis=2)
        first = same.argmax(axis=1) == band
        for y in to[first][np.argsort(-matches[first], kind="stable")].tolist():
            if top(root[x]) == top(root[y]):
                continue
            both = len(np.intersect1d(set_of(x), set_of(y), assume_unique=True))
            if 100 * both >= PER_CENT * (n[x] + n[y] - both):
                found.append((max(cid[x], cid[y]), min(cid[x], cid[y])))
                parent[top(root[x])] = top(root[y])
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return _grouped(docs).drop("text_hash", "root")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component, all its columns: the one of least doc_id (null last), then of least hash of the text, then of all columns.

    Rows without a shingle are components of their own, but for those of equal doc_id and text, of which one is kept.
    """
    marked = _grouped(docs).select("doc_id", "text_hash", "root")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first")
    chosen = marked.where("root is not null").groupBy("root").agg(order).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    chosen = chosen.unionByName(marked.where("root is null").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct())
    names = [f"c{k}" for k in range(len(docs.columns))]
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    both = keyed.join(chosen, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")))
    first = both.withColumn("r", F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.xxhash64(*names)))).where("r = 1")
    return fewer(first.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True))), waves=2 * WAVES)


def _grouped(docs: DataFrame) -> DataFrame:
    """near_duplicates with the hash of each text and root, a number of the component (null where there is no shingle)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = written(_signed(source), "signed", "none")
    classes = signed.where("n > 0").groupBy("digest").agg(F.first("sig").alias("sig"), F.first("n").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("doc_id").alias("first_id"))
    classes = written(fewer(classes.withColumn("cid", F.monotonically_increasing_id())), "classes", "none")

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    bands = classes.select("cid", F.posexplode(band).alias("band", "bucket"))
    buckets = written(fewer(bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("cid").alias("pivot")).where("size > 1").select(F.col("bucket").alias("k"), "pivot", "size")), "buckets")
    many = max(1_000, classes.count() * BANDS // 1_000)
    hot_buckets = buckets.where(F.col("size") > many)  # a thousand at most
    members = written(fewer(heavy_join(bands, buckets, "bucket", "k", F.col("cid"), heavy=hot_buckets.select(F.col("k").alias("_heavy"))).select("bucket", "band", "cid", "pivot")), "members")

    # texts of the classes that have a candidate, one row each
    wanted = members.select("cid").distinct().join(classes.select(F.col("cid").alias("c"), F.col("rep.doc_id").alias("d"), F.col("rep.text_hash").alias("t")), F.col("cid") == F.col("c"))
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).select("cid", "text")
    texts = written(fewer(texts.groupBy("cid").agg(F.first("text").alias("text"))), "texts")

    stars = members.where("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct()
    hot = hot_buckets.select(F.col("pivot").alias("_heavy")).distinct()  # the pivots of most pairs are those of the largest buckets
    links = written(fewer(_confirmed(_likely(stars, classes, hot), texts, hot)), "links")

    # what the stars left apart: classes of one bucket in different components
    rooted = members.join(components(links), F.col("cid") == F.col("node"), "left").select("bucket", "band", "cid", F.coalesce("root", "cid").alias("root"))
    counted = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    apart = counted.groupBy("bucket").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1").select(F.col("bucket").alias("k"), "main")
    rest = written(fewer(heavy_join(rooted, apart, "bucket", "k", F.col("cid"), heavy=hot_buckets.select(F.col("k").alias("_heavy"))).select("bucket", "band", "cid", "root", "main")), "rest")
    more = written(fewer(_rest_links(rest, classes, _sets(texts)).distinct()), "more")
    links = links.unionByName(_confirmed(more, texts, heavy_keys(more, "b")))

    roots = components(links)
    grouped = classes.select("digest", "cid", "first_id").join(roots, F.col("cid") == F.col("node"), "left").select("digest", "first_id", F.coalesce("root", "cid").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = spread_join(grouped, ids.withColumnRenamed("root", "r"), F.col("root"), "r", F.col("digest")).select(F.col("digest").alias("d"), "root", "component_id")
    linked = heavy_join(signed.where("n > 0"), named, "digest", "d", F.col("doc_id")).select("doc_id", "text_hash", "n", "root", "component_id")
    alone = signed.where("n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", "text_hash", "root", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
