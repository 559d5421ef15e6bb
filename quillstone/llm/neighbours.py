"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

1. Codes.  `ROTATIONS` rotations of 64 dimensions at most, each learned by iterative quantisation on a bounded
   sample (`SAMPLE` vectors of least hash), give a code of as many 64-bit words: the signs of the rotated vector.
2. Radius.  `PILOTS` queries are compared with every vector.  The radius of the search is the least Hamming
   radius that holds the share `RECALL` of their true neighbours, so recall is measured against brute force.
3. Index.  Word j of a code is its substring j.  Table j keeps every code under the leading bits of substring j.
4. Pigeonhole probing.  A code within radius r of the query differs in at most floor(r / m) bits, or one less, in one
   substring at least.  A query visits the cells of each table whose leading bits differ in no more bits than that, so
   no code within the radius is missed.  A pair found in several tables counts in the first of them only.
5. The codes within the radius are ranked by the inner products of the original vectors, in double precision.

Cells are cut into pieces of about `ROWS` codes and `QUERIES` queries, so no cell is gathered in one task however
full it is.  Equal vectors are one point, with its `k + 1` smallest ids, which are all that an answer can name.  A
query with fewer than k neighbours within the radius is searched again with all codes.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part;
with no vector left the result is empty.  Ties go to the smaller id.  A row with null id takes no part.  Rows of
equal id and vector are one; a query never finds its own id.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import least_hashed, remove, written

SAMPLE, ROUNDS, ROTATIONS, DIGEST = 8_192, 25, 4, 16
PILOTS, RECALL = 64, 0.97
ROWS, QUERIES, MOST_BITS, SALTS = 16_384, 4_096, 12, 8
SCHEMA = "query_id long, rank int, vec_id long, score double"


@dataclass
class Codes:
    """Turns vectors into codes: row k of words holds the bits of rotation k."""

    mean: np.ndarray
    turns: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x - self.mean
        words = []
        for turn in self.turns:
            bits = np.zeros((len(x), 64), np.uint8)
            bits[:, : turn.shape[1]] = y @ turn > 0
            words.append(np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0])
        return np.stack(words, axis=1) if len(x) else np.zeros((0, len(self.turns)), np.uint64)


def learn(sample: np.ndarray, rotations: int = ROTATIONS) -> Codes:
    """Iterative quantisation: principal directions, turned so that signs lose least, from several random starts."""
    mean = sample.mean(axis=0)
    x = sample - mean
    width = min(64, sample.shape[1])
    directions = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :width]
    seen, turns = x @ directions, []
    for k in range(rotations):
        turn = np.linalg.qr(np.random.default_rng(k).normal(size=(width, width)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(seen.T @ np.where(seen @ turn > 0, 1.0, -1.0))
            turn = u @ v
        turns.append(directions @ turn)
    return Codes(mean, turns)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the same order wherever they are computed."""
    out = np.empty(len(a))
    for at in range(0, len(a), 1 << 15):
        out[at : at + (1 << 15)] = (a[at : at + (1 << 15)] * b[at : at + (1 << 15)]).sum(axis=1)
    return out


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    joined = np.frombuffer(b"".join(column.to_pylist()), kind).astype(float)
    return joined.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _words(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(table.column(f"w{k}")).view(np.uint64) for k in range(ROTATIONS)], axis=1)


def thresholds(radius: int, tables: int = ROTATIONS) -> list[int]:
    """Most bits in which substring j of a code within the radius may differ, for one j at least."""
    share, left = divmod(radius, tables)
    return [share if j <= left else share - 1 for j in range(tables)]


def _coded(rows: DataFrame, codes: Codes, kind: str) -> DataFrame:
    """vec_id, digest of the vector, its bytes and the words of its code."""
    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            if not len(batch):
                continue
            x = np.asarray(batch.column("embedding").flatten()).astype(kind).reshape(len(batch), -1) + 0  # no negative zero
            raw = [row.tobytes() for row in x]
            words = shared.value(x.astype(float)).view(np.int64)
            digests = [hashlib.blake2b(r, digest_size=DIGEST).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(raw, pa.binary()), *(pa.array(words[:, k]) for k in range(ROTATIONS))], names=["vec_id", "digest", "vec", *(f"w{k}" for k in range(ROTATIONS))])

    return rows.mapInArrow(code, "vec_id long, digest binary, vec binary, " + ", ".join(f"w{k} long" for k in range(ROTATIONS)))


def _points(coded: DataFrame, k: int) -> DataFrame:
    """One row for equal vectors: point (the least id), ids (the k + 1 least), vec, words."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    for keys in (["digest", salt], ["digest"]):  # equal vectors may be a third of all
        coded = coded.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    words = [F.first(f"w{j}").alias(f"w{j}") for j in range(ROTATIONS)]
    return coded.groupBy("digest").agg(F.min("vec_id").alias("point"), F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("vec").alias("vec"), *words)


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k best of their query: highest score, then least id."""
    order = np.lexsort((ids, -score, query))
    ordered = query[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def measured_radius(points: DataFrame, pilots: DataFrame, kind: str, k: int) -> int:
    """Least radius that holds the share RECALL of the pilots' true neighbours, found by brute force over all points."""
    rows = least_hashed(pilots, "point", PILOTS, "point").select("point", "vec", *(f"w{j}" for j in range(ROTATIONS))).toArrow()
    if not len(rows):
        return 0
    own, own_vec, own_words = np.asarray(rows.column("point")), _matrix(rows.column("vec").combine_chunks(), kind), _words(rows)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                score, ids, words = own_vec @ _matrix(some.column("vec"), kind).T, np.asarray(some.column("point")), _words(some)
                score[own[:, None] == ids[None, :]] = -np.inf
                near = np.argpartition(-score, min(k, len(ids) - 1), axis=1)[:, :k]
                q = np.repeat(np.arange(len(own)), near.shape[1])
                far = np.bitwise_count(own_words[q] ^ words[near.ravel()]).sum(axis=1).astype(np.int64)
                found = [q, score[q, near.ravel()], ids[near.ravel()], far]
                best = [np.concatenate(x) for x in zip(best, found, strict=True)]
                kept = _best(*best[:3], k)
                best = [x[kept] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["q", "score", "id", "far"])

    each = points.select("point", "vec", *(f"w{j}" for j in range(ROTATIONS))).mapInArrow(nearest, "q long, score double, id long, far long")
    line = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = each.where("score > double('-infinity')").withColumn("r", F.row_number().over(line)).where(F.col("r") <= k)
    far = np.sort(np.array([r["far"] for r in top.select("far").collect()]))  # k rows for each pilot
    return int(far[min(len(far) - 1, int(np.ceil(RECALL * len(far))) - 1)]) if len(far) else 0


def _search(points: DataFrame, queries: DataFrame, radius: int, kind: str, k: int, bits: int) -> DataFrame:
    """query (a point), vec_id, score: the k best ids within the radius."""
    limits = thresholds(radius)
    words = [f"w{j}" for j in range(ROTATIONS)]
    cells = 1 << bits

    def lead(j: int):  # noqa: ANN202
        return F.col(f"w{j}").bitwiseAND(cells - 1).cast("int")

    tables = F.array(*(F.struct(F.lit(j).alias("j"), lead(j).alias("cell")) for j in range(ROTATIONS) if limits[j] >= 0))
    kept = points.select("point", "ids", "vec", *words, F.explode(tables).alias("t")).select("*", "t.j", "t.cell").drop("t")

    def probed(j: int):  # noqa: ANN202
        near = F.filter(F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: F.bit_count(c.bitwiseXOR(lead(j))) <= limits[j])
        return F.transform(near, lambda c: F.struct(F.lit(j).alias("j"), c.alias("cell")))

    probes = F.flatten(F.array(*(probed(j) for j in range(ROTATIONS) if limits[j] >= 0)))
    asked = queries.select(F.col("point").alias("query"), F.col("vec").alias("q_vec"), *(F.col(w).alias(f"q_{w}") for w in words), F.explode(probes).alias("t")).select("*", "t.j", "t.cell").drop("t")

    # a row for each cell of each table: ROTATIONS * 2 ** MOST_BITS at most
    n = kept.groupBy("j", "cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("pieces")).join(asked.groupBy("j", "cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")), ["j", "cell"])
    sizes = F.broadcast(written(n, "cells"))
    left = kept.join(sizes, ["j", "cell"]).withColumn("piece", F.pmod(F.xxhash64("point"), F.col("pieces")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("pieces", "blocks")
    right = asked.join(sizes, ["j", "cell"]).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces", "blocks")

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(a) or not len(b):
            return schema.empty_table()
        a, b = a.combine_chunks(), b.combine_chunks()
        j = a.column("j")[0].as_py()
        rows, asks = _words(a), _words(b.rename_columns([c.removeprefix("q_") if c.startswith("q_w") else c for c in b.column_names]))
        x, y = _matrix(a.column("vec").chunk(0), kind), _matrix(b.column("q_vec").chunk(0), kind)
        lists = a.column("ids").chunk(0)
        number, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        first = np.cumsum(number) - number
        query = np.asarray(b.column("query"))
        out = []
        for at in range(0, len(asks), 128):
            some = asks[at : at + 128]
            q, p = np.nonzero(np.bitwise_count(some[:, j, None] ^ rows[None, :, j]) <= limits[j])
            far = np.bitwise_count(some[q] ^ rows[p])
            keep = far.sum(axis=1, dtype=np.int64) <= radius
            for i in range(j):
                keep &= far[:, i].astype(np.int64) > limits[i]
            q, p = q[keep] + at, p[keep]
            score = products(y[q], x[p])
            each = np.repeat(np.arange(len(q)), number[p])
            ids = flat[first[p][each] + np.arange(len(each)) - np.repeat(np.cumsum(number[p]) - number[p], number[p])]
            q, score = q[each], score[each]
            best = _best(q, score, ids, k)
            out.append((query[q[best]], ids[best], score[best]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    keys = ["j", "cell", "piece", "block"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(match, "query long, vec_id long, score double")
    line = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(line)).where(F.col("r") <= k).drop("r")


def nearest(vectors: DataFrame, every: int, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each vector whose id is divisible by `every`.  vectors: vec_id, embedding."""
    spark = vectors.sparkSession
    kind = "<f4" if "array<float>" in dict(vectors.dtypes)["embedding"] else "<f8"
    item = "float" if kind == "<f4" else "double"
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{item}>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0)
    source = source.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite)
    lengths = source.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], SCHEMA)
    source = source.where(F.size("embedding") == lengths[0]["n"])
    sample = np.array([r["embedding"] for r in least_hashed(source, "vec_id", SAMPLE, "vec_id").select("embedding").collect()], float)
    coded = written(_coded(source, learn(sample), kind).distinct(), "coded", "none")
    points = written(_points(coded, k), "points", "none")
    total = points.count()
    bits = min(MOST_BITS, max(1, int(np.ceil(np.log2(max(2, total) / ROWS)))))
    asking = coded.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "digest")
    queries = points.join(asking.select("digest").distinct(), "digest", "left_semi")
    radius = measured_radius(points, queries, kind, k)
    found = written(_search(points, queries, radius, kind, k + 1, bits), "found")

    # fewer than k neighbours and itself within the radius, though there are more rows
    enough = found.groupBy("query").count().where(F.col("count") > k).select("query")
    short = written(queries.join(enough, F.col("point") == F.col("query"), "left_anti"), "short")
    if radius < 64 * ROTATIONS and not short.isEmpty():
        again = written(_search(points, short, 64 * ROTATIONS, kind, k + 1, bits), "again")
        found = found.join(short.select(F.col("point").alias("query")), "query", "left_anti").unionByName(again)
    named = asking.join(points.select("digest", "point"), "digest").select("query_id", "point")
    own = named.join(found, F.col("point") == F.col("query")).where("vec_id <> query_id").select("query_id", "vec_id", "score")
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    result = own.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    kept = written(result, "nearest")
    for df in (coded, points):
        remove(df)
    return kept
