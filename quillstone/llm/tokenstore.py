"""A content-addressed store of token ids.

A rolling hash over the last ids cuts each document's id stream into chunks, so equal passages give equal chunks
wherever they stand.  A chunk is stored once, under the hash of its bytes; a document is a recipe, the list of
its chunks, with the root of a Merkle tree over them.  Layout below the store's folder:

    chunks/    digest, ids: the distinct chunks (ids: little-endian, 2 or 4 bytes each, zstandard)
    recipes/   part, page, place, row, doc_id, n_tokens, before, digests, root: in ascending doc_id order, over all files
               in the order of their names; a file is a part, `PAGE` recipes of it are a page, before counts the part's ids
    parts/     part, start, n_docs, pages: how many ids, documents and pages precede a part
    manifest/  level, number, n_docs, n_tokens, root: a Merkle tree over the recipes' roots, `PAGE` at a time; level 0 has
               the pages, the last level one node

Reading recomputes the hash of every chunk, the root of every recipe and all of the manifest; a difference, a lost or
an added recipe or page raises an error.

Null or empty text: the end id alone.  Repeated rows are separate recipes over the same chunks.  Null ids come
first.  An empty table gives an empty store.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import new_path, remove, slices, spread_join, written
from quillstone.llm.encoding import encoder

END_ID = 0
#: A chunk ends where the rolling hash has MEAN_BITS zero bits, after LEAST ids at least and MOST at most.
MEAN_BITS, LEAST, MOST, ROLL = 9, 64, 4096, 16
DIGEST = 16
#: Children of a node of the manifest.
PAGE = 1024
STAGED = "row long, doc_id long, n_tokens long, digests array<binary>, root binary, ids array<binary>"
_STAGED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("root", pa.binary()), ("ids", pa.list_(pa.binary()))])
RECIPES = "part int, page long, place int, row long, doc_id long, n_tokens long, before long, digests array<binary>, root binary"
NODES = "level int, number long, n_docs long, n_tokens long, root binary"


def rolling(ids: np.ndarray) -> np.ndarray:
    """Hash of the last ROLL ids at every place, older ids being shifted further out."""
    x = ids.astype(np.uint64)
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    step = 1
    while step < ROLL:
        x[step:] = x[step:] + (x[:-step] << np.uint64(step))
        step *= 2
    return x


def chunk_ends(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all documents, whose own ends are given; documents end a chunk."""
    high = rolling(ids) >> np.uint64(64 - MEAN_BITS)
    marks = np.flatnonzero(high == 0) + 1
    out: list[int] = []
    at = 0
    for end, m in zip(ends[1:].tolist(), np.searchsorted(marks, ends[1:]).tolist(), strict=True):
        last = out[-1] if out else 0
        for mark in marks[at:m].tolist():
            if mark - last >= LEAST:
                while mark - last > MOST:
                    last += MOST
                    out.append(last)
                out.append(mark)
                last = mark
        at = m
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end > last:
            out.append(end)
    return np.array(out, np.int64)


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over the leaves in their order; an odd one rises as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=DIGEST).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[k : k + 2]), digest_size=DIGEST).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else digest_of(b"")


def _stage(docs: DataFrame, tokenizer_path: str, end_id: int, wide: bool) -> DataFrame:
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, shrink = encoder(tokenizer_path, True, end_id).encode, zstandard.ZstdCompressor(level=1, write_content_size=True)
        row, kind = TaskContext.get().partitionId() << 40, "<u4" if wide else "<u2"
        met: set[bytes] = set()  # chunks that this task has put out
        for batch in batches:
            for some in slices(batch, "text", 8 << 20):
                ids, ends = encode(some.column("text"))
                cuts = chunk_ends(ids, ends)
                raw, size = memoryview(ids.astype(kind)).cast("B"), 4 if wide else 2
                parts = [raw[a * size : b * size] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
                digests = [digest_of(x) for x in parts]
                kept = []
                for x, d in zip(parts, digests, strict=True):
                    kept.append(None if d in met else shrink.compress(x))
                    met.add(d)
                if len(met) > 100_000:
                    met.clear()
                at = np.searchsorted(cuts, ends, side="right").astype(np.int32)
                roots = [merkle_root(digests[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                bounds = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(some))), some.column("doc_id"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(bounds, pa.array(digests, pa.binary())), pa.array(roots, pa.binary()), pa.ListArray.from_arrays(bounds, pa.array(kept, pa.binary()))], schema=_STAGED)
                row += len(some)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(stage, STAGED)


def _placed(staged: DataFrame) -> DataFrame:
    """The recipes in ascending order: by ranges of (doc_id, row), sorted and numbered inside the task that writes the range."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            place, through = np.arange(at, at + len(batch)), before + np.cumsum(n)
            numbered = [pa.array(np.full(len(batch), part, np.int32)), pa.array(place // PAGE), pa.array((place % PAGE).astype(np.int32)), batch.column("row"), batch.column("doc_id"), batch.column("n_tokens"), pa.array(through - n), batch.column("digests"), batch.column("root")]
            yield pa.RecordBatch.from_arrays(numbered, names=[c.split(" ")[0] for c in RECIPES.split(", ")])
            at, before = at + len(batch), int(through[-1]) if len(batch) else before

    ranged = staged.select("row", "doc_id", "n_tokens", "digests", "root").repartitionByRange(F.col("doc_id").asc_nulls_first(), "row")
    return ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row").mapInArrow(number, RECIPES)


def _joined(children: DataFrame, level: int) -> DataFrame:
    """The nodes over children (number, place, n_docs, n_tokens, root): PAGE of them at most have one number."""

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merkle_root([c["root"] for c in x]) for x in batch.column("children").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), level, np.int32)), *(batch.column(c) for c in ("number", "n_docs", "n_tokens")), pa.array(found, pa.binary())], names=["level", "number", "n_docs", "n_tokens", "root"])

    gathered = children.groupBy("number").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("place", "root"))).alias("children"))
    return gathered.mapInArrow(root, NODES)


def _pages(recipes: DataFrame, parts: DataFrame) -> DataFrame:
    """Level 0 of the manifest; parts has a row for each file of recipes."""
    numbered = recipes.select("part", "page", "place", "n_tokens", "root").join(F.broadcast(parts.select("part", "pages")), "part", "left")
    return _joined(numbered.select((F.col("pages") + F.col("page")).alias("number"), "place", F.lit(1).cast("long").alias("n_docs"), "n_tokens", "root"), 0)


def _above(nodes: DataFrame, level: int) -> DataFrame:
    return _joined(nodes.select(F.floor(F.col("number") / PAGE).cast("long").alias("number"), (F.col("number") % PAGE).alias("place"), "n_docs", "n_tokens", "root"), level + 1)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, wide: bool = False) -> None:
    """Encode all documents and write the store.  wide: 4 bytes an id, for files of more than 65,536 ids."""
    spark = docs.sparkSession
    staged = written(_stage(docs, tokenizer_path, end_id, wide), "staged", "none")
    each = staged.select(F.explode(F.arrays_zip("digests", "ids")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.ids").alias("ids")).where("ids is not null")
    each.groupBy("digest").agg(F.first("ids").alias("ids")).write.option("compression", "none").parquet(f"{path}/chunks")
    _placed(staged).write.option("compression", "zstd").parquet(f"{path}/recipes")
    remove(staged)

    # a row for each file of recipes, as many as there are ranges
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    totals = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("n_docs"), (F.max("page") + 1).alias("n_pages")).orderBy("part").collect()
    rows, start, n_docs, pages = [], 0, 0, 0
    for r in totals:
        rows.append((r["part"], start, n_docs, pages))
        start, n_docs, pages = start + r["n"], n_docs + r["n_docs"], pages + r["n_pages"]
    parts = spark.createDataFrame(rows, "part int, start long, n_docs long, pages long").coalesce(1)
    parts.write.parquet(f"{path}/parts")
    level, nodes = 0, pages
    _pages(recipes, parts).write.parquet(f"{path}/manifest/level=0")
    while nodes > 1:
        below = spark.read.schema(NODES).parquet(f"{path}/manifest/level={level}")
        _above(below, level).write.parquet(f"{path}/manifest/level={level + 1}")
        level, nodes = level + 1, -(-nodes // PAGE)


def check_manifest(spark: SparkSession, path: str) -> str:
    """Recompute the manifest from the recipes, level by level; the root of the store as hexadecimal digits."""
    recipes, parts = spark.read.schema(RECIPES).parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/parts")
    stored = spark.read.parquet(f"{path}/manifest")
    top = stored.agg(F.max("level").alias("level")).first()["level"] or 0
    for level in range(top + 1):
        own = spark.read.schema(NODES).parquet(f"{path}/manifest/level={level}").drop("level")
        found = _pages(recipes, parts) if not level else _above(spark.read.schema(NODES).parquet(f"{path}/manifest/level={level - 1}"), level - 1)
        both = own.join(found.select(F.col("number").alias("_number"), *(F.col(c).alias(f"_{c}") for c in ("n_docs", "n_tokens", "root"))), F.col("number") == F.col("_number"), "full_outer")
        same = F.col("number").isNotNull() & (F.col("root") == F.col("_root")) & (F.col("n_docs") == F.col("_n_docs")) & (F.col("n_tokens") == F.col("_n_tokens"))
        if not both.where(~F.coalesce(same, F.lit(False))).isEmpty():
            raise ValueError(f"level {level} of the manifest does not match what it stands for")
    last = spark.read.schema(NODES).parquet(f"{path}/manifest/level={top}").limit(2).collect()
    if len(last) > 1:
        raise ValueError("the manifest has no single root")
    return last[0]["root"].hex() if last else ""


def _checked_chunks(spark: SparkSession, path: str, wide: bool, with_ids: bool) -> DataFrame:
    """digest, n, crc (of the ids as 4-byte integers) of every stored chunk, its bytes being hashed again."""
    size, kind = (4, "<u4") if wide else (2, "<u2")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            n, crc, out = [], [], []
            for digest, packed in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                data = grow.decompress(packed)
                if digest_of(data) != digest:
                    raise ValueError(f"chunk {digest.hex()} does not hold what it was stored for")
                ids = np.frombuffer(data, kind).astype("<u4").tobytes()
                n.append(len(data) // size)
                crc.append(zlib.crc32(ids))
                if with_ids:
                    out.append(ids)
            columns = [batch.column("digest"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(out, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "n", "crc", *(["ids"] if with_ids else [])])

    return spark.read.parquet(f"{path}/chunks").mapInArrow(check, "digest binary, n long, crc long" + ", ids binary" * with_ids)


def _times_x(crc: np.ndarray, zero_bytes: np.ndarray) -> np.ndarray:
    """crc32 remainders moved on by numbers of zero bytes: square-and-multiply with matrices over GF(2)."""
    poly = np.uint32(0xEDB88320)
    columns = np.array([poly, *(np.uint32(1) << np.arange(31, dtype=np.uint32))], np.uint32)  # one zero bit

    def apply(matrix: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.zeros_like(value)
        for bit in range(32):
            out ^= np.where(value >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
        return out

    for _ in range(3):
        columns = apply(columns, columns)  # 2, 4, 8 bits
    value, left = crc.astype(np.uint32), zero_bytes.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        value[odd] = apply(columns, value[odd])
        columns, left = apply(columns, columns), left >> 1
    return value


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with start, the number of ids of all documents before."""
    parts = spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("_base"))
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes").join(F.broadcast(parts), "part").withColumn("start", F.col("_base") + F.col("before"))


def read_digests(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored files.

    The crc32 of a document's bytes is put together from those of its chunks, so chunk bytes stay where they were read.
    """
    check_manifest(spark, path)
    recipes = _recipes(spark, path)
    links = recipes.select("row", F.posexplode("digests").alias("pos", "d"))
    checked = _checked_chunks(spark, path, wide, False)
    met = spread_join(links, checked, F.col("d"), "digest", F.col("row"), "left")
    light = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "d", "n", "crc"))).alias("parts"))
    whole = recipes.select("row", "doc_id", "start", "n_tokens", "root").join(light, "row", "left")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            parts = batch.column("parts")
            sizes = parts.value_lengths().to_numpy(zero_copy_only=False)
            flat = parts.flatten()
            n, crc, d = (flat.field(k) for k in ("n", "crc", "d"))
            if n.null_count:
                raise ValueError("a recipe names a chunk that the store lacks")
            n, crc, d = n.to_numpy(), crc.to_numpy(), d.to_pylist()
            ends = np.cumsum(sizes)
            for k, (a, b, root) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), batch.column("root").to_pylist(), strict=True)):
                if merkle_root(d[a:b]) != root:
                    raise ValueError(f"recipe in row {k} does not match its Merkle root")
            # bytes that follow each chunk in its document
            through = np.cumsum(n)
            total = through[ends - 1] - np.append(0, through[ends - 1][:-1])
            if (total != batch.column("n_tokens").to_numpy()).any():
                raise ValueError("a recipe does not have its number of ids")
            after = np.repeat(through[ends - 1], sizes) - through
            moved = _times_x(crc.astype(np.uint32), after * 4)
            whole_crc = np.bitwise_xor.reduceat(moved, ends - sizes).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(whole_crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc_id, start, ids array<long> of every document, put together from its chunks and checked as read_digests() does."""
    check_manifest(spark, path)
    recipes = _recipes(spark, path)
    links = recipes.select("row", F.posexplode("digests").alias("pos", "d"))
    checked = _checked_chunks(spark, path, wide, True)
    parts = links.join(checked, F.col("d") == F.col("digest"), "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "d", "ids"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunks, root, n in zip(batch.column("parts").to_pylist(), batch.column("root").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                if any(c["ids"] is None for c in chunks or []):
                    raise ValueError("a recipe names a chunk that the store lacks")
                if merkle_root([c["d"] for c in chunks or []]) != root:
                    raise ValueError("a recipe does not match its Merkle root")
                out.append(np.frombuffer(b"".join(c["ids"] for c in chunks or []), "<u4").astype(np.int64))
                if len(out[-1]) != n:
                    raise ValueError("a recipe does not have its number of ids")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    whole = recipes.select("row", "doc_id", "start", "n_tokens", "root").join(parts, "row", "left")
    return whole.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(join, "doc_id long, start long, ids array<long>")


def store_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write a store into the shared folder and read its digests back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_store(docs, path, tokenizer_path)
    return read_digests(spark, path)
