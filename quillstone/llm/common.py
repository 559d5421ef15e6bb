"""What the corpus operators share: the tables of a run, the shared folder, small column helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch are handled in slices of about so many bytes of text.
SLICE_BYTES = 16 << 20
#: Tasks over which the rows of one key are spread.
SALTS = 8
#: fewer() leaves so many partitions for each core, or one for so many shuffle partitions, if that is more.
WAVES, MERGED = 4, 8
#: Short rows (two numbers) of one file.
FILE_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session may lack it; it then gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fewer(df: DataFrame, rows: int | None = None, waves: int = WAVES) -> DataFrame:
    """df in fewer partitions, for a table that comes out of a shuffle and is to be written: each partition is a file.

    The last stage's partitions are put together, no row moves or is lost.  Many tiny files cost more than their rows: on local
    disks Hadoop starts a process for each file it makes.  rows: what the table has at most, if that is known and rows are short.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if rows is not None:
        return df.coalesce(max(cores, -(-rows // FILE_ROWS)))
    return df.coalesce(max(waves * cores, int(spark.conf.get("spark.sql.shuffle.partitions")) // MERGED))


def remove(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(many: DataFrame, one: DataFrame, key: Column, one_key: str, by: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """many with the columns of one, which has one row for each key at most.

    Rows of many are dealt out by key and a salt taken from `by`, and every row of one is sent once for each salt, so a
    key with a third of all rows is spread over `salts` tasks.
    """
    salted = one.withColumn("_one_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = many.withColumn("_key", key).withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return dealt.join(salted, (F.col("_key") == F.col(one_key)) & (F.col("_salt") == F.col("_one_salt")), how).drop("_key", "_salt", "_one_salt")


def heavy_keys(many: DataFrame, key: str) -> DataFrame:
    """_heavy: the keys that more than a thousandth of many's rows have, 1,000 keys at most."""
    counts = many.groupBy(key).agg(F.count("*").alias("_n")).where(F.col(key).isNotNull())
    total = F.broadcast(many.agg(F.count("*").alias("_total")))  # one row
    return counts.join(total, F.col("_n") > F.greatest(F.col("_total") / 1_000, F.lit(1_000))).select(F.col(key).alias("_heavy"))


def heavy_join(many: DataFrame, one: DataFrame, key: str, one_key: str, by: Column, how: str = "inner", salts: int = SALTS, heavy: DataFrame | None = None) -> DataFrame:
    """spread_join that salts only the heavy keys: those of heavy_keys(many), or of a table of as few that is given.

    Without such a table many is read twice, so it should be a written one or cheap to make.
    """
    heavy = F.broadcast(heavy_keys(many, key) if heavy is None else heavy)
    dealt = many.join(heavy, F.col(key) == F.col("_heavy"), "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_heavy").isNotNull(), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0)).drop("_heavy")
    lasts = F.when(F.col("_heavy").isNotNull(), salts - 1).otherwise(0)
    sent = one.join(heavy, F.col(one_key) == F.col("_heavy"), "left").withColumn("_one_salt", F.explode(F.sequence(F.lit(0), lasts))).drop("_heavy")
    return dealt.join(sent, (F.col(key) == F.col(one_key)) & (F.col("_salt") == F.col("_one_salt")), how).drop("_salt", "_one_salt")


def least_hashed(df: DataFrame, key: str | Column, k: int, *ties: str) -> DataFrame:
    """The k rows of least 64-bit hash of the key, ties by further columns.

    A bound on the hash, set from the number of rows, leaves few more than k of them to be ordered in one place.
    """
    df = df.withColumn("_hash", F.xxhash64(key))
    share = 4 * (k + 50) / max(1, df.count())
    if share < 1:
        near = df.where(F.col("_hash") < F.lit(int(-(1 << 63) + share * 2.0**64)))
        if near.count() >= k:
            df = near
    return df.orderBy("_hash", *ties).limit(k).drop("_hash")


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of the id's decimal text, modulo by: the folds of the contracts (null: 0)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(by)), F.lit(0))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose column holds about `most` bytes; one longer text is a part of its own."""
    data = batch.column(column)
    if not len(data):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(data):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
