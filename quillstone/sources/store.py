"""A store of company facts that is filled as companies are asked for: each raw document is read and parsed once.

    facts/bucket=N/   the facts of companies whose hash falls into the bucket, with the fill that wrote them
    keys/             cik, bucket, fill: written after the facts of a fill, so it says which of them count

A fill that breaks off leaves facts without keys, which no reader sees; its companies are read again by the next one.  Where two fills
at once read one company, the facts of one of them count.  Companies without a raw document are asked for again each time.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.filings import COMPANY_FACTS, exploded_facts
from quillstone.sources.zips import _file

BUCKETS = 256
FACTS = "cik bigint, entity_name string, ns string, tag string, unit string, pos int, start date, end date, val double, fy int, fp string, form string, filed date, frame string"
KEYS = "cik bigint, bucket int, fill string"


def documents(spark: SparkSession, folder: str, pattern: str = r"CIK0*(\d+)\.json(\.gz)?$") -> DataFrame:
    """cik, path of the raw documents in a folder, by their names alone."""
    names = spark.read.format("binaryFile").load(folder).select("path")
    return names.select(F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).try_cast("bigint").alias("cik"), "path").where("cik is not null")


def _keys(spark: SparkSession, store: str) -> DataFrame:
    try:
        rows = spark.read.schema(KEYS).parquet(f"{store}/keys")
    except AnalysisException:  # nothing was stored yet
        rows = spark.createDataFrame([], KEYS)
    return rows.groupBy("cik", "bucket").agg(F.min("fill").alias("fill"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("cik"), F.lit(buckets)).cast("int")


def _parsed(found: DataFrame) -> DataFrame:
    """The facts of documents (cik, path), each opened in the task that has its row; unreadable JSON is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cik, path in zip(batch.column("cik").to_pylist(), batch.column("path").to_pylist(), strict=True):
                with _file(path) as f:
                    raw = f.read()
                text = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                yield pa.RecordBatch.from_arrays([pa.array([cik], pa.int64()), pa.array([text.decode()], pa.string())], names=["key", "doc"])

    docs = found.select("cik", "path").mapInArrow(read, "key bigint, doc string")
    # the company is the one that was asked for, whatever the document says of itself
    parsed = docs.select("key", F.from_json("doc", COMPANY_FACTS, {"mode": "FAILFAST"}).alias("d")).select(F.col("key").alias("cik"), "d.entityName", "d.facts")
    return exploded_facts(parsed)


def fill(wanted: DataFrame, raw: DataFrame, store: str, buckets: int = BUCKETS) -> None:
    """Read and store the documents of wanted companies that the store lacks.

    wanted: cik; raw: cik, path, one row for each company.  Null and repeated companies count once or not at all.
    Only missing documents are opened; neither their paths nor their facts pass the driver.
    """
    spark = wanted.sparkSession
    name = uuid.uuid4().hex
    asked = wanted.select(F.col("cik").cast("bigint").alias("cik")).where("cik is not null").distinct()
    missing = asked.join(_keys(spark, store), "cik", "left_anti").join(raw.select("cik", "path"), "cik")
    if missing.isEmpty():
        return
    facts = _parsed(missing).withColumn("fill", F.lit(name)).withColumn("bucket", _bucket(buckets))
    facts.repartition("bucket", "cik").write.partitionBy("bucket").mode("append").parquet(f"{store}/facts")
    missing.select("cik", _bucket(buckets).alias("bucket"), F.lit(name).alias("fill")).write.mode("append").parquet(f"{store}/keys")


def stored(wanted: DataFrame, store: str) -> DataFrame:
    """The facts of wanted companies that the store has.

    Only their buckets' folders are read: the driver learns which buckets those are, BUCKETS numbers at most.
    """
    spark = wanted.sparkSession
    asked = wanted.select(F.col("cik").cast("bigint").alias("cik")).where("cik is not null").distinct()
    keys = _keys(spark, store).join(asked, "cik", "left_semi")
    met = [r.bucket for r in keys.select("bucket").distinct().collect()]
    if not met:
        return spark.createDataFrame([], FACTS)
    rows = spark.read.schema(f"{FACTS}, fill string, bucket int").parquet(f"{store}/facts").where(F.col("bucket").isin(met))
    return rows.join(keys, ["cik", "bucket", "fill"], "left_semi").drop("bucket", "fill")


def read_through(wanted: DataFrame, raw: DataFrame, store: str, buckets: int = BUCKETS) -> DataFrame:
    """The facts of wanted companies, from the store where it has them, else from their documents, which it then has too."""
    fill(wanted, raw, store, buckets)
    return stored(wanted, store)
