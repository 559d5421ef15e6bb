"""Configuration kept as JSON: axis lists, concept maps, industry groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def asset(spark: SparkSession, path: str, schema: str, entries: str | None = None) -> DataFrame:
    """One JSON document as rows: the array of the named field with each element's place as ordinal, else the document itself."""
    whole = spark.read.schema(schema).json(path, multiLine=True)
    if entries is None:
        return whole
    return whole.select(F.posexplode(entries).alias("ordinal", "_e")).select("ordinal", "_e.*")
