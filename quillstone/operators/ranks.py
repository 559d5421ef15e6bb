"""Places over all rows of a table, found without one task that holds them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id() holds the partition above and the row below this bit.
BIT = 33


def _checkpoints(spark: SparkSession) -> None:
    """Set the folder of checkpoints where none is set: spark.checkpoint.dir, or a folder of its own in a local session."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
    spark.sparkContext.setCheckpointDir(folder)


def placed(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """df with the place of each row in that order, from 1; rows that the order doesn't tell apart follow in any order.

    Rows are sorted by ranges and numbered inside them; the sizes of the ranges before, one number for each, are added.  The sorted
    rows go to a checkpoint first, as ranges drawn once more might have other borders.
    """
    _checkpoints(df.sparkSession)
    ranged = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    ranged = ranged.withColumn("_range", F.shiftright("_id", BIT))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))  # a row for each range
    return ranged.join(F.broadcast(sizes), "_range").withColumn(place, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << BIT) - 1)) + 1).drop("_range", "_id", "_before")
