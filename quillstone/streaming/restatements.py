"""Streams, an extension beyond batch work: restatements as they arrive, and counts by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_restatements(facts: DataFrame, keys: list[str], state_path: str, checkpoint: str):  # noqa: ANN201
    """Keep the latest filed row of each key in a folder of Parquet versions, batch by batch.

    A batch is reduced to one row for each key before it meets the rows kept so far; the newest version is the result.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        new = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("filed", *columns)).alias("_row")).select("_row.*")
        if number:
            old = spark.read.schema(batch.schema).parquet(f"{state_path}/v={number - 1}")
            new = new.unionByName(old).groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("filed", *columns)).alias("_row")).select("_row.*")
        new.write.mode("overwrite").parquet(f"{state_path}/v={number}")

    return facts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, total of events (ts, event_type, value); events later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
