"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fewer, remove, spread_join, written


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for the nodes that edges (a, b) name, but the roots themselves.

    Each step is a minimum by node, pre-aggregated, and a salted join, so the edges of a node that most others are linked
    to are spread over tasks; no node's neighbours are gathered.  The edges of a
    step are written to the shared folder.  The number of steps grows with the logarithm of the longest path.
    """
    now = written(fewer(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "edges")
    before = _sum(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = spread_join(both, least, F.col("a"), "n", F.col("b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        down = spread_join(large, least, F.col("a"), "n", F.col("b"))
        small = down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        step = written(fewer(small, before[0]), "edges")  # no step adds edges
        after = _sum(step)
        remove(now)
        now = step
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
