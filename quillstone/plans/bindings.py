"""The engine's roles on the test tables, in DataFrames and in SQL.

A fact is a line item: entity l_suppkey, tag l_returnflag, end l_shipdate, filed o_orderdate, form o_orderpriority,
value l_extendedprice.  (l_orderkey, l_linenumber) isn't unique, so ties are settled by all of them and the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.calendar import fiscal_period
from quillstone.operators.facts import latest_restated
from quillstone.operators.series import dense_grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column | str) -> Column:
    return F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("tag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), F.to_date("l_shipdate").alias("end"),
        F.to_date("o_orderdate").alias("filed"), money("l_extendedprice").alias("val"), money("l_quantity").alias("quantity"), F.col("o_orderpriority").alias("form"), F.col("l_orderkey").alias("k1"), F.col("l_partkey").alias("part"), F.col("o_custkey").alias("customer"),
    )


#: Latest filed first, ties settled.
NEWEST = ("filed", "k1", "line", "end", "val")


def newest() -> list[Column]:
    return [F.desc(c) for c in NEWEST]


def keyed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fy, q = fiscal_period(F.col("end"), F.lit(12))
    return facts(spark, sf_dir).withColumn("fy", fy).withColumn("q", q)


def cells(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """entity, tag, period, val, filed, orig_filed, end: the latest restated value of each quarter; fine: tags by status and line too."""
    df = keyed_facts(spark, sf_dir)
    if fine:
        df = df.withColumn("tag", F.concat("tag", "status", F.col("line").cast("string")))
    latest = latest_restated(df, ["entity", "tag", "fy", "q"], newest())
    return latest.withColumn("period", F.col("fy") * 4 + F.col("q")).select("entity", "tag", "period", "fy", "q", "val", "filed", "orig_filed", "end")


def grid(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """cells on the calendar of all quarters, idx counting from 1."""
    known = cells(spark, sf_dir, fine)
    # every line item has an order, so the calendar comes from the ship dates alone
    fy, q = fiscal_period(F.to_date("l_shipdate"), F.lit(12))
    bounds = table(spark, sf_dir, "lineitem").select(fy.alias("fy"), q.alias("q")).agg(F.min(F.col("fy") * 4 + F.col("q")).alias("lo"), F.max(F.col("fy") * 4 + F.col("q")).alias("hi"))
    periods = bounds.select("lo", F.explode(F.sequence("lo", "hi")).alias("period")).select("period", (F.col("period") - F.col("lo") + 1).alias("idx"))
    return dense_grid(known.drop("fy", "q"), ["entity", "tag"], periods)


def sql(body: str, *, fine: bool = False) -> str:
    """SQL that may use facts, keyed, latest, periods and grid before its own text."""
    tag = "l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR)" if fine else "l_returnflag"
    return f"""
WITH facts AS (
  SELECT l_suppkey AS entity, {tag} AS tag, l_linestatus AS status, l_linenumber AS line, CAST(l_shipdate AS DATE) AS e, CAST(o_orderdate AS DATE) AS filed,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS val, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, o_orderpriority AS form, l_orderkey AS k1, l_partkey AS part, o_custkey AS customer
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), years AS (
  SELECT *, CASE WHEN make_date(year(e) - 1, 12, 31) >= e - 20 THEN year(e) - 1 WHEN make_date(year(e), 12, 31) >= e - 20 THEN year(e) ELSE year(e) + 1 END AS fy FROM facts
), keyed AS (
  SELECT *, CAST(4 - ((CAST(floor((make_date(fy, 12, 31) - e) / 91.31 + 0.5) AS INTEGER) % 4) + 4) % 4 AS INTEGER) AS q FROM years
), latest AS (
  SELECT *, fy * 4 + q AS period FROM (SELECT *, min(filed) OVER (PARTITION BY entity, tag, fy, q) AS orig_filed,
    row_number() OVER (PARTITION BY entity, tag, fy, q ORDER BY filed DESC, k1 DESC, line DESC, e DESC, val DESC) AS r FROM keyed) WHERE r = 1
), periods AS (
  SELECT lo + i AS period, i + 1 AS idx FROM (SELECT lo, unnest(range(0, hi - lo + 1)) AS i FROM (SELECT min(fy * 4 + q) AS lo, max(fy * 4 + q) AS hi FROM keyed))
), grid AS (
  SELECT n.entity, n.tag, p.period, p.idx, l.val, l.filed, l.orig_filed, l.e
  FROM (SELECT DISTINCT entity, tag FROM keyed) n CROSS JOIN periods p LEFT JOIN latest l ON l.entity = n.entity AND l.tag = n.tag AND l.period = p.period
)
{body}
"""
