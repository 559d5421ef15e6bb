"""Queries on fiscal periods, restatements, tags and quarters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import calendar, scalars
from quillstone.operators import facts as op
from quillstone.operators import series
from quillstone.plans.bindings import facts, grid, keyed_facts, newest, sql, table
from quillstone.plans.registry import query

KEY = ["entity", "tag"]


@query(
    "latest_restated_ttm",
    sql("""SELECT entity, tag, period, CAST(idx AS BIGINT) AS idx, CAST(val AS DOUBLE) AS val, orig_filed,
  CAST(CASE WHEN count(val) OVER w = 4 THEN sum(val) OVER w END AS DOUBLE) AS ttm
FROM grid WINDOW w AS (PARTITION BY entity, tag ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""),
)
def latest_restated_ttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest restated value of each quarter, when it was first filed, and the trailing sum of four quarters."""
    df = grid(spark, sf_dir)
    return df.select(*KEY, F.col("period").cast("long"), F.col("idx").cast("long"), F.col("val").cast("double").alias("val"), "orig_filed", series.trailing(KEY, "val").cast("double").alias("ttm"))


@query(
    "fiscal_period_assignment",
    """
WITH f AS (
  SELECT l_orderkey AS k1, l_linenumber AS line, l_suppkey AS entity, CAST(l_shipdate AS DATE) AS e, CAST(s_nationkey % 12 + 1 AS INTEGER) AS m
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), y AS (
  SELECT *, CASE WHEN last_day(make_date(year(e) - 1, m, 1)) >= e - 20 THEN last_day(make_date(year(e) - 1, m, 1)) WHEN last_day(make_date(year(e), m, 1)) >= e - 20 THEN last_day(make_date(year(e), m, 1)) ELSE last_day(make_date(year(e) + 1, m, 1)) END AS ye FROM f
), z AS (SELECT *, CAST(4 - ((CAST(floor((ye - e) / 91.31 + 0.5) AS INTEGER) % 4) + 4) % 4 AS BIGINT) AS q FROM y)
SELECT k1, line, entity, e AS "end", year(ye) AS fy, q, 'FY' || CAST(year(ye) AS VARCHAR) || ' Q' || CAST(q AS VARCHAR) AS period, year(ye) * 4 + q AS idx FROM z
""",
)
def fiscal_period_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal year and quarter of every line item, each supplier having a fiscal year of its own."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), (F.pmod("s_nationkey", F.lit(12)) + 1).cast("int").alias("m"))
    df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("end")).join(suppliers, "entity")
    fy, q = calendar.fiscal_period(F.col("end"), F.col("m"))
    key = calendar.period_key(fy, q)
    return df.select("k1", "line", "entity", "end", fy.cast("long").alias("fy"), q.cast("long").alias("q"), key.alias("period"), calendar.period_index(key).cast("long").alias("idx"))


@query(
    "latest_restatement",
    sql("""SELECT entity, tag, CAST(fy AS BIGINT) AS fy, CAST(q AS BIGINT) AS q, CAST(val AS DOUBLE) AS val, filed, orig_filed, form FROM latest"""),
)
def latest_restatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op.latest_restated(keyed_facts(spark, sf_dir), ["entity", "tag", "fy", "q"], newest())
    return df.select(*KEY, F.col("fy").cast("long"), F.col("q").cast("long"), F.col("val").cast("double"), "filed", "orig_filed", "form")


@query(
    "tag_priority_fallback",
    sql(""", tags AS (SELECT * FROM (VALUES ('flow', 'A', 0, false), ('flow', 'R', 1, true), ('rest', 'N', 0, false), ('rest', 'R', 1, false)) t(concept, tag, prio, negate)),
joined AS (SELECT t.concept, k.*, t.prio, CASE WHEN negate THEN -val ELSE val END AS v FROM keyed k JOIN tags t ON k.tag = t.tag),
ranked AS (SELECT *, min(filed) OVER (PARTITION BY concept, entity, fy, q, tag) AS orig_filed,
  row_number() OVER (PARTITION BY concept, entity, fy, q ORDER BY prio, filed DESC, k1 DESC, line DESC, e DESC, v DESC) AS r FROM joined)
SELECT concept, entity, CAST(fy AS BIGINT) AS fy, CAST(q AS BIGINT) AS q, tag AS source_tag, CAST(v AS DOUBLE) AS val, filed, orig_filed FROM ranked WHERE r = 1"""),
)
def tag_priority_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the tags of a concept the first that has a value in a quarter, some of them counting negatively."""
    tags = spark.createDataFrame([("flow", "A", 0, False), ("flow", "R", 1, True), ("rest", "N", 0, False), ("rest", "R", 1, False)], "concept string, tag string, priority int, negate boolean")
    df = op.by_tag_priority(keyed_facts(spark, sf_dir), F.broadcast(tags), ["entity", "fy", "q"], newest())
    return df.select("concept", "entity", F.col("fy").cast("long"), F.col("q").cast("long"), F.col("tag").alias("source_tag"), F.col("val").cast("double"), "filed", "orig_filed")


#: Durations: from the order's date to the ship date, moved so that some are quarters and some are years.
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.when(F.col("line") <= 2, 364).when(F.col("line") <= 5, 90).otherwise(180)
    return facts(spark, sf_dir).withColumn("start", F.date_sub("end", days)).withColumn("unit", F.when(F.col("tag") == "A", "USD").when(F.col("tag") == "N", "EUR").otherwise("shares"))


_DURATIONS = """, d AS (SELECT *, CASE WHEN line <= 2 THEN 364 WHEN line <= 5 THEN 90 ELSE 180 END AS days, CASE WHEN tag = 'A' THEN 'USD' WHEN tag = 'N' THEN 'EUR' ELSE 'shares' END AS unit FROM facts)"""


@query(
    "fye_month_vote",
    sql(_DURATIONS + """, per_end AS (SELECT entity, e, count(*) AS n FROM d WHERE days > 300 AND days < 400 GROUP BY 1, 2),
recent AS (SELECT * FROM (SELECT *, max(e) OVER (PARTITION BY entity) AS latest FROM per_end) WHERE e >= latest - 2190),
votes AS (SELECT entity, month(e - 5) AS m, sum(n) AS n, max(e) AS last FROM recent GROUP BY 1, 2)
SELECT entity, CAST(m AS BIGINT) AS fye_month FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, last DESC) AS r FROM votes) WHERE r = 1"""),
)
def fye_month_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.year_end_month(durations(spark, sf_dir)).select("entity", F.col("fye_month").cast("long"))


@query(
    "fiscal_year_ends",
    sql(_DURATIONS + """, y AS (SELECT d.entity, k.fy, d.e FROM d JOIN (SELECT DISTINCT e, fy, q FROM keyed) k ON d.e = k.e WHERE d.days > 300 AND d.days < 400 AND k.q = 4),
v AS (SELECT entity, fy, e, count(*) AS n FROM y GROUP BY 1, 2, 3)
SELECT entity, CAST(fy AS BIGINT) AS fy, e AS fy_end FROM (SELECT *, row_number() OVER (PARTITION BY entity, fy ORDER BY n DESC, e DESC) AS r FROM v) WHERE r = 1"""),
)
def fiscal_year_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = durations(spark, sf_dir)
    months = df.select("entity").distinct().withColumn("fye_month", F.lit(12))
    return op.year_ends(df, months).select("entity", F.col("fy").cast("long"), "fy_end")


@query(
    "currency_vote",
    sql(_DURATIONS + """, v AS (SELECT entity, unit, count(*) AS n FROM d WHERE regexp_matches(unit, '^[A-Z]{3}$') GROUP BY 1, 2)
SELECT entity, unit AS currency FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, unit) AS r FROM v) WHERE r = 1"""),
)
def currency_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.reporting_currency(durations(spark, sf_dir))


@query(
    "annual_mode",
    sql(_DURATIONS + """ SELECT entity, avg(CASE WHEN days BETWEEN 45 AND 130 THEN 1.0 ELSE 0.0 END) < 0.05 AS annual FROM d GROUP BY 1"""),
)
def annual_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.reports_by_year(durations(spark, sf_dir))


@query(
    "fact_classes",
    sql(_DURATIONS + """, k AS (SELECT d.*, z.fy, z.q, make_date(z.fy - 1, 12, 31) + 1 AS fy_start FROM d JOIN (SELECT DISTINCT e, fy, q FROM keyed) z ON d.e = z.e),
b AS (SELECT *, abs((e - days) - fy_start) <= 15 AS begins FROM k WHERE days BETWEEN 45 AND 400),
c AS (SELECT entity, fy, q, unnest(list_filter([CASE WHEN begins AND (days > 300 OR q = 4) THEN 'A' END, CASE WHEN days <= 300 AND begins THEN 'C' END, CASE WHEN days <= 300 AND ((begins AND q = 1) OR (NOT begins AND days <= 130)) THEN 'Q' END], lambda x: x IS NOT NULL)) AS kind, val FROM b)
SELECT entity, CAST(fy AS BIGINT) AS fy, CAST(q AS BIGINT) AS q, kind, count(*) AS n, CAST(sum(val) AS DOUBLE) AS total FROM c GROUP BY 1, 2, 3, 4"""),
)
def fact_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts play which part: single quarters, cumulative values, whole years."""
    df = durations(spark, sf_dir)
    months = df.select("entity").distinct().withColumn("fye_month", F.lit(12))
    return op.keyed(df, months).groupBy("entity", F.col("fy").cast("long").alias("fy"), F.col("q").cast("long").alias("q"), "kind").agg(F.count("*").alias("n"), F.sum("val").cast("double").alias("total"))


@query(
    "quarter_from_ytd",
    sql(""", sums AS (SELECT entity, tag, fy, q, sum(val) AS v, max(form) AS form FROM keyed GROUP BY 1, 2, 3, 4),
ytd AS (SELECT *, sum(v) OVER (PARTITION BY entity, tag, fy ORDER BY q) AS c FROM sums),
wide AS (SELECT entity, tag, fy, max(CASE WHEN q = 1 THEN c END) AS k1, max(CASE WHEN q = 2 THEN c END) AS k2, max(CASE WHEN q = 3 THEN c END) AS k3, max(CASE WHEN q = 4 THEN c END) AS a FROM ytd GROUP BY 1, 2, 3),
f AS (SELECT *, coalesce(k1, 0) AS f1, coalesce(k2, k1, 0) AS f2, coalesce(k3, k2, k1, 0) AS f3, CASE WHEN a IS NOT NULL THEN 4 WHEN k3 IS NOT NULL THEN 3 WHEN k2 IS NOT NULL THEN 2 WHEN k1 IS NOT NULL THEN 1 END AS last FROM wide)
SELECT entity, tag, CAST(fy AS BIGINT) AS fy, q, CAST(v AS DOUBLE) AS val, est AS is_estimated FROM (
  SELECT entity, tag, fy, 1 AS q, k1 AS v, k1 IS NULL AS est, last FROM f WHERE k1 IS NOT NULL
  UNION ALL SELECT entity, tag, fy, 2, k2 - k1, false, last FROM f WHERE k1 IS NOT NULL AND k2 IS NOT NULL
  UNION ALL SELECT entity, tag, fy, 3, k3 - k2, false, last FROM f WHERE k2 IS NOT NULL AND k3 IS NOT NULL
  UNION ALL SELECT entity, tag, fy, 4, a - k3, true, last FROM f WHERE k3 IS NOT NULL AND a IS NOT NULL)"""),
)
def quarter_from_ytd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters recovered from year-to-date values, the fourth from the year."""
    sums = keyed_facts(spark, sf_dir).groupBy("entity", F.col("tag").alias("concept"), "fy", "q").agg(F.sum("val").alias("v"))
    from pyspark.sql import Window

    ytd = sums.withColumn("val", F.sum("v").over(Window.partitionBy("entity", "concept", "fy").orderBy("q")))
    cells = ytd.select("entity", "concept", "fy", "q", F.when(F.col("q") == 4, "A").otherwise("C").alias("kind"), "val", F.lit("10-Q").alias("form"))
    return op.quarters(cells).select("entity", F.col("concept").alias("tag"), F.col("fy").cast("long"), "q", F.col("val").cast("double"), "is_estimated")


@query(
    "row_source_tag",
    sql(""", v AS (SELECT entity, status AS concept, form AS source_tag, count(*) AS n FROM facts GROUP BY 1, 2, 3)
SELECT entity, concept, source_tag FROM (SELECT *, row_number() OVER (PARTITION BY entity, concept ORDER BY n DESC, source_tag) AS r FROM v) WHERE r = 1"""),
)
def row_source_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.row_source(facts(spark, sf_dir).select("entity", F.col("status").alias("concept"), F.col("form").alias("source_tag")))


@query(
    "split_ratio_snap",
    sql(""", r AS (SELECT entity, k1, line, CAST(val AS DOUBLE) / CAST(quantity AS DOUBLE) / 1000 AS ratio FROM facts),
s AS (SELECT *, CASE WHEN ratio >= 1.5 THEN list_filter([2.0,3,4,5,6,7,8,10,12,15,20,25,30,50], lambda x: abs(ratio - x) / x < 0.08)[1] WHEN ratio > 0 AND ratio <= 0.67 THEN 1.0 / list_filter([2.0,3,4,5,6,7,8,10,12,15,20,25,30,50], lambda x: abs(1 / ratio - x) / x < 0.08)[1] END AS factor FROM r)
SELECT entity, round(CAST(factor AS DOUBLE), 6) AS factor, count(*) AS n FROM s GROUP BY 1, 2"""),
)
def split_ratio_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often unit prices, in thousands, are near a clean split."""
    ratio = F.col("val").cast("double") / F.col("quantity").cast("double") / 1000
    return facts(spark, sf_dir).groupBy("entity", F.round(scalars.split_factor(ratio), 6).alias("factor")).agg(F.count("*").alias("n"))


@query(
    "filing_periods",
    """
WITH f AS (SELECT o_orderkey AS k1, CAST(o_orderdate AS DATE) AS d, CAST(c_nationkey % 12 + 1 AS INTEGER) AS m, CASE WHEN o_orderpriority LIKE '1%' THEN '10-K' ELSE '10-Q' END AS form FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT *, (m - month(d) + 12) % 12 AS gap FROM f)
SELECT k1, CASE WHEN form = '10-K' OR gap = 0 THEN 'FY' || CAST(year(d + to_months(CAST(gap AS INTEGER))) AS VARCHAR) ELSE 'FY' || CAST(year(d + to_months(CAST(gap AS INTEGER))) AS VARCHAR) || ' Q' || CAST(CAST(4 - floor(gap / 3 + 0.5) AS INTEGER) AS VARCHAR) END AS filing_period,
  'FY' || CAST(year(d) + CASE WHEN month(d) > m THEN 1 ELSE 0 END AS VARCHAR) || ' Q' || CAST(((month(d) - m + 11) % 12) // 3 + 1 AS VARCHAR) AS segment_period FROM g
""",
)
def filing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two other rules for a period: that of a filing by its months, and that of segment columns."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.pmod("c_nationkey", F.lit(12)) + 1).cast("int").alias("m"))
    df = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).withColumn("d", F.to_date("o_orderdate"))
    form = F.when(F.col("o_orderpriority").startswith("1"), "10-K").otherwise("10-Q")
    return df.select(F.col("o_orderkey").alias("k1"), calendar.filing_period(F.col("d"), F.concat(F.lpad(F.col("m").cast("string"), 2, "0"), F.lit("28")), form).alias("filing_period"), calendar.segment_period(F.col("d"), F.col("m")).alias("segment_period"))


@query(
    "power_of_thousand",
    sql(""", r AS (SELECT entity, k1, line, CAST(val AS DOUBLE) * pow(10, (line % 4) * 3) AS v, CAST(val AS DOUBLE) * (1 + line / 50.0) AS anchor FROM facts),
e AS (SELECT *, v / anchor AS ratio, CAST(floor(log10(v / anchor) / 3 + 0.5) * 3 AS INTEGER) AS p FROM r)
SELECT entity, CAST(sum(CASE WHEN ratio BETWEEN 0.1 AND 10 THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT ratio BETWEEN 0.1 AND 10 AND p <> 0 AND abs(ratio / pow(10, p) - 1) <= 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS rescaled, count(*) AS n FROM e GROUP BY 1"""),
)
def power_of_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values filed on another scale than their anchor: kept, or brought back by a power of 1000."""
    df = facts(spark, sf_dir).withColumn("v", F.col("val").cast("double") * F.pow(F.lit(10.0), (F.col("line") % 4) * 3)).withColumn("anchor", F.col("val").cast("double") * (1 + F.col("line") / 50.0))
    new = series.rescaled(F.col("v"), F.col("anchor"), F.lit(False))
    return df.withColumn("new", new).groupBy("entity").agg(F.count_if(F.col("new") == F.col("v")).alias("kept"), F.count_if(F.col("new") != F.col("v")).alias("rescaled"), F.count("*").alias("n"))




@query("provenance_cells", sql(""" SELECT entity, tag, period, CAST(val AS DOUBLE) AS value, fy % 2 = 0 AND q = 4 AS is_estimated, tag AS source_tag, form, filed, orig_filed, e AS "end" FROM latest"""))
def provenance_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the latest value of each quarter comes from: tag, form, the day filed and first filed; some fourth quarters count as estimates."""
    latest = op.latest_restated(keyed_facts(spark, sf_dir), ["entity", "tag", "fy", "q"], newest()).withColumn("period", F.col("fy") * 4 + F.col("q")).withColumn("val", F.col("val").cast("double"))
    return op.provenance(latest, ["entity", "tag", "period"], (F.col("fy") % 2 == 0) & (F.col("q") == 4)).select("entity", "tag", F.col("period").cast("long").alias("period"), "cell.*")
