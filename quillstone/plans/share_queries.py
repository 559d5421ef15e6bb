"""Queries on share counts and on what cells lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import audits, shares
from quillstone.plans.bindings import facts, sql
from quillstone.plans.registry import query


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("entity", "tag", F.last_day("end").alias("end"), "filed", F.col("val").cast("double").alias("val"), F.lit(None).cast("date").alias("start"))


_INSTANTS = """, i AS (SELECT entity, tag, CAST(last_day(e) AS DATE) AS d, filed, CAST(val AS DOUBLE) AS val FROM facts)"""


@query("issued_less_treasury", sql(_INSTANTS + """, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, d ORDER BY filed DESC, val DESC) AS r FROM i WHERE tag = 'N') WHERE r = 1), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, d ORDER BY filed DESC, val DESC) AS r FROM i WHERE tag = 'R') WHERE r = 1)
SELECT a.entity, a.d AS "end", round(a.val - t.val, 4) AS val FROM a JOIN t ON a.entity = t.entity AND a.d = t.d WHERE a.val - t.val > 0"""))
def issued_less_treasury(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _instants(spark, sf_dir)
    return shares.issued_less_treasury(df.where("tag = 'N'"), df.where("tag = 'R'")).withColumn("val", F.round("val", 4))


@query("first_fact_at", sql(_INSTANTS + """ SELECT entity, d AS "end", tag, val FROM (SELECT *, row_number() OVER (PARTITION BY entity, d ORDER BY CASE tag WHEN 'R' THEN 0 ELSE 1 END, filed DESC, val DESC) AS r FROM i WHERE tag IN ('R', 'A')) WHERE r = 1"""))
def first_fact_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.first_fact_at(_instants(spark, sf_dir), ["R", "A"], ["entity", "end"])


@query("cover_counts", sql(""", c AS (SELECT entity, year(e) AS fy, CASE WHEN line = 7 THEN 'FY' WHEN line <= 4 THEN 'Q' || CAST(line AS VARCHAR) ELSE 'H1' END AS fp, filed, CAST(val AS DOUBLE) AS val FROM facts),
p AS (SELECT entity, 'FY' || CAST(fy AS VARCHAR) || ' Q' || CASE WHEN fp = 'FY' THEN '4' ELSE substr(fp, 2, 1) END AS period, filed, val FROM c WHERE fp <> 'H1')
SELECT entity, period, val FROM (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY filed DESC, val DESC) AS r FROM p) WHERE r = 1"""))
def cover_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = F.when(F.col("line") == 7, "FY").when(F.col("line") <= 4, F.concat(F.lit("Q"), F.col("line").cast("string"))).otherwise("H1")
    return shares.cover_counts(facts(spark, sf_dir).select("entity", F.year("end").alias("fy"), fp.alias("fp"), "filed", F.col("val").cast("double").alias("val")))


@query("class_totals", sql(""", c AS (SELECT entity, year(e) AS y, tag, CAST(sum(val) AS DOUBLE) AS n FROM facts GROUP BY 1, 2, 3), s AS (SELECT entity, y, count(*) AS k, min(n) AS lo, max(n) AS hi, sum(n) AS a, sum(CASE WHEN tag <> 'R' THEN n END) AS earning, sum(CASE WHEN tag <> 'R' THEN 1 ELSE 0 END) AS ke, y % 2 = 0 AS near FROM c GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN k > 1 AND lo = hi THEN 'one total for every class' WHEN ke > 0 AND ke < k AND near THEN 'earning classes' WHEN k = 1 THEN 'one class' ELSE 'all classes' END AS basis FROM s)
SELECT entity, y AS "end", round(CASE basis WHEN 'one total for every class' THEN lo WHEN 'earning classes' THEN earning ELSE a END, 2) AS total, basis FROM b"""))
def class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly totals over return flags as share classes, of which R earns nothing; implied counts speak for the others in even years."""
    df = facts(spark, sf_dir).groupBy("entity", F.year("end").cast("long").alias("end"), F.col("tag").alias("class")).agg(F.sum("val").cast("double").alias("n")).withColumn("earns", F.col("class") != "R")
    implied = df.groupBy("entity", "end").agg(F.when(F.col("end") % 2 == 0, F.sum(F.when(F.col("earns"), F.col("n")))).otherwise(F.sum("n")).alias("implied"))
    return shares.class_totals(df, implied).withColumn("total", F.round("total", 2))


_CLASS_SERIES = """, c0 AS (SELECT part AS entity, CAST(year(e) AS INTEGER) AS y, CAST(line AS VARCHAR) AS class, floor(CAST(sum(quantity) AS DOUBLE) / 5) * 5 AS n, line <> 7 AS earns FROM facts GROUP BY part, year(e), line),
c1 AS (SELECT * FROM c0 WHERE n <> 0 QUALIFY row_number() OVER (PARTITION BY entity, y, n ORDER BY class) = 1),
c2 AS (SELECT *, count(*) OVER d AS k, coalesce(abs(n / nullif(sum(n) OVER d - n, 0) - 1) < 0.005, false) AS sub FROM c1 WINDOW d AS (PARTITION BY entity, y)),
c3 AS (SELECT entity, y, class, n, earns FROM (SELECT *, count(*) FILTER (sub) OVER (PARTITION BY entity, y ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c2) WHERE NOT sub OR k - before <= 2),
c4 AS (SELECT *, n / sum(n) OVER d AS share, count(*) OVER d AS k, max(y) OVER (PARTITION BY entity) AS newest FROM c3 WINDOW d AS (PARTITION BY entity, y)),
need AS (SELECT entity, count(*) AS need FROM c4 WHERE y = newest AND share >= 0.05 GROUP BY 1),
c5 AS (SELECT c4.* FROM c4 JOIN need USING (entity) WHERE k >= need),
imp AS (SELECT part AS entity, CAST(sum(quantity) FILTER (line > 1) AS DOUBLE) AS implied FROM facts JOIN (SELECT part, max(year(e)) AS y FROM facts GROUP BY 1) m USING (part) WHERE year(e) = m.y AND part % 3 <> 0 GROUP BY 1),
u AS (SELECT entity, class, n, implied, sum(n) OVER w AS total, count(*) OVER w AS k, bool_or(entity % 4 = 0 AND class = '2') OVER w AS conv FROM c5 JOIN imp USING (entity) WHERE y = newest AND implied > 0 WINDOW w AS (PARTITION BY entity)),
up AS (SELECT entity, class FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(total - n - implied) / implied, class) AS r FROM u WHERE k > 1 AND NOT conv AND abs(total - implied) / implied > 0.25) WHERE r = 1 AND abs(total - n - implied) / implied < 0.1),
c6 AS (SELECT c5.* FROM c5 ANTI JOIN up USING (entity, class)),
s AS (SELECT entity, y, count(*) AS k, sum(n) AS a, sum(n) FILTER (earns) AS earning, count(*) FILTER (earns) AS ke, sum(n) FILTER (entity % 4 = 0 AND class = '2') AS target, max(implied) AS implied FROM c6 LEFT JOIN imp USING (entity) GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN ke > 0 AND ke < k AND abs(earning - implied) < abs(a - implied) THEN 'earning classes' WHEN k = 1 THEN 'one class' WHEN target IS NOT NULL AND k = 2 THEN 'converted' WHEN target IS NOT NULL THEN 'open' ELSE 'all classes' END AS basis FROM s),
t AS (SELECT entity, y, basis, CASE basis WHEN 'earning classes' THEN earning WHEN 'converted' THEN (a - target) * 3 + target ELSE a END AS total FROM b WHERE basis <> 'open'),
band AS (SELECT * FROM (SELECT *, arg_max(total, y) OVER (PARTITION BY entity) AS newest FROM t) WHERE total / newest BETWEEN 0.5 AND 2),
near AS (SELECT *, lag(total) OVER w AS p, lead(total) OVER w AS q, count(*) OVER (PARTITION BY entity) AS m FROM band WINDOW w AS (PARTITION BY entity ORDER BY y)),
smooth AS (SELECT * FROM near WHERE NOT (m >= 3 AND CASE WHEN p IS NULL OR q IS NULL THEN greatest(total / coalesce(p, q), coalesce(p, q) / total) >= 2.5 ELSE greatest(total / p, p / total) >= 1.6 AND greatest(total / q, q / total) >= 1.6 AND greatest(p / q, q / p) < 1.25 END)),
steps AS (SELECT *, lag(total) OVER (PARTITION BY entity ORDER BY y) AS before FROM smooth),
kept AS (SELECT *, bool_and(before IS NULL OR greatest(total / before, before / total) < 4) OVER (PARTITION BY entity) AS steady FROM steps)
SELECT entity, make_date(y, 12, 31) AS "end", total, basis FROM kept WHERE steady"""


@query("class_series", sql(_CLASS_SERIES))
def class_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of yearly totals of each part, its line numbers being classes, of which 7 earns nothing and 2 converts for some parts."""
    df = facts(spark, sf_dir).withColumn("end", F.make_date(F.year("end"), F.lit(12), F.lit(31))).drop("entity").withColumnRenamed("part", "entity")
    n = F.floor(F.sum("quantity").cast("double") / 5) * 5.0
    classes = df.groupBy("entity", "end", F.col("line").cast("string").alias("class")).agg(n.alias("n"), (F.first("line") != 7).alias("earns"))
    newest = df.groupBy("entity", "end").agg(F.sum(F.when(F.col("line") > 1, F.col("quantity"))).cast("double").alias("implied")).where("entity % 3 <> 0")
    implied = newest.groupBy("entity").agg(F.max_by("implied", "end").alias("implied"))
    ratios = df.where("entity % 4 = 0").select("entity", F.lit("2").alias("class"), F.lit(3.0).alias("ratio")).distinct()
    return shares.class_series(classes, implied, ratios)


@query("gap_census", sql(""", g AS (SELECT e.entity, c.concept FROM (SELECT DISTINCT entity FROM facts) e CROSS JOIN (SELECT DISTINCT part % 40 AS concept FROM facts) c),
f AS (SELECT entity, part % 40 AS concept, max(CASE WHEN line = 1 THEN 1 END) AS a, max(CASE WHEN line = 2 THEN 1 END) AS b, max(CASE WHEN line = 3 THEN 1 END) AS c, max(CASE WHEN line = 4 THEN 1 END) AS d, max(CASE WHEN line = 5 THEN 1 END) AS e FROM facts GROUP BY 1, 2)
SELECT g.entity, g.concept, CASE WHEN a = 1 THEN 'filled' WHEN b = 1 THEN 'dash' WHEN c = 1 THEN 'dim_only' WHEN d = 1 THEN 'fixable' WHEN e = 1 THEN 'custom' ELSE 'over_broad' END AS state FROM g LEFT JOIN f ON g.entity = f.entity AND g.concept = f.concept"""))
def gap_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cell of suppliers by part groups lacks, by the lines that have it."""
    df = facts(spark, sf_dir).select("entity", (F.col("part") % 40).alias("concept"), "line")
    grid = df.select("entity").distinct().crossJoin(F.broadcast(df.select("concept").distinct()))
    return audits.gap_census(grid, *(df.where(F.col("line") == k) for k in (1, 2, 3, 4, 5)))


@query("derivable_closure", sql(""", p AS (SELECT DISTINCT entity, CAST(part % 300 AS VARCHAR) AS concept FROM facts), x AS (SELECT entity FROM p WHERE concept IN ('1', '2', '3') GROUP BY 1 HAVING count(DISTINCT concept) = 3), y AS (SELECT x.entity FROM x JOIN p ON x.entity = p.entity AND p.concept = '4')
SELECT entity, concept FROM p UNION SELECT entity, 'x' FROM x UNION SELECT entity, 'y' FROM y"""))
def derivable_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = facts(spark, sf_dir).select("entity", (F.col("part") % 300).cast("string").alias("concept"))
    return audits.derivable(df, {"y": ["x", "4"], "x": ["1", "2", "3"]}, 2)


@query("split_basis", sql(""", base AS (SELECT part, year(e) AS y, CAST(sum(quantity) AS DOUBLE) AS n FROM facts GROUP BY 1, 2),
c AS (SELECT DISTINCT f.part AS entity, year(f.e) AS y, year(f.filed) AS filed, n * CASE WHEN year(f.filed) >= 1996 + f.part % 7 AND f.part % 11 <> 0 OR f.part % 13 = 0 AND year(f.filed) = 1999 THEN 10 ELSE 1 END * CASE WHEN f.part % 17 = 0 THEN 1 + (year(f.filed) - 1995) * 0.01 ELSE 1 END AS val FROM facts f JOIN base b ON b.part = f.part AND b.y = year(f.e)),
d AS (SELECT DISTINCT part AS entity, 10.0 AS ratio FROM facts WHERE part % 5 <> 0 UNION SELECT DISTINCT part, 5.0 FROM facts WHERE part % 3 = 0),
pairs AS (SELECT a.entity, a.filed AS old, b.filed AS new, d.ratio FROM c a JOIN c b ON a.entity = b.entity AND a.y = b.y AND a.filed < b.filed JOIN d ON d.entity = a.entity WHERE abs(b.val / (a.val * d.ratio) - 1) < 0.03),
one AS (SELECT entity, CAST(min(ratio) AS DOUBLE) AS ratio, CAST(max(old) AS BIGINT) AS before, CAST(min(new) AS BIGINT) AS since FROM pairs p GROUP BY 1 HAVING min(ratio) = max(ratio) AND NOT bool_or(EXISTS (SELECT 1 FROM pairs x WHERE x.entity = p.entity AND x.new = p.old)))
SELECT c.entity, CAST(c.filed AS BIGINT) AS filed, coalesce(o.ratio, 1.0) AS ratio, CAST(CASE WHEN o.ratio IS NULL THEN 1 WHEN c.filed <= o.before THEN o.ratio WHEN c.filed >= o.since THEN 1 END AS DOUBLE) AS factor, count(*) AS days FROM c LEFT JOIN one o ON o.entity = c.entity GROUP BY ALL"""))
def split_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side of a split the years are on in which parts' quantities were filed: later years state ten times as much, from a year that differs by part."""
    df = facts(spark, sf_dir).select(F.col("part").alias("entity"), F.year("end").alias("end"), F.year("filed").cast("long").alias("filed"), "quantity")
    base = df.groupBy("entity", "end").agg(F.sum("quantity").cast("double").alias("n"))
    moved = ((F.col("filed") >= 1996 + F.col("entity") % 7) & (F.col("entity") % 11 != 0)) | ((F.col("entity") % 13 == 0) & (F.col("filed") == 1999))
    drift = F.when(F.col("entity") % 17 == 0, 1 + (F.col("filed") - 1995) * 0.01).otherwise(1.0)
    counts = df.select("entity", "end", "filed").distinct().join(base, ["entity", "end"]).withColumn("val", F.col("n") * F.when(moved, 10).otherwise(1) * drift)
    ids = df.select("entity").distinct()
    declared = ids.where("entity % 5 <> 0").withColumn("ratio", F.lit(10.0)).unionByName(ids.where("entity % 3 = 0").withColumn("ratio", F.lit(5.0)))
    found = shares.with_factor(counts.select("entity", "filed"), shares.split_basis(counts, declared))
    return found.groupBy("entity", "filed", "ratio", "factor").agg(F.count("*").alias("days"))
