"""Queries on who stands behind a ticker, and what companies' reports cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import audits, issuers
from quillstone.plans.bindings import facts, sql
from quillstone.plans.registry import query


@query("resolved_issuers", sql(""", s AS (SELECT DISTINCT entity AS k FROM facts),
roster AS (SELECT k AS entity, CASE k % 4 WHEN 0 THEN 'S.' WHEN 1 THEN 'S-' ELSE 'S' END || k AS ticker FROM s WHERE k % 8 <> 3), asked AS (SELECT k, CASE k % 4 WHEN 0 THEN 'S-' WHEN 1 THEN 's.' ELSE 's' END || k AS asked FROM s),
tries AS (SELECT k, asked, unnest([upper(asked), translate(upper(asked), '.', '-'), translate(upper(asked), '-', '.')]) AS t, unnest([1, 2, 3]) AS p FROM asked),
hit AS (SELECT k, asked, r.entity, r.ticker, CASE WHEN r.ticker = upper(asked) THEN 'roster' ELSE 'spelling' END AS how FROM tries JOIN roster r ON r.ticker = t QUALIFY row_number() OVER (PARTITION BY k ORDER BY p) = 1),
base AS (SELECT a.k, a.asked, coalesce(h.entity, CASE WHEN a.k % 16 = 3 THEN a.k END) AS entity, coalesce(h.ticker, CASE WHEN a.k % 16 = 3 THEN upper(a.asked) END) AS ticker, coalesce(h.how, CASE WHEN a.k % 16 = 3 THEN 'feed' END) AS how FROM asked a LEFT JOIN hit h ON h.k = a.k),
sib AS (SELECT b.*, CASE WHEN b.entity % 5 = 0 AND b.entity % 10 = 0 AND n.k IS NOT NULL THEN b.entity + 1 END AS other FROM base b LEFT JOIN s n ON n.k = b.entity + 1),
one AS (SELECT asked, coalesce(other, entity) AS entity, ticker, how || CASE WHEN other IS NOT NULL THEN ' > sibling' ELSE '' END AS how FROM sib),
f AS (SELECT entity, CASE WHEN entity % 3 <> 0 AND tag = 'A' THEN '10-K' WHEN tag = 'R' THEN '8-K' ELSE '10-Q' END AS form, k1, min(filed) OVER (PARTITION BY k1) AS day, min(entity) OVER (PARTITION BY k1) AS agent FROM facts),
yearly AS (SELECT DISTINCT entity FROM f WHERE form = '10-K'),
tried AS (SELECT entity, agent, max((day, k1)) AS last FROM f WHERE form <> '8-K' AND agent <> entity AND entity NOT IN (SELECT entity FROM yearly) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY last[1] DESC, lpad(CAST(agent AS VARCHAR), 10, '0') || '-' || lpad(CAST(last[2] AS VARCHAR), 12, '0') DESC, agent) AS p FROM tried),
pred AS (SELECT entity, arg_min(agent, p) AS agent FROM ranked WHERE p <= 4 AND agent IN (SELECT entity FROM yearly) GROUP BY 1)
SELECT o.asked, coalesce(p.agent, o.entity) AS entity, o.ticker, o.how || CASE WHEN p.agent IS NOT NULL THEN ' > predecessor' ELSE '' END AS how, 'sic' || CAST(coalesce(p.agent, o.entity) % 6 AS VARCHAR) AS sic FROM one o LEFT JOIN pred p ON p.entity = o.entity"""))
def resolved_issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers behind tickers in several spellings; some list none, some have no annual reports; an order is an accession that all its suppliers list."""
    df = facts(spark, sf_dir)
    ids = df.select(F.col("entity").alias("k")).distinct()
    k = F.col("k")
    number = k.cast("string")
    asked = ids.select(F.concat(F.when(k % 4 == 0, "S-").when(k % 4 == 1, "s.").otherwise("s"), number).alias("asked"))
    ticker = F.concat(F.when(k % 4 == 0, "S.").when(k % 4 == 1, "S-").otherwise("S"), number)
    roster = ids.where("k % 8 <> 3").select(ticker.alias("ticker"), k.alias("entity"))
    feed = ids.where("k % 16 = 3").select(F.concat(F.lit("S"), number).alias("ticker"), k.alias("entity"))
    before = F.concat(F.when((k - 1) % 4 == 0, "S.").when((k - 1) % 4 == 1, "S-").otherwise("S"), (k - 1).cast("string"))
    tickers = F.when(k % 5 == 0, F.array().cast("array<string>")).when((k - 1) % 10 == 0, F.array(ticker, before)).otherwise(F.array(ticker))
    companies = ids.select(k.alias("entity"), tickers.alias("tickers"), F.concat(F.lit("sic"), (k % 6).cast("string")).alias("sic"))
    day = F.to_date(F.lit("2001-01-01"))
    registrants = ids.select(k.alias("entity"), F.lit("a").alias("accession"), day.alias("filing_date"), F.posexplode(F.array(k, k + 1)).alias("place", "other"))
    orders = df.groupBy("k1").agg(F.min("entity").alias("agent"), F.min("filed").alias("filing_date"))
    form = F.when((F.col("entity") % 3 != 0) & (F.col("tag") == "A"), "10-K").when(F.col("tag") == "R", "8-K").otherwise("10-Q")
    accession = F.concat(F.lpad(F.col("agent").cast("string"), 10, "0"), F.lit("-"), F.lpad(F.col("k1").cast("string"), 12, "0"))
    filings = df.join(orders, "k1").select("entity", form.alias("form"), accession.alias("accession"), "filing_date")
    return issuers.resolved(asked, roster, feed, companies, registrants, filings)


@query("coverage_sweep", sql(""", p AS (SELECT entity, 'C' || part % 12 || CASE WHEN line <= 2 THEN '' WHEN line <= 4 THEN 'Net' ELSE 'Gross' || line END AS tag, CASE WHEN status = 'F' THEN e - CAST(quantity * 9 AS INTEGER) END AS s, e, val FROM facts WHERE part % 30 < 3 + entity % 20),
t AS (SELECT 'c' || i AS concept, 'C' || i || 'Net' AS tag, 1 AS place FROM range(0, 12) r(i) UNION ALL SELECT 'c' || i, 'C' || i, 2 FROM range(0, 12) r(i)),
seen AS (SELECT entity, tag, max(e) AS latest, count(DISTINCT CASE WHEN s IS NULL OR e - s BETWEEN 340 AND 400 THEN year(e) END) AS years FROM p GROUP BY 1, 2),
hit AS (SELECT entity, concept, tag, latest, years FROM seen JOIN t USING (tag) QUALIFY row_number() OVER (PARTITION BY entity, concept ORDER BY place) = 1),
x AS (SELECT entity FROM hit WHERE concept IN ('c0', 'c1') GROUP BY 1 HAVING count(*) = 2), y AS (SELECT x.entity FROM x JOIN hit ON hit.entity = x.entity AND hit.concept = 'c2'),
cells AS (SELECT e.entity, c.concept FROM (SELECT DISTINCT entity FROM seen) e, (SELECT DISTINCT concept FROM t UNION SELECT 'x' UNION SELECT 'y' UNION SELECT 'z') c),
st AS (SELECT c.entity, c.concept, h.tag, h.latest, h.years, CASE WHEN h.tag IS NOT NULL THEN 'hit' WHEN c.concept = 'x' AND c.entity IN (SELECT entity FROM x) OR c.concept IN ('y', 'c11') AND c.entity IN (SELECT entity FROM y) THEN 'derived' WHEN c.concept = 'z' AND c.entity IN (SELECT entity FROM hit WHERE concept = 'c3') THEN 'zeroed' ELSE 'missing' END AS state FROM cells c LEFT JOIN hit h USING (entity, concept)),
kin AS (SELECT s.entity, t.concept, string_agg(DISTINCT s.tag, ' ' ORDER BY s.tag) AS kin FROM seen s JOIN t ON starts_with(s.tag, t.tag) AND s.tag <> t.tag WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.concept = t.concept AND o.tag = s.tag) GROUP BY 1, 2)
SELECT st.entity, st.concept, state, tag, latest, years, CASE WHEN state = 'missing' THEN coalesce(kin, '') ELSE '' END AS kin FROM st LEFT JOIN kin USING (entity, concept)"""))
def coverage_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppliers have of twelve concepts with two tags each, two derived ones, one that counts as nought; tags with other endings are kin."""
    df = facts(spark, sf_dir).where(F.col("part") % 30 < 3 + F.col("entity") % 20)
    tag = F.concat(F.lit("C"), (F.col("part") % 12).cast("string"), F.when(F.col("line") <= 2, "").when(F.col("line") <= 4, "Net").otherwise(F.concat(F.lit("Gross"), F.col("line").cast("string"))))
    points = df.select("entity", tag.alias("tag"), F.when(F.col("status") == "F", F.date_sub("end", (F.col("quantity") * 9).cast("int"))).alias("start"), "end", "val")
    tags = spark.createDataFrame([(f"c{i}", f"C{i}{ending}", place) for i in range(12) for place, ending in ((1, "Net"), (2, ""))], "concept string, tag string, place int")
    out = audits.coverage_sweep(points, tags, {"y": ["x", "c2"], "x": ["c0", "c1"], "c11": ["y"]}, {"z": "c3"})
    return out.withColumn("kin", F.array_join("kin", " "))
