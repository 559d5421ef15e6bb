"""Queries on what a market's grids reach and lack, and on share counts from all places that state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.calendar import period_key
from quillstone.operators import grid_audit as audit
from quillstone.operators import market_coverage as market
from quillstone.operators import repairs, share_sources, shares
from quillstone.plans.bindings import facts, grid, keyed_facts, sql
from quillstone.plans.registry import query
from quillstone.plans.series_queries import KEY

_DOUBLE = "CAST(val AS DOUBLE)"


@query("aligned_shares", sql(f""", p AS (SELECT entity, fy, q, CAST(last_day(max(e)) AS DATE) AS d FROM keyed GROUP BY ALL),
s AS (SELECT entity, tag, line, fy, q, {_DOUBLE} AS v, row_number() OVER (PARTITION BY entity, tag, line, fy, q ORDER BY filed DESC, val DESC) AS r FROM keyed),
ug AS (SELECT * FROM s WHERE r = 1 AND tag = 'A' AND line = 6), ba AS (SELECT * FROM s WHERE r = 1 AND tag = 'R' AND line = 4), di AS (SELECT * FROM s WHERE r = 1 AND tag = 'R' AND line = 3),
co AS (SELECT entity, fy, q, {_DOUBLE} AS v, row_number() OVER (PARTITION BY entity, fy, q ORDER BY filed DESC, val DESC) AS r FROM keyed WHERE line = 7 AND tag <> 'N'),
i AS (SELECT entity, tag, last_day(e) AS d, {_DOUBLE} AS v, row_number() OVER (PARTITION BY entity, tag, last_day(e) ORDER BY filed DESC, val DESC) AS r FROM facts WHERE line = 1),
net AS (SELECT a.entity, a.d, a.v - b.v AS v FROM i a JOIN i b ON a.entity = b.entity AND a.d = b.d WHERE a.r = 1 AND b.r = 1 AND a.tag = 'N' AND b.tag = 'R' AND a.v > b.v),
cl AS (SELECT p.entity, p.fy, p.q, {_DOUBLE} AS v, row_number() OVER (PARTITION BY p.entity, p.fy, p.q ORDER BY e, val) AS r FROM p JOIN facts f ON f.entity = p.entity AND f.e BETWEEN p.d AND p.d + 75 WHERE line = 5 AND tag = 'N'),
ca AS (SELECT p.entity, p.fy, p.q, tag, {_DOUBLE} AS v, row_number() OVER (PARTITION BY p.entity, p.fy, p.q, tag ORDER BY e, val) AS r FROM p JOIN facts f ON f.entity = p.entity AND f.e BETWEEN p.d - 5 AND p.d + 5 WHERE line = 2 AND tag <> 'R'),
j AS (SELECT p.*, ug.v AS us_gaap, net.v AS issued_treasury, co.v AS cover, cl.v AS classes, coalesce(cb.v, ba.v) AS basic, coalesce(cd.v, di.v) AS diluted FROM p
  LEFT JOIN ug ON ug.entity = p.entity AND ug.fy = p.fy AND ug.q = p.q LEFT JOIN ba ON ba.entity = p.entity AND ba.fy = p.fy AND ba.q = p.q LEFT JOIN di ON di.entity = p.entity AND di.fy = p.fy AND di.q = p.q
  LEFT JOIN co ON co.r = 1 AND co.entity = p.entity AND co.fy = p.fy AND co.q = p.q LEFT JOIN net ON net.entity = p.entity AND net.d = p.d LEFT JOIN cl ON cl.r = 1 AND cl.entity = p.entity AND cl.fy = p.fy AND cl.q = p.q
  LEFT JOIN ca cb ON cb.r = 1 AND cb.tag = 'A' AND cb.entity = p.entity AND cb.fy = p.fy AND cb.q = p.q LEFT JOIN ca cd ON cd.r = 1 AND cd.tag = 'N' AND cd.entity = p.entity AND cd.fy = p.fy AND cd.q = p.q),
k AS (SELECT *, CASE WHEN us_gaap IS NOT NULL THEN 'us-gaap' WHEN cover IS NOT NULL THEN 'cover' WHEN classes IS NOT NULL THEN 'classes' WHEN coalesce(basic, diluted) IS NOT NULL THEN 'average' END AS shares_source FROM j)
SELECT entity, 'FY' || fy || ' Q' || q AS period, d AS "end", us_gaap, round(issued_treasury, 2) AS issued_treasury, cover, classes, basic, diluted, coalesce(us_gaap, cover, classes, basic, diluted) AS shares, shares_source, shares_source IN ('classes', 'average') AS shares_estimated FROM k"""))
def aligned_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share counts of each supplier and quarter from six places: kinds of line items stand for the places."""
    df = keyed_facts(spark, sf_dir).withColumn("period", period_key(F.col("fy"), F.col("q"))).withColumn("val", F.col("val").cast("double"))
    line, tag = F.col("line"), F.col("tag")
    latest = lambda rows, name: rows.groupBy("entity", "period").agg(F.max_by("val", F.struct("filed", "val")).alias(name))
    periods = df.groupBy("entity", "period").agg(F.last_day(F.max("end")).alias("end"))
    cover = shares.cover_counts(df.where((line == 7) & (tag != "N")).withColumn("fp", F.when(F.col("q") == 4, "FY").otherwise(F.concat(F.lit("Q"), F.col("q").cast("string")))))
    averages = latest(df.where((tag == "R") & (line == 4)), "basic").join(latest(df.where((tag == "R") & (line == 3)), "diluted"), ["entity", "period"], "full_outer")
    days = df.where(line == 1).withColumn("end", F.last_day("end"))
    net = shares.issued_less_treasury(days.where("tag = 'N'"), days.where("tag = 'R'"))
    wide = df.where((line == 2) & (tag != "R")).select("entity", "end", F.when(tag == "A", F.col("val")).alias("basic"), F.when(tag == "N", F.col("val")).alias("diluted"))
    out = share_sources.aligned(periods, latest(df.where((tag == "A") & (line == 6)), "val"), cover, averages, df.where((line == 5) & (tag == "N")), net, wide)
    return out.withColumn("issued_treasury", F.round("issued_treasury", 2))


_CONCEPTS = [(f"{t}{k}", t) for t in "ANR" for k in range(1, 8)]


@query("market_coverage", sql(""", f AS (SELECT part AS entity, tag || CAST(line AS VARCHAR) AS concept, tag AS stmt, quantity > 20 AS dim FROM facts), direct AS (SELECT DISTINCT entity, concept, stmt FROM f WHERE NOT dim), dims AS (SELECT DISTINCT entity, concept FROM f WHERE dim),
r1 AS (SELECT entity, concept FROM direct UNION SELECT entity, 'A1' FROM direct WHERE concept IN ('A2', 'A3') GROUP BY 1 HAVING count(*) = 2), r2 AS (SELECT entity, concept FROM r1 UNION SELECT entity, 'R7' FROM r1 WHERE concept IN ('A1', 'R2') GROUP BY 1 HAVING count(*) = 2),
c AS (SELECT t.t AS stmt, t.t || CAST(k.k AS VARCHAR) AS concept FROM (VALUES ('A'), ('N'), ('R')) t(t), (SELECT unnest(range(1, 8)) AS k) k), filed AS (SELECT DISTINCT entity, stmt FROM direct),
m AS (SELECT filed.entity % 3 AS grp, c.concept, c.stmt, CASE WHEN d.entity IS NOT NULL THEN 0 WHEN r2.entity IS NOT NULL THEN 1 WHEN dims.entity IS NOT NULL THEN 2 END AS way FROM filed JOIN c ON c.stmt = filed.stmt LEFT JOIN direct d ON d.entity = filed.entity AND d.concept = c.concept LEFT JOIN r2 ON r2.entity = filed.entity AND r2.concept = c.concept LEFT JOIN dims ON dims.entity = filed.entity AND dims.concept = c.concept)
SELECT CAST(grp AS BIGINT) AS grp, concept, stmt, count(*) AS n_all, count(*) FILTER (way = 0) AS n_direct, count(*) FILTER (way = 1) AS n_derived, count(*) FILTER (way = 2) AS n_dim_only, round(count(*) FILTER (way < 2) / count(*), 6) AS rate FROM m GROUP BY 1, 2, 3"""))
def market_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What parts have of the 21 kinds of line items, large quantities standing for facts with dimensions."""
    df = facts(spark, sf_dir).select(F.col("part").alias("entity"), F.concat("tag", F.col("line").cast("string")).alias("concept"), (F.col("quantity") > 20).alias("dimensioned"))
    groups = df.select("entity", (F.col("entity") % 3).cast("long").alias("grp")).distinct()
    out = market.market_coverage(df, spark.createDataFrame(_CONCEPTS, "concept string, stmt string"), {"R7": ["A1", "R2"], "A1": ["A2", "A3"]}, groups, 2)
    return out.withColumn("rate", F.round("rate", 6))


@query("tag_agreement", sql(""", x AS (SELECT entity, tag || CAST(line AS VARCHAR) AS tag, CASE WHEN line % 2 = 0 THEN date_trunc('month', e)::DATE END AS s, last_day(e) AS d, CASE WHEN quantity > 45 THEN 0.0 ELSE CAST(ceil(quantity / 6) AS DOUBLE) END AS v, filed FROM facts),
l AS (SELECT entity, tag, s, d, arg_max(v, (filed, v)) AS v FROM x GROUP BY ALL), pr AS (SELECT * FROM (VALUES ('even', 'A2', 1), ('even', 'A4', 2), ('odd', 'A1', 1), ('odd', 'R3', 2)) t(concept, tag, place)), cn AS (SELECT * FROM (VALUES ('even', 'N2'), ('even', 'R4'), ('odd', 'N1'), ('odd', 'A1'), ('odd', 'N4')) t(concept, tag)),
own AS (SELECT concept, entity, s, d, arg_min(v, place) AS a FROM l JOIN pr ON l.tag = pr.tag GROUP BY ALL),
m AS (SELECT o.concept, cn.tag, l.entity, a, v AS b, CASE WHEN v <> 0 THEN a / v END AS r FROM l JOIN cn ON l.tag = cn.tag JOIN own o ON o.concept = cn.concept AND o.entity = l.entity AND o.d = l.d AND o.s IS NOT DISTINCT FROM l.s),
g AS (SELECT concept, tag, count(*) AS n_overlap, count(DISTINCT entity) AS n_entities, avg(CASE WHEN coalesce(abs(r - 1) < 0.01, a = 0) THEN 1 ELSE 0 END) AS agreement, median(r) AS med FROM m GROUP BY 1, 2)
SELECT concept, tag, n_overlap, n_entities, round(agreement, 6) AS agreement, round(med, 6) AS median_ratio, n_overlap >= 30 AND n_entities >= 3 AND agreement >= 0.9 AS accepted, CASE WHEN n_overlap < 30 OR n_entities < 3 THEN 'few' WHEN agreement >= 0.9 THEN NULL WHEN abs(med - 1) > 0.05 THEN 'biased' ELSE 'differs' END AS reason FROM g"""))
def tag_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether kinds of line items state the same as others of the month: spans for even lines, instants for odd ones."""
    v = F.when(F.col("quantity") > 45, 0.0).otherwise(F.ceil(F.col("quantity") / 6).cast("double"))
    start = F.when(F.col("line") % 2 == 0, F.trunc("end", "month"))
    points = facts(spark, sf_dir).select("entity", F.concat("tag", F.col("line").cast("string")).alias("tag"), F.lit("USD").alias("unit"), start.alias("start"), F.last_day("end").alias("end"), v.alias("val"), "filed")
    own = spark.createDataFrame([("even", "A2", 1), ("even", "A4", 2), ("odd", "A1", 1), ("odd", "R3", 2)], "concept string, tag string, place int")
    other = spark.createDataFrame([("even", "N2"), ("even", "R4"), ("odd", "N1"), ("odd", "A1"), ("odd", "N4")], "concept string, tag string")
    return market.tag_agreement(points, own, other).withColumns({c: F.round(c, 6) for c in ("agreement", "median_ratio")})


def _kind(carried: Column) -> Column:
    return F.when(carried, "carry").when(F.col("idx") % 4 == 0, "q4").when(F.col("idx") % 7 == 1, "derive")


def _cells(spark: SparkSession, sf_dir: str, fine: bool) -> DataFrame:
    df = repairs.carry_forward(grid(spark, sf_dir, fine), KEY, ["val"])
    return df.select("entity", F.col("tag").alias("concept"), "idx", F.col("val").cast("double").alias("value"), _kind(F.col("val_carried")).alias("kind"))


_CELLS = """, v AS (SELECT entity, tag, idx, val, CASE WHEN count(val) OVER (PARTITION BY entity, tag) >= 2 THEN last_value(val IGNORE NULLS) OVER (PARTITION BY entity, tag ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) ELSE val END AS v FROM grid),
k AS (SELECT entity, tag, idx, v, CASE WHEN val IS NULL AND v IS NOT NULL THEN 'carry' WHEN idx % 4 = 0 THEN 'q4' WHEN idx % 7 = 1 THEN 'derive' END AS kind FROM v),
w AS (SELECT *, idx - max(CASE WHEN v IS NOT NULL AND kind IS DISTINCT FROM 'carry' THEN idx END) OVER (PARTITION BY entity, tag ORDER BY idx) AS behind, min(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY entity, tag) AS lo, max(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY entity, tag) AS hi FROM k),
a AS (SELECT entity, tag, count(*) AS n, count(*) FILTER (v IS NULL) AS m, list(idx ORDER BY idx) FILTER (v IS NULL AND idx BETWEEN lo AND hi) AS gaps, count(*) FILTER (v IS NOT NULL AND kind = 'q4') AS q4, count(*) FILTER (v IS NOT NULL AND kind = 'derive') AS derive, count(*) FILTER (v IS NOT NULL AND kind = 'carry') AS carry, CAST(coalesce(max(CASE WHEN v IS NOT NULL AND kind = 'carry' THEN behind END), 0) AS BIGINT) AS longest, min(lo) AS lo, max(hi) AS hi, min(idx) AS first, max(idx) AS last FROM w GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN lo IS NULL THEN 'none' WHEN len(gaps) > 0 THEN 'interior' WHEN lo > first AND hi < last THEN 'both ends' WHEN lo > first THEN 'oldest only' WHEN hi < last THEN 'newest only' ELSE 'complete' END AS shape FROM a)
"""


@query("grid_audit", sql(_CELLS + """SELECT entity, tag AS concept, n AS n_periods, m AS n_missing, coalesce(array_to_string(gaps, ','), '') AS gaps, q4 AS n_q4, derive AS n_derive, 0::BIGINT AS n_zero, carry AS n_carry, 0::BIGINT AS n_approx, longest AS longest_carry, shape FROM b""", fine=True))
def grid_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rows of all grids lack, and what of them is estimated, after balances have been carried on."""
    out = audit.concept_audit(_cells(spark, sf_dir, True))
    return out.withColumn("gaps", F.array_join(F.col("gaps").cast("array<string>"), ",")).withColumn("longest_carry", F.col("longest_carry").cast("long"))


_FINE = [f"{t}{s}{k}" for t, s in (("A", "F"), ("N", "O"), ("R", "F")) for k in (1, 2, 7)]
_METRICS = {"margin": "(AF1 - RF1) / AF1", "growth": "AF2 / AF2[t-4] - 1", "turn": "NO1 / avg(RF2)", "both": "margin + growth"}


@query("company_audit", sql(_CELLS + f""", c AS (SELECT * FROM b WHERE tag IN ({", ".join(f"'{c}'" for c in _FINE)})), f AS (SELECT entity, max(n) AS n_periods, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (m = n), '') AS full_miss, coalesce(string_agg(tag || ':' || m || ':' || shape, ',' ORDER BY tag) FILTER (m > 0 AND m < n), '') AS holes,
  coalesce(string_agg(tag || ':' || concat_ws('/', CASE WHEN carry > 0 THEN 'carry=' || carry END, CASE WHEN derive > 0 THEN 'derive=' || derive END, CASE WHEN q4 > 0 THEN 'q4=' || q4 END), ',' ORDER BY tag) FILTER (carry + derive + q4 > 0), '') AS estimated, coalesce(string_agg(tag || ':' || longest, ',' ORDER BY tag) FILTER (longest > 0), '') AS stale FROM c GROUP BY 1),
h AS (SELECT entity, idx, {", ".join(f"count(v) FILTER (tag = '{c}') > 0 AS h{c}" for c in ("AF1", "AF2", "NO1", "RF1", "RF2"))} FROM k GROUP BY 1, 2), i AS (SELECT *, lag(hAF2, 4) OVER o AS before, lag(hRF2) OVER o AS last FROM h WINDOW o AS (PARTITION BY entity ORDER BY idx)),
n AS (SELECT entity, count(*) FILTER (NOT (hAF1 AND hRF1)) AS margin, count(*) FILTER (NOT (hAF2 AND coalesce(before, false))) AS growth, count(*) FILTER (NOT (hNO1 AND hRF2 AND coalesce(last, false))) AS turn, count(*) FILTER (NOT (hAF1 AND hRF1 AND hAF2 AND coalesce(before, false))) AS both_ FROM i GROUP BY 1)
SELECT f.entity, n_periods, full_miss, holes, concat_ws(',', CASE WHEN both_ > 0 THEN 'both:' || both_ END, CASE WHEN growth > 0 THEN 'growth:' || growth END, CASE WHEN margin > 0 THEN 'margin:' || margin END, CASE WHEN turn > 0 THEN 'turn:' || turn END) AS metric_na, estimated, stale FROM f JOIN n ON n.entity = f.entity""", fine=True))
def company_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each supplier: the kinds of items it lacks, its metrics and its estimates, maps written as text."""

    def text(column: str, value: Column) -> Column:
        entries = F.array_sort(F.map_entries(column))
        return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), value(e["value"]))), ",").alias(column)

    whole = lambda v: v.cast("string")
    kinds = lambda v: F.array_join(F.transform(F.array_sort(F.map_entries(v)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "/")
    out = audit.company_audit(_cells(spark, sf_dir, True), _FINE, _METRICS)
    estimated = F.array_join(F.transform(F.array_sort(F.map_keys("estimated")), lambda c: F.concat(c, F.lit(":"), kinds(F.try_element_at("estimated", c)))), ",").alias("estimated")
    return out.select("entity", "n_periods", F.array_join("full_miss", ",").alias("full_miss"), text("holes", lambda v: F.concat(v["missing"].cast("string"), F.lit(":"), v["shape"])), text("metric_na", whole), estimated, text("stale", whole))
