"""Queries on whole statements: repairs in their order, share counts, splits, valuation at market prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import formulas
from quillstone.functions.scalars import binary_round
from quillstone.operators import facts as op
from quillstone.operators import repairs, shares, splits, statements, valuation
from quillstone.plans.bindings import facts, grid, keyed_facts, sql, table
from quillstone.plans.registry import query
from quillstone.plans.series_queries import _WIDE, _wide


def _long() -> Column:
    return F.col("idx").cast("long").alias("idx")


@query("repaired_statement", sql(_WIDE + """, s0 AS (SELECT entity, idx, CASE WHEN idx % 2 = 0 AND revenue IS NOT NULL AND cogs IS NOT NULL AND cogs <> 0 AND abs(revenue / cogs - 1) <= 0.2 THEN 0.0 ELSE revenue END AS revenue, cogs, equity, coalesce(CASE WHEN idx % 3 > 0 THEN cogs END, CASE WHEN equity IS NOT NULL THEN 0.0 END) AS debt, CASE WHEN idx % 4 = 1 AND entity % 5 > 0 THEN equity END AS c0 FROM w),
s1 AS (SELECT *, CASE WHEN count(c0) OVER (PARTITION BY entity) >= 2 THEN last_value(c0 IGNORE NULLS) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) ELSE c0 END AS cash FROM s0), s2 AS (SELECT *, revenue - coalesce(cogs, 0) AS gross FROM s1),
s3 AS (SELECT *, count(equity) OVER o AS n, last_value(equity IGNORE NULLS) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, last_value(equity IGNORE NULLS) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM s2 WINDOW o AS (PARTITION BY entity ORDER BY idx)),
s4 AS (SELECT *, min(CASE WHEN n <= 9 AND equity >= 2.5 * p AND p < 0.4 * latest THEN idx END) OVER (PARTITION BY entity) AS cut FROM s3)
SELECT entity, CAST(idx AS BIGINT) AS idx, round(revenue, 4) AS revenue, round(debt, 4) AS debt, round(cash, 4) AS cash, c0 IS NULL AND cash IS NOT NULL AS cash_carried, round(gross, 4) AS gross, gross IS NOT NULL AS gross_derived, count(cash) OVER (PARTITION BY entity) > 0 OR entity % 2 = 1 AS cash_applicable FROM s4 WHERE cut IS NULL OR idx >= cut"""))
def repaired_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repairs of a statement in their order: totals, zeros, carried balances, derived items, listing, applicability, internal items."""
    idx = F.col("idx")
    df = _wide(spark, sf_dir).withColumn("revenue_tag", F.when(idx % 2 == 0, "Total").otherwise("Own")).withColumn("debt", F.when(idx % 3 > 0, F.col("cogs")))
    df = df.withColumn("cash", F.when((idx % 4 == 1) & (F.col("entity") % 5 > 0), F.col("equity"))).withColumn("gross", F.lit(None).cast("double")).withColumn("group", (F.col("entity") % 2).cast("string"))
    rules = statements.Rules(["entity"], totals=[("revenue", "cogs", ["Total"], None, 0.2)], zeros=["debt"], anchor="equity", carried=["cash"], derive=[("gross", "revenue - cogs?")], listing="equity", group="group", barred={"cash": ("0",)}, internal=["equity", "cogs"])
    out = statements.statement(df, rules)
    return out.select("entity", _long(), *(F.round(c, 4).alias(c) for c in ("revenue", "debt", "cash")), "cash_carried", F.round("gross", 4).alias("gross"), "gross_derived", "cash_applicable")


@query("share_arbitration", sql(_WIDE + """, a AS (SELECT entity, idx, CASE WHEN idx % 11 = 3 THEN NULL ELSE cogs * (0.6 + 0.1 * (idx % 8)) END AS s, CASE WHEN idx % 3 = 0 THEN 'cover' WHEN idx % 3 = 1 THEN 'us-gaap' ELSE 'classes' END AS src, CASE WHEN idx % 9 = 4 THEN NULL ELSE cogs END AS w, cogs * 1.045 AS c1, cogs * (0.93 + 0.01 * (idx % 4)) AS c2 FROM w WHERE cogs IS NOT NULL),
b AS (SELECT *, lead(w) OVER (PARTITION BY entity ORDER BY idx) AS nw, CASE WHEN abs(c1 / w - 1) < 0.1 AND NOT coalesce(abs(c2 / w - 1) < abs(c1 / w - 1), false) THEN c1 WHEN abs(c2 / w - 1) < 0.1 THEN c2 END AS v, CASE WHEN abs(c1 / w - 1) < 0.1 AND NOT coalesce(abs(c2 / w - 1) < abs(c1 / w - 1), false) THEN 'one' WHEN abs(c2 / w - 1) < 0.1 THEN 'two' END AS vs FROM a),
c AS (SELECT *, coalesce(abs(s / nw - 1) <= 0.15 AND CASE WHEN s > w THEN nw >= w * 1.1 ELSE nw <= w * 0.9 END, false) AS catches FROM b), d AS (SELECT *, coalesce(abs(s / w - 1) > 0.2 AND NOT catches AND v <> s, false) AS wrong FROM c),
e AS (SELECT *, list(src) FILTER (wrong) OVER (PARTITION BY entity) AS guilty FROM d), f AS (SELECT *, coalesce(list_contains(guilty, src), false) AND NOT wrong AND s IS NOT NULL AS again, coalesce(abs(s / w - 1) > 0.1, false) AS far FROM e)
SELECT entity, CAST(idx AS BIGINT) AS idx, round(CASE WHEN wrong OR again AND far AND v IS NOT NULL THEN v WHEN again AND (w IS NULL OR far AND v IS NULL AND NOT catches) THEN NULL ELSE s END / 7.31, 2) AS shares, CASE WHEN wrong OR again AND far AND v IS NOT NULL THEN vs ELSE src END AS source FROM f"""))
def share_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share counts against weighted averages and two other sources, catch-ups and convicted sources included.

    Factors are quotients of whole numbers, as its SQL takes them for decimal numbers: 0.6 + 0.1 * 6 of doubles is more than 1.2.
    """
    idx, cogs = F.col("idx"), F.col("cogs")
    df = _wide(spark, sf_dir).where("cogs is not null").withColumn("s", F.when(idx % 11 != 3, cogs * ((6 + idx % 8) / 10))).withColumn("src", F.when(idx % 3 == 0, "cover").when(idx % 3 == 1, "us-gaap").otherwise("classes"))
    df = df.withColumn("w", F.when(idx % 9 != 4, cogs)).withColumn("c1", cogs * 1.045).withColumn("c2", cogs * ((93 + idx % 4) / 100))
    out = repairs.arbitrate_shares(df, ["entity"], "s", "src", "w", {"one": "c1", "two": "c2"})
    return out.select("entity", _long(), binary_round(F.col("s") / 7.31, 2).alias("shares"), F.col("src").alias("source"))


@query("filled_shares", sql(_WIDE + " SELECT entity, CAST(idx AS BIGINT) AS idx, coalesce(CASE WHEN idx % 3 = 0 THEN revenue END, CASE WHEN idx % 3 = 1 THEN cogs END, equity) AS shares, CASE WHEN idx % 3 = 0 AND revenue IS NOT NULL THEN 'us-gaap' WHEN idx % 3 = 1 AND cogs IS NOT NULL THEN 'cover' WHEN equity IS NOT NULL THEN 'weighted' END AS shares_source FROM w"))
def filled_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _wide(spark, sf_dir).withColumn("a", F.when(F.col("idx") % 3 == 0, F.col("revenue"))).withColumn("b", F.when(F.col("idx") % 3 == 1, F.col("cogs")))
    return shares.filled(df, {"us-gaap": "a", "cover": "b", "weighted": "equity"}).select("entity", _long(), "shares", "shares_source")


@query("eps_repair", sql(_WIDE + """, s AS (SELECT entity, idx, revenue / cogs * CASE WHEN idx % 4 = 0 THEN 1000 WHEN idx % 4 = 1 THEN 40 ELSE 1 END AS v, abs(revenue / nullif(cogs, 0)) AS anchor FROM w), r AS (SELECT *, abs(v) / anchor AS ratio, CAST(floor(log10(abs(v) / anchor) / 3 + 0.5) * 3 AS INTEGER) AS x FROM s)
SELECT entity, CAST(idx AS BIGINT) AS idx, round(CASE WHEN v IS NULL OR ratio BETWEEN 0.1 AND 10 THEN v WHEN x <> 0 AND abs(ratio / pow(10, x) - 1) <= 0.3 THEN v / pow(10, x) END, 6) AS eps FROM r"""))
def eps_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earnings per share on the wrong scale come back or go."""
    idx = F.col("idx")
    df = _wide(spark, sf_dir).withColumn("eps", F.col("revenue") / F.col("cogs") * F.when(idx % 4 == 0, 1000).when(idx % 4 == 1, 40).otherwise(1))
    return repairs.repair_eps(df, "eps", "revenue", "cogs").select("entity", _long(), F.round("eps", 6).alias("eps"))


@query("applicable_cells", """WITH c AS (SELECT l_suppkey AS entity, l_returnflag AS concept, CAST(l_suppkey % 3 AS VARCHAR) AS grp, max(CASE WHEN l_linenumber > 5 AND l_suppkey % 4 > 0 THEN l_quantity END) AS v FROM lineitem GROUP BY 1, 2, 3), g AS (SELECT * FROM (VALUES ('0', 'A', true), ('0', 'N', false), ('1', 'R', false)) t(grp, concept, structural)), o AS (SELECT entity, concept FROM c WHERE entity % 8 = 4 AND concept = 'R'), j AS (SELECT DISTINCT entity FROM o)
SELECT c.entity, c.concept, v IS NOT NULL OR NOT CASE WHEN j.entity IS NOT NULL THEN o.entity IS NOT NULL OR coalesce(structural, false) ELSE structural IS NOT NULL END AS applicable FROM c LEFT JOIN g ON c.grp = g.grp AND c.concept = g.concept LEFT JOIN o ON c.entity = o.entity AND c.concept = o.concept LEFT JOIN j ON c.entity = j.entity""")
def applicable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a concept applies to a supplier: by its own list and the structural ones of its group, else by the group's."""
    value = F.max(F.when((F.col("l_linenumber") > 5) & (F.col("l_suppkey") % 4 > 0), F.col("l_quantity")))
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("concept"), (F.col("l_suppkey") % 3).cast("string").alias("group_name")).agg(value.alias("value"))
    groups = spark.createDataFrame([("0", "A", True), ("0", "N", False), ("1", "R", False)], "group_name string, concept string, structural boolean")
    own = cells.where("entity % 8 = 4 and concept = 'R'").select("entity", "concept")
    return repairs.applicability(cells, groups, own).select("entity", "concept", "applicable")


@query("per_share_quarters", sql(""", c AS (SELECT entity, CAST(fy AS BIGINT) AS fy, tag AS concept, CASE WHEN tag = 'A' THEN 'shares' ELSE 'USD/shares' END AS unit, CASE WHEN q = 4 AND status = 'O' THEN 'A' ELSE 'Q' END AS kind, CAST(q AS BIGINT) AS q, CAST(val AS DOUBLE) AS val FROM keyed WHERE NOT (q = 4 AND status = 'F' AND entity % 2 = 0)),
d AS (SELECT entity, concept, unit, fy, q, max(val) AS v FROM c WHERE kind = 'Q' GROUP BY 1, 2, 3, 4, 5), y AS (SELECT entity, concept, unit, fy, 4 AS q, max(val) AS v FROM c WHERE kind = 'A' AND unit = 'shares' GROUP BY 1, 2, 3, 4)
SELECT coalesce(d.entity, y.entity) AS entity, coalesce(d.concept, y.concept) AS concept, coalesce(d.fy, y.fy) AS fy, coalesce(d.q, y.q) AS q, coalesce(d.v, y.v) AS val FROM d FULL JOIN y ON d.entity = y.entity AND d.concept = y.concept AND d.fy = y.fy AND d.q = y.q"""))
def per_share_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of share counts and per-share values as reported; a missing fourth one of shares is the year's."""
    df = keyed_facts(spark, sf_dir).where("not (q = 4 and status = 'F' and entity % 2 = 0)")
    unit, kind = F.when(F.col("tag") == "A", "shares").otherwise("USD/shares"), F.when((F.col("q") == 4) & (F.col("status") == "O"), "A").otherwise("Q")
    cells = df.select("entity", F.col("tag").alias("concept"), unit.alias("unit"), F.col("fy").cast("long").alias("fy"), F.col("q").cast("long").alias("q"), kind.alias("kind"), F.col("val").cast("double").alias("val"))
    return op.per_share_quarters(cells)


@query("annual_fourth_quarters", sql(""", s AS (SELECT entity, tag, fy, q, CAST(max(val) AS DOUBLE) AS v FROM keyed GROUP BY 1, 2, 3, 4), w AS (SELECT entity, tag, fy, max(CASE WHEN q = 1 THEN v END) AS q1, max(CASE WHEN q = 2 AND entity % 3 > 0 THEN v END) AS q2, max(CASE WHEN q = 3 THEN v END) AS q3, max(CASE WHEN q = 4 THEN v END) * 3 AS q4 FROM s GROUP BY 1, 2, 3),
c AS (SELECT *, q1 AS c1, q1 + q2 AS c2, q1 + q2 + q3 AS c3, CASE WHEN q1 + q2 + q3 IS NOT NULL THEN CASE WHEN entity % 2 = 0 AND abs(q4) > abs(q1 + q2 + q3) THEN q4 ELSE q1 + q2 + q3 + q4 END END AS c4 FROM w),
f AS (SELECT *, CASE WHEN c4 IS NOT NULL THEN 4 WHEN c3 IS NOT NULL THEN 3 WHEN c2 IS NOT NULL THEN 2 WHEN c1 IS NOT NULL THEN 1 END AS l, coalesce(c1, 0) AS f1, coalesce(c2, c1, 0) AS f2, coalesce(c3, c2, c1, 0) AS f3, coalesce(c4, c3, c2, c1, 0) AS f4 FROM c)
SELECT entity, tag, CAST(fy AS BIGINT) AS fy, 1 AS q, round(f1, 2) AS val, c1 IS NULL AS is_estimated FROM f WHERE l >= 1 UNION ALL SELECT entity, tag, fy, 2, round(f2 - f1, 2), c2 IS NULL OR c1 IS NULL FROM f WHERE l >= 2 UNION ALL SELECT entity, tag, fy, 3, round(f3 - f2, 2), c3 IS NULL OR c2 IS NULL FROM f WHERE l >= 3 UNION ALL SELECT entity, tag, fy, 4, round(f4 - f3, 2), c4 IS NULL OR c3 IS NULL OR q4 IS NULL FROM f WHERE l >= 4"""))
def annual_fourth_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single quarters of a concept that is nought where absent; fourth ones of annual reports may be the year itself."""
    s = keyed_facts(spark, sf_dir).groupBy("entity", F.col("tag").alias("concept"), "fy", "q").agg(F.max("val").cast("double").alias("val")).where("q <> 2 or entity % 3 > 0")
    cells = s.withColumn("val", F.when(F.col("q") == 4, F.col("val") * 3).otherwise(F.col("val"))).withColumn("kind", F.lit("Q")).withColumn("form", F.when(F.col("entity") % 2 == 0, "10-K").otherwise("10-Q"))
    return op.quarters(cells, F.lit(True)).select("entity", F.col("concept").alias("tag"), F.col("fy").cast("long").alias("fy"), "q", F.round("val", 2).alias("val"), "is_estimated")


@query("annual_mode_ifrs", sql("""SELECT entity, entity % 3 = 0 OR avg(CASE WHEN line <= 3 AND entity % 2 = 0 THEN 1.0 ELSE 0.0 END) < 0.05 AS annual FROM facts GROUP BY 1"""))
def annual_mode_ifrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that report years only, those under IFRS among them."""
    days = F.when((F.col("line") <= 3) & (F.col("entity") % 2 == 0), 90).otherwise(364)
    return op.reports_by_year(facts(spark, sf_dir).withColumn("start", F.date_sub("end", days)), F.col("entity") % 3 == 0)


@query("market_valuation", sql(""", p AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS d, CAST(max(o_totalprice) AS DOUBLE) AS price FROM orders GROUP BY 1, 2), g AS (SELECT entity, tag, idx, CAST(val AS DOUBLE) AS v, e FROM grid), a AS (SELECT g.*, p.price AS p0 FROM g ASOF LEFT JOIN p ON g.entity = p.entity AND g.e >= p.d),
c AS (SELECT *, CASE WHEN entity % 5 > 0 THEN p0 END * v / 1000 AS cap, CASE WHEN count(v) OVER t = 4 THEN sum(v) OVER t END AS ttm FROM a WINDOW t AS (PARTITION BY entity, tag ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT entity, tag, CAST(idx AS BIGINT) AS idx, round(cap, 2) AS market_cap, round(CASE WHEN ttm > 0 THEN cap / ttm END, 6) AS pe, round(CASE WHEN v > 0 THEN cap / v END, 6) AS pb FROM c"""))
def market_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiples at the last price before each period's end; null where price and statement differ in currency."""
    df = grid(spark, sf_dir).withColumn("v", F.col("val").cast("double"))
    names = {c: F.col("v") for c in ("net_income", "revenue", "cfo", "capex", "operating_income", "dna", "equity", "total_liabilities", "cash", "short_term_investments", "short_term_debt", "long_term_debt")}
    df = df.withColumns(names | {"shares": F.col("v") / 1000, "currency": F.when(F.col("entity") % 5 > 0, "USD").otherwise("EUR")})
    prices = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("price")).withColumn("price_currency", F.lit("USD"))
    df = df.select("entity", "tag", "idx", "end", "currency", "shares", *names)
    return statements.valued(df, prices, ["entity", "tag"], "end", "currency", ["entity"]).select("entity", "tag", _long(), F.round("market_cap", 2).alias("market_cap"), F.round("pe", 6).alias("pe"), F.round("pb", 6).alias("pb"))


@query("price_targets", """SELECT p_partkey, CASE WHEN e > 0 THEN price / e END AS forward_pe, CASE WHEN g > 0 AND e > 0 THEN price / e / g END AS forward_peg, pe * e AS target_price, CASE WHEN price > 0 THEN pe * e / price END - 1 AS upside, e IS NULL OR g IS NULL AS input_required
FROM (SELECT p_partkey, p_retailprice AS price, CAST(p_size AS DOUBLE) AS pe, CASE WHEN p_size % 4 > 0 THEN CAST(p_size % 7 AS DOUBLE) END AS e, CASE WHEN p_size % 5 > 0 THEN CAST(p_size AS DOUBLE) END AS g FROM part)""")
def price_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward multiples and targets from forecasts, some of which are still awaited."""
    size = F.col("p_size")
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), size.cast("double").alias("pe"), F.when(size % 4 > 0, (size % 7).cast("double")).alias("e"), F.when(size % 5 > 0, size.cast("double")).alias("g"))
    return valuation.targets(df, F.col("e"), F.col("g"), "price", "pe").select("p_partkey", "forward_pe", "forward_peg", "target_price", "upside", "input_required")


@query("inapplicable_metrics", sql(_WIDE + " SELECT entity, CAST(idx AS BIGINT) AS idx, round(revenue / nullif(cogs, 0), 6) AS turnover, coalesce(idx % 4 <> 0, true) AS turnover_applicable, round(coalesce(revenue, 0) + coalesce(cogs, 0) - coalesce(equity, 0), 4) AS cycle FROM w"))
def inapplicable_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric that a reported nought makes inapplicable, and the cash cycle of what is there."""
    df = _wide(spark, sf_dir).withColumn("stock", (F.col("idx") % 4).cast("double"))
    out = formulas.with_metrics(df, {"turnover": "revenue / cogs"}, ["entity"], zero_means_inapplicable={"turnover": "stock"})
    return out.select("entity", _long(), F.round("turnover", 6).alias("turnover"), "turnover_applicable", F.round(formulas.cash_cycle("revenue", "cogs", "equity"), 4).alias("cycle"))


@query("split_decisions", """SELECT o_custkey AS entity, 'no exchange data' AS cell, count(*) AS n FROM orders WHERE o_custkey % 4 = 0 GROUP BY 1 UNION ALL
SELECT entity, CASE WHEN entity % 4 = 1 THEN 'not covered' WHEN confirmed AND dev < 0.001 AND dev_raw < 0.001 THEN 'exact' ELSE 'denied' END, count(*) FROM (SELECT o_custkey AS entity, o_orderkey % 3 > 0 AS confirmed, (o_orderkey % 5) * 0.0004 AS dev, (o_orderkey % 7) * 0.0003 AS dev_raw FROM orders WHERE o_custkey % 4 IN (1, 2)) GROUP BY 1, 2 UNION ALL
SELECT o_custkey, 'both', count(*) FROM orders WHERE o_custkey % 4 = 3 GROUP BY 1""")
def split_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the decision table: customers without exchange data, not covered, covered without splits, and with a split for each event."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    found = o.select(F.col("o_custkey").alias("entity"), F.date_add(F.to_date("o_orderdate"), 10).alias("threshold"), F.lit(2.0).alias("factor"), (k % 3 > 0).alias("confirmed"), ((k % 5) * 0.0004).alias("dev"), ((k % 7) * 0.0003).alias("dev_raw"))
    kind, none = F.col("o_custkey") % 4, F.lit(None).cast("date")
    start = F.when(kind == 2, F.lit("1990-01-01").cast("date")).when(kind == 1, F.lit("2010-01-01").cast("date")).otherwise(F.lit("1990-01-01").cast("date"))
    bare = o.where(kind.isin(1, 2)).select(F.col("o_custkey").alias("entity"), none.alias("ex_date"), F.lit(None).cast("double").alias("factor"), start.alias("cover_start"), none.alias("first_filed")).distinct()
    each = o.where(kind == 3).select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("ex_date"), F.lit(2.0).alias("factor"), start.alias("cover_start"), F.date_add(F.to_date("o_orderdate"), 10).alias("first_filed"))
    return splits.decided(found, bare.unionByName(each)).groupBy("entity", "cell").agg(F.count("*").alias("n"))


@query("split_census", """WITH c AS (SELECT o_custkey AS entity, o_orderkey % 3 > 0 AS confirmed, (o_orderkey % 5) * 0.0004 AS dev, (o_orderkey % 7) * 0.0003 AS dev_raw FROM orders)
SELECT confirmed, CASE WHEN confirmed AND dev < 0.001 AND dev_raw < 0.001 THEN 'exact' ELSE 'denied' END AS cell, count(*) AS n_events, count(DISTINCT entity) AS n_entities, round(avg(dev), 9) AS mean_dev FROM c GROUP BY 1, 2""")
def split_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and companies by cell, where the exchange covers all and knows no split."""
    o, k, none = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.lit(None).cast("date")
    found = o.select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("threshold"), F.lit(2.0).alias("factor"), (k % 3 > 0).alias("confirmed"), ((k % 5) * 0.0004).alias("dev"), ((k % 7) * 0.0003).alias("dev_raw"))
    covered = o.select(F.col("o_custkey").alias("entity"), none.alias("ex_date"), F.lit(None).cast("double").alias("factor"), F.lit("1990-01-01").cast("date").alias("cover_start"), none.alias("first_filed")).distinct()
    return splits.census(splits.decided(found, covered)).withColumn("mean_dev", F.round("mean_dev", 9))


@query("split_report", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 8 AS kind, o_orderkey % 3 > 0 AS sure, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 977) * 8e-5 END AS dev, (o_orderkey % 7) * 3e-4 AS raw FROM orders),
c AS (SELECT k, dev, CASE WHEN kind = 0 THEN CASE WHEN sure THEN 'A4' ELSE 'B4' END WHEN kind = 1 THEN CASE WHEN sure THEN 'A3' ELSE 'B3' END WHEN kind IN (3, 4) THEN CASE WHEN sure THEN 'A1' ELSE 'B1' END
 WHEN NOT sure THEN 'B2' WHEN dev < 0.001 AND raw < 0.001 THEN 'A2a' ELSE 'A2b' END AS code FROM o WHERE kind <> 6 UNION ALL SELECT k, dev, CASE WHEN sure THEN 'D1' ELSE 'D2' END FROM o WHERE kind = 4 UNION ALL SELECT k, NULL, 'C1' FROM o WHERE kind IN (5, 6, 7)),
m AS (SELECT *, CASE WHEN code IN ('A2b', 'B2') THEN 'dropped' WHEN code = 'C1' THEN 'added' WHEN code[1] = 'D' THEN 'merged' ELSE 'kept' END AS outcome FROM c),
f AS (SELECT unnest(['kept', 'kept', 'dropped', 'kept', 'kept', 'kept', 'dropped', 'kept', 'kept', 'added', 'merged', 'merged', 'kept', 'dropped', 'added', 'merged', NULL]) AS outcome, unnest(['A1', 'A2a', 'A2b', 'A3', 'A4', 'B1', 'B2', 'B3', 'B4', 'C1', 'D1', 'D2', NULL, NULL, NULL, NULL, NULL]) AS code),
n AS (SELECT outcome, code, count(*) AS n_events, count(DISTINCT k) AS n_entities, count(*) FILTER (dev >= 0.02) AS over_2, count(*) FILTER (dev >= 0.04) AS over_4 FROM m GROUP BY GROUPING SETS ((outcome, code), (outcome), ())),
d AS (SELECT code, list(dev ORDER BY dev) AS v FROM m WHERE dev IS NOT NULL GROUP BY 1)
SELECT f.outcome, f.code, coalesce(n_events, 0) AS n_events, coalesce(n_entities, 0) AS n_entities, coalesce(over_2, 0) AS over_2, coalesce(over_4, 0) AS over_4, v[least(len(v), len(v) // 2 + 1)] AS median_dev, v[least(len(v), 3 * len(v) // 4 + 1)] AS p75_dev, v[least(len(v), 9 * len(v) // 10 + 1)] AS p90_dev
FROM f LEFT JOIN n ON f.outcome IS NOT DISTINCT FROM n.outcome AND f.code IS NOT DISTINCT FROM n.code LEFT JOIN d ON f.code = d.code""")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census report of splits made of orders, by kind: no exchange data; not covered; denied or exact; matched; matched and
    repeated after 300 days; of another factor; unfiled; filed too late to match.
    """
    k, day, none = F.col("o_orderkey"), F.to_date("o_orderdate"), F.lit(None).cast("date")
    kind, sure = k % 8, k % 3 > 0
    o = table(spark, sf_dir, "orders").where(k.isNotNull())
    first = F.when(kind == 7, 201).otherwise(10)
    after = F.when(kind == 4, F.array(first, F.lit(310))).otherwise(F.array(first))
    event = [k.alias("entity"), F.when(kind == 5, 3.0).otherwise(2.0).alias("factor"), sure.alias("confirmed"), F.when(sure, (k % 977) * 8e-5).alias("dev"), ((k % 7) * 3e-4).alias("dev_raw")]
    found = o.where(kind != 6).select(*event, day.alias("day"), F.explode(after).alias("after")).withColumn("threshold", F.expr("date_add(day, after)")).drop("day", "after")
    start = F.when(kind == 1, F.lit("2010-01-01")).otherwise(F.lit("1990-01-01")).cast("date")
    split = kind >= 3
    listed = o.where(kind > 0).select(k.alias("entity"), F.when(split, day).alias("ex_date"), F.when(split, 2.0).alias("factor"), start.alias("cover_start"), F.when(split & (kind != 6), F.date_add(day, 10)).otherwise(none).alias("first_filed"))
    return splits.report(splits.decided(found, listed))


@query("statement_of_nine_steps", sql(_WIDE + """, g AS (SELECT entity, idx, cogs, equity, abs(revenue) AS ni, CAST(5000 * (1 + entity % 7) AS DOUBLE) AS n FROM w),
s AS (SELECT *, CASE WHEN ni IS NOT NULL AND ni / n >= 0.1 AND idx % 8 <> 7 THEN n END AS avg_n, CASE WHEN ni IS NOT NULL AND ni / n >= 0.1 AND idx % 8 <> 6 THEN n END AS dil, CASE WHEN ni / n >= 0.1 THEN ni / n END AS e FROM g),
t AS (SELECT *, CASE WHEN ni IS NOT NULL AND e IS NOT NULL AND coalesce(avg_n, dil) IS NOT NULL THEN n * CASE WHEN idx % 6 = 2 THEN 1.04 ELSE 1 END END AS shares, CASE WHEN idx % 6 = 2 THEN 'classes' WHEN idx % 3 = 0 THEN 'cover' ELSE 'us-gaap' END AS src FROM s),
c AS (SELECT *, CASE WHEN idx % 4 = 1 AND entity % 5 > 0 THEN equity END AS c0 FROM t),
d AS (SELECT *, CASE WHEN count(c0) OVER (PARTITION BY entity) >= 2 THEN last_value(c0 IGNORE NULLS) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) ELSE c0 END AS cash FROM c),
o AS (SELECT *, count(equity) OVER p AS k, last_value(equity IGNORE NULLS) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, last_value(equity IGNORE NULLS) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM d WINDOW p AS (PARTITION BY entity ORDER BY idx)),
q AS (SELECT *, min(CASE WHEN entity % 3 > 0 AND k <= 9 AND equity >= 2.5 * b AND b < 0.4 * z THEN idx END) OVER (PARTITION BY entity) AS cut FROM o)
SELECT entity, CAST(idx AS BIGINT) AS idx, round(CASE WHEN idx % 6 = 2 AND avg_n IS NULL AND dil IS NULL THEN NULL ELSE shares END, 3) AS shares, avg_n AS average, dil AS diluted, round(e / 7.31, 6) AS eps, round(e / 7.31, 6) AS eps_diluted, round(ni, 3) AS net_income, CAST(CASE WHEN equity IS NOT NULL THEN 0 END AS DOUBLE) AS debt, round(cash, 3) AS cash, round(ni - coalesce(cogs, 0), 3) AS gross, count(cash) OVER (PARTITION BY entity) > 0 OR entity % 2 = 1 AS cash_applicable
FROM q WHERE cut IS NULL OR idx >= cut"""))
def statement_of_nine_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement through every repair: counts and earnings in thousands, totals, zeros, balances, sources, derived items, listing (but for annual reporters)."""
    idx, entity = F.col("idx"), F.col("entity")
    n = (5000 * (1 + entity % 7)).cast("double")
    df = _wide(spark, sf_dir).withColumn("net_income", F.abs("revenue")).withColumn("n", n)
    there = F.col("net_income") / F.col("n") >= 0.1
    wrong = F.when(idx % 5 == 1, 1000.0).when(idx % 5 == 3, 0.001).otherwise(1.0)
    df = df.withColumn("eps", F.when(there, F.col("net_income") / F.col("n"))).withColumn("average", F.when(there & (idx % 8 != 7), F.col("n") * wrong)).withColumn("diluted", F.when(there & (idx % 8 != 6), F.col("n") / wrong))
    some = F.coalesce("average", "diluted").isNotNull()
    df = df.withColumn("shares", F.when(some, F.col("n") * F.when(idx % 6 == 2, 1.04).otherwise(1) * F.when(idx % 7 == 0, 1_000_000.0).otherwise(1.0)))
    df = df.withColumn("eps_diluted", F.col("eps") * F.when(idx % 4 == 1, 1000).otherwise(1)).withColumn("src", F.when(idx % 6 == 2, "classes").when(idx % 3 == 0, "cover").otherwise("us-gaap")).withColumn("other", F.col("n") * 1.01)
    df = df.withColumn("debt", F.col("equity")).withColumn("debt_tag", F.lit("Total")).withColumn("short", F.col("equity")).withColumn("cash", F.when((idx % 4 == 1) & (entity % 5 > 0), F.col("equity"))).withColumn("gross", F.lit(None).cast("double"))
    df = df.withColumn("group", (entity % 2).cast("string")).withColumn("years", entity % 3 == 0)
    rules = statements.Rules(
        ["entity"], shares="shares", weighted="average", diluted="diluted", net_income="net_income", eps="eps", eps_diluted="eps_diluted", totals=[("debt", "short", ["Total"], None, 0.01)], zeros=["debt"], anchor="equity",
        carried=["cash"], source="src", sources={"other": "other"}, derive=[("gross", "net_income - cogs?")], listing="equity", annual="years", group="group", barred={"cash": ("0",)}, internal=["cogs", "revenue", "other"],
    )
    out = statements.statement(df, rules)
    rounded = {"shares": 3, "average": 3, "diluted": 3, "eps": 6, "eps_diluted": 6, "net_income": 3, "debt": 3, "cash": 3, "gross": 3}
    # a factor without halves at the last place, so that rounding is the same everywhere
    out = out.withColumns({c: F.col(c) / 7.31 for c in ("eps", "eps_diluted")})
    return out.select("entity", _long(), *(F.round(c, k).alias(c) for c, k in rounded.items()), "cash_applicable")
