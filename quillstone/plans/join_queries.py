"""Queries on joins by time, range and precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import matching, splits
from quillstone.plans.bindings import cells, facts, money, sql, table
from quillstone.plans.registry import query


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price for each user and day: that of the last event."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max_by(money("value"), F.struct("ts", "event_id")).alias("price"))


_PRICES = "prices AS (SELECT user_id, d, price FROM (SELECT user_id, CAST(ts AS DATE) AS d, CAST(value AS DECIMAL(18,2)) AS price, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)"
_ASKED = "asked AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) + 3 AS d FROM events)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.date_add(F.date_trunc("week", F.col("ts").cast("timestamp_ntz")).cast("date"), 3).alias("d")).distinct()


@query("price_asof", f"WITH {_PRICES}, {_ASKED} SELECT a.user_id, a.d, CAST(p.price AS DOUBLE) AS price, p.d AS price_day FROM asked a ASOF LEFT JOIN prices p ON a.user_id = p.user_id AND a.d >= p.d")
def price_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price at or before the middle of each week in which a user was active."""
    prices = _prices(spark, sf_dir).withColumn("price_day", F.col("d")).withColumnRenamed("d", "at")
    out = matching.as_of(_asked(spark, sf_dir), prices, ["user_id"], "d", "at", ["price", "price_day"], "week")
    return out.select("user_id", "d", F.col("price").cast("double").alias("price"), "price_day")


@query("forward_filing_asof", f"WITH {_PRICES}, {_ASKED} SELECT a.user_id, a.d, min(p.d) AS next_day FROM asked a LEFT JOIN prices p ON a.user_id = p.user_id AND p.d >= a.d GROUP BY 1, 2")
def forward_filing_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day with a price at or after the middle of each week."""
    days = _prices(spark, sf_dir).select("user_id", F.col("d").alias("next_day"))
    return matching.first_at_or_after(_asked(spark, sf_dir), days, ["user_id"], "d", "next_day").select("user_id", "d", "next_day")


_DAYS = "days AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS d, CAST(max(o_totalprice) AS DECIMAL(18,2)) AS v FROM orders GROUP BY 1, 2), ends AS (SELECT DISTINCT o_custkey AS entity, CAST(last_day(CAST(o_orderdate AS DATE)) AS DATE) AS e FROM orders)"


def _days_and_ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("d"), "o_totalprice")
    return o.groupBy("entity", "d").agg(money(F.max("o_totalprice")).alias("v")), o.select("entity", F.last_day("d").alias("e")).distinct()


@query("within_75_days", f"WITH {_DAYS} SELECT e.entity, e.e, min(d.d) AS matched_day, CAST(arg_min(d.v, d.d) AS DOUBLE) AS v FROM ends e LEFT JOIN days d ON e.entity = d.entity AND d.d - e.e BETWEEN 0 AND 75 GROUP BY 1, 2")
def within_75_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, ends = _days_and_ends(spark, sf_dir)
    out = matching.within_days(ends, days.withColumnRenamed("d", "day"), ["entity"], "e", "day", 0, 75, ["v"])
    return out.select("entity", "e", "matched_day", F.col("v").cast("double").alias("v"))


@query("band_5_days", f"WITH {_DAYS} SELECT e.entity, e.e, min(d.d) AS matched_day, CAST(arg_min(d.v, d.d) AS DOUBLE) AS v FROM ends e LEFT JOIN days d ON e.entity = d.entity AND abs(d.d - e.e) <= 5 GROUP BY 1, 2")
def band_5_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, ends = _days_and_ends(spark, sf_dir)
    out = matching.within_days(ends, days.withColumnRenamed("d", "day"), ["entity"], "e", "day", -5, 5, ["v"])
    return out.select("entity", "e", "matched_day", F.col("v").cast("double").alias("v"))


#: Overlapping ranges, as industry codes have them.
RANGES = [(1, 50, "any", 0), (1, 10, "small", 1), (8, 25, "middle", 2), (11, 20, "core", 3), (16, 25, "upper", 4), (30, 50, "large", 5)]


@query("narrowest_range_join", """WITH r(lo, hi, name, ord) AS (VALUES (1, 50, 'any', 0), (1, 10, 'small', 1), (8, 25, 'middle', 2), (11, 20, 'core', 3), (16, 25, 'upper', 4), (30, 50, 'large', 5)),
b AS (SELECT p_size, name FROM (SELECT p_size, name, row_number() OVER (PARTITION BY p_size ORDER BY hi - lo, ord) AS n FROM (SELECT DISTINCT p_size FROM part) JOIN r ON p_size BETWEEN lo AND hi) WHERE n = 1)
SELECT p_partkey, p_size, name AS group_name FROM part LEFT JOIN b USING (p_size)""")
def narrowest_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame(RANGES, "lo int, hi int, name string, ordinal int")
    return matching.narrowest_range(table(spark, sf_dir, "part"), "p_size", ranges).select("p_partkey", "p_size", "group_name")


_CUT = "DATE '1998-07-01'"


@query("cross_boundary_pairs", sql(f""", v AS (SELECT entity, tag, period_, filed, max(val) AS val FROM (SELECT *, fy * 4 + q AS period_ FROM keyed) GROUP BY 1, 2, 3, 4),
p AS (SELECT a.entity, CAST(b.val AS DOUBLE) / CAST(a.val AS DOUBLE) AS ratio FROM v a JOIN v b ON a.entity = b.entity AND a.tag = b.tag AND a.period_ = b.period_ AND a.filed < {_CUT} AND b.filed >= {_CUT})
SELECT entity, count(*) AS n, round(min(ratio), 6) AS least, round(max(ratio), 6) AS most FROM p GROUP BY 1"""))
def cross_boundary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later over earlier value of one quarter's filings on both sides of a day."""
    from quillstone.plans.bindings import keyed_facts

    df = keyed_facts(spark, sf_dir).select("entity", F.concat_ws("/", "tag", (F.col("fy") * 4 + F.col("q")).cast("string")).alias("period"), F.lit("instant").alias("kind"), "filed", F.col("val").cast("double").alias("val"))
    points = df.groupBy("entity", "period", "kind", "filed").agg(F.max("val").alias("val"))
    events = df.select("entity").distinct().withColumn("threshold", F.to_date(F.lit("1998-07-01")))
    return splits.across(points, events).groupBy("entity").agg(F.count("*").alias("n"), F.round(F.min("ratio"), 6).alias("least"), F.round(F.max("ratio"), 6).alias("most"))


@query("split_adjust_product", sql(""", s(threshold, factor) AS (VALUES (DATE '1996-06-01', 2.0), (DATE '1998-01-01', 0.5), (DATE '2000-03-01', 3.0)),
f AS (SELECT f.*, coalesce((SELECT product(s.factor) FROM s WHERE s.threshold > f.filed), 1) AS p FROM facts f)
SELECT entity, tag, round(sum(CASE WHEN tag = 'A' THEN CAST(val AS DOUBLE) * p ELSE CAST(val AS DOUBLE) / p END), 2) AS adjusted FROM f GROUP BY 1, 2"""))
def split_adjust_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on the newest basis; tag A holds share counts, the others per-share values."""
    df = facts(spark, sf_dir).select("entity", "tag", "filed", F.col("val").cast("double").alias("val"), F.when(F.col("tag") == "A", "shares").otherwise("USD/shares").alias("unit"))
    dates = spark.createDataFrame([("1996-06-01", 2.0), ("1998-01-01", 0.5), ("2000-03-01", 3.0)], "t string, factor double").select(F.to_date("t").alias("threshold"), "factor")
    events = df.select("entity").distinct().crossJoin(F.broadcast(dates))
    return splits.adjusted(df, events, ["entity", "tag"]).groupBy("entity", "tag").agg(F.round(F.sum("val"), 2).alias("adjusted"))


_CLEAN = "list_filter(CAST([2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 25, 30, 50] AS DOUBLE[]), lambda s: abs({r} - s) / s < 0.08)[1]"
_SPLIT_EVENTS = f""", pts AS MATERIALIZED (SELECT part AS entity, tag || '/' || CAST(line AS VARCHAR) AS period, filed, CAST(val AS DOUBLE) AS val, k1 FROM facts WHERE val > 0),
steps AS (SELECT entity, filed AS lo, lead(filed) OVER w AS hi, lead(val) OVER w / val AS ratio FROM pts WINDOW w AS (PARTITION BY entity, period ORDER BY filed, k1, val)),
clean AS (SELECT *, CASE WHEN ratio >= 1.5 THEN {_CLEAN.format(r="ratio")} WHEN ratio > 0 AND ratio <= 0.67 THEN CAST(1 AS DOUBLE) / {_CLEAN.format(r="(CAST(1 AS DOUBLE) / ratio)")} END AS factor FROM steps WHERE lo < hi),
seen AS MATERIALIZED (SELECT *, factor > 1 AS forward FROM clean WHERE factor IS NOT NULL),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity, forward ORDER BY hi, lo) AS r FROM (SELECT DISTINCT entity, forward, lo, hi FROM seen)),
p AS (SELECT entity, forward, r, hi AS point FROM o WHERE r = 1 UNION ALL SELECT o.entity, o.forward, o.r, CASE WHEN o.lo >= p.point THEN o.hi ELSE p.point END FROM p JOIN o ON o.entity = p.entity AND o.forward = p.forward AND o.r = p.r + 1),
held AS (SELECT o.entity, o.forward, o.lo, o.hi, min(p.point) AS threshold FROM o JOIN (SELECT DISTINCT entity, forward, point FROM p) p ON o.entity = p.entity AND o.forward = p.forward AND p.point > o.lo AND p.point <= o.hi GROUP BY 1, 2, 3, 4),
votes AS MATERIALIZED (SELECT entity, forward, threshold, factor, 2 * count(*) AS votes, min(abs(ratio / factor - 1)) AS dev_raw FROM seen JOIN held USING (entity, forward, lo, hi) GROUP BY 1, 2, 3, 4),
sides AS (SELECT t.entity, t.threshold, b.val / a.val AS ratio FROM (SELECT DISTINCT entity, threshold FROM votes) t JOIN pts a ON a.entity = t.entity AND a.filed < t.threshold JOIN pts b ON b.entity = a.entity AND b.period = a.period AND b.filed >= t.threshold),
judged AS (SELECT v.entity, v.forward, v.threshold, v.factor, v.votes, v.dev_raw, coalesce(bool_or(abs(s.ratio / v.factor - 1) < 0.08), false) AS confirmed, coalesce(bool_or(abs(s.ratio - 1) < 0.08), false) AS flat, min(abs(s.ratio / v.factor - 1)) AS near FROM votes v LEFT JOIN sides s ON s.entity = v.entity AND s.threshold = v.threshold GROUP BY 1, 2, 3, 4, 5, 6)
SELECT entity, threshold, factor, confirmed, CASE WHEN confirmed THEN near END AS dev, dev_raw FROM (SELECT *, row_number() OVER (PARTITION BY entity, forward, threshold ORDER BY confirmed DESC, votes DESC, factor DESC) AS r FROM judged) WHERE r = 1 AND (confirmed OR NOT flat)"""


@query("split_events", sql(_SPLIT_EVENTS).replace("WITH facts AS", "WITH RECURSIVE facts AS", 1))
def split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits seen in the part's unit price across filings, clustered, voted on and confirmed."""
    df = facts(spark, sf_dir).select(F.col("part").alias("entity"), F.concat_ws("/", "tag", "line").alias("period"), F.lit("shares").alias("kind"), "filed", F.col("val").cast("double").alias("val"), F.col("k1").alias("pos"))
    return splits.detected(df)


@query("interval_stabbing", sql(""", i AS MATERIALIZED (SELECT customer, k1, min(filed) AS lo, max(e) AS hi FROM facts GROUP BY 1, 2 HAVING min(filed) < max(e)),
o AS MATERIALIZED (SELECT customer, lo, hi, row_number() OVER (PARTITION BY customer ORDER BY hi, lo) AS r FROM (SELECT DISTINCT customer, lo, hi FROM i)),
p AS (SELECT customer, r, hi AS point FROM o WHERE r = 1 UNION ALL SELECT o.customer, o.r, CASE WHEN o.lo >= p.point THEN o.hi ELSE p.point END FROM p JOIN o ON o.customer = p.customer AND o.r = p.r + 1)
SELECT i.customer, i.k1, i.lo, i.hi, min(p.point) AS threshold FROM i JOIN (SELECT DISTINCT customer, point FROM p) p ON i.customer = p.customer AND p.point > i.lo AND p.point <= i.hi GROUP BY 1, 2, 3, 4""").replace("WITH facts AS", "WITH RECURSIVE facts AS", 1))
def interval_stabbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest days such that each order's time between order and last shipment holds one, by customer."""
    df = facts(spark, sf_dir).groupBy("customer", "k1").agg(F.min("filed").alias("lo"), F.max("end").alias("hi")).where("lo < hi")
    return splits.stabbed(df, ["customer"]).select("customer", "k1", "lo", "hi", "threshold")


@query("snapshot_diff", """WITH a AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1999-07-01' GROUP BY 1, 2),
b AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2)
SELECT coalesce(a.entity, b.entity) AS entity, CAST(coalesce(a.y, b.y) AS BIGINT) AS y, a.v AS old, b.v AS new, CASE WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' WHEN a.v IS NULL THEN 'gained' WHEN b.v IS NULL THEN 'lost' ELSE 'moved' END AS change FROM a FULL JOIN b ON a.entity = b.entity AND a.y = b.y""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly totals of customers in two snapshots of the orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("long").alias("y"), "o_orderdate", money("o_totalprice").alias("v"))

    def snapshot(where):  # noqa: ANN001, ANN202
        return o.where(where).groupBy("entity", "y").agg(F.sum("v").cast("double").alias("v"))

    return matching.snapshot_diff(snapshot("o_orderdate < timestamp_ntz '1999-07-01 00:00:00'"), snapshot("o_orderdate >= timestamp_ntz '1996-01-01 00:00:00'"), ["entity", "y"], "v")


@query("overlap_agreement", sql(""", p AS (SELECT entity, period, CAST(val AS DOUBLE) AS v FROM latest WHERE tag = 'A'), c AS (SELECT entity, period, tag, CAST(val AS DOUBLE) AS v FROM latest WHERE tag <> 'A'),
m AS (SELECT c.tag, c.entity, c.v / p.v AS ratio FROM c JOIN p ON c.entity = p.entity AND c.period = p.period WHERE p.v <> 0)
SELECT tag, count(*) AS n_overlap, count(DISTINCT entity) AS n_entities, round(avg(CASE WHEN abs(ratio - 1) < 0.01 THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(median(ratio), 6) AS median_ratio, count(*) >= 30 AND count(DISTINCT entity) >= 3 AND avg(CASE WHEN abs(ratio - 1) < 0.01 THEN 1.0 ELSE 0.0 END) >= 0.9 AS accepted FROM m GROUP BY 1"""))
def overlap_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cells(spark, sf_dir).select("entity", "period", "tag", F.col("val").cast("double").alias("val"))
    out = matching.overlap_agreement(df.where("tag = 'A'").drop("tag"), df.where("tag <> 'A'"), ["entity", "period"], "entity")
    return out.select("tag", "n_overlap", "n_entities", F.round("agreement", 6).alias("agreement"), F.round("median_ratio", 6).alias("median_ratio"), "accepted")


@query("newest_filing_wins", sql(""", c AS (SELECT entity, fy * 4 + q AS period, form AS member, k1 AS filing, filed, max(val) AS val FROM keyed GROUP BY 1, 2, 3, 4, 5),
f AS (SELECT *, first_value(filing) OVER (PARTITION BY entity, period ORDER BY filed DESC, filing) AS claimant FROM c),
a AS (SELECT * FROM f WHERE (entity, period, member) IN (SELECT (entity, period, member) FROM f WHERE filing = claimant))
SELECT entity, CAST(period AS BIGINT) AS period, member, filing, CAST(val AS DOUBLE) AS val FROM (SELECT *, row_number() OVER (PARTITION BY entity, period, member ORDER BY filed DESC, filing) AS r FROM a) WHERE r = 1"""))
def newest_filing_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that the newest order of a supplier's quarter has, with their newest values."""
    from quillstone.plans.bindings import keyed_facts

    df = keyed_facts(spark, sf_dir).groupBy("entity", (F.col("fy") * 4 + F.col("q")).cast("long").alias("period"), F.col("form").alias("member"), F.col("k1").alias("filing"), "filed").agg(F.max("val").alias("val"))
    out = matching.newest_filing_wins(df, ["entity", "period"], "member", [F.desc("filed")])
    return out.select("entity", "period", "member", "filing", F.col("val").cast("double").alias("val"))


@query("foreign_form_fallback", """WITH w AS (SELECT *, bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) OVER (PARTITION BY o_custkey) AS local, bool_or(o_orderpriority = '3-MEDIUM') OVER (PARTITION BY o_custkey) AS abroad FROM orders)
SELECT o_orderkey, o_custkey AS entity, o_orderpriority AS form FROM w WHERE CASE WHEN NOT local AND abroad THEN o_orderpriority = '3-MEDIUM' ELSE o_orderpriority IN ('1-URGENT', '2-HIGH') END""")
def foreign_form_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("form"))
    return matching.preferred_forms(df, ("1-URGENT", "2-HIGH"), ("3-MEDIUM",))


@query("semi_anti_predecessor", """WITH f AS (SELECT l_suppkey AS entity, lpad(CAST(l_partkey % 100 + 1 AS VARCHAR), 10, '0') || '-' || CAST(l_linenumber AS VARCHAR) AS accession, l_returnflag AS form FROM lineitem),
n AS (SELECT entity, accession, CAST(substr(accession, 1, 10) AS BIGINT) AS candidate FROM f)
SELECT DISTINCT n.entity, n.candidate FROM n WHERE n.candidate <> n.entity AND n.candidate IN (SELECT entity FROM f WHERE form = 'A') AND (n.candidate, n.accession) IN (SELECT (entity, accession) FROM f)""")
def semi_anti_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that an accession number names, that filed form A and list the same accession."""
    accession = F.concat(F.lpad((F.col("l_partkey") % 100 + 1).cast("string"), 10, "0"), F.lit("-"), F.col("l_linenumber").cast("string"))
    df = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), accession.alias("accession"), F.col("l_returnflag").alias("form"))
    return matching.predecessors(df, ("A",))


@query("ticker_spellings", """WITH roster AS (SELECT 'SUPP-' || CAST(s_suppkey AS VARCHAR) AS ticker, s_suppkey FROM supplier), asked AS (SELECT DISTINCT 'supp' || CASE WHEN l_linenumber % 2 = 0 THEN '.' ELSE '-' END || CAST(l_suppkey + l_linenumber AS VARCHAR) AS name FROM lineitem),
t AS (SELECT name, 0 AS p, upper(name) AS s FROM asked UNION ALL SELECT name, 1, replace(upper(name), '.', '-') FROM asked UNION ALL SELECT name, 2, replace(upper(name), '-', '.') FROM asked),
b AS (SELECT name, ticker, s_suppkey FROM (SELECT t.name, r.ticker, r.s_suppkey, row_number() OVER (PARTITION BY t.name ORDER BY p) AS n FROM t JOIN roster r ON t.s = r.ticker) WHERE n = 1)
SELECT a.name, b.ticker AS found_ticker, b.s_suppkey FROM asked a LEFT JOIN b USING (name)""")
def ticker_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = table(spark, sf_dir, "supplier").select(F.concat(F.lit("SUPP-"), F.col("s_suppkey").cast("string")).alias("ticker"), "s_suppkey")
    mark = F.when(F.col("l_linenumber") % 2 == 0, ".").otherwise("-")
    asked = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("supp"), mark, (F.col("l_suppkey") + F.col("l_linenumber")).cast("string")).alias("name")).distinct()
    return matching.first_spelling(asked, roster, "name")


