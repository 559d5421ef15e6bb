"""Queries that pick filings, facts, tags and concepts, and put them in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import calendar, labels, scalars
from quillstone.operators import audits, evidence, matching, picks, series
from quillstone.plans.bindings import facts, grid, sql, table
from quillstone.plans.registry import query

_FILINGS = """WITH f AS (SELECT o_custkey AS entity, o_orderkey AS accession, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS report_date, CAST(o_orderdate AS DATE) + 30 AS filing_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '20-F' WHEN '3-MEDIUM' THEN '8-K' ELSE '10-Q' END AS form FROM orders)"""
_NEWEST = "report_date DESC NULLS LAST, filing_date DESC NULLS LAST, accession DESC"


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, p = F.to_date("o_orderdate"), F.col("o_orderpriority")
    form = F.when(p == "1-URGENT", "10-K").when(p == "2-HIGH", "20-F").when(p == "3-MEDIUM", "8-K").otherwise("10-Q")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("accession"), F.when(F.col("o_orderkey") % 5 > 0, day).alias("report_date"), F.date_add(day, 30).alias("filing_date"), form.alias("form"))


@query("date_range", _FILINGS + " SELECT accession FROM f WHERE coalesce(report_date, filing_date) BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of a range of days by report date, else filing date."""
    return picks.in_dates(_filings(spark, sf_dir), "1997-01-01", "1998-06-30").select("accession")


@query("fiscal_range", """WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'unknown' WHEN l_linenumber > 4 THEN 'FY' || CAST(year(l_shipdate) AS VARCHAR) ELSE 'FY' || CAST(year(l_shipdate) AS VARCHAR) || ' Q' || CAST(l_linenumber AS VARCHAR) END AS period, year(l_shipdate) * 4 + CASE WHEN l_linenumber > 4 THEN 4 ELSE l_linenumber END AS place FROM lineitem)
SELECT period, count(*) AS n FROM p WHERE period = 'unknown' OR place BETWEEN 1996 * 4 + 3 AND 1998 * 4 + 4 GROUP BY 1""")
def fiscal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by period keys; those that can't be read stay."""
    n, year = F.col("l_linenumber"), F.concat(F.lit("FY"), F.year("l_shipdate").cast("string"))
    df = table(spark, sf_dir, "lineitem").select(F.when(n == 7, "unknown").when(n > 4, year).otherwise(F.concat(year, F.lit(" Q"), n.cast("string"))).alias("period"))
    return picks.in_fiscal_range(df, "period", "FY1996 Q3", "FY1998").groupBy("period").agg(F.count("*").alias("n"))


@query("first_of_kind", _FILINGS + f""" SELECT entity, accession, form FROM (SELECT *, form IN ('10-K', '20-F') AS annual, row_number() OVER (PARTITION BY entity, form IN ('10-K', '20-F') ORDER BY {_NEWEST}) AS r FROM f WHERE form <> '8-K') WHERE r <= CASE WHEN annual THEN 2 ELSE 4 END""")
def first_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two annual and four quarterly filings."""
    return picks.first_of_kind(_filings(spark, sf_dir), ("10-K", "20-F"), ("10-Q",)).select("entity", "accession", "form")


@query("filings_by_form", _FILINGS + """ SELECT * FROM (SELECT entity, accession, row_number() OVER (PARTITION BY entity ORDER BY CASE form WHEN '10-K' THEN 1 WHEN '20-F' THEN 2 ELSE 3 END, filing_date DESC, accession DESC) AS rank FROM f WHERE form <> '8-K') WHERE rank <= 3""")
def filings_by_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.by_form(_filings(spark, sf_dir), ["10-K", "20-F", "10-Q"], 3).select("entity", "accession", F.col("rank").cast("long").alias("rank"))


@query("newest_filings", _FILINGS + """ SELECT * FROM (SELECT entity, accession, row_number() OVER (PARTITION BY entity ORDER BY filing_date DESC, accession DESC) AS rank FROM f WHERE form <> '8-K') WHERE rank <= 3""")
def newest_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.newest_filed(_filings(spark, sf_dir), ["10-K", "20-F", "10-Q"], 3).select("entity", "accession", F.col("rank").cast("long").alias("rank"))


@query("paged_history", _FILINGS + """, p AS (SELECT *, make_date(year(filing_date), 12, 31) AS filing_to FROM f WHERE filing_date < DATE '1999-01-01'), r AS (SELECT * FROM f WHERE filing_date >= DATE '1999-01-01'), o AS (SELECT entity FROM r GROUP BY 1 HAVING min(filing_date) > DATE '1997-05-01')
SELECT entity, accession, filing_date FROM r UNION ALL SELECT entity, accession, filing_date FROM p WHERE filing_to >= DATE '1997-05-01' AND entity IN (SELECT entity FROM o)""")
def paged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent filings and the yearly pages that reach back to a day."""
    f, cut = _filings(spark, sf_dir), F.lit("1999-01-01").cast("date")
    pages = f.where(F.col("filing_date") < cut).withColumn("filing_to", F.make_date(F.year("filing_date"), F.lit(12), F.lit(31)))
    return picks.with_history(f.where(F.col("filing_date") >= cut), pages, "1997-05-01").select("entity", "accession", "filing_date")


_SPANS = """, d AS (SELECT entity, tag, k1, line, e AS "end", e - CASE line WHEN 1 THEN 80 WHEN 2 THEN 91 WHEN 3 THEN 99 WHEN 4 THEN 100 WHEN 5 THEN 300 WHEN 6 THEN 364 ELSE 400 END AS start, CASE line WHEN 1 THEN 80 WHEN 2 THEN 91 WHEN 3 THEN 99 WHEN 4 THEN 100 WHEN 5 THEN 300 WHEN 6 THEN 364 ELSE 400 END AS days, filed, CAST(val AS DOUBLE) - 20000 AS val, CASE WHEN k1 % 3 = 0 THEN 'USD' WHEN k1 % 3 = 1 THEN 'EUR/shares' ELSE 'EUR' END AS unit FROM facts)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("line"), F.col("k1") % 3
    days = F.when(n == 1, 80).when(n == 2, 91).when(n == 3, 99).when(n == 4, 100).when(n == 5, 300).when(n == 6, 364).otherwise(400)
    return facts(spark, sf_dir).select("entity", "tag", "k1", "line", "end", F.date_sub("end", days).alias("start"), "filed", (F.col("val").cast("double") - 20000).alias("val"), F.when(k == 0, "USD").when(k == 1, "EUR/shares").otherwise("EUR").alias("unit"))


@query("share_and_eps_facts", sql(_SPANS + """ SELECT 'shares' AS kind, entity, count(*) AS n FROM d WHERE val > 0 AND days > 80 AND days < 100 GROUP BY 2 UNION ALL SELECT 'per share', entity, count(*) FROM d WHERE val > 0 AND (days < 100 OR days > 300 AND days < 400) GROUP BY 2"""))
def share_and_eps_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that can show a split, by company."""
    df = _spans(spark, sf_dir)
    count = lambda some, kind: some.groupBy(F.lit(kind).alias("kind"), "entity").agg(F.count("*").alias("n"))
    return count(picks.share_facts(df), "shares").unionByName(count(picks.per_share_facts(df), "per share"))


@query("one_currency", sql(_SPANS + """ SELECT entity, unit, count(*) AS n FROM d WHERE unit LIKE CASE WHEN entity % 2 = 0 THEN 'USD%' ELSE 'EUR%' END GROUP BY 1, 2"""))
def one_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _spans(spark, sf_dir)
    own = df.select("entity").distinct().withColumn("currency", F.when(F.col("entity") % 2 == 0, "USD").otherwise("EUR"))
    return picks.one_currency(df, own).groupBy("entity", "unit").agg(F.count("*").alias("n"))


@query("matches_kind", sql(_SPANS + """ SELECT entity, count(*) FILTER (days BETWEEN 300 AND 400) AS n_annual, count(*) FILTER (days BETWEEN 80 AND 100) AS n_quarterly FROM d GROUP BY 1"""))
def matches_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = lambda k: F.count_if(picks.matches_kind(F.col("start"), F.col("end"), F.lit(k)))
    return _spans(spark, sf_dir).groupBy("entity").agg(fits("A").alias("n_annual"), fits("Q").alias("n_quarterly"))


@query("instant_shares", sql(""", i AS (SELECT entity, tag, e, filed, CAST(val AS DOUBLE) AS v, k1 * 10 + line AS pos FROM facts WHERE status = 'O' AND (tag = 'N' OR entity % 3 > 0 AND tag = 'R' OR entity % 3 = 0 AND tag = 'A')), w AS (SELECT entity, min(CASE tag WHEN 'R' THEN 1 WHEN 'N' THEN 2 END) AS p FROM i GROUP BY 1)
SELECT i.entity, e AS "end", filed, arg_min(v, (pos, v)) AS val FROM i JOIN w ON i.entity = w.entity AND CASE tag WHEN 'R' THEN 1 WHEN 'N' THEN 2 END = p GROUP BY 1, 2, 3"""))
def instant_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share counts by day and filing, of tag R for companies that have it, else of N."""
    t, third = F.col("tag"), F.col("entity") % 3
    df = facts(spark, sf_dir).where("status = 'O'").where((t == "N") | ((third > 0) & (t == "R")) | ((third == 0) & (t == "A")))
    df = df.select("entity", "tag", "end", F.lit(None).cast("date").alias("start"), "filed", F.col("val").cast("double").alias("val"), F.struct((F.col("k1") * 10 + F.col("line")).alias("p"), F.col("val").cast("double").alias("v")).alias("pos"))
    return picks.instants(df, ["R", "N"])


@query("filed_dates", sql("SELECT entity, array_to_string(list_sort(list(DISTINCT filed)), ',') AS dates FROM facts GROUP BY 1"))
def filed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.filed_dates(facts(spark, sf_dir)).select("entity", F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"))


@query("shown_and_classified", sql(""", c AS (SELECT * FROM (VALUES ('A', 'IS', 'USD', false), ('N', 'BS', 'shares', false), ('R', 'CF', 'USD', true)) t(concept, statement, unit, internal)) SELECT f.tag AS concept, statement IN ('IS', 'CF') AS is_flow, unit <> 'shares' AS is_additive, count(*) AS n FROM facts f JOIN c ON f.tag = c.concept WHERE NOT internal GROUP BY 1, 2, 3"""))
def shown_and_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of concepts that aren't internal, with what kind of number they hold."""
    rows = [("A", "IS", "USD", False), ("N", "BS", "shares", False), ("R", "CF", "USD", True)]
    concepts = spark.createDataFrame(rows, "concept string, statement string, unit string, internal boolean")
    cells = picks.shown(facts(spark, sf_dir).select(F.col("tag").alias("concept")), concepts)
    return cells.join(F.broadcast(picks.classified(concepts)), "concept").groupBy("concept", "is_flow", "is_additive").agg(F.count("*").alias("n"))


@query("without_noise", """SELECT p_partkey FROM (SELECT p_partkey, p_name, DATE '2021-06-01' + CAST(p_partkey % 500 AS INTEGER) AS latest FROM part) WHERE NOT contains(lower(p_name), 'red') AND NOT contains(lower(p_name), 'small') AND length(p_name) >= 9 AND latest >= DATE '2022-01-01'""")
def without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("tag"), F.date_add(F.lit("2021-06-01").cast("date"), (F.col("p_partkey") % 500).cast("int")).alias("latest"))
    return picks.without_noise(df, ("Red", "small"), 9, "2022-01-01").select("p_partkey")


@query("revenue_like", sql(_SPANS + """, q AS (SELECT * FROM d WHERE tag IN ('A', 'R') AND unit IN ('USD', 'EUR') AND days BETWEEN 45 AND 130 AND year("end") >= 1999)
SELECT entity, tag, unit, count(*) AS n, max("end") AS "end", arg_max(val, ("end", val)) AS val FROM q GROUP BY 1, 2, 3 HAVING count(*) >= 2"""))
def revenue_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.revenue_like(_spans(spark, sf_dir), ("A", "R"), 1999)


@query("common_label", "SELECT p_brand AS tag, p_type AS label FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) WHERE r = 1")
def common_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.common_label(table(spark, sf_dir, "part").select(F.col("p_brand").alias("tag"), F.col("p_type").alias("label")))


@query("systemic_holes", sql(""", h AS (SELECT entity, tag, max(CASE WHEN val IS NOT NULL THEN idx END) - min(CASE WHEN val IS NOT NULL THEN idx END) + 1 - count(val) AS n FROM grid GROUP BY 1, 2) SELECT tag, count(DISTINCT entity) AS n_entities FROM h WHERE n > 0 GROUP BY 1""", fine=True))
def systemic_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.hole_labels(series.holes(grid(spark, sf_dir, True), ["entity", "tag"], "val"), "tag")


@query("implied_latest", sql(""", a AS (SELECT entity, e AS d, CAST(max(val) AS DOUBLE) AS val FROM facts WHERE tag = 'A' GROUP BY 1, 2), b AS (SELECT entity, e AS d, CAST(max(quantity) - 5 AS DOUBLE) AS val FROM facts WHERE tag = 'N' GROUP BY 1, 2)
SELECT a.entity, max(a.d) AS d, round(arg_max(a.val / b.val, a.d), 6) AS implied FROM a JOIN b ON a.entity = b.entity AND a.d = b.d WHERE b.val <> 0 GROUP BY 1"""))
def implied_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = facts(spark, sf_dir).withColumnRenamed("end", "d")
    income = df.where("tag = 'A'").groupBy("entity", "d").agg(F.max("val").cast("double").alias("val"))
    eps = df.where("tag = 'N'").groupBy("entity", "d").agg((F.max("quantity") - 5).cast("double").alias("val"))
    return picks.implied_latest(eps, income).withColumn("implied", F.round("implied", 6))


@query("column_places", sql(""", p AS (SELECT DISTINCT entity, last_day(e) AS e, CASE WHEN month(e) = 12 THEN 'A' ELSE 'Q' END AS kind FROM facts) SELECT entity, CAST(e AS DATE) AS "end", kind, row_number() OVER (PARTITION BY entity ORDER BY kind, e) AS place FROM p"""))
def column_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = facts(spark, sf_dir).select("entity", F.last_day("end").alias("end"), F.when(F.month("end") == 12, "A").otherwise("Q").alias("kind"))
    return picks.column_places(df).withColumn("place", F.col("place").cast("long"))


@query("config_order", "SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 9 END, p_type) AS place FROM part")
def config_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = spark.createDataFrame([("STANDARD", 1), ("ECONOMY", 2)], "p_type string, ordinal int")
    return picks.in_config_order(table(spark, sf_dir, "part").select("p_partkey", "p_type"), config, "p_type").select("p_partkey", "p_type", F.col("place").cast("long").alias("place"))


@query("flattened_results", sql(""" SELECT entity, form AS period, tag AS concept, CAST(max(val) AS DOUBLE) AS value FROM facts GROUP BY 1, 2, 3"""))
def flattened_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested results, one for each supplier, as rows again."""
    cells = facts(spark, sf_dir).groupBy("entity", "form", "tag").agg(F.max("val").cast("double").alias("v"))
    inner = cells.groupBy("entity", "form").agg(F.map_from_entries(F.collect_list(F.struct("tag", "v"))).alias("m"))
    nested = inner.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("form", "m"))).alias("values"))
    return picks.flattened(nested, ["entity"], "values")


@query("verification_moves", sql(""", a AS (SELECT entity, tag, idx, CASE WHEN val IS NOT NULL THEN val > 30000 END AS v FROM grid WHERE idx < 20), b AS (SELECT entity, tag, idx, CASE WHEN val IS NOT NULL AND idx % 5 > 0 THEN val > 40000 END AS v FROM grid WHERE idx > 3),
s AS (SELECT CASE WHEN a.entity IS NULL THEN NULL WHEN a.v IS NULL THEN 'unknown' WHEN a.v THEN 'ok' ELSE 'bad' END AS was, CASE WHEN b.entity IS NULL THEN NULL WHEN b.v IS NULL THEN 'unknown' WHEN b.v THEN 'ok' ELSE 'bad' END AS now FROM a FULL JOIN b ON a.entity = b.entity AND a.tag = b.tag AND a.idx = b.idx),
r AS (SELECT was, now, count(*) AS n, CASE was WHEN 'ok' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END AS x, CASE now WHEN 'ok' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END AS y FROM s GROUP BY 1, 2)
SELECT was, now, n, CASE WHEN was IS NULL THEN 'gained' WHEN now IS NULL THEN 'lost' WHEN y > x THEN 'better' WHEN y < x THEN 'worse' ELSE 'same' END AS move FROM r""", fine=True))
def verification_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, keys = grid(spark, sf_dir, True), ["entity", "tag", "idx"]
    before = df.where("idx < 20").select(*keys, (F.col("val") > 30000).alias("verified"))
    after = df.where("idx > 3").select(*keys, F.when(F.col("idx") % 5 > 0, F.col("val") > 40000).alias("verified"))
    return picks.verification_moves(before, after, keys)


@query("company_applicability", sql(""", t AS (SELECT DISTINCT entity, status AS stmt, part % 211 AS tag FROM facts), j AS (SELECT entity FROM (SELECT entity, stmt, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1 HAVING min(n) >= 20 AND count(*) = 2),
e AS (SELECT tag, tag % 40 AS c FROM (SELECT DISTINCT tag FROM t) WHERE tag % 4 <> 3 AND NOT (tag % 10 = 5) AND (tag % 8 <> 2 OR tag % 40 = 10)), h AS (SELECT DISTINCT entity, c FROM t JOIN e USING (tag)),
d AS (SELECT entity, c FROM h UNION SELECT entity, 41 FROM h WHERE c IN (1, 2) GROUP BY 1 HAVING count(DISTINCT c) = 2)
SELECT j.entity, CAST(u.c AS VARCHAR) AS concept FROM j CROSS JOIN (SELECT unnest(range(0, 42)) AS c) u EXCEPT SELECT entity, CAST(c AS VARCHAR) FROM d"""))
def company_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that suppliers give no evidence of: part groups as tags, some revoked, some claimed otherwise by labels."""
    tags = facts(spark, sf_dir).select("entity", F.col("status").alias("stmt"), (F.col("part") % 211).alias("tag"))
    pairs = tags.select("tag", (F.col("tag") % 40).cast("string").alias("concept")).distinct()
    scored = pairs.where("tag % 4 <> 3")
    claims = scored.where("tag % 8 = 2").select("tag", F.lit("10").alias("concept"))
    proof = evidence.supported(scored.where("false"), scored, scored.where("tag % 10 = 5"), claims)
    concepts = spark.range(42).select(F.col("id").cast("string").alias("concept"))
    return evidence.inapplicable(tags, proof, concepts, {"41": ["1", "2"]}, 20, 2, 2)


@query("token_evidence", """WITH t AS (SELECT DISTINCT doc_id AS tag, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS token FROM documents), c AS (SELECT item_id AS concept, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS token FROM benchmark), n AS (SELECT count(DISTINCT concept) AS n FROM c), i AS (SELECT token, ln((SELECT n FROM n) / count(*)) AS idf FROM c GROUP BY 1)
SELECT tag, concept FROM t JOIN c USING (token) JOIN i USING (token) GROUP BY 1, 2 HAVING sum(idf) >= 30""")
def token_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item whose words a document shares enough of."""
    words = lambda: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1)))
    concepts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("concept"), words().alias("tokens"))
    weights = concepts.select("concept", F.explode("tokens").alias("token")).join(audits.token_weights(concepts, "concept", "tokens"), "token").select("concept", "token", "idf")
    return evidence.token_evidence(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tag"), F.explode(words()).alias("token")), weights, 30.0)


@query("listed_siblings", """WITH c AS (SELECT s_suppkey AS entity, CASE WHEN s_suppkey % 3 = 0 THEN [] ELSE ['T' || CAST(s_suppkey % 10 AS VARCHAR), 'X'] END AS tickers, 't' || CAST(s_suppkey % 10 AS VARCHAR) AS wanted FROM supplier), r AS (SELECT a.s_suppkey AS entity, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey)
SELECT c.entity, upper(c.wanted) AS ticker, min(o.entity) AS sibling FROM c JOIN r USING (entity) JOIN c o ON r.other = o.entity WHERE len(c.tickers) = 0 AND list_contains(o.tickers, upper(c.wanted)) GROUP BY 1, 2""")
def listed_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers without tickers and a supplier of their nation that lists the ticker asked for."""
    s, ticker = table(spark, sf_dir, "supplier"), (F.col("s_suppkey") % 10).cast("string")
    tickers = F.when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("T"), ticker), F.lit("X")))
    companies = s.select(F.col("s_suppkey").alias("entity"), tickers.alias("tickers"), F.concat(F.lit("t"), ticker).alias("wanted"))
    both = s.select(F.col("s_suppkey").alias("entity"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("other"), "s_nationkey"), "s_nationkey")
    return matching.listed_siblings(companies, both.select("entity", "other"))


@query("latest_point", sql(""", p AS (SELECT entity, tag, CASE status WHEN 'O' THEN 'ns1' ELSE 'ns2' END AS ns, CASE WHEN line < 5 THEN 'USD' ELSE 'EUR' END AS unit, e, filed, k1, line, CAST(val AS DOUBLE) AS val FROM facts WHERE line < 7)
SELECT entity, tag, e AS "end", val FROM (SELECT *, row_number() OVER (PARTITION BY entity, tag ORDER BY ns, unit, e DESC, filed DESC, val DESC) AS r FROM p) WHERE r = 1"""))
def latest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = facts(spark, sf_dir).select("entity", "tag", F.when(F.col("status") == "O", "ns1").otherwise("ns2").alias("ns"), F.when(F.col("line") < 5, "USD").when(F.col("line") < 7, "EUR").otherwise("JPY").alias("unit"), "end", "filed", F.col("val").cast("double").alias("val"))
    return audits.latest_point(df, ["ns1", "ns2"], ["EUR", "USD"])


@query("axis_census", sql(""", d AS (SELECT entity, k1 AS ctx, unnest([{'axis': 'seg', 'member': CASE WHEN line > 4 THEN 'us-gaap:' ELSE 'own:' END || tag}, {'axis': 'cons', 'member': 'srt:' || status}]) AS d FROM facts)
SELECT d.axis AS axis, d.member AS member, count(DISTINCT (entity, ctx)) AS n_contexts, count(DISTINCT entity) AS n_entities, d.member LIKE 'own:%' AS custom FROM d GROUP BY 1, 2, 5"""))
def axis_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = lambda axis, member: F.struct(F.lit(axis).alias("axis"), member.alias("member"))
    own = F.concat(F.when(F.col("line") > 4, "us-gaap:").otherwise("own:"), F.col("tag"))
    return audits.axis_census(facts(spark, sf_dir).select("entity", F.col("k1").alias("ctx"), F.array(dim("seg", own), dim("cons", F.concat(F.lit("srt:"), F.col("status")))).alias("dims")))


@query("scalar_labels", """WITH p AS (SELECT p_partkey, p_size, p_type, p_brand, p_retailprice, 'own:' || upper(p_type[1]) || lower(p_type[2:]) || 'USAWest' || CASE WHEN p_size % 3 = 0 THEN 'SegmentsMember' WHEN p_size % 3 = 1 THEN 'SegmentMember' ELSE 'Member' END AS q FROM part)
SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS padded, CAST(p_partkey AS VARCHAR) AS plain, lower(p_type) || 'usawest' AS member,
  upper(p_type[1]) || lower(p_type[2:]) || ' USA West' AS spaced, CASE WHEN p_size % 2 = 0 THEN 'custom' ELSE 'us-gaap:X' END AS masked,
  CASE WHEN p_size % 2 = 0 THEN 'Class B2' ELSE 'Preferred' END AS class, CASE WHEN p_size % 2 = 0 THEN 'b2' ELSE 'preferred' END AS class_key, '2024-03-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') || '#Q' AS key, make_date(2024, 3, CAST(p_size % 28 + 1 AS INTEGER)) AS day, 'Q' AS kind,
  p_size BETWEEN 2 AND 50 AS clean, CASE p_size % 5 WHEN 0 THEN 'zero' WHEN 1 THEN 'carry' WHEN 2 THEN 'approx' WHEN 3 THEN 'derive' ELSE 'q4' END AS estimate, CASE WHEN p_size > 10 THEN printf('%.1f%%', 100.0 * p_size / 64) ELSE '-' END AS pct, CASE WHEN p_size > 20 THEN printf('%.1fB', p_size / 8.0) ELSE printf('%.0fM', p_size * 1.0) END AS money,
  CASE WHEN p_size % 3 = 0 THEN 'USD/shares,TWD/shares' WHEN p_size % 3 = 1 THEN 'shares' ELSE 'USD' END AS units, abs(p_size - 20) <= 30 AS year_end FROM p""")
def scalar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, names, labels and notes, made of part names and sizes."""
    n, size = F.col("p_partkey"), F.col("p_size")
    kind = F.concat(F.upper(F.substring("p_type", 1, 1)), F.lower(F.substr("p_type", F.lit(2))))
    q = F.concat(F.lit("own:"), kind, F.lit("USAWest"), F.when(size % 3 == 0, "SegmentsMember").when(size % 3 == 1, "SegmentMember").otherwise("Member"))
    even = size % 2 == 0
    share = F.when(even, "own:CommonClassB2Member").otherwise("us-gaap:PreferredMember")
    key = calendar.segment_key(F.make_date(F.lit(2024), F.lit(3), (size % 28 + 1).cast("int")), F.lit("Q"))
    day, k = calendar.split_segment_key(key)
    source = F.element_at(F.array(*map(F.lit, ("zero fill", "carried on", "approx.", "derived", "plain"))), (size % 5 + 1).cast("int"))
    end = F.date_add(F.lit("2023-12-31").cast("date"), (size - 20).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.pad_cik(n).alias("padded"), scalars.unpad_cik(scalars.pad_cik(n)).alias("plain"), scalars.member_key(q).alias("member"), scalars.spaced_name(q).alias("spaced"),
        scalars.custom_masked(F.when(even, "own:X").otherwise("us-gaap:X")).alias("masked"), scalars.class_label(share).alias("class"), labels.class_words(share).alias("class_key"), key.alias("key"), day.alias("day"), k.alias("kind"),
        scalars.clean_ratio(size.cast("double") + 0.001, F.lit(1.0)).alias("clean"), scalars.estimate_kind(source).alias("estimate"), labels.percent(F.when(size > 10, size).otherwise(0), F.when(size > 10, 64).otherwise(0)).alias("pct"),
        labels.amount(F.when(size > 20, size / 8.0 * 1e9).otherwise(size * 1e6)).alias("money"), F.array_join(labels.preferred_units(F.when(size % 3 == 0, "USD/shares").when(size % 3 == 1, "shares").otherwise("pure")), ",").alias("units"), (F.abs(F.date_diff(end, F.lit("2023-12-31").cast("date"))) <= 30).alias("year_end"),
    )


@query("keywords_and_notes", """SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(p_name, '[A-Za-z]+'), lambda w: length(w) > 3 AND lower(w) NOT IN ('green', 'large')), ' ') AS words,
  CASE WHEN p_size % 2 = 0 THEN CASE p_size % 6 WHEN 0 THEN 'computed from other items: ' || p_brand WHEN 2 THEN 'carried on from the period before' ELSE 'not reported, taken as nought' END ELSE 'as reported' END AS note FROM part""")
def keywords_and_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 6 == 0, "derive").when(F.col("p_size") % 6 == 2, "carry").otherwise("zero")
    words = labels.keywords(F.col("p_name"), ("green", "large"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(words, " ").alias("words"), labels.origin_note(F.col("p_size") % 2 == 0, kind, F.col("p_brand")).alias("note"))


@query("percentiles_and_medians", sql(""", v AS (SELECT entity, list_sort(list(CAST(val AS DOUBLE))) AS l, median(CAST(val AS DOUBLE)) AS m FROM facts GROUP BY 1) SELECT entity, l[least(len(l) - 1, CAST(floor(len(l) * 0.9) AS BIGINT)) + 1] AS p90, m AS median FROM v"""))
def percentiles_and_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = facts(spark, sf_dir).select("entity", F.col("val").cast("double").alias("v"))
    return audits.at_ranks(values, ["entity"], "v", 0.9).withColumnRenamed("percentile", "p90")


@query("vocabulary_and_kin", """WITH c AS (SELECT p_type, string_agg(DISTINCT w, ' ' ORDER BY w) AS tokens FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size > 3) GROUP BY 1), k AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS kin FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_size = 1)
SELECT 'concept' AS what, p_type AS name, tokens AS value FROM c UNION ALL SELECT 'kin', p_name, kin FROM (SELECT p_name, kin, row_number() OVER (PARTITION BY p_name ORDER BY length(kin) DESC, kin DESC) AS r FROM (SELECT DISTINCT p_name FROM part) JOIN k ON starts_with(p_name, kin) AND p_name <> kin) WHERE r = 1""")
def vocabulary_and_kin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each part type, and the known name that a part name begins with."""
    part = table(spark, sf_dir, "part")
    words = audits.vocabulary(part.select(F.col("p_type").alias("concept"), F.split("p_name", " ").alias("tokens"), (F.col("p_size") <= 3).alias("internal")))
    known = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("tag")).unionByName(part.where("p_size = 1").select(F.col("p_name").alias("tag"))).distinct()
    kin = audits.kin_tags(part.select(F.col("p_name").alias("tag")), known)
    return words.select(F.lit("concept").alias("what"), F.col("concept").alias("name"), F.array_join("tokens", " ").alias("value")).unionByName(kin.select(F.lit("kin").alias("what"), F.col("tag").alias("name"), F.col("kin").alias("value")))
