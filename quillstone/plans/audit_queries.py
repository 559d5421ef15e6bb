"""Queries of market-wide audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import scalars
from quillstone.operators import audits
from quillstone.plans.bindings import facts, grid, sql, table
from quillstone.plans.registry import query

_WORDS = "w AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'))) AS token FROM documents)"


def _lowered(text: Column) -> Column:
    """Small letters as the SQL makes them: a dotted capital I becomes a plain i, which F.lower gives a dot of its own that cuts words."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _lowered(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z]+)"), F.lit(1))).alias("tokens"))


@query("token_idf", f"WITH {_WORDS}, n AS (SELECT count(DISTINCT doc_id) AS n FROM w) SELECT token, count(*) AS df, round(ln((SELECT n FROM n) / count(*)), 6) AS idf FROM (SELECT DISTINCT doc_id, token FROM w) GROUP BY 1")
def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents a word occurs, and its weight."""
    told = F.col("text").rlike("[A-Za-z\u0130\u212a]")  # what becomes a letter of [a-z]
    return audits.token_weights(_words(spark, sf_dir), "doc_id", "tokens", told).select("token", "df", F.round("idf", 6).alias("idf"))


@query("tag_scoring", """WITH c AS (SELECT item_id AS concept, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS token FROM benchmark),
n AS (SELECT count(DISTINCT concept) AS n FROM c), i AS (SELECT token, ln((SELECT n FROM n) / count(*)) AS idf FROM c GROUP BY 1),
t AS (SELECT DISTINCT doc_id AS tag, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS token FROM documents),
s AS (SELECT t.tag, c.concept, sum(i.idf) AS score FROM t JOIN c USING (token) JOIN i USING (token) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY tag ORDER BY score DESC, concept))
SELECT tag, concept, round(score, 4) AS score FROM r WHERE r = 1 AND score >= 40.0 AND (second IS NULL OR score >= second * 2)""")
def tag_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark item whose weighted words a document shares most of, if that is clear."""
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("concept"), F.regexp_extract_all(_lowered(F.col("text")), F.lit("([a-z]+)"), F.lit(1)).alias("tokens"))
    docs = _words(spark, sf_dir).select(F.col("doc_id").alias("tag"), "tokens")
    return audits.score_tags(docs, item, 40.0, 2.0).select("tag", "concept", F.round("score", 4).alias("score"))


@query("cooccurrence", sql(""", d AS (SELECT DISTINCT entity, form AS stmt, tag AS concept FROM facts WHERE status = 'F'), w AS (SELECT DISTINCT entity, form AS stmt, CAST(line AS VARCHAR) AS tag, tag AS concept FROM facts WHERE status = 'O'),
c AS (SELECT w.tag, w.concept, sum(CASE WHEN d.entity IS NOT NULL THEN 1 ELSE 0 END) AS b, sum(CASE WHEN d.entity IS NULL THEN 1 ELSE 0 END) AS a FROM w LEFT JOIN d ON w.entity = d.entity AND w.stmt = d.stmt AND w.concept = d.concept GROUP BY 1, 2)
SELECT tag, concept, CAST(b AS BIGINT) AS n_both, CAST(a AS BIGINT) AS n_alone, round(b / (a + b), 6) AS rate, a + b >= 30 AND b / (a + b) >= 0.5 AS revoked FROM c"""))
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = facts(spark, sf_dir)
    direct = df.where("status = 'F'").select("entity", F.col("form").alias("stmt"), F.col("tag").alias("concept"))
    weak = df.where("status = 'O'").select("entity", F.col("form").alias("stmt"), F.col("line").cast("string").alias("tag"), F.col("tag").alias("concept"))
    return audits.cooccurrence(direct, weak).withColumn("rate", F.round("rate", 6))


_HITS = """h AS (SELECT DISTINCT l_suppkey AS entity, p_brand || '/' || p_type || '/' || CAST(p_size AS VARCHAR) AS concept FROM lineitem JOIN part ON l_partkey = p_partkey), u AS (SELECT s_suppkey AS entity, s_nationkey % 4 AS grp FROM supplier)"""


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    hits = items.select(F.col("l_suppkey").alias("entity"), F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("concept"))
    return hits, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), (F.col("s_nationkey") % 4).alias("grp"))


_RATES = _HITS + """, n AS (SELECT grp, count(DISTINCT entity) AS n_all FROM u GROUP BY 1), r AS (SELECT u.grp, h.concept, count(*) AS n_hit, n.n_all, count(*) / n.n_all AS rate FROM h JOIN u USING (entity) JOIN n USING (grp) GROUP BY 1, 2, 4)"""


@query("coverage_by_group", f"WITH {_RATES} SELECT CAST(grp AS BIGINT) AS grp, concept, n_hit, n_all, round(rate, 6) AS rate FROM r")
def coverage_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.coverage(*_hits(spark, sf_dir), ["grp"]).select(F.col("grp").cast("long").alias("grp"), "concept", "n_hit", "n_all", F.round("rate", 6).alias("rate"))


@query("set_ops_universal", f"WITH {_RATES} SELECT concept FROM r WHERE rate >= 0.5 GROUP BY 1 HAVING count(DISTINCT grp) = (SELECT count(DISTINCT grp) FROM r)")
def set_ops_universal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of parts that half of the suppliers of every group have delivered."""
    return audits.universal(audits.coverage(*_hits(spark, sf_dir), ["grp"]), "grp", 0.5)


@query("industry_applicability", f"WITH {_RATES} SELECT CAST(grp AS VARCHAR) AS grp, concept, rate < 0.6 AS structural FROM r WHERE n_all >= 5 AND rate < 0.7")
def industry_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = audits.coverage(*_hits(spark, sf_dir), ["grp"]).withColumn("grp", F.col("grp").cast("string"))
    return audits.industry_applicability(rates, "grp", 5, 0.7, 0.6)


@query("missing_grid", f"WITH {_HITS}, c AS (SELECT DISTINCT concept FROM h) SELECT u.entity, c.concept FROM u CROSS JOIN c EXCEPT SELECT entity, concept FROM h")
def missing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, universe = _hits(spark, sf_dir)
    return audits.missing_pairs(universe, hits.select("concept"), hits)


@query("grouping_sets_missing", sql(""", c AS (SELECT tag AS concept, entity % 3 AS sector, entity % 7 AS industry, CASE WHEN val IS NULL THEN 1 ELSE 0 END AS missing FROM grid),
g AS (SELECT concept, sector, industry, grouping(sector) AS ns, count(*) AS n, sum(missing) AS m FROM c GROUP BY GROUPING SETS ((concept, sector), (concept, industry)))
SELECT CASE WHEN ns = 0 THEN 'sector' ELSE 'industry' END AS level, CASE WHEN ns = 0 THEN CAST(sector AS VARCHAR) ELSE CAST(industry AS VARCHAR) END AS name, concept, n, CAST(m AS BIGINT) AS n_missing, round(m / n, 6) AS rate FROM g WHERE n >= CASE WHEN ns = 0 THEN 8 ELSE 5 END AND m / n >= 0.6""", fine=True))
def grouping_sets_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = grid(spark, sf_dir, True).select(F.col("tag").alias("concept"), (F.col("entity") % 3).alias("sector"), (F.col("entity") % 7).alias("industry"), F.col("val").isNull().cast("int").alias("missing"))
    return audits.structural_missing(df, "sector", "industry", 0.6).withColumn("rate", F.round("rate", 6))


@query("three_state_counts", sql(""", s AS (SELECT entity, tag, CASE WHEN val IS NOT NULL THEN val > 30000 END AS state FROM grid) SELECT entity, CAST(count(*) FILTER (state) AS BIGINT) AS n_ok, CAST(count(*) FILTER (NOT state) AS BIGINT) AS n_bad, CAST(count(*) FILTER (state IS NULL) AS BIGINT) AS n_unknown FROM s GROUP BY 1""", fine=True))
def three_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = grid(spark, sf_dir, True).withColumn("state", F.col("val") > 30000)
    return audits.state_counts(df, ["entity"], "state")


@query("topk_candidates", """WITH r AS (SELECT p_brand, p_partkey, p_name, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, length(p_name), p_partkey) AS rank FROM part) SELECT * FROM r WHERE rank <= 5""")
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_retailprice")
    return audits.best_candidates(df, "p_brand", [F.desc("p_retailprice"), F.length("p_name"), F.col("p_partkey")]).withColumn("rank", F.col("rank").cast("long"))


@query("stratified_round_robin", "SELECT c_custkey, c_mktsegment, turn FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR) || '/7'), c_custkey) AS turn FROM customer) ORDER BY turn, c_mktsegment LIMIT 50")
def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty customers, one of each market segment in turn."""
    return audits.round_robin(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 50, 7).withColumn("turn", F.col("turn").cast("long"))


@query("tag_popularity", sql("SELECT form, line, count(DISTINCT entity) AS n_entities FROM facts GROUP BY 1, 2 HAVING count(DISTINCT entity) >= 3"))
def tag_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.popular(facts(spark, sf_dir), ["form", "line"], "entity", 3)


@query("enough_evidence", sql(""", p AS (SELECT entity, tag AS stmt, count(DISTINCT part) AS n FROM facts GROUP BY 1, 2) SELECT entity FROM p GROUP BY 1 HAVING min(n) >= 180 AND count(*) = 3"""))
def enough_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = facts(spark, sf_dir).select("entity", F.col("tag").alias("stmt"), F.col("part").alias("tag"))
    return audits.enough_evidence(df, 180)


@query("count_histogram", "SELECT n_rows, count(*) AS n_keys FROM (SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY 1) GROUP BY 1")
def count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.histogram(table(spark, sf_dir, "orders"), "o_custkey")


@query("masked_patterns", """SELECT pattern, n_entities, amount, CAST(row_number() OVER (ORDER BY n_entities DESC, amount DESC, pattern) AS BIGINT) AS rank FROM (SELECT regexp_replace(url, '[0-9]', '#', 'g') AS pattern, count(DISTINCT page_id) AS n_entities, CAST(sum(length(html)) AS BIGINT) AS amount FROM pages GROUP BY 1)""")
def masked_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").withColumn("size", F.char_length("html"))
    return audits.patterns(df, scalars.digits_masked(F.col("url")), "page_id", "size").withColumn("rank", F.col("rank").cast("long"))


@query("missing_metrics", sql(""", w AS (SELECT entity, idx, max(CASE WHEN tag = 'A' THEN val END) AS a, max(CASE WHEN tag = 'N' THEN val END) AS n, max(CASE WHEN tag = 'R' THEN val END) AS r FROM grid GROUP BY 1, 2)
SELECT entity, 'a' AS metric, CAST(count(*) FILTER (a IS NULL) AS BIGINT) AS n_missing, count(*) AS n_all FROM w GROUP BY 1 UNION ALL SELECT entity, 'n', CAST(count(*) FILTER (n IS NULL) AS BIGINT), count(*) FROM w GROUP BY 1 UNION ALL SELECT entity, 'r', CAST(count(*) FILTER (r IS NULL) AS BIGINT), count(*) FROM w GROUP BY 1"""))
def missing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = grid(spark, sf_dir).groupBy("entity", "idx").agg(*(F.max(F.when(F.col("tag") == t, F.col("val"))).alias(t.lower()) for t in "ANR"))
    return audits.metric_status(wide, ["a", "n", "r"], ["entity"])


@query("name_tokens", """SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(name, '[A-Z]+[a-z]*|[a-z]+|[0-9]+'), lambda x: lower(x))), lambda x: x NOT IN ('xml', 'of'))), ' ') AS tokens FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '') || 'Of' || CAST(p_size AS VARCHAR) AS name FROM part)""")
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of part names written in CamelCase, without stop words."""
    camel = F.concat(F.array_join(F.transform(F.split("p_name", " "), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), ""), F.lit("Of"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(scalars.name_tokens(camel, ("xml", "of"))), " ").alias("tokens"))
