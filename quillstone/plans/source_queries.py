"""Queries on nested, textual and wide forms of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import calendar
from quillstone.plans.bindings import cells, facts, sql, table
from quillstone.plans.registry import query
from quillstone.sources import filings, sinks


@query("json_map_explode", """SELECT event_id, k AS name, CAST(json_extract_string(props, '$.' || k) AS BIGINT) AS val FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def json_map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each event's JSON object."""
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "val"))


@query("company_facts_explode", sql(""", c AS (SELECT entity, tag, e, val, filed, row_number() OVER (PARTITION BY entity, tag ORDER BY e, filed, k1, line, val) - 1 AS pos FROM facts) SELECT entity AS cik, tag, pos, e AS "end", CAST(val AS DOUBLE) AS val, filed FROM c"""))
def company_facts_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents, one for each supplier and year, taken apart into points again, which are counted on over the years of a tag."""
    point = F.struct("end", "filed", "k1", "line", F.col("val").cast("double").alias("val"))
    lists = facts(spark, sf_dir).groupBy("entity", F.year("end").alias("year"), "tag").agg(F.array_sort(F.collect_list(point)).alias("p"))
    shaped = F.transform("p", lambda x: F.struct(F.lit(None).cast("date").alias("start"), x["end"].alias("end"), x["val"].alias("val"), F.lit(None).cast("int").alias("fy"), F.lit(None).cast("string").alias("fp"), F.lit("10-Q").alias("form"), x["filed"].alias("filed"), F.lit(None).cast("string").alias("frame")))
    units = F.struct(F.create_map(F.lit("USD"), shaped).alias("units"))
    docs = lists.groupBy(F.col("entity").alias("cik"), "year").agg(F.map_from_entries(F.collect_list(F.struct("tag", units.alias("u")))).alias("t")).select("cik", F.lit("").alias("entityName"), F.create_map(F.lit("us-gaap"), "t").alias("facts"))
    text = docs.select(F.to_json(F.struct("cik", "entityName", "facts")).alias("j"))
    raw = text.select(F.from_json("j", filings.COMPANY_FACTS).alias("d")).select("d.*")
    points = filings.exploded_facts(raw)
    sizes = facts(spark, sf_dir).groupBy(F.col("entity").alias("e"), F.col("tag").alias("t"), F.year("end").alias("y")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("e", "t").orderBy(F.asc_nulls_last("y")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("e", "t", "y", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = points.join(before, (F.col("cik") == F.col("e")) & (F.col("tag") == F.col("t")) & F.year("end").eqNullSafe(F.col("y")))
    return placed.select("cik", "tag", (F.col("before") + F.col("pos")).alias("pos"), "end", "val", "filed")


@query("parallel_arrays_inline", """SELECT o_custkey AS entity, o_orderkey, form, CAST(o_orderdate AS DATE) AS filing_date, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS report_date, form LIKE '%/A' AS amended,
'/Archives/edgar/data/' || o_custkey || '/' || o_orderkey || '/' || o_orderpriority || '.htm' AS url FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN '10-K' ELSE '10-Q/A' END AS form FROM orders)""")
def parallel_arrays_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of parallel arrays, one for each customer and year, as rows of filings again; a dash in each order's number goes from its address."""
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    form = F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q/A")
    each = F.struct(form.alias("form"), day.alias("day"), F.concat(key.substr(1, 1), F.lit("-"), key.substr(F.lit(2), F.length(key))).alias("number"), F.concat("o_orderpriority", F.lit(".htm")).alias("document"), F.when(F.col("o_orderkey") % 3 > 0, day).otherwise("").alias("report"))
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate")).agg(F.collect_list(each).alias("x"))
    recent = F.struct(F.col("x.form").alias("form"), F.col("x.day").alias("filingDate"), F.col("x.number").alias("accessionNumber"), F.col("x.document").alias("primaryDocument"), F.col("x.report").alias("reportDate"))
    raw = lists.select(F.col("o_custkey").cast("string").alias("cik"), F.lit("").alias("name"), F.lit("1231").alias("fiscalYearEnd"), F.struct(recent.alias("recent")).alias("filings"))
    number = F.translate("accession", "-", "").cast("bigint").alias("o_orderkey")
    return filings.listed_filings(raw).select(F.col("cik").alias("entity"), number, "form", "filing_date", "report_date", "amended", "url")


@query("regex_context_scan", """SELECT page_id, CAST(len(h) AS BIGINT) AS n_links, CAST(len(list_distinct(h)) AS BIGINT) AS n_targets, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM (SELECT page_id, html, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)""")
def regex_context_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and title of each page by regular expressions."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.size(F.array_distinct(links)).cast("long").alias("n_targets"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


_QUARTERS = ["q1", "q2", "q3", "q4"]


@query("pivot_grid", sql("SELECT entity, tag, CAST(fy AS BIGINT) AS fy, " + ", ".join(f"CAST(max(CASE WHEN q = {k} THEN val END) AS DOUBLE) AS q{k}" for k in range(1, 5)) + " FROM latest GROUP BY ALL"))
def pivot_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each year of a tag, a column for each of its quarters."""
    df = cells(spark, sf_dir).select("entity", "tag", F.col("fy").cast("long").alias("fy"), F.concat(F.lit("q"), F.col("q").cast("string")).alias("period"), F.col("val").cast("double").alias("value"))
    return sinks.statement(df, ["entity", "tag", "fy"], _QUARTERS)


@query("unpivot_raw", sql("SELECT entity, tag, CAST(fy AS BIGINT) AS fy, 'q' || CAST(q AS VARCHAR) AS period, CAST(val AS DOUBLE) AS value FROM latest"))
def unpivot_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide statement as a long table again."""
    return sinks.long_cells(pivot_grid(spark, sf_dir), ["entity", "tag", "fy"], _QUARTERS)


@query("statement_csv", """WITH f AS (SELECT p_partkey, p_name, p_brand, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END AS s FROM part) SELECT CAST(p_partkey AS VARCHAR) || ',' || p_name || ',' || chr(34) || p_brand || ', ' || chr(34) || chr(34) || 'x' || chr(34) || chr(34) || chr(34) || ',' || coalesce(s, 'n/a') AS line FROM f""")
def statement_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat("p_brand", F.lit(', "x"')).alias("b"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("s"))
    return sinks.csv_lines(df, ["p_partkey", "p_name", "b", "s"])


@query("cache_keys", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS cache_key FROM pages")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sinks.safe_key(F.col("url")).alias("cache_key"))


@query("upsert_rows", """WITH old AS (SELECT o_custkey AS entity, max(o_totalprice) AS v, 'old' AS origin FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), new AS (SELECT o_custkey AS entity, max(o_totalprice) AS v, 'new' AS origin FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE entity NOT IN (SELECT entity FROM new)""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer rows, and the older ones of customers that have none."""
    o = table(spark, sf_dir, "orders")
    cut = F.col("o_orderdate") < F.expr("timestamp_ntz '1998-01-01 00:00:00'")
    old = o.where(cut).groupBy(F.col("o_custkey").alias("entity")).agg(F.max("o_totalprice").alias("v")).withColumn("origin", F.lit("old"))
    new = o.where(~cut).groupBy(F.col("o_custkey").alias("entity")).agg(F.max("o_totalprice").alias("v")).withColumn("origin", F.lit("new"))
    return sinks.upserted(old, new, ["entity"])


@query("unpacked_lists", """WITH p AS (SELECT c_custkey AS entity, CAST(c_nationkey % 4 AS VARCHAR) || ',' || CAST(c_nationkey % 6 AS VARCHAR) AS packed FROM customer), i AS (SELECT entity, CAST(unnest(string_split(packed, ',')) AS INTEGER) AS i FROM p)
SELECT entity, ['cash', 'inventory', 'goodwill', 'equity', 'revenue', 'capex'][i + 1] AS concept FROM i""")
def unpacked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.concat_ws(",", (F.col("c_nationkey") % 4).cast("string"), (F.col("c_nationkey") % 6).cast("string")).alias("packed"))
    return filings.unpacked(df, "packed", ["cash", "inventory", "goodwill", "equity", "revenue", "capex"])


@query("event_days", "SELECT event_id, CAST(ts AS DATE) AS d FROM events")
def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates from epoch seconds."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", calendar.epoch_date(seconds).alias("d"))


@query("windowed_events", """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and type, by the same code as the stream's."""
    from quillstone.streaming.restatements import windowed_counts

    df = windowed_counts(table(spark, sf_dir, "events"))
    return df.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))


