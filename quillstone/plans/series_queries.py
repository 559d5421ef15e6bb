"""Queries over the periods of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import formulas
from quillstone.operators import repairs, series, valuation
from quillstone.plans.bindings import grid, sql, table
from quillstone.plans.registry import query

KEY = ["entity", "tag"]
_W = "WINDOW w AS (PARTITION BY entity, tag ORDER BY idx)"


def _rows(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select("entity", "tag", F.col("idx").cast("long").alias("idx"), *columns)


def _dbl(df: DataFrame) -> DataFrame:
    return df.withColumn("val", F.col("val").cast("double"))


@query("growth_rates", sql(f"""SELECT entity, tag, CAST(idx AS BIGINT) AS idx, round(CASE WHEN y > 0 THEN v / y - 1 END, 6) AS yoy, round(CASE WHEN p > 0 THEN v / p - 1 END, 6) AS qoq
FROM (SELECT entity, tag, idx, CAST(val AS DOUBLE) AS v, CAST(lag(val, 4) OVER w AS DOUBLE) AS y, CAST(lag(val, 1) OVER w AS DOUBLE) AS p FROM grid {_W})"""))
def growth_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _dbl(grid(spark, sf_dir))
    return _rows(df, F.round(series.growth(KEY, "val", 4), 6).alias("yoy"), F.round(series.growth(KEY, "val", 1), 6).alias("qoq"))


@query("average_balance", sql(f"""SELECT entity, tag, CAST(idx AS BIGINT) AS idx, round(CASE WHEN idx = 1 THEN v ELSE (v + p) / 2 END, 4) AS balance FROM (SELECT *, CAST(val AS DOUBLE) AS v, CAST(lag(val) OVER w AS DOUBLE) AS p FROM grid {_W})"""))
def average_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_dbl(grid(spark, sf_dir)), F.round(series.average_balance(KEY, "val"), 4).alias("balance"))


@query("carry_forward_limit3", sql(f"""SELECT entity, tag, CAST(idx AS BIGINT) AS idx, CAST(v AS DOUBLE) AS val, val IS NULL AND v IS NOT NULL AS carried FROM (
  SELECT *, CASE WHEN count(val) OVER (PARTITION BY entity, tag) >= 2 THEN last_value(val IGNORE NULLS) OVER (PARTITION BY entity, tag ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) ELSE val END AS v FROM grid)""", fine=True))
def carry_forward_limit3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = repairs.carry_forward(grid(spark, sf_dir, True), KEY, ["val"])
    return _rows(df, F.col("val").cast("double").alias("val"), F.col("val_carried").alias("carried"))


@query("ratio_vs_own_median", sql("""SELECT entity, tag, CAST(idx AS BIGINT) AS idx, round(v / median(v) OVER (PARTITION BY entity, tag), 6) AS ratio FROM (SELECT *, CAST(val AS DOUBLE) AS v FROM grid)"""))
def ratio_vs_own_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_dbl(grid(spark, sf_dir)), F.round(series.over_own_median(KEY, "val"), 6).alias("ratio"))


@query("outlier_values", sql(""", g AS MATERIALIZED (SELECT entity, tag, idx, v, count(v) OVER (PARTITION BY entity, tag ORDER BY idx DESC) AS r, count(v) OVER (PARTITION BY entity, tag) AS n FROM (SELECT entity, tag, idx, CAST(val AS DOUBLE) * CASE WHEN idx % 7 = 0 THEN 1000 ELSE 1 END AS v FROM grid)),
m AS (SELECT entity, tag, CASE WHEN count(*) >= 3 THEN list_sort(list(v))[count(*) // 2 + 1] END AS m FROM g WHERE v IS NOT NULL AND r <= 4 GROUP BY 1, 2)
SELECT g.entity, g.tag, CAST(g.idx AS BIGINT) AS idx, CASE WHEN m IS NULL OR (v / m <= 100 AND v / m >= 0.01) THEN v END AS val FROM g JOIN m ON g.entity = m.entity AND g.tag = m.tag WHERE n > 0""", fine=True))
def outlier_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values a hundred times off the upper middle of the last four are dropped; every seventh period is inflated for it."""
    df = _dbl(grid(spark, sf_dir, True)).withColumn("val", F.col("val") * F.when(F.col("idx") % 7 == 0, 1000).otherwise(1))
    seen = df.groupBy(*KEY).agg(F.count("val").alias("n")).where("n > 0").select(*KEY)
    return _rows(series.without_outliers(df.join(seen, KEY, "left_semi"), KEY, "val"), F.col("val"))


@query("ipo_jump_cut", sql("""SELECT entity, tag, CAST(idx AS BIGINT) AS idx, v AS val FROM (SELECT *, min(CASE WHEN n <= 9 AND v >= 2.5 * p AND p < 0.4 * latest THEN idx END) OVER (PARTITION BY entity, tag) AS cut FROM (
  SELECT entity, tag, idx, CAST(val AS DOUBLE) AS v, CAST(last_value(val IGNORE NULLS) OVER (PARTITION BY entity, tag ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS p, count(val) OVER w AS n, CAST(last_value(val IGNORE NULLS) OVER (PARTITION BY entity, tag ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS DOUBLE) AS latest
  FROM grid WINDOW w AS (PARTITION BY entity, tag ORDER BY idx))) WHERE cut IS NULL OR idx >= cut""", fine=True))
def ipo_jump_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(series.before_listing(_dbl(grid(spark, sf_dir, True)), KEY, "val"), F.col("val"))


@query("interior_holes", sql("""SELECT entity, tag, CAST(first_idx AS BIGINT) AS first_idx, CAST(last_idx AS BIGINT) AS last_idx, n_present, CAST(n_holes AS BIGINT) AS n_holes,
  CASE WHEN n_present = 0 THEN 'none' WHEN n_holes > 0 THEN 'interior' WHEN first_idx > lo AND last_idx < hi THEN 'both ends' WHEN first_idx > lo THEN 'oldest only' WHEN last_idx < hi THEN 'newest only' ELSE 'complete' END AS shape
FROM (SELECT *, coalesce(last_idx - first_idx + 1 - n_present, 0) AS n_holes FROM (SELECT entity, tag, min(CASE WHEN val IS NOT NULL THEN idx END) AS first_idx, max(CASE WHEN val IS NOT NULL THEN idx END) AS last_idx, count(val) AS n_present, min(idx) AS lo, max(idx) AS hi FROM grid GROUP BY 1, 2))""", fine=True))
def interior_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.holes(grid(spark, sf_dir, True), KEY, "val")
    return df.select(*KEY, F.col("first_idx").cast("long").alias("first_idx"), F.col("last_idx").cast("long").alias("last_idx"), "n_present", F.col("n_holes").cast("long").alias("n_holes"), "shape")


@query("staleness_runs", sql("""SELECT entity, tag, CAST(max(lag) AS BIGINT) AS longest, CAST(sum(CASE WHEN lag > 3 THEN 1 ELSE 0 END) AS BIGINT) AS beyond
FROM (SELECT entity, tag, idx - max(CASE WHEN val IS NOT NULL THEN idx END) OVER (PARTITION BY entity, tag ORDER BY idx) AS lag FROM grid) GROUP BY 1, 2""", fine=True))
def staleness_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = grid(spark, sf_dir, True).withColumn("lag", series.staleness(KEY, F.col("val").isNotNull()))
    return df.groupBy(*KEY).agg(F.max("lag").cast("long").alias("longest"), F.count_if(F.col("lag") > 3).alias("beyond"))


_DAILY = """WITH p AS (SELECT user_id AS entity, CAST(ts AS DATE) AS d, CAST(max(value) AS DOUBLE) + 1 AS v FROM events GROUP BY 1, 2),
n AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a, lag(d) OVER w AS bd, lead(d) OVER w AS ad FROM p WINDOW w AS (PARTITION BY entity ORDER BY d))"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("d")).agg((F.max("value").cast("double") + 1).alias("v"))


@query("spike_filter", _DAILY + """ SELECT entity, d, v FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS m FROM n) WHERE m < 3 OR NOT coalesce(
  (greatest(v / b, b / v) >= 1.6 AND greatest(v / a, a / v) >= 1.6 AND greatest(b / a, a / b) < 1.25 AND a IS NOT NULL AND b IS NOT NULL)
  OR ((a IS NULL OR b IS NULL) AND greatest(v / coalesce(b, a), coalesce(b, a) / v) >= 2.5 AND coalesce(ad - d, d - bd) >= 200), false)""")
def spike_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _daily(spark, sf_dir)
    return df.withColumn("_spike", series.is_spike(["entity"], "v", "d")).where("not _spike").drop("_spike")


@query("stale_value_filter", """WITH p AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS d, CAST(floor(max(o_totalprice) / 100000) AS DOUBLE) + 1 AS v FROM orders GROUP BY 1, 2),
pairs AS (SELECT x.entity, x.d, max(y.d) AS back FROM p x JOIN p y ON x.entity = y.entity AND y.d > x.d + 400 AND y.v = x.v GROUP BY 1, 2),
stale AS (SELECT DISTINCT b.entity, b.d FROM pairs b JOIN p x ON x.entity = b.entity AND x.d = b.d JOIN p z ON z.entity = b.entity AND z.d > b.d AND z.d < b.back AND abs(z.v / x.v - 1) > 0.05)
SELECT p.entity, p.d, p.v FROM p LEFT JOIN stale s ON p.entity = s.entity AND p.d = s.d WHERE s.d IS NULL""")
def stale_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("d")).agg((F.floor(F.max("o_totalprice") / 100000).cast("double") + 1).alias("v"))
    return series.stale_points(df, ["entity"], "v", "d")


@query("one_basis", _DAILY + " SELECT entity, coalesce(max(greatest(v / b, b / v)) < 4, true) AS one_basis FROM n GROUP BY 1")
def one_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _daily(spark, sf_dir).withColumn("ok", series.one_basis(["entity"], "v", "d"))
    return df.groupBy("entity").agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("one_basis"))


@query("clamp_with_lookback", sql("SELECT entity, tag, CAST(idx AS BIGINT) AS idx, CAST(val AS DOUBLE) AS val, idx < 12 AS is_lookback FROM grid WHERE idx BETWEEN 8 AND 20"))
def clamp_with_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(series.clamp(grid(spark, sf_dir), 12, 20, 4), F.col("val").cast("double").alias("val"), F.col("is_lookback"))


_WIDE = """, w AS (SELECT entity, idx, CAST(max(CASE WHEN tag = 'A' THEN val END) AS DOUBLE) AS revenue, CAST(max(CASE WHEN tag = 'N' THEN val END) AS DOUBLE) AS cogs, CAST(max(CASE WHEN tag = 'R' THEN val END) AS DOUBLE) AS equity FROM grid GROUP BY 1, 2)"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = {"revenue": "A", "cogs": "N", "equity": "R"}
    return grid(spark, sf_dir).groupBy("entity", "idx").agg(*(F.max(F.when(F.col("tag") == t, F.col("val"))).cast("double").alias(n) for n, t in roles.items()))


@query("derive_expression", sql(_WIDE + """ SELECT entity, CAST(idx AS BIGINT) AS idx, round(revenue - coalesce(cogs, 0) + coalesce(equity, 0), 4) AS gross, round((revenue - cogs) * CASE WHEN equity <> 0 THEN equity END / CASE WHEN revenue <> 0 THEN revenue END, 4) AS mixed, round(revenue * coalesce(cogs / 1000, 1) / coalesce(equity, 1), 4) AS optional FROM (SELECT entity, idx, revenue, CASE WHEN idx % 3 > 0 THEN cogs END AS cogs, CASE WHEN idx % 4 > 0 THEN equity END AS equity FROM w)"""))
def derive_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from left to right, optional terms left out where they are absent."""
    df = _wide(spark, sf_dir).withColumn("cogs", F.when(F.col("idx") % 3 > 0, F.col("cogs"))).withColumn("equity", F.when(F.col("idx") % 4 > 0, F.col("equity"))).withColumn("k", F.col("cogs") / 1000)
    return df.select("entity", F.col("idx").cast("long").alias("idx"), F.round(formulas.derived("revenue - cogs? + equity?"), 4).alias("gross"), F.round(formulas.derived("revenue - cogs * equity / revenue"), 4).alias("mixed"), F.round(formulas.derived("revenue * k? / equity?"), 4).alias("optional"))


@query("fill_derived", sql(_WIDE + """ SELECT entity, CAST(idx AS BIGINT) AS idx, round(coalesce(equity, revenue - cogs), 4) AS equity, equity IS NULL AND revenue - cogs IS NOT NULL AS equity_derived FROM w"""))
def fill_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = formulas.fill_derived(_wide(spark, sf_dir), [("equity", "revenue - cogs")])
    return df.select("entity", F.col("idx").cast("long").alias("idx"), F.round("equity", 4).alias("equity"), "equity_derived")


#: Metrics of the engine; those of names that the tables lack are tested on fixtures.
METRICS = {"gross_margin": "gross_profit / revenue", "gross_profit": "revenue - cogs", "roe": "gross_profit / avg(equity) * 4", "revenue_yoy": "revenue / revenue[t-4] - 1", "days": "equity / revenue * 91.25"}

_METRICS = """, m AS (SELECT *, revenue - cogs AS gp, lag(equity) OVER w1 AS pe, lag(revenue, 4) OVER w1 AS r4, lag(revenue, 1) OVER w1 AS r1, row_number() OVER w1 AS n FROM w WINDOW w1 AS (PARTITION BY entity ORDER BY idx)),
a AS (SELECT *, CASE WHEN n = 1 THEN equity ELSE (equity + pe) / 2 END AS ae FROM m)"""


@query("metric_formula", sql(_WIDE + _METRICS + """ SELECT entity, CAST(idx AS BIGINT) AS idx, round(gp, 4) AS gross_profit, round(gp / nullif(revenue, 0), 6) AS gross_margin, round(gp / nullif(ae, 0) * 4, 6) AS roe, round(revenue / nullif(r4, 0) - 1, 6) AS revenue_yoy, round(equity / nullif(revenue, 0) * 91.25, 4) AS days FROM a"""))
def metric_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = formulas.with_metrics(_wide(spark, sf_dir), METRICS, ["entity"])
    return df.select("entity", F.col("idx").cast("long").alias("idx"), F.round("gross_profit", 4).alias("gross_profit"), F.round("gross_margin", 6).alias("gross_margin"), F.round("roe", 6).alias("roe"), F.round("revenue_yoy", 6).alias("revenue_yoy"), F.round("days", 4).alias("days"))


@query("metric_annual", sql(_WIDE + _METRICS + """ SELECT entity, CAST(idx AS BIGINT) AS idx, round(gp / nullif(ae, 0), 6) AS roe, round(revenue / nullif(r1, 0) - 1, 6) AS revenue_yoy, round(equity / nullif(revenue, 0) * 365, 4) AS days FROM a"""))
def metric_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics where a period is a year."""
    df = formulas.with_metrics(_wide(spark, sf_dir), METRICS, ["entity"], annual=True)
    return df.select("entity", F.col("idx").cast("long").alias("idx"), F.round("roe", 6).alias("roe"), F.round("revenue_yoy", 6).alias("revenue_yoy"), F.round("days", 4).alias("days"))


_VALUED = _WIDE + """, v AS (SELECT *, equity * 2 AS price, revenue / 1000 AS shares FROM w),
c AS (SELECT *, price * shares AS cap, CASE WHEN count(revenue) OVER t = 4 THEN sum(revenue) OVER t END AS rt, CASE WHEN count(cogs) OVER t = 4 THEN sum(cogs) OVER t END AS ct FROM v WINDOW t AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


@query("valuation_multiples", sql(_VALUED + """, z AS (SELECT *, CASE WHEN ct > 0 THEN cap / ct END AS pe, CASE WHEN rt > 0 THEN cap / rt END AS ps, lag(ct, 4) OVER (PARTITION BY entity ORDER BY idx) AS c4 FROM c)
SELECT entity, CAST(idx AS BIGINT) AS idx, round(cap, 2) AS market_cap, round(pe, 6) AS pe, round(ps, 6) AS ps, round(CASE WHEN equity > 0 THEN cap / equity END, 6) AS pb, round(cap + cogs - equity, 2) AS ev,
  round(CASE WHEN CASE WHEN c4 > 0 THEN ct / c4 - 1 END * 100 > 0 THEN pe / ((ct / c4 - 1) * 100) END, 4) AS peg, round(ps / median(ps) OVER (PARTITION BY entity), 6) AS ps_vs_median FROM z"""))
def valuation_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _wide(spark, sf_dir)
    null = F.lit(None).cast("double")
    names = {"price": F.col("equity") * 2, "shares": F.col("revenue") / 1000, "net_income": F.col("cogs"), "cfo": F.col("revenue"), "capex": F.col("cogs"), "operating_income": F.col("revenue"), "dna": F.col("cogs"), "total_liabilities": F.col("cogs"), "cash": F.col("equity"), "short_term_investments": null, "short_term_debt": F.col("cogs"), "long_term_debt": F.col("revenue")}
    out = valuation.multiples(df.withColumns(names), ["entity"])
    return out.select("entity", F.col("idx").cast("long").alias("idx"), F.round("market_cap", 2).alias("market_cap"), *(F.round(c, 6).alias(c) for c in ("pe", "ps", "pb")), F.round("ev", 2).alias("ev"), F.round("peg", 4).alias("peg"), F.round("ps_vs_median", 6).alias("ps_vs_median"))


@query("bounded_zero", sql(_VALUED + """ SELECT entity, CAST(idx AS BIGINT) AS idx, CASE WHEN cap > 0 AND revenue - coalesce(cogs, 0) >= 0 AND (revenue - coalesce(cogs, 0)) / cap <= 0.0005 THEN CAST(0 AS DOUBLE) END AS debt FROM c"""))
def bounded_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent debt is nought where what it could be at most is a small share of the market cap."""
    df = _wide(spark, sf_dir).withColumn("cap", F.col("equity") * 2 * F.col("revenue") / 1000)
    debt = valuation.bounded_zero(F.lit(None).cast("double"), ["revenue"], ["cogs"], "cap", 0.0005)
    return df.select("entity", F.col("idx").cast("long").alias("idx"), debt.alias("debt"))


@query("scale_repair", sql(_WIDE + """, s AS (SELECT *, revenue * CASE WHEN idx % 5 = 0 THEN 1000 ELSE 1 END AS v FROM w), r AS (SELECT *, abs(v) / nullif(abs(cogs), 0) AS ratio FROM s),
p AS (SELECT *, CAST(floor(log10(ratio) / 3 + 0.5) * 3 AS INTEGER) AS x FROM r)
SELECT entity, CAST(idx AS BIGINT) AS idx, round(CASE WHEN v IS NULL OR v = 0 OR ratio IS NULL OR ratio BETWEEN 0.1 AND 10 THEN v WHEN x <> 0 AND abs(ratio / pow(10, x) - 1) <= 0.2 THEN v / pow(10, x) WHEN ratio > 100 OR ratio < 0.01 THEN NULL ELSE v END, 4) AS val FROM p"""))
def scale_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on the wrong scale, every fifth period, against another row as their anchor."""
    df = _wide(spark, sf_dir).withColumn("v", F.col("revenue") * F.when(F.col("idx") % 5 == 0, 1000).otherwise(1))
    return df.select("entity", F.col("idx").cast("long").alias("idx"), F.round(series.rescaled(F.col("v"), F.abs("cogs"), F.lit(False)), 4).alias("val"))


@query("zero_if_absent", sql(_WIDE + " SELECT entity, CAST(idx AS BIGINT) AS idx, coalesce(cogs, CASE WHEN revenue IS NOT NULL THEN 0.0 END) AS cogs FROM w"))
def zero_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = repairs.zero_where_reported(_wide(spark, sf_dir), ["cogs"], "revenue")
    return df.select("entity", F.col("idx").cast("long").alias("idx"), "cogs")


@query("total_tag_dedupe", sql(_WIDE + """ SELECT entity, CAST(idx AS BIGINT) AS idx, CASE WHEN idx % 2 = 0 AND revenue IS NOT NULL AND cogs IS NOT NULL AND cogs <> 0 AND abs(revenue / cogs - 1) <= 0.2 THEN 0.0 ELSE revenue END AS revenue FROM w"""))
def total_tag_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total that equals its part leaves nothing for the rest; every other period comes from a total's tag."""
    df = _wide(spark, sf_dir).withColumn("revenue_tag", F.when(F.col("idx") % 2 == 0, "Total").otherwise("Own"))
    return repairs.split_totals(df, "revenue", "cogs", ["Total"], tolerance=0.2).select("entity", F.col("idx").cast("long").alias("idx"), "revenue")


@query("metric_availability", sql(_WIDE + """, h AS (SELECT entity, idx, revenue IS NOT NULL AS r, cogs IS NOT NULL AS c, idx % 3 > 0 AND equity IS NOT NULL AS q FROM w),
l AS (SELECT *, coalesce(lag(r, 4) OVER o, false) AS r4, coalesce(lag(c) OVER o, false) AS c1, coalesce(lag(q) OVER o, false) AS q1, coalesce(lag(r AND c) OVER o, false) AS g1 FROM h WINDOW o AS (PARTITION BY entity ORDER BY idx)),
m AS (SELECT entity, idx, CASE WHEN NOT r THEN 'revenue' WHEN NOT c THEN 'cogs' END AS gross, CASE WHEN NOT r THEN 'revenue' WHEN NOT r4 THEN 'revenue[t-4]' END AS growth, CASE WHEN NOT (r AND c) THEN 'gross' WHEN NOT q THEN 'equity' WHEN NOT q1 THEN 'equity[t-1]' END AS ret, CASE WHEN NOT (r AND c) THEN 'gross' WHEN NOT g1 THEN 'gross[t-1]' WHEN NOT c1 THEN 'cogs[t-1]' END AS step FROM l)
SELECT entity, CAST(idx AS BIGINT) AS idx, gross IS NULL AS gross_available, gross AS gross_missing, growth IS NULL AS growth_available, growth AS growth_missing, ret IS NULL AS return_available, ret AS return_missing, step IS NULL AS step_available, step AS step_missing, false AS a_available, 'a' AS a_missing, false AS b_available, 'b' AS b_missing, false AS c_available, 'c' AS c_missing FROM m"""))
def metric_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which metrics each quarter has all items for, and the first that lacks; a and b refer to each other, c to them."""
    df = _wide(spark, sf_dir).withColumn("equity", F.when(F.col("idx") % 3 > 0, F.col("equity")))
    metrics = {"return": "gross / avg(equity)", "gross": "revenue - cogs", "growth": "revenue / revenue[t-4] - 1", "step": "gross - gross[t-1] + cogs[t-1] * 91.25", "a": "b + revenue", "b": "a * 2", "c": "a / cogs"}
    out = formulas.with_availability(df, metrics, ["entity"])
    return out.select("entity", F.col("idx").cast("long").alias("idx"), *(f"{m}_{x}" for m in ("gross", "growth", "return", "step", "a", "b", "c") for x in ("available", "missing")))


def _rescaled_sql(v: str, anchor: str, strong: str) -> str:
    ratio = f"(abs({v}) / nullif({anchor}, 0))"
    power = f"(floor(log10(nullif({ratio}, 0)) / 3 + 0.5) * 3)"
    return f"CASE WHEN {v} IS NULL OR {v} = 0 OR {anchor} IS NULL OR {anchor} = 0 OR {ratio} BETWEEN 0.1 AND 10 THEN {v} WHEN {power} <> 0 AND abs({ratio} / pow(10, {power}) - 1) <= 0.2 THEN {v} / pow(10, {power}) WHEN {strong} OR {ratio} > 100 OR {ratio} < 0.01 THEN NULL ELSE {v} END"


@query("share_scale_repair", sql(_WIDE + f""", a AS (SELECT entity, idx, nullif(cogs * CASE WHEN idx % 5 = 0 THEN 1000 WHEN idx % 7 = 0 THEN 1000000 WHEN idx % 11 = 0 THEN 17 WHEN idx % 13 = 0 THEN 0 ELSE 1 END, 0) AS v, CASE WHEN idx % 3 > 0 AND abs(revenue / (cogs * 1.1)) >= 0.1 AND abs(revenue / (revenue / (cogs * 1.1))) >= 1000 THEN abs(revenue / (revenue / (cogs * 1.1))) END AS strong, CASE WHEN idx % 4 = 0 THEN nullif(abs(equity), 0) END AS weak FROM w),
b AS (SELECT *, coalesce(strong, weak) AS anchor, {_rescaled_sql("v", "coalesce(strong, weak)", "strong IS NOT NULL")} AS f FROM a), c AS (SELECT *, coalesce(abs(f / anchor) BETWEEN 0.1 AND 10, false) AS settled FROM b),
d AS (SELECT *, max(CASE WHEN settled THEN idx END) OVER up AS bi, min(CASE WHEN settled THEN idx END) OVER down AS ai, last_value(CASE WHEN settled THEN f END IGNORE NULLS) OVER up AS bv, first_value(CASE WHEN settled THEN f END IGNORE NULLS) OVER down AS av FROM c WINDOW up AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, abs(CASE WHEN bi IS NULL OR ai - idx < idx - bi THEN av ELSE bv END) AS near FROM d), g AS (SELECT *, CASE WHEN settled OR near IS NULL THEN f ELSE {_rescaled_sql("f", "near", "false")} END AS s FROM e),
h AS (SELECT *, count(s) OVER (PARTITION BY entity ORDER BY idx DESC) AS r FROM g), m AS (SELECT entity, CASE WHEN count(*) >= 3 THEN list_sort(list(s))[count(*) // 2 + 1] END AS m FROM h WHERE s IS NOT NULL AND r <= 4 GROUP BY 1)
SELECT h.entity, CAST(idx AS BIGINT) AS idx, round(CASE WHEN s <> 0 AND (abs(s) / m > 100 OR abs(s) / m < 0.01) THEN NULL ELSE s END, 4) AS shares, coalesce(v <> s, false) AS shares_rescaled FROM h LEFT JOIN m ON m.entity = h.entity"""))
def share_scale_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts on wrong scales, by what income and earnings imply, a weak anchor, the nearest settled period and the latest values."""
    idx = F.col("idx")
    off = F.when(idx % 5 == 0, 1000).when(idx % 7 == 0, 1_000_000).when(idx % 11 == 0, 17).when(idx % 13 == 0, 0).otherwise(1)
    df = _wide(spark, sf_dir).withColumns({"shares": F.col("cogs") * off, "eps": F.when(idx % 3 > 0, F.try_divide("revenue", F.col("cogs") * 1.1)), "average": F.when(idx % 4 == 0, F.col("equity"))})
    out = repairs.repair_scale(df, ["entity"], "shares", "revenue", "eps", "average")
    return out.select("entity", idx.cast("long").alias("idx"), F.round("shares", 4).alias("shares"), "shares_rescaled")
