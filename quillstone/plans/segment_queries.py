"""Queries on breakdowns: reconciliation, projection, parents, structure."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.calendar import fiscal_period
from quillstone.operators import segment_gaps, segment_merge, segments
from quillstone.plans.bindings import facts, keyed_facts, money, sql, table
from quillstone.plans.registry import query


@query("axis_totals_reconcile", sql(""", p AS (SELECT entity, tag, year(e) AS y, sum(val) AS part FROM facts WHERE line <= 6 GROUP BY 1, 2, 3), t AS (SELECT entity, tag, year(e) AS y, sum(val) AS total FROM facts GROUP BY 1, 2, 3),
f AS (SELECT t.entity, t.tag, t.y, CAST(part AS DOUBLE) AS part, CAST(total AS DOUBLE) AS total, abs(part - total) <= abs(total) * 0.05 AS fits FROM t JOIN p USING (entity, tag, y))
SELECT entity, tag, y, part, total, CASE WHEN bool_or(fits) OVER (PARTITION BY entity, tag) THEN fits END AS verified FROM f"""))
def axis_totals_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether lines 1 to 6 make up 95 % of a year's total; null for suppliers' tags where they never do."""
    df = facts(spark, sf_dir).groupBy("entity", "tag", F.year("end").cast("long").alias("y")).agg(F.sum(F.when(F.col("line") <= 6, F.col("val"))).cast("double").alias("part"), F.sum("val").cast("double").alias("total")).where("part is not null")
    return df.withColumn("verified", segments.verified_state(df, ["entity", "tag"], "part", "total", tolerance=0.05))


@query("cross_tab_projection", sql(""", x AS (SELECT entity, year(e) AS period, form AS member, tag AS other, sum(val) AS val FROM facts GROUP BY 1, 2, 3, 4), t AS (SELECT entity, year(e) AS period, sum(val) * (1 + (entity + year(e)) % 2) AS total FROM facts GROUP BY 1, 2),
s AS (SELECT entity, period, member, sum(val) AS val FROM x GROUP BY 1, 2, 3), w AS (SELECT s.entity, s.period, sum(s.val) AS v, max(t.total) AS total FROM s JOIN t USING (entity, period) GROUP BY 1, 2)
SELECT s.entity, CAST(s.period AS BIGINT) AS period, s.member, CAST(s.val AS DOUBLE) AS val FROM s JOIN w USING (entity, period) WHERE abs(w.v - w.total) <= abs(w.total) * 0.005"""))
def cross_tab_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breakdown by form, from one by form and tag, in years where it makes up the total: that of every second year is twice as high."""
    df = facts(spark, sf_dir).withColumn("period", F.year("end").cast("long"))
    cross = df.groupBy("entity", "period", F.lit("form").alias("axis"), F.col("form").alias("member"), F.col("tag").alias("other"), F.lit("revenue").alias("concept")).agg(F.sum("val").alias("val"))
    totals = df.groupBy("entity", "period", F.lit("revenue").alias("concept")).agg(F.sum("val").alias("total")).withColumn("total", F.col("total") * (1 + (F.col("entity") + F.col("period")) % 2))
    none = cross.select("entity", "period", "axis").where("false")
    return segments.projected(cross, totals, none).select("entity", "period", "member", F.col("val").cast("double").alias("val"))


@query("subset_parents", sql(""", leaf AS (SELECT entity, year(e) AS period, form AS member, CAST(sum(val) AS DOUBLE) AS val FROM facts GROUP BY 1, 2, 3), both_ AS (SELECT * FROM leaf UNION ALL SELECT entity, year(e), '0-TOGETHER', CAST(sum(val) AS DOUBLE) FROM facts WHERE form < '3' GROUP BY 1, 2),
t AS (SELECT entity, year(e) AS period, CAST(sum(val) AS DOUBLE) AS total FROM facts GROUP BY 1, 2), m AS (SELECT b.*, total, CAST(row_number() OVER (PARTITION BY entity, period ORDER BY member) - 1 AS INTEGER) AS k FROM both_ b JOIN t USING (entity, period)),
sets AS (SELECT entity, period, total, count(*) AS n, list(val ORDER BY k) AS vals, list(member ORDER BY k) AS names FROM m GROUP BY 1, 2, 3),
masks AS (SELECT entity, period, total, names, g.mask, bit_count(g.mask) AS size, list_sum(list_transform(range(0, n), lambda i: CASE WHEN (g.mask >> CAST(i AS INTEGER)) & 1 = 1 THEN vals[i + 1] ELSE 0 END)) AS s, n FROM sets, (SELECT CAST(unnest(range(1, 64)) AS INTEGER) AS mask) g WHERE g.mask < (1 << CAST(n AS INTEGER))),
hits AS (SELECT *, max(size) OVER (PARTITION BY entity, period) AS best FROM masks WHERE abs(s - total) <= abs(total) * 0.005),
votes AS (SELECT entity, list_filter(names, lambda x, i: (mask >> CAST(i - 1 AS INTEGER)) & 1 = 0) AS parents, count(*) AS n FROM hits WHERE size = best GROUP BY 1, 2),
chosen AS (SELECT entity, parents FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, len(parents), parents) AS r FROM votes) WHERE r = 1),
j AS (SELECT m.*, coalesce(list_contains(c.parents, m.member), false) AS p FROM m LEFT JOIN chosen c USING (entity)),
ok AS (SELECT entity, period, abs(sum(val) - max(total)) <= abs(max(total)) * 0.005 AS bare, abs(coalesce(sum(CASE WHEN NOT p THEN val END), 0) - max(total)) <= abs(max(total)) * 0.005 AS without FROM j GROUP BY 1, 2),
gain AS (SELECT entity, count(*) FILTER (without) > count(*) FILTER (bare) AS accept FROM ok GROUP BY 1)
SELECT j.entity, 'form' AS axis, 'revenue' AS concept, j.period, 'A' AS kind, member, val, p AND accept AS is_parent, false AS is_residual, CASE WHEN accept THEN without ELSE bare END AS verified FROM j JOIN ok USING (entity, period) JOIN gain USING (entity)"""))
def subset_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly breakdowns by form, reported together with sums of some forms, taken apart again."""
    df = facts(spark, sf_dir).withColumn("period", F.year("end").cast("long"))
    leaves = df.groupBy("entity", "period", F.col("form").alias("member")).agg(F.sum("val").cast("double").alias("val"))
    sums = df.where("form < '3'").groupBy("entity", "period", F.lit("0-TOGETHER").alias("member")).agg(F.sum("val").cast("double").alias("val"))
    values = leaves.unionByName(sums).select("entity", F.lit("form").alias("axis"), F.lit("revenue").alias("concept"), "period", F.lit("A").alias("kind"), "member", "val", F.lit(False).alias("is_residual"))
    totals = df.groupBy("entity", F.lit("revenue").alias("concept"), "period").agg(F.sum("val").cast("double").alias("total"))
    return segments.reconciled(values, totals)


@query("segment_ratios", sql(""", y AS (SELECT entity, year(e) AS period, form AS member, CAST(sum(CASE WHEN tag = 'A' THEN val END) AS DOUBLE) AS revenue, CAST(sum(CASE WHEN tag = 'N' THEN val END) AS DOUBLE) AS cogs, CAST(sum(CASE WHEN tag = 'R' THEN val END) AS DOUBLE) AS oi FROM facts GROUP BY 1, 2, 3)
SELECT entity, CAST(period AS BIGINT) AS period, member, revenue, round(sum(revenue) OVER w, 2) AS total, round(revenue / nullif(sum(revenue) OVER w, 0), 6) AS share, round((revenue - cogs) / nullif(revenue, 0), 6) AS gross_margin, round(oi / nullif(revenue, 0), 6) AS operating_margin FROM y WINDOW w AS (PARTITION BY entity, period)"""))
def segment_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = facts(spark, sf_dir).groupBy("entity", F.year("end").cast("long").alias("period"), F.col("form").alias("member"), F.when(F.col("tag") == "A", "revenue").when(F.col("tag") == "N", "cogs").otherwise("operating_income").alias("concept")).agg(F.sum("val").cast("double").alias("val"))
    marked = df.withColumn("axis", F.lit("form")).withColumn("is_parent", F.lit(False)).withColumn("is_residual", F.lit(False))
    return segments.ratios(marked).select("entity", "period", "member", "revenue", F.round("total", 2).alias("total"), F.round("share", 6).alias("share"), F.round("gross_margin", 6).alias("gross_margin"), F.round("operating_margin", 6).alias("operating_margin"))


@query("structure_generations", """WITH RECURSIVE p AS (SELECT DISTINCT o_custkey AS entity, o_orderpriority AS member, year(o_orderdate) * 4 + quarter(o_orderdate) AS period FROM orders),
edges AS (SELECT DISTINCT a.entity, a.member AS x, b.member AS y FROM p a JOIN p b ON a.entity = b.entity AND a.period = b.period),
reach AS (SELECT DISTINCT entity, member AS x, member AS y FROM p UNION SELECT r.entity, r.x, e.y FROM reach r JOIN edges e ON r.entity = e.entity AND r.y = e.x),
comp AS (SELECT entity, x AS member, min(y) AS root FROM reach GROUP BY 1, 2),
first AS (SELECT c.entity, c.root, list_sort(list(DISTINCT p.period)) AS s FROM comp c JOIN p ON c.entity = p.entity AND c.member = p.member GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s) AS g, count(*) OVER (PARTITION BY entity) AS n FROM first)
SELECT c.entity, c.member, g AS generation FROM comp c JOIN ranked r ON c.entity = r.entity AND c.root = r.root WHERE n BETWEEN 2 AND 3""")
def structure_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities of a customer linked by quarters that have both, where that makes two or three groups."""
    period = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long")
    presence = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("member"), period.alias("period")).distinct()
    return segments.generations(presence, ["entity"]).withColumn("generation", F.col("generation").cast("long"))


@query("segment_admission", sql(""", r AS (SELECT *, CASE WHEN tag = 'A' THEN 'total' WHEN tag = 'N' AND status = 'F' THEN CASE WHEN line <= 3 THEN NULL ELSE 'cons_not_operating' END WHEN tag = 'N' THEN 'foreign_dim' WHEN status = 'F' THEN 'cross_axis' ELSE 'residual' END AS reason FROM facts) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, CAST(sum(val) AS DOUBLE) AS amount FROM r GROUP BY 1"""))
def segment_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why facts count or don't, by dimensions made of tag, status and line."""
    return _marked(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum("val").cast("double").alias("amount"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    def dim(axis: str, member: str):  # noqa: ANN202
        return F.struct(F.lit(axis).alias("axis"), F.lit(member).alias("member"))

    cons = F.when(F.col("line") <= 3, dim("cons", "x:OperatingSegmentsMember")).otherwise(dim("cons", "x:CorporateMember"))
    dims = F.when(F.col("tag") == "A", F.array().cast("array<struct<axis:string,member:string>>")).when((F.col("tag") == "N") & (F.col("status") == "F"), F.array(dim("seg", "x:EastMember"), cons)).when(F.col("tag") == "N", F.array(dim("seg", "x:EastMember"), dim("other", "x:AMember"))).when(F.col("status") == "F", F.array(dim("seg", "x:EastMember"), dim("seg2", "x:WestMember"))).otherwise(F.array(dim("cons", "x:CorporateMember")))
    df = facts(spark, sf_dir).withColumn("dims", dims).withColumn("unit", F.lit("iso4217:USD"))
    axes = segments.Axes(("seg", "seg2"), ("cons",), ("x:OperatingSegmentsMember",))
    return segments.admitted(df, axes)


@query("residual_items", sql(""", m AS (SELECT entity, 'A' AS kind, 'FY' || year(e) AS period, form AS member, tag, val FROM facts UNION ALL SELECT entity, 'Q', 'FY' || year(e) || ' Q' || quarter(e), form, tag, val FROM facts), leaf AS (SELECT entity, kind, period, member, CAST(sum(val) AS DOUBLE) AS val FROM m GROUP BY ALL),
s AS (SELECT entity, kind, period, CAST(sum(val) AS DOUBLE) AS s, CAST(sum(val) FILTER (tag = 'N') AS DOUBLE) * 0.1 AS x, CAST(sum(val) FILTER (tag = 'R') AS DOUBLE) * 0.07 AS y, 1.0::DOUBLE AS z FROM m GROUP BY ALL), t AS (SELECT *, CASE WHEN entity % 7 = 0 THEN s * 1.5 ELSE s + coalesce(x, 0) + CASE WHEN entity % 2 = 0 THEN coalesce(y, 0) ELSE 0 END END AS total FROM s),
n AS (SELECT *, total - s AS need, abs(total) * 0.005 AS tol FROM t), k AS (SELECT n.*, k, abs(CASE WHEN k & 1 = 1 THEN x ELSE 0 END + CASE WHEN k & 2 = 2 THEN y ELSE 0 END + CASE WHEN k & 4 = 4 THEN z ELSE 0 END - need) AS err FROM n, (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS k)),
p AS (SELECT entity, k FROM k WHERE err <= tol AND abs(need) > tol QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY err, bit_count(k), k) = 1), v AS (SELECT entity, k FROM p GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, bit_count(k), k) = 1),
f AS (SELECT n.*, coalesce(v.k, 0) AS k, abs(need) <= tol AS bare, abs(need - CASE WHEN v.k & 1 = 1 THEN coalesce(x, 0) ELSE 0 END - CASE WHEN v.k & 2 = 2 THEN coalesce(y, 0) ELSE 0 END - CASE WHEN v.k & 4 = 4 THEN z ELSE 0 END) <= tol AS filled FROM n LEFT JOIN v ON v.entity = n.entity),
a AS (SELECT entity, k > 0 AND count(*) FILTER (filled) > count(*) FILTER (bare) AS take FROM f GROUP BY entity, k), g AS (SELECT f.*, take, CASE WHEN take THEN filled ELSE bare END AS fits FROM f JOIN a ON a.entity = f.entity), h AS (SELECT *, CASE WHEN bool_or(fits) OVER (PARTITION BY entity) THEN fits END AS verified FROM g),
i AS (SELECT entity, kind, period, 'x' AS member, x AS val, verified FROM h WHERE take AND k & 1 = 1 UNION ALL SELECT entity, kind, period, 'y', y, verified FROM h WHERE take AND k & 2 = 2 UNION ALL SELECT entity, kind, period, 'z', z, verified FROM h WHERE take AND k & 4 = 4)
SELECT l.entity, l.kind, l.period, member, val, false AS is_residual, verified FROM leaf l JOIN h ON h.entity = l.entity AND h.period = l.period UNION ALL SELECT entity, kind, period, member, round(val, 4), true, verified FROM i WHERE val IS NOT NULL"""))
def residual_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakdowns by form, of years and of quarters together, that only reconciling items bring to the whole; those of every seventh supplier never do."""
    df = facts(spark, sf_dir)
    year = F.concat(F.lit("FY"), F.year("end").cast("string"))
    rows = df.withColumn("kind", F.lit("A")).withColumn("period", year).unionByName(df.withColumn("kind", F.lit("Q")).withColumn("period", F.concat(year, F.lit(" Q"), F.quarter("end").cast("string"))))
    of = lambda tag, share: F.sum(F.when(F.col("tag") == tag, F.col("val"))).cast("double") * share
    sums = rows.groupBy("entity", "kind", "period").agg(F.sum("val").cast("double").alias("s"), of("N", 0.1).alias("x"), of("R", 0.07).alias("y"), F.lit(1.0).alias("z"))
    extra = F.coalesce("x", F.lit(0.0)) + F.when(F.col("entity") % 2 == 0, F.coalesce("y", F.lit(0.0))).otherwise(0.0)
    totals = sums.select("entity", F.lit("operating_income").alias("concept"), "period", F.when(F.col("entity") % 7 == 0, F.col("s") * 1.5).otherwise(F.col("s") + extra).alias("total"))
    plain = rows.groupBy("entity", "kind", "period", F.col("form").alias("member")).agg(F.sum("val").cast("double").alias("val")).withColumn("is_residual", F.lit(False))
    items = sums.select("entity", "kind", "period", F.inline(F.array(*(F.struct(F.lit(c).alias("member"), F.col(c).alias("val")) for c in "xyz")))).where("val is not null").withColumn("is_residual", F.lit(True))
    values = plain.unionByName(items).withColumn("axis", F.lit("form")).withColumn("concept", F.lit("operating_income"))
    out = segments.reconciled(values, totals).select("entity", "kind", "period", "member", "val", "is_residual", "verified")
    return out.withColumn("val", F.when(F.col("is_residual"), F.round("val", 4)).otherwise(F.col("val")))


@query("drop_telemetry", sql(""", r AS (SELECT *, CASE WHEN tag = 'A' THEN 'total' WHEN tag = 'N' AND status = 'F' THEN CASE WHEN line <= 3 THEN NULL ELSE 'cons_not_operating' END WHEN tag = 'N' THEN 'foreign_dim' WHEN status = 'F' THEN 'cross_axis' ELSE 'residual' END AS reason FROM facts)
SELECT entity, reason, form AS tag, count(*) AS n, CAST(coalesce(sum(abs(val)) FILTER (line % 2 = 0), 0) AS DOUBLE) AS amount FROM r WHERE reason NOT IN ('total', 'residual') GROUP BY 1, 2, 3"""))
def drop_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was left out of each supplier's breakdowns, by reason and form; even lines stand for revenue."""
    df = _marked(spark, sf_dir).withColumn("tag", F.col("form")).withColumn("concept", F.when(F.col("line") % 2 == 0, "revenue").otherwise("cost"))
    return segments.drop_telemetry(df, "revenue", ("entity",)).withColumn("amount", F.col("amount").cast("double"))


_GAPS = """, r AS (SELECT entity, year(filed) AS filing, fy * 4 + q AS period, line, tag, form, status, CAST(max(val) * 100 AS BIGINT) AS val FROM keyed GROUP BY ALL),
a AS (SELECT *, CASE WHEN line > 2 THEN NULL WHEN entity % 3 = 0 AND tag = 'A' THEN 'form' WHEN entity % 5 = 0 AND tag = 'N' THEN 'flag' ELSE 'status' END AS axis FROM r),
f AS (SELECT *, CASE line WHEN 3 THEN ['flag', 'form'] WHEN 4 THEN ['flag', 'form', 'status'] WHEN 5 THEN ['status'] WHEN 6 THEN [] WHEN 7 THEN ['lone'] ELSE [axis] END AS axes FROM a),
c AS (SELECT entity, axis, CASE axis WHEN 'flag' THEN tag ELSE form END AS member, period, max(val) AS val FROM f WHERE line <= 2 GROUP BY ALL), e AS (SELECT DISTINCT entity, axis FROM c),
x AS (SELECT entity, axis, sum(abs(val)) AS crossed FROM (SELECT * FROM (SELECT entity, filing, period, unnest(axes) AS axis, val FROM f WHERE line IN (3, 4)) QUALIFY filing = max(filing) OVER (PARTITION BY entity, period, axis)) GROUP BY ALL),
l AS (SELECT entity, axes, CASE line WHEN 3 THEN 'cross_axis' WHEN 4 THEN 'deep_cross' WHEN 5 THEN 'member_excluded' ELSE 'foreign_dim' END AS reason,
 CASE line WHEN 3 THEN 'flag×form' WHEN 4 THEN 'flag×form×status' WHEN 5 THEN 'x:EliminationMember@status' ELSE 'other@lone' END AS what, count(*) AS n, coalesce(sum(abs(val)) FILTER (line <> 7), 0) AS amount FROM f WHERE line IN (3, 4, 5, 7) GROUP BY ALL),
s AS (SELECT entity, axis, count(*) AS n FROM (SELECT entity, unnest(axes) AS axis FROM f WHERE filing >= 1994 AND entity % 4 <> 1) GROUP BY ALL),
t AS (SELECT entity, sum(abs(val)) AS whole FROM (SELECT entity, period, max(val) AS val FROM f WHERE line = 6 GROUP BY entity, period, filing QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY filing DESC) = 1) GROUP BY 1),
told AS (SELECT entity, axis, sum(amount) AS told, first(reason || '|' || what ORDER BY amount DESC, reason, what) AS cause FROM (SELECT *, unnest(axes) AS axis FROM l) GROUP BY 1, 2),
d AS (SELECT s.entity, s.axis, told.cause, s.n, CASE WHEN coalesce(crossed, 0) + coalesce(told, 0) <> 0 THEN coalesce(crossed, 0) + coalesce(told, 0) ELSE coalesce(whole, 0) END AS amount FROM s ANTI JOIN e USING (entity, axis) LEFT JOIN x USING (entity, axis) LEFT JOIN told USING (entity, axis) LEFT JOIN t USING (entity)),
g AS (SELECT entity, axis, period, count(*) = 1 AND NOT (entity % 2 = 0 AND period % 3 = 0) AS alone, max(val) AS v FROM c GROUP BY 1, 2, 3),
h AS (SELECT entity, axis, count(*) FILTER (alone) AS n, sum(v) FILTER (alone) AS amount, bool_and(alone) AS single FROM g GROUP BY 1, 2 HAVING count(*) FILTER (alone) > 0),
q AS (SELECT entity, period, row_number() OVER (PARTITION BY entity ORDER BY period) AS idx FROM (SELECT DISTINCT entity, period FROM c)),
y AS (SELECT c.*, idx, lead(idx) OVER w AS nxt, val + lead(val) OVER w AS pair FROM c JOIN q USING (entity, period) WINDOW w AS (PARTITION BY entity, axis, member ORDER BY idx)),
o AS (SELECT entity, axis, count(DISTINCT place) AS n, sum(pair) / 2 AS amount FROM (SELECT *, unnest(range(idx + 1, nxt)) AS place FROM y WHERE nxt > idx + 1) GROUP BY 1, 2),
m AS (SELECT l.entity, reason, what, l.n, CASE WHEN reason = 'cross_axis' AND coalesce(crossed, 0) <> 0 THEN crossed ELSE l.amount END AS amount FROM l LEFT JOIN x ON l.entity = x.entity AND l.axes[1] = x.axis WHERE l.amount <> 0 AND (reason = 'member_excluded' OR (reason <> 'foreign_dim'
 AND NOT list_has_all(coalesce((SELECT list(e.axis) FROM e WHERE e.entity = l.entity), []), l.axes) AND NOT list_has_any(coalesce((SELECT list(d.axis) FROM d WHERE d.entity = l.entity), []), l.axes)))),
w AS (SELECT entity, 'axis_dropped' AS code, axis, cause, n, CAST(amount AS DOUBLE) AS amount, false AS single_segment FROM d UNION ALL SELECT entity, 'degenerate_axis', axis, NULL, n, CAST(amount AS DOUBLE), single FROM h
 UNION ALL SELECT entity, 'period_hole', axis, NULL, n, CAST(amount AS DOUBLE), false FROM o UNION ALL SELECT entity, 'dropped_facts', reason, what, n, CAST(amount AS DOUBLE), false FROM m)
SELECT entity, code, axis, cause, n, amount, single_segment, row_number() OVER (PARTITION BY entity ORDER BY amount DESC, code, axis, cause) AS rank FROM w"""


#: Each call's kept rows are its own, though files of one path may have changed between two calls.
_CALLS = count()


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, filing, period, line, tag, form, status, val: the largest amount of each in cents, dealt out by entity.

    Facts are sent as narrow as they can be; what is made of them by entity needs no further exchange.
    """
    fy, q = fiscal_period(F.to_date("l_shipdate"), F.lit(12))
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k1"), F.col("l_suppkey").alias("entity"), (fy * 4 + q).cast("long").alias("period"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("tag"), F.col("l_linestatus").alias("status"), (money("l_extendedprice") * 100).cast("long").alias("val"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k1"), F.year(F.to_date("o_orderdate")).alias("filing"), F.col("o_orderpriority").alias("form"))
    dealt = items.join(orders, "k1").drop("k1").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "entity")
    return dealt.groupBy("entity", "filing", "period", "line", "tag", "form", "status").agg(F.max("val").alias("val"))


@query("breakdown_gaps", sql(_GAPS))
def breakdown_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppliers' yearly filings lack in breakdowns by form, flag and status.

    Lines 1 and 2 are cells, 3 and 4 crossed over two and three axes, 5 an excluded member, 6 totals, 7 costs with a foreign
    dimension.  Axes seen were counted from 1994 on, and for one supplier in four not at all.  Amounts are in cents, so that they are exact.
    """

    def dims(**members):  # noqa: ANN003, ANN202
        return F.array(*(F.struct(F.lit(axis).alias("axis"), m.alias("member")) for axis, m in members.items()))

    form, flag, status = F.col("form"), F.col("tag"), F.col("status")
    df = _filed(spark, sf_dir).withColumn("_call", F.lit(next(_CALLS)))
    single = F.when((F.col("entity") % 3 == 0) & (flag == "A"), dims(form=form)).when((F.col("entity") % 5 == 0) & (flag == "N"), dims(flag=flag)).otherwise(dims(status=form))
    of_line = {3: dims(form=form, flag=flag), 4: dims(status=status, form=form, flag=flag), 5: dims(status=F.lit("x:EliminationMember")), 6: F.filter(dims(form=form), lambda _: F.lit(False)), 7: dims(other=form, lone=flag)}
    made = single
    for line, d in of_line.items():
        made = F.when(F.col("line") == line, d).otherwise(made)

    def dressed(df: DataFrame) -> DataFrame:
        return df.withColumn("dims", made).withColumn("unit", F.lit("iso4217:USD")).withColumn("kind", F.lit("Q")).withColumn("concept", F.when(F.col("line") == 7, "cogs").otherwise("revenue"))

    axes = segments.Axes(("form", "flag", "status", "lone"), ("cons",))
    judged = segments.admitted(dressed(df), axes).select(*df.columns, "reason", "axis", "member")
    marked = dressed(judged.persist(StorageLevel.DISK_ONLY))  # read a dozen times
    left_out = marked.where("reason not in ('total', 'residual')")  # and not null
    shown = marked.where("reason is null").groupBy("entity", "axis", "member", "period", "kind", "concept").agg(F.max("val").alias("val"))
    crosses = segment_merge.whole_tables(segments.crossed(left_out, axes), [F.desc("filing")])
    totals = marked.where("reason = 'total'").groupBy("entity", "concept", "period", "filing").agg(F.max("val").alias("total"))
    stated = totals.groupBy("entity", "concept", "period").agg(F.max_by("total", "filing").alias("total"))
    doubled = F.when((F.col("entity") % 2 == 0) & (F.col("period") % 3 == 0), 2).otherwise(1)
    own = shown.groupBy("entity", "axis", "concept", "period").agg(F.sum("val").alias("total")).withColumn("total", F.col("total") * doubled)
    counted = marked.where("filing >= 1994 and entity % 4 <> 1")
    lost, touched = (t.persist(StorageLevel.DISK_ONLY) for t in (segment_gaps.tally(left_out, axes.segment), segment_gaps.seen(counted, axes.segment)))
    found = segment_gaps.gaps(lost, touched, shown, crosses, stated, own)
    return found.withColumn("amount", F.col("amount").cast("double")).withColumn("rank", F.col("rank").cast("long"))


_MERGE = """, r AS (SELECT entity, year(filed) * 2 + CASE WHEN month(filed) > 6 THEN 1 ELSE 0 END AS filing, year(e) AS period, line, status AS axis, form AS member, tag AS concept, CAST(max(val) AS DOUBLE) AS val FROM facts GROUP BY ALL),
c AS (SELECT entity, filing, period, axis, member, concept, max(val) AS val FROM r WHERE line <= 3 GROUP BY ALL),
t AS (SELECT entity, filing, period, concept, max(val) AS val FROM r WHERE line = 4 GROUP BY ALL), i AS (SELECT entity, filing, period, member, concept, max(val) AS val FROM r WHERE line = 5 GROUP BY ALL),
x AS (SELECT entity, filing, period, 'made' AS axis, member, axis AS other, concept, max(val) AS val FROM r WHERE line >= 6 AND entity % 2 = 0 GROUP BY ALL),
claim AS (SELECT entity, period, axis, max(filing) AS filing FROM c GROUP BY ALL),
own AS (SELECT c.entity, c.period, c.axis, c.member FROM c JOIN claim USING (entity, period, axis, filing) GROUP BY ALL),
d AS (SELECT c.* FROM c JOIN own USING (entity, period, axis, member) QUALIFY row_number() OVER (PARTITION BY entity, period, axis, member, concept ORDER BY filing DESC) = 1),
nt AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY entity, period, concept ORDER BY filing DESC) = 1),
st AS (SELECT k.entity, k.period, k.axis, t.concept, t.val, false AS b FROM claim k JOIN t USING (entity, period, filing)),
bt AS (SELECT k.entity, k.period, k.axis, nt.concept, nt.val, true AS b FROM claim k ANTI JOIN t USING (entity, period, filing) JOIN nt USING (entity, period)),
it AS (SELECT k.entity, k.period, k.axis, i.member, i.concept, i.val FROM claim k JOIN i USING (entity, period, filing)),
nx AS (SELECT * FROM x QUALIFY filing = max(filing) OVER (PARTITION BY entity, period, axis)),
s AS (SELECT entity, period, axis, member, concept, sum(val) AS val FROM nx GROUP BY ALL),
ok AS (SELECT s.entity, s.period, s.axis, s.concept FROM s JOIN nt USING (entity, period, concept) GROUP BY ALL HAVING abs(sum(s.val) - max(nt.val)) <= abs(max(nt.val)) * 0.5),
m AS (SELECT s.* FROM s SEMI JOIN ok USING (entity, period, axis, concept)),
mt AS (SELECT DISTINCT m.entity, m.period, m.axis, nt.concept, nt.val, true AS b FROM m JOIN nt USING (entity, period))
SELECT 'cell' AS what, entity, period, axis, member, concept, val, false AS borrowed FROM d UNION ALL SELECT 'cell', entity, period, axis, member, concept, val, true FROM m
UNION ALL SELECT 'total', entity, period, axis, '', concept, val, b FROM st UNION ALL SELECT 'total', entity, period, axis, '', concept, val, b FROM bt UNION ALL SELECT 'total', entity, period, axis, '', concept, val, b FROM mt
UNION ALL SELECT 'residual', entity, period, axis, member, concept, val, false FROM it UNION ALL SELECT 'cross', entity, period, axis, member || '|' || other, concept, val, false FROM nx"""


@query("merged_breakdowns", sql(_MERGE))
def merged_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-yearly filings of suppliers put together: lines 1 to 3 are breakdowns, 4 totals, 5 residual items, the others cross tables."""
    filing = (F.year("filed") * 2 + (F.month("filed") > 6).cast("int")).cast("long")
    df = facts(spark, sf_dir).select("entity", filing.alias("filing"), F.year("end").cast("long").alias("period"), "line", F.col("status").alias("axis"), F.col("form").alias("member"), F.col("tag").alias("concept"), F.col("val").cast("double").alias("val"))

    def rows(condition: str, *keys: str) -> DataFrame:
        return df.where(condition).groupBy("entity", "filing", "period", *keys, "concept").agg(F.max("val").alias("val"))

    crosses = rows("line >= 6 and entity % 2 = 0", "axis", "member").withColumnRenamed("axis", "other").withColumn("axis", F.lit("made"))
    both = segment_merge.merged(rows("line <= 3", "axis", "member"), rows("line = 4"), rows("line = 5", "member"), crosses, [F.desc("filing")], 0.5)
    tables = {
        "cell": both.cells.withColumnRenamed("is_projected", "borrowed"),
        "total": both.totals.select(*segment_merge.SCOPE, F.lit("").alias("member"), "concept", F.col("total").alias("val"), F.col("is_borrowed").alias("borrowed")),
        "residual": both.residuals.withColumn("borrowed", F.lit(False)),
        "cross": both.crosses.withColumn("member", F.concat_ws("|", "member", "other")).withColumn("borrowed", F.lit(False)),
    }
    return reduce(DataFrame.unionByName, (t.select(F.lit(n).alias("what"), *segment_merge.SCOPE, "member", "concept", "val", "borrowed") for n, t in tables.items()))
