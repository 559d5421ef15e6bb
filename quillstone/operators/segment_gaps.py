"""What a breakdown lacks, told by what the extraction left out: axes that never appear, single members, holes, lost facts.

The extraction's telemetry is two small tables that add up over filings: `tally` (entity, reason, what, axes, n, amount; axes is
the sorted set of segment axes that the fact had) and `seen` (entity, axis, n).  Amounts are those of revenue.  Older stored
filings may have a tally without an account of the axes seen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons that a better extraction could mend; the others filter on purpose.
MENDABLE = ("cross_axis", "deep_cross", "member_excluded")
CROSSED = ("cross_axis", "deep_cross")
COLUMNS = ["entity", "code", "axis", "cause", "n", "amount", "single_segment"]


def _axes(segment: tuple[str, ...]) -> Column:
    known = F.array(*map(F.lit, segment))
    return F.array_sort(F.filter(F.transform("dims", lambda d: d["axis"]), lambda a: F.array_contains(known, a)))


def tally(marked: DataFrame, segment: tuple[str, ...]) -> DataFrame:
    """Facts left out by reason and what they were: the crossed axes, the member, or the other dimension, with their segment axes.

    marked: facts with reason as `segments.admitted` gives it.  A crossed fact that has a foreign dimension as well counts twice, for
    the crossing and for the dimension.  A null value counts as a fact without an amount.
    """
    n = F.size("axes")
    crossing = F.when(n == 2, "cross_axis").when(n > 2, "deep_cross")
    further = F.when(~F.col("reason").isin("total", "residual", *CROSSED), F.col("reason"))
    rows = marked.withColumn("axes", _axes(segment)).withColumn("reason", F.explode(F.array_compact(F.array(crossing, further))))
    at = F.concat_ws("+", "axes")
    other = F.array_sort(F.filter(F.transform("dims", lambda d: d["axis"]), lambda a: ~F.array_contains("axes", a)))
    member = F.get(F.transform(F.filter("dims", lambda d: F.array_contains("axes", d["axis"])), lambda d: d["member"]), F.lit(0))
    what = F.when(F.col("reason").isin(*CROSSED), F.concat_ws("×", "axes")).when(F.col("reason") == "member_excluded", F.concat_ws("@", member, at)).when(n == 0, F.concat_ws("×", other)).otherwise(F.concat_ws("@", F.concat_ws("+", other), at))
    revenue = F.coalesce(F.sum(F.when(F.col("concept") == "revenue", F.abs("val"))), F.lit(0))
    return rows.withColumn("what", what).groupBy("entity", "reason", "what", "axes").agg(F.count("*").alias("n"), revenue.alias("amount"))


def seen(marked: DataFrame, segment: tuple[str, ...]) -> DataFrame:
    """How many facts of the wanted concepts touch each segment axis, whether they count or not."""
    return marked.select("entity", F.explode(_axes(segment)).alias("axis")).groupBy("entity", "axis").agg(F.count("*").alias("n"))


def _missing(touched: DataFrame, emitted: DataFrame) -> DataFrame:
    return touched.join(emitted, ["entity", "axis"], "left_anti")


def _dropped_axes(lost: DataFrame, touched: DataFrame, emitted: DataFrame, crossed: DataFrame, stated: DataFrame) -> DataFrame:
    """Axes that facts have and the result lacks, by what was crossed and left out on them, else by the entity's whole revenue."""
    told = lost.where("reason <> 'kind_mismatch'").withColumn("axis", F.explode(F.array_distinct("axes")))
    worst = F.min_by(F.concat_ws("|", "reason", "what"), F.struct(-F.col("amount"), "reason", "what"))
    told = told.groupBy("entity", "axis").agg(F.sum("amount").alias("_told"), worst.alias("cause"))
    whole = stated.where("concept = 'revenue'").groupBy("entity").agg(F.sum(F.abs("total")).alias("_whole"))
    gone = _missing(touched, emitted).join(crossed, ["entity", "axis"], "left").join(told, ["entity", "axis"], "left").join(whole, "entity", "left")
    known = F.coalesce("crossed", F.lit(0)) + F.coalesce("_told", F.lit(0))
    amount = F.when(known != 0, known).otherwise(F.coalesce("_whole", F.lit(0)))
    return gone.select("entity", F.lit("axis_dropped").alias("code"), "axis", "cause", "n", amount.alias("amount"), F.lit(False).alias("single_segment"))


def _degenerate(revenue: DataFrame, own: DataFrame, tolerance: float) -> DataFrame:
    """Periods whose only member is the axis's total; single_segment: all periods that have data are such."""
    periods = revenue.groupBy("entity", "axis", "period").agg(F.count("val").alias("_k"), F.max("val").alias("_v")).where("_k > 0")
    joined = periods.join(own.where("concept = 'revenue'").select("entity", "axis", "period", "total"), ["entity", "axis", "period"], "left")
    alone = F.coalesce((F.col("_k") == 1) & (F.abs(F.col("_v") - F.col("total")) <= F.abs("total") * tolerance), F.lit(False))
    found = joined.withColumn("_alone", alone).groupBy("entity", "axis").agg(F.count_if("_alone").alias("n"), F.count("*").alias("_all"), F.sum(F.when(F.col("_alone"), F.abs("total"))).alias("amount"))
    return found.where("n > 0").select("entity", F.lit("degenerate_axis").alias("code"), "axis", F.lit(None).cast("string").alias("cause"), "n", "amount", (F.col("n") == F.col("_all")).alias("single_segment"))


def _holes(revenue: DataFrame) -> DataFrame:
    """Quarters without a value of a member between two with one; the amount is the mean of the two for each member and quarter."""
    values = revenue.where("kind = 'Q' and val is not null and entity is not null and period is not null")
    nxt = Window.partitionBy("entity", "axis", "member").orderBy("_idx")
    placed = values.withColumn("_idx", F.dense_rank().over(Window.partitionBy("entity").orderBy("period")))
    placed = placed.withColumn("_to", F.lead("_idx").over(nxt)).withColumn("_both", F.abs("val") + F.abs(F.lead("val").over(nxt))).where("_to > _idx + 1")
    each = placed.withColumn("_at", F.explode(F.sequence(F.col("_idx") + 1, F.col("_to") - 1)))
    return each.groupBy("entity", "axis").agg(F.count_distinct("_at").alias("n"), (F.sum("_both") / 2).alias("amount")).select("entity", F.lit("period_hole").alias("code"), "axis", F.lit(None).cast("string").alias("cause"), "n", "amount", F.lit(False).alias("single_segment"))


def _lost_facts(lost: DataFrame, emitted: DataFrame, touched: DataFrame, crossed: DataFrame) -> DataFrame:
    """Mendable losses that nothing else tells of: not those crossed over axes that were all emitted after all (a projection
    saved them), nor those with an axis that is reported as dropped.  A two-axis crossing counts each cell of the merged cross
    table once, in the direction of its first axis, as tallies repeat a period that several filings report.
    """
    sets = emitted.groupBy("entity").agg(F.collect_set("axis").alias("_emitted"))  # axes of the configuration
    gone = _missing(touched, emitted).groupBy("entity").agg(F.collect_set("axis").alias("_gone"))
    rows = lost.where(F.col("reason").isin(*MENDABLE) & (F.col("amount") != 0)).join(sets, "entity", "left").join(gone, "entity", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_emitted", F.coalesce("_emitted", none)).withColumn("_gone", F.coalesce("_gone", none))
    told = F.forall("axes", lambda a: F.array_contains("_emitted", a)) | F.exists("axes", lambda a: F.array_contains("_gone", a))
    rows = rows.where(~F.col("reason").isin(*CROSSED) | ~told).withColumn("_first", F.get("axes", F.lit(0)))
    rows = rows.join(crossed.select("entity", F.col("axis").alias("_first"), "crossed"), ["entity", "_first"], "left")
    amount = F.when((F.col("reason") == "cross_axis") & (F.coalesce("crossed", F.lit(0)) != 0), F.col("crossed")).otherwise(F.col("amount"))
    return rows.select("entity", F.lit("dropped_facts").alias("code"), F.col("reason").alias("axis"), F.col("what").alias("cause"), "n", amount.alias("amount"), F.lit(False).alias("single_segment"))


def gaps(lost: DataFrame, touched: DataFrame, shown: DataFrame, crosses: DataFrame, stated: DataFrame, own: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """entity, code, axis, cause, n, amount, single_segment and rank, the largest amounts of an entity first.

    lost, touched: `tally` and `seen`.  shown: entity, axis, member, period, kind, concept, val of what the result has; a row of a
    null value still makes its axis one that the result has.  crosses: the merged cross tables (`segment_merge`).  stated: newest
    totals by entity, concept, period; own: totals of each axis.  Ties are settled by code, axis and cause.

    Everything after shown and crosses works on one row for each axis of an entity; sums are taken before rows are exchanged.
    """
    revenue = shown.where("concept = 'revenue'")
    emitted = shown.select("entity", "axis").distinct()
    crossed = crosses.where("concept = 'revenue'").groupBy("entity", "axis").agg(F.sum(F.abs("val")).alias("crossed"))
    every = [_dropped_axes(lost, touched, emitted, crossed, stated), _degenerate(revenue, own, tolerance), _holes(revenue), _lost_facts(lost, emitted, touched, crossed)]
    whole = reduce(DataFrame.unionByName, (df.select(*COLUMNS) for df in every))
    return whole.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc_nulls_last("amount"), "code", "axis", "cause")))
