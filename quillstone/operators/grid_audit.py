"""What a statement's grid lacks and how much of it is estimated: by concept, and one row for each company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.formulas import with_availability
from quillstone.operators.series import holes, line

#: The ways a value can be estimated: an annual value less its quarters, a rule, absent counted as nought, carried on, approximated.
KINDS = ("q4", "derive", "zero", "carry", "approx")


def concept_audit(cells: DataFrame) -> DataFrame:
    """entity, concept, n_periods, n_missing, shape, gaps, n_<kind> of each of KINDS, longest_carry.

    cells: entity, concept, idx, value, kind, a row for each period of a dense grid; kind is null for reported values and counts for
    values alone.  shape is that of `series.holes`, gaps the places between the first and the last value that have none, in order.
    longest_carry: how many periods after the last value that wasn't carried a carried one stands, at most; nought if none does.
    """
    keys = ["entity", "concept"]
    has = F.col("value").isNotNull()
    carry = has & F.coalesce(F.col("kind") == "carry", F.lit(False))
    settled = F.last(F.when(has & ~carry, F.col("idx")), ignorenulls=True).over(line(keys).rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy(*keys)
    first, last = F.min(F.when(has, F.col("idx"))).over(whole), F.max(F.when(has, F.col("idx"))).over(whole)
    marked = cells.withColumns({"_behind": F.when(carry, F.col("idx") - settled), "_inside": ~has & F.col("idx").between(first, last)})
    kinds = [F.count_if(has & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]
    gaps = F.array_sort(F.collect_list(F.when(F.col("_inside"), F.col("idx")))).alias("gaps")
    counted = marked.groupBy(*keys).agg(F.count("*").alias("n_periods"), F.count_if(~has).alias("n_missing"), gaps, *kinds, F.coalesce(F.max("_behind"), F.lit(0)).alias("longest_carry"))
    return counted.join(holes(cells, keys, "value").select(*keys, "shape"), keys)


def company_audit(cells: DataFrame, concepts: list[str], formulas: dict[str, str]) -> DataFrame:
    """entity, n_periods, full_miss, holes, metric_na, estimated, stale: what a company's grid lacks, one row for each.

    cells as for concept_audit; concepts and formulas are configuration, and bound the arrays and maps.  full_miss: concepts without any
    value, in order.  holes: the others that miss some, to their number and shape.  metric_na: metrics to the number of periods in
    which a need of theirs is missing (`formulas.with_availability`).  estimated: concepts to their counts by kind, noughts left out.
    stale: concepts to longest_carry where that isn't nought.  Concepts that aren't named take no part.
    """
    named = cells.where(F.col("concept").isin(*concepts))
    of = concept_audit(named)
    kinds = F.map_filter(F.create_map(*(x for k in KINDS for x in (F.lit(k), F.col(f"n_{k}")))), lambda _, n: n > 0)

    def listed(where: Column, *what: Column) -> Column:
        return F.collect_list(F.when(where, F.struct("concept", *what)))

    missing = F.col("n_missing")
    some = of.withColumn("_kinds", kinds).groupBy("entity").agg(
        F.max("n_periods").alias("n_periods"),
        F.array_sort(F.collect_list(F.when(missing == F.col("n_periods"), F.col("concept")))).alias("full_miss"),
        F.map_from_entries(listed((missing > 0) & (missing < F.col("n_periods")), F.struct(missing.alias("missing"), "shape"))).alias("holes"),
        F.map_from_entries(listed(F.size("_kinds") > 0, F.col("_kinds"))).alias("estimated"),
        F.map_from_entries(listed(F.col("longest_carry") > 0, F.col("longest_carry"))).alias("stale"),
    )
    if not formulas:
        return some.select("entity", "n_periods", "full_miss", "holes", F.create_map().cast("map<string,bigint>").alias("metric_na"), "estimated", "stale")
    wide = named.groupBy("entity", "idx").agg(*(F.max(F.when(F.col("concept") == c, F.col("value"))).alias(c) for c in concepts))
    lacking = with_availability(wide, formulas, ["entity"]).groupBy("entity").agg(*(F.count_if(~F.col(f"{m}_available")).alias(m) for m in formulas))
    na = F.map_filter(F.create_map(*(x for m in formulas for x in (F.lit(m), F.col(m)))).cast("map<string,bigint>"), lambda _, n: n > 0)
    return some.join(lacking.select("entity", na.alias("metric_na")), "entity").select("entity", "n_periods", "full_miss", "holes", "metric_na", "estimated", "stale")
