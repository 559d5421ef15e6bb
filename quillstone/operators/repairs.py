"""Repairs of a statement grid, in the order in which they must run.

grid: entity, period, idx and a column for each concept; <concept>_tag holds the source of a cell where a step needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.series import carried, nearest_settled, rescaled, without_outliers

#: The order of the steps: each relies on those before it.
ORDER = ("scale", "totals", "zeros", "carry", "sources", "derive", "listing", "applicability", "internal")


def implied_shares(net_income: str, eps: str, eps_derived: Column | None = None) -> Column:
    """Share count that net income and earnings per share imply; null for small or derived ones."""
    ok = (F.abs(eps) >= 0.1) & ~(eps_derived if eps_derived is not None else F.lit(False))
    count = F.abs(F.col(net_income) / F.when(ok, F.col(eps)))
    return F.when(count >= 1000, count)


def repair_scale(grid: DataFrame, keys: list[str], shares: str, net_income: str, eps: str, weak_anchor: str | None = None) -> DataFrame:
    """shares on its true scale: by what net income and earnings imply, then by the nearest settled period.

    Zero counts as missing.  Last, values unlike the latest four are dropped.
    """
    strong = implied_shares(net_income, eps)
    anchor = F.coalesce(strong, F.abs(F.nullif(F.col(weak_anchor), F.lit(0)))) if weak_anchor else strong
    df = grid.withColumn(shares, F.when(F.col(shares) != 0, F.col(shares))).withColumn("_had", F.col(shares).isNotNull())
    df = df.withColumn("_strong", strong.isNotNull()).withColumn("_anchor", anchor)
    df = df.withColumn("_first", rescaled(F.col(shares), F.col("_anchor"), F.col("_strong")))
    settled = F.col("_anchor").isNotNull() & F.col("_first").isNotNull() & (F.abs(F.col("_first") / F.col("_anchor")).between(0.1, 10))
    df = df.withColumn("_settled", F.coalesce(settled, F.lit(False))).withColumn("_near", F.abs(nearest_settled(keys, "_first", F.col("_settled"))))
    second = F.when(F.col("_settled") | F.col("_near").isNull(), F.col("_first")).otherwise(rescaled(F.col("_first"), F.col("_near"), F.lit(False)))
    df = df.withColumn(f"{shares}_rescaled", F.coalesce(F.col(shares) != second, F.lit(False))).withColumn(shares, second)
    return without_outliers(df.drop("_had", "_strong", "_anchor", "_first", "_settled", "_near"), keys, shares)


def repair_eps(grid: DataFrame, eps: str, net_income: str, shares: str) -> DataFrame:
    """Earnings per share on the scale of net income over shares, within 30 %; dropped where no power of 1000 fits."""
    return grid.withColumn(eps, rescaled(F.col(eps), F.abs(F.col(net_income) / F.when(F.col(shares) != 0, F.col(shares))), F.lit(True), 0.3))


def split_totals(grid: DataFrame, concept: str, other: str, total_tags: list[str], specific: str | None = None, tolerance: float = 0.005) -> DataFrame:
    """A cell from a total's tag without the part that another row shows.

    If the specific item and the other row make up the total, the specific item; if total and other are equal, 0.
    """
    cell, part = F.col(concept), F.col(other)
    total = F.col(f"{concept}_tag").isin(*total_tags) & cell.isNotNull() & part.isNotNull()
    closes = F.abs(F.col(specific) + part - cell) <= F.abs(cell) * tolerance if specific else F.lit(False)
    equal = (part != 0) & (F.abs(cell / F.when(part != 0, part) - 1) <= tolerance)
    new = F.when(total & closes, F.col(specific) if specific else cell).when(total & equal, F.lit(0.0)).otherwise(cell)
    return grid.withColumn(concept, new)


def zero_where_reported(grid: DataFrame, concepts: list[str], anchor: str = "total_assets") -> DataFrame:
    """Nought for absent cells of periods in which the anchor was reported."""
    return grid.withColumns({c: F.coalesce(F.col(c), F.when(F.col(anchor).isNotNull(), F.lit(0.0))) for c in concepts})


def carry_forward(grid: DataFrame, keys: list[str], concepts: list[str], most: int = 3) -> DataFrame:
    """Balance items and share counts carried on for up to three periods; <concept>_carried marks them."""
    for c in concepts:
        new = carried(keys, c, most)
        grid = grid.withColumn(f"{c}_carried", F.col(c).isNull() & new.isNotNull()).withColumn(c, new)
    return grid


def weighted_average(basic: str, diluted: str | None = None) -> Column:
    """The size of the basic weighted average, else of the diluted one; nought counts as missing."""
    v = F.coalesce(F.col(basic), F.col(diluted)) if diluted else F.col(basic)
    return F.when(v != 0, F.abs(v))


def catches_up(value: Column, now: Column, ahead: Column) -> Column:
    """Whether the next weighted average is within 15 % of a count and has itself moved 10 % towards it: a real issue or buyback."""
    moved = F.when(value > now, ahead >= now * 1.1).otherwise(ahead <= now * 0.9)
    return F.coalesce((F.abs(value / ahead - 1) <= 0.15) & moved, F.lit(False))


def arbitrate_shares(grid: DataFrame, keys: list[str], shares: str, source: str, weighted: str, candidates: dict[str, str], diluted: str | None = None) -> DataFrame:
    """A share count that is over 20 % off the weighted average is replaced by the closest candidate within 10 %.

    A count that the next weighted average catches up with is left alone.  A source that was replaced once is convicted
    for its company: its other cells go where there is no weighted average, and those over 10 % off are replaced, or go
    unless the next average catches up.  candidates: source name to column; of equally close ones the first.
    """
    line = Window.partitionBy(*keys).orderBy("idx")
    df = grid.withColumn("_w", weighted_average(weighted, diluted)).withColumn("_ahead", F.lead("_w").over(line))
    value = F.abs(F.when(F.col(shares) != 0, F.col(shares)))
    off = F.abs(value / F.col("_w") - 1)
    gaps = [F.when(F.col(c) != 0, F.abs(F.abs(F.col(c)) / F.col("_w") - 1)) for c in candidates.values()]
    options = F.array_compact(F.array(*(F.when(g < 0.1, F.struct(g.alias("gap"), F.lit(k).alias("k"), F.lit(n).alias("source"), F.col(c).cast("double").alias("v"))) for k, (g, (n, c)) in enumerate(zip(gaps, candidates.items(), strict=True)))))
    df = df.withColumn("_best", F.array_min(options)).withColumn("_off", off).withColumn("_catches", catches_up(value, F.col("_w"), F.col("_ahead")))
    other = F.col("_best").isNotNull() & (F.col("_best.v") != F.col(shares))
    df = df.withColumn("_wrong", F.coalesce((F.col("_off") > 0.2) & ~F.col("_catches") & other, F.lit(False)))
    df = df.withColumn("_convicted", F.collect_set(F.when(F.col("_wrong"), F.col(source))).over(Window.partitionBy(*keys)))
    guilty = F.coalesce(F.array_contains("_convicted", F.col(source)), F.lit(False)) & ~F.col("_wrong") & value.isNotNull()
    far = F.coalesce(F.col("_off") > 0.1, F.lit(False))
    replace = F.col("_wrong") | (guilty & far & other)
    drop = guilty & (F.col("_w").isNull() | (far & ~other & ~F.col("_catches")))
    df = df.withColumn("_replace", replace).withColumn("_drop", drop)
    new = F.when(F.col("_replace"), F.col("_best.v")).when(F.col("_drop"), F.lit(None)).otherwise(F.col(shares))
    return df.withColumn(source, F.when(F.col("_replace"), F.col("_best.source")).otherwise(F.col(source))).withColumn(shares, new).drop("_replace", "_drop", "_w", "_ahead", "_off", "_best", "_catches", "_wrong", "_convicted")


def applicability(cells: DataFrame, groups: DataFrame, per_company: DataFrame | None = None) -> DataFrame:
    """cells (entity, group_name, concept, value) with applicable.

    A company's own list rules with the group's structural ones, else the group's list.  A concept with any value in a
    company applies in all its periods.  groups: group_name, concept, structural; per_company: entity, concept.
    """
    of_group = groups.select("group_name", "concept", F.col("structural").alias("_structural"))
    df = cells.join(F.broadcast(of_group), ["group_name", "concept"], "left")
    barred = F.col("_structural").isNotNull()
    if per_company is not None:
        own = per_company.select("entity", "concept", F.lit(True).alias("_own"))
        judged = per_company.select("entity").distinct().withColumn("_judged", F.lit(True))
        df = df.join(own, ["entity", "concept"], "left").join(judged, "entity", "left")
        barred = F.when(F.col("_judged").isNotNull(), F.col("_own").isNotNull() | F.coalesce("_structural", F.lit(False))).otherwise(barred)
    has = F.count("value").over(Window.partitionBy("entity", "concept")) > 0
    return df.withColumn("applicable", has | ~barred).drop("_structural", "_own", "_judged")
