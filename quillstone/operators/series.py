"""Operators over the periods of a row: dense grids, trailing sums, lags, fills, repairs.

Rows are (keys, idx, value columns); idx is the place of a period in the grid, so lags are positional.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillstone.functions.scalars import thousands, upper_middle


def dense_grid(values: DataFrame, keys: list[str], periods: DataFrame) -> DataFrame:
    """A row for each key and period, values being null where there is none.

    periods: period, idx, a bounded calendar; values has one row at most for each key and period.  A key's values, no
    more than the calendar has periods, travel as one map, so values is computed once.
    """
    rest = [c for c in values.columns if c not in (*keys, "period")]
    known = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("period", F.struct(*rest).alias("_v")))).alias("_known"))
    placed = known.crossJoin(F.broadcast(periods)).withColumn("_cell", F.try_element_at("_known", F.col("period")))
    return placed.select(*keys, "period", *(c for c in periods.columns if c != "period"), *(F.col(f"_cell.{c}").alias(c) for c in rest))


def line(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("idx")


def trailing(keys: list[str], value: str, n: int = 4) -> Column:
    """Sum of a value and the n - 1 before it; null unless all are there."""
    w = line(keys).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.sum(value).over(w))


def growth(keys: list[str], value: str, k: int) -> Column:
    """Relative change against k periods before; null unless that one is positive."""
    before = F.lag(value, k).over(line(keys))
    return F.when(before > 0, F.col(value) / before - 1)


def average_balance(keys: list[str], value: str) -> Column:
    """Mean of a value and the one before; the value itself in the first period; null if either is missing."""
    w = line(keys)
    return F.when(F.row_number().over(w) == 1, F.col(value)).otherwise((F.col(value) + F.lag(value).over(w)) / 2)


def carried(keys: list[str], value: str, most: int = 3) -> Column:
    """A value, or the last one of up to `most` periods before; only in rows with two values at least."""
    w = line(keys).rowsBetween(-most, 0)
    return F.when(F.count(value).over(Window.partitionBy(*keys)) >= 2, F.last(value, ignorenulls=True).over(w)).otherwise(F.col(value))


def over_own_median(keys: list[str], value: str) -> Column:
    return F.col(value) / F.median(value).over(Window.partitionBy(*keys))


def before_listing(df: DataFrame, keys: list[str], value: str, annual: Column | None = None) -> DataFrame:
    """Rows from the first jump on, where there is one in the first eight steps between values; periods without a value don't count.

    A jump: 2.5 times the value before at least, that one being below 0.4 of the latest.  Companies that only report
    years (annual) keep all their rows.
    """
    w, all_ = line(keys), Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    jump = (F.count(value).over(w) <= 9) & (F.col(value) >= 2.5 * before) & (before < 0.4 * F.last(value, ignorenulls=True).over(all_))
    if annual is not None:
        jump = jump & ~annual
    cut = df.withColumn("_jump", F.when(jump, F.col("idx"))).withColumn("_from", F.min("_jump").over(Window.partitionBy(*keys)))
    return cut.where(F.col("_from").isNull() | (F.col("idx") >= F.col("_from"))).drop("_jump", "_from")


def holes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, first_idx, last_idx, n_present, n_holes and shape of each row of a dense grid.

    Holes lie between the first and the last value.  shape: complete, none, oldest only, newest only, both ends
    missing, or interior.
    """
    present = F.col(value).isNotNull()
    found = df.groupBy(*keys).agg(F.min(F.when(present, F.col("idx"))).alias("first_idx"), F.max(F.when(present, F.col("idx"))).alias("last_idx"), F.count(value).alias("n_present"), F.min("idx").alias("_lo"), F.max("idx").alias("_hi"))
    n = F.coalesce(F.col("last_idx") - F.col("first_idx") + 1 - F.col("n_present"), F.lit(0))
    late, early = F.col("first_idx") > F.col("_lo"), F.col("last_idx") < F.col("_hi")
    shape = F.when(F.col("n_present") == 0, "none").when(n > 0, "interior").when(late & early, "both ends").when(late, "oldest only").when(early, "newest only").otherwise("complete")
    return found.withColumn("n_holes", n).withColumn("shape", shape).drop("_lo", "_hi")


def staleness(keys: list[str], real: Column) -> Column:
    """Periods since the last real observation; null before the first."""
    return F.col("idx") - F.last(F.when(real, F.col("idx")), ignorenulls=True).over(line(keys).rowsBetween(Window.unboundedPreceding, 0))


def is_spike(keys: list[str], value: str, day: str) -> Column:
    """A point unlike both neighbours though they agree, or an end far from its only neighbour, in series of three points or more."""
    w = Window.partitionBy(*keys).orderBy(day)
    before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)

    def apart(a: Column, b: Column) -> Column:
        return F.greatest(F.try_divide(a, b), F.try_divide(b, a))

    inside = (apart(v, before) >= 1.6) & (apart(v, after) >= 1.6) & (apart(before, after) < 1.25)
    gap = F.coalesce(F.date_diff(F.lead(day).over(w), F.col(day)), F.date_diff(F.col(day), F.lag(day).over(w)))
    at_end = (before.isNull() | after.isNull()) & (apart(v, F.coalesce(before, after)) >= 2.5) & (gap >= 200)
    several = F.count(value).over(Window.partitionBy(*keys)) >= 3
    return F.coalesce(several & (inside | at_end), F.lit(False))


def stale_points(df: DataFrame, keys: list[str], value: str, day: str) -> DataFrame:
    """Rows without those whose value returns more than 400 days later with a value between that differs by over 5 %.

    A value that returns has one last day, and before it one last day on which another value stood outside 5 %; its rows before the
    latter are stale.  So a key's rows meet each of its values that return once, not each row, and leave one day for it.
    """
    spans = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.min(day).alias("_from"), F.max(day).alias("_back")).where(F.date_diff("_back", "_from") > 400)
    others = df.select(*keys, F.col(day).alias("_d"), F.col(value).alias("_other")).distinct()
    apart = F.abs(F.try_divide(F.col("_other"), F.col("_v")) - 1) > 0.05
    met = spans.join(others, keys).where((F.col("_d") > F.col("_from")) & (F.col("_d") < F.col("_back")) & apart)
    known = met.groupBy(*keys, "_v", "_back").agg(F.max("_d").alias("_until"))
    on = [*(F.col(f"x.{k}") == F.col(f"k.{k}") for k in keys), F.col(f"x.{value}") == F.col("k._v"), F.col(f"x.{day}") < F.col("k._until"), F.date_diff("k._back", f"x.{day}") > 400]
    return df.alias("x").join(known.alias("k"), on, "left_anti")


def one_basis(keys: list[str], value: str, day: str) -> Column:
    """Whether no step between neighbours is fourfold or more, in either direction."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(day))
    return F.greatest(F.try_divide(F.col(value), before), F.try_divide(before, F.col(value))) < 4


def rescaled(value: Column, anchor: Column, strong: Column, tolerance: float = 0.2) -> Column:
    """A value brought to the scale of its anchor by a power of 1000, or null if it must go.

    Within a factor of 10 it stays.  Else the nearest power of 1000 is tried; if that misses by more than the
    tolerance, the value goes where the anchor is strong or the gap is over a hundredfold, and stays otherwise.
    """
    ratio = F.abs(value) / anchor
    power = F.pow(F.lit(10.0), thousands(ratio))
    fits = (thousands(ratio) != 0) & (F.abs(ratio / power - 1) <= tolerance)
    return F.when(value.isNull() | (value == 0) | anchor.isNull() | (anchor == 0) | ratio.between(0.1, 10), value).when(fits, value / power).when(strong | (ratio > 100) | (ratio < 0.01), F.lit(None)).otherwise(value)


def nearest_settled(keys: list[str], value: str, settled: Column) -> Column:
    """The value of the nearest settled period, the earlier one on a tie."""
    w = line(keys)
    point = F.when(settled, F.struct(F.col("idx").alias("i"), F.col(value).alias("v")))
    before = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    take_after = before.isNull() | (after["i"] - F.col("idx") < F.col("idx") - before["i"])
    return F.when(take_after, after["v"]).otherwise(before["v"])


def without_outliers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values over a hundred times, or under a hundredth of, the upper middle of the last four become null."""
    whole = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    middle = upper_middle(F.collect_list(F.struct("idx", F.col(value).alias("v"))).over(whole)["v"])
    ratio = F.abs(value) / F.col("_middle")
    out = F.coalesce((F.col(value) != 0) & ((ratio > 100) | (ratio < 0.01)), F.lit(False))
    return df.withColumn("_middle", middle).withColumn(value, F.when(~out, F.col(value))).drop("_middle")


def clamp(df: DataFrame, first: int, last: int, lookback: int = 0) -> DataFrame:
    """Rows with idx from first - lookback to last, is_lookback marking what precedes first."""
    return df.where(F.col("idx").between(first - lookback, last)).withColumn("is_lookback", F.col("idx") < first)
