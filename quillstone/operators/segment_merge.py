"""Breakdowns of several filings put together: what the newest filing says of a period and axis claims it.

Tables have entity, filing, period and the columns that order filings; cells further axis, member, concept, val; totals concept,
val; residuals member, concept, val; crosses axis, member, other, concept, val.  Where annual and quarterly values share an end,
period says which (`2024-09-28#A`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.segments import projected, reconciled

SCOPE = ["entity", "period", "axis"]


@dataclass
class Merged:
    """cells: entity, period, axis, member, concept, val, is_projected.  totals: entity, period, axis, concept, total, is_borrowed.
    residuals: entity, period, axis, member, concept, val.  crosses: entity, period, axis, member, other, concept, val.
    """

    cells: DataFrame
    totals: DataFrame
    residuals: DataFrame
    crosses: DataFrame

    def reconciled(self, kind: Column, tolerance: float = 0.005, must: tuple[str, ...] = ("revenue",)) -> DataFrame:
        """Every axis against its own totals and residual items; kind: annual or quarterly, made of period."""
        plain = self.cells.select(*SCOPE, "concept", "member", "val", F.lit(False).alias("is_residual"))
        items = self.residuals.select(*SCOPE, "concept", "member", "val", F.lit(True).alias("is_residual"))
        return reconciled(plain.unionByName(items).withColumn("kind", kind), self.totals.select(*SCOPE, "concept", "total"), tolerance, must)


def _newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of the newest filing for each of the keys."""
    w = Window.partitionBy(*keys).orderBy(*order, "filing")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _claimed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with claimant, the newest filing that has any row of the scope."""
    return rows.withColumn("claimant", F.first("filing").over(Window.partitionBy(*SCOPE).orderBy(*order, "filing")))


def whole_tables(crosses: DataFrame, order: list[Column]) -> DataFrame:
    """Cross tables of the newest filing that has one for (period, axis), none of their cells from older ones."""
    return _claimed(crosses, order).where(F.col("filing") == F.col("claimant")).select(*SCOPE, "member", "other", "concept", "val")


def merged(cells: DataFrame, totals: DataFrame, residuals: DataFrame, crosses: DataFrame, order: list[Column], tolerance: float = 0.005) -> Merged:
    """One breakdown of all filings of each entity.

    Members: only those of the claimant of (period, axis); older filings add concepts that it lacks.  Totals of an axis: all of
    the claimant's for the period; the newest of any filing where it has none at all.  Residual items: the claimant's and no
    others.  Cross tables: whole, from the newest filing that has one for (period, axis).  An axis without any cell is made from
    cross tables where that adds up to the newest total; that total then is the axis's own.

    All windows of cells share one exchange by entity, period and axis; claims are one row for each of these.
    """
    claimed = _claimed(cells, order)
    own = F.bool_or(F.col("filing") == F.col("claimant")).over(Window.partitionBy(*SCOPE, "member"))
    direct = _newest(claimed.withColumn("_own", own).where("_own"), [*SCOPE, "member", "concept"], order)
    claims = claimed.select(*SCOPE, F.col("claimant").alias("filing")).distinct()

    newest = _newest(totals, ["entity", "period", "concept"], order).select("entity", "period", "concept", F.col("val").alias("total"))
    of_filing = totals.select("entity", "period", "filing", "concept", F.col("val").alias("total"))
    stated = claims.join(of_filing, ["entity", "period", "filing"]).select(*SCOPE, "concept", "total", F.lit(False).alias("is_borrowed"))
    without = claims.join(of_filing.select("entity", "period", "filing").distinct(), ["entity", "period", "filing"], "left_anti")
    borrowed = without.join(newest, ["entity", "period"]).select(*SCOPE, "concept", "total", F.lit(True).alias("is_borrowed"))

    items = claims.join(residuals.select("entity", "period", "filing", "member", "concept", "val"), ["entity", "period", "filing"]).select(*SCOPE, "member", "concept", "val")
    tables = whole_tables(crosses, order)
    made = projected(tables, newest, direct, tolerance).select(*SCOPE, "member", "concept", "val")
    of_made = made.select(*SCOPE).distinct().join(newest, ["entity", "period"]).select(*SCOPE, "concept", "total", F.lit(True).alias("is_borrowed"))

    columns = [*SCOPE, "member", "concept", "val"]
    every = direct.select(*columns, F.lit(False).alias("is_projected")).unionByName(made.select(*columns, F.lit(True).alias("is_projected")))
    return Merged(every, stated.unionByName(borrowed).unionByName(of_made), items, tables)
