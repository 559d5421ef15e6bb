"""Share counts outstanding from all places that state them, aligned to periods and kept side by side.

The places differ in how they name a period: reported counts by the period itself, cover pages by the fiscal label of the
filing, class totals by the cover's day, issued and treasury shares by the balance day.  Every place becomes rows of
(entity, period, place, val), and one aggregate puts them beside each other, so a further place costs no further join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.matching import within_days

#: How many days after a period's end a cover's class total may be dated, and how far a class average may be from it.
COVER_DAYS, AVERAGE_DAYS = 75, 5
#: What fills the count of a period, in this order; issued less treasury shares only stand by for the arbitration.
FILL = {"us-gaap": "us_gaap", "cover": "cover", "classes": "classes", "average": "average"}
#: The fills that no filing states as the count itself.
ESTIMATES = ("classes", "average")
PLACES = ("us_gaap", "issued_treasury", "cover", "classes", "basic", "diluted")


def _dated(periods: DataFrame, points: DataFrame, low: int, high: int, place: str, value: str) -> DataFrame:
    """entity, period, place, val: the first point of a day low to high days from the period's end; least value of that day."""
    has = points.where(F.col(value).isNotNull()).select("entity", F.col("end").alias("_day"), F.col(value).cast("double").alias("val"))
    met = within_days(periods.select("entity", "period", "end"), has, ["entity"], "end", "_day", low, high, ["val"])
    return met.where("val is not null").select("entity", "period", F.lit(place).alias("place"), "val")


def aligned(periods: DataFrame, reported: DataFrame, cover: DataFrame, averages: DataFrame, classes: DataFrame | None = None, net: DataFrame | None = None, class_averages: DataFrame | None = None) -> DataFrame:
    """periods with a column for each place (us_gaap, issued_treasury, cover, classes, basic, diluted), and shares, shares_source
    and shares_estimated.

    periods: entity, period, end, a row for each; reported: entity, period, val; cover: the same, as `shares.cover_counts` gives them;
    averages: entity, period, basic, diluted; classes: entity, end, val, as `shares.class_series`; net: entity, end, val, as
    `shares.issued_less_treasury`; class_averages: entity, end, basic, diluted, which replace the averages of a period that they
    lie within `AVERAGE_DAYS` of.  shares is the first of us-gaap, cover, classes and the average, which is the basic one or, in a
    period without it, the diluted one.  Of several rows of a place and period the greatest value counts.  Null values and
    periods without an end match nothing; a period that no place knows has nulls.  The columns feed `repairs.arbitrate_shares`.
    """

    def stated(df: DataFrame, place: str, value: str = "val") -> DataFrame:
        return df.select("entity", "period", F.lit(place).alias("place"), F.col(value).cast("double").alias("val"))

    rows = [stated(reported, "us_gaap"), stated(cover, "cover"), stated(averages, "basic", "basic"), stated(averages, "diluted", "diluted")]
    if net is not None:
        rows.append(stated(periods.select("entity", "period", "end").join(net.select("entity", "end", "val"), ["entity", "end"]), "issued_treasury"))
    if classes is not None:
        rows.append(_dated(periods, classes, 0, COVER_DAYS, "classes", "val"))
    if class_averages is not None:
        rows += [_dated(periods, class_averages, -AVERAGE_DAYS, AVERAGE_DAYS, f"class_{c}", c) for c in ("basic", "diluted")]
    long = rows[0]
    for more in rows[1:]:
        long = long.unionByName(more)
    places = [*PLACES, "class_basic", "class_diluted"]
    wide = long.groupBy("entity", "period").agg(*(F.max(F.when(F.col("place") == p, F.col("val"))).alias(p) for p in places))
    df = periods.join(wide, ["entity", "period"], "left").withColumns({c: F.coalesce(f"class_{c}", c) for c in ("basic", "diluted")}).drop("class_basic", "class_diluted")
    df = df.withColumn("average", F.coalesce("basic", "diluted"))
    source = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in FILL.items()))
    return df.withColumns({"shares": F.coalesce(*FILL.values()), "shares_source": source, "shares_estimated": source.isin(*ESTIMATES)}).drop("average")
