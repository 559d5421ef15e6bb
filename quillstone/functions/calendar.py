"""Fiscal calendars as column expressions.  Three rules exist side by side; fiscal_period is the engine's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A period that ends up to so many days after the month's end still belongs to that fiscal year (52/53-week years).
DRIFT_DAYS = 20
QUARTER_DAYS = 91.31


def half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards also for negative ones."""
    return F.floor(x + F.lit(0.5))


def span_days(start: Column, end: Column) -> Column:
    """Length of a duration; null for an instant."""
    return F.date_diff(end, start)


def fiscal_year_end(end: Column, month: Column) -> Column:
    """The first month-end of the fiscal month, from the year before on, that is no more than DRIFT_DAYS before end."""
    ends = [F.last_day(F.make_date(F.year(end) + k, month, F.lit(1))) for k in (-1, 0, 1, 2)]
    return F.coalesce(*(F.when(e >= F.date_sub(end, DRIFT_DAYS), e) for e in ends), ends[1])


def fiscal_period(end: Column, month: Column) -> tuple[Column, Column]:
    """Fiscal year and quarter of a period's end, by the days to the end of its fiscal year."""
    year_end = fiscal_year_end(end, month)
    back = F.pmod(half_up(F.date_diff(year_end, end) / F.lit(QUARTER_DAYS)), F.lit(4))
    return F.year(year_end), (F.lit(4) - back).cast("int")


def period_key(fy: Column, q: Column | None = None) -> Column:
    """FY2026 Q2, or FY2026 for a whole year."""
    return F.concat(F.lit("FY"), fy.cast("string"), *([F.lit(" Q"), q.cast("string")] if q is not None else []))


def period_index(key: Column) -> Column:
    """Sortable number of a period key, a whole year counting as its fourth quarter; null if it can't be read."""
    fy = F.try_element_at(F.regexp_extract_all(key, F.lit(r"^FY(\d{4})(?: Q[1-4])?$"), F.lit(1)), F.lit(1)).try_cast("int")
    q = F.try_element_at(F.regexp_extract_all(key, F.lit(r" Q([1-4])$"), F.lit(1)), F.lit(1)).try_cast("int")
    return fy * 4 + F.coalesce(q, F.lit(4))


def filing_period(report: Column, year_end_mmdd: Column, form: Column) -> Column:
    """Period of a filing by months alone: the fiscal year for annual forms and at the year's end, else its quarter."""
    fye = F.substring(year_end_mmdd, 1, 2).cast("int")
    gap = F.pmod(fye - F.month(report), F.lit(12))
    fy = F.year(F.add_months(report, gap))
    q = F.lit(4) - half_up(gap / 3)
    annual = form.isin("10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A") | (gap == 0)
    return F.when(annual, period_key(fy)).otherwise(period_key(fy, q.cast("int")))


def segment_period(end: Column, month: Column) -> Column:
    """Label of a segment quarter: quarters of three months before the fiscal month; without one, the calendar month."""
    m = F.month(end)
    q = F.floor(F.pmod(m - month + 11, F.lit(12)) / 3).cast("int") + 1
    fy = F.year(end) + F.when(m > month, 1).otherwise(0)
    return F.when(month.isNull(), F.date_format(end, "yyyy-MM")).otherwise(period_key(fy, q))


def epoch_date(seconds: Column) -> Column:
    """The UTC date of epoch seconds, which may be negative."""
    return F.to_date(F.timestamp_seconds(seconds))


def segment_key(end: Column, kind: Column) -> Column:
    return F.concat_ws("#", end.cast("string"), kind)


def split_segment_key(key: Column) -> tuple[Column, Column]:
    """Date and kind (A or Q) of a segment key, split at the last #; without a kind it is annual."""
    has = F.instr(key, "#") > 0
    kind = F.when(has, F.substring_index(key, "#", -1)).otherwise(F.lit("A"))
    date = F.when(has, F.regexp_replace(key, r"#[^#]*$", "")).otherwise(key)
    return F.try_to_date(date), kind
