"""From raw tagged facts to one value for each fiscal quarter.

facts: entity, tag, start (null for an instant), end, val, form, filed, and pos, the order within the source.
Every step is a window or an aggregate over (entity, concept, period); an entity is never gathered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.calendar import fiscal_period, fiscal_year_end, span_days


def latest_restated(facts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in order (latest filed first), and orig_filed, when the key was first filed."""
    by_key = Window.partitionBy(*keys)
    ranked = facts.withColumn("orig_filed", F.min("filed").over(by_key)).withColumn("_rank", F.row_number().over(by_key.orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def provenance(facts: DataFrame, keys: list[str], estimated: Column) -> DataFrame:
    """keys and cell: value, is_estimated, source_tag, form, filed, orig_filed (filed where that isn't known) and end of chosen facts."""
    first = F.coalesce("orig_filed", "filed") if "orig_filed" in facts.columns else F.col("filed")
    fields = (F.col("val").alias("value"), F.coalesce(estimated, F.lit(False)).alias("is_estimated"), F.col("tag").alias("source_tag"), "form", "filed", first.alias("orig_filed"), "end")
    return facts.select(*keys, F.struct(*fields).alias("cell"))


def by_tag_priority(facts: DataFrame, concept_tags: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each concept and key: the first tag that has one, then the latest filed.

    concept_tags: concept, tag, priority, negate (whether the tag counts against the concept); a few hundred rows of
    configuration.  orig_filed is the first filing under the chosen tag.
    """
    joined = facts.join(concept_tags, "tag").withColumn("val", F.when(F.col("negate"), -F.col("val")).otherwise(F.col("val"))).drop("negate")
    same_tag = Window.partitionBy("concept", *keys, "tag")
    ranked = joined.withColumn("orig_filed", F.min("filed").over(same_tag))
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("concept", *keys).orderBy("priority", *order)))
    return ranked.where("_rank = 1").drop("_rank")


def year_end_month(facts: DataFrame) -> DataFrame:
    """entity, fye_month: the month most facts of a year's length end in, over the last six years of each entity.

    The month is that of five days before, for years that drift over a month's end.  Ties go to the month met last.
    """
    days = span_days(F.col("start"), F.col("end"))
    per_end = facts.where((days > 300) & (days < 400)).groupBy("entity", "end").agg(F.count("*").alias("n"))
    recent = per_end.withColumn("latest", F.max("end").over(Window.partitionBy("entity"))).where(F.col("end") >= F.date_sub("latest", 6 * 365))
    votes = recent.groupBy("entity", F.month(F.date_sub("end", 5)).alias("month")).agg(F.sum("n").alias("n"), F.max("end").alias("last"))
    return votes.groupBy("entity").agg(F.max_by("month", F.struct("n", "last")).alias("fye_month"))


def year_ends(facts: DataFrame, months: DataFrame) -> DataFrame:
    """entity, fy, fy_end: the end of each fiscal year that most facts of a year's length have; ties to the later date."""
    days = span_days(F.col("start"), F.col("end"))
    fy, q = fiscal_period(F.col("end"), F.col("fye_month"))
    yearly = facts.where((days > 300) & (days < 400)).join(months, "entity").withColumn("fy", fy).where(q == 4)
    votes = yearly.groupBy("entity", "fy", "end").agg(F.count("*").alias("n"))
    return votes.groupBy("entity", "fy").agg(F.max_by("end", F.struct("n", "end")).alias("fy_end"))


def reporting_currency(facts: DataFrame) -> DataFrame:
    """entity, currency: the three-letter unit with most facts (ties alphabetically), USD without any."""
    votes = facts.groupBy("entity", "unit").agg(F.count("*").alias("n"))
    plain = F.col("unit").rlike("^[A-Z]{3}$")
    return votes.groupBy("entity").agg(F.coalesce(F.min_by(F.when(plain, F.col("unit")), F.when(plain, F.struct((-F.col("n")).alias("n"), "unit"))), F.lit("USD")).alias("currency"))


def reports_by_year(facts: DataFrame, ifrs: Column | None = None) -> DataFrame:
    """entity, annual: whether it reports under IFRS, less than 5 % of its durations are of a quarter's length, or it has none.

    ifrs: whether a fact's company does; the same for all facts of a company.
    """
    days = span_days(F.col("start"), F.col("end"))
    quarterly = F.avg(F.when(days.isNotNull(), days.between(45, 130).cast("int")))
    few = F.coalesce(quarterly, F.lit(0.0)) < 0.05
    return facts.groupBy("entity").agg((few if ifrs is None else F.bool_or(F.coalesce(ifrs, F.lit(False))) | few).alias("annual"))


def keyed(facts: DataFrame, months: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """facts with fy, q and kind, a row for each part a fact can play.

    kind: Q a single quarter or an instant, C from the year's start to the quarter's end, A a whole year.  Durations of
    less than 45 or more than 400 days, and those of more than 130 days that don't begin with the year, play none.
    """
    fy, q = fiscal_period(F.col("end"), F.col("fye_month"))
    work = facts.join(months, "entity").withColumn("fy", fy).withColumn("q", q).withColumn("_days", span_days(F.col("start"), F.col("end")))
    before = F.last_day(F.make_date(F.col("fy") - 1, F.col("fye_month"), F.lit(1)))
    if ends is not None:
        work = work.join(ends.select("entity", (F.col("fy") + 1).alias("fy"), F.col("fy_end").alias("_before")), ["entity", "fy"], "left")
        before = F.coalesce("_before", before)
    begins = F.abs(F.date_diff(F.col("start"), F.date_add(before, 1))) <= 15
    days = F.col("_days")
    fits, short = days.between(45, 400), days <= 300
    kinds = F.array_compact(
        F.array(
            F.when(days.isNull(), "Q"),
            F.when(fits & begins & (~short | (F.col("q") == 4)), "A"),
            F.when(fits & short & begins, "C"),
            F.when(fits & short & ((begins & (F.col("q") == 1)) | (~begins & (days <= 130))), "Q"),
        )
    )
    return work.withColumn("kind", F.explode(kinds)).drop("_days", "_before", "fye_month")


def quarters(cells: DataFrame, zero_if_absent: Column | None = None) -> DataFrame:
    """entity, concept, fy, q, val, is_estimated from cells (entity, concept, fy, q, kind, val, form) of additive flows.

    Cumulative values come from C, or the one before plus Q; the year from A, or nine months plus a fourth quarter,
    unless that one was filed in an annual report and exceeds the nine months, when it is the year itself.  A quarter
    is the difference of two cumulative values.  Where one was missing and had to be carried on, the quarters on both
    sides are left out, unless the concept is zero where absent; then they are kept as estimates.
    """
    zero = F.lit(False) if zero_if_absent is None else zero_if_absent

    def cell(kind: str, q: int, what: str = "val") -> Column:
        return F.max(F.when((F.col("kind") == kind) & (F.col("q") == q), F.col(what)))

    wide = cells.groupBy("entity", "concept", "fy").agg(
        *(cell("Q", k).alias(f"q{k}") for k in (1, 2, 3, 4)), *(cell("C", k).alias(f"k{k}") for k in (1, 2, 3)),
        F.max(F.when(F.col("kind") == "A", F.col("val"))).alias("a"), cell("Q", 4, "form").alias("f4"),
    )
    c1 = F.coalesce("k1", "q1")
    c2 = F.coalesce(F.col("k2"), c1 + F.col("q2"))
    c3 = F.coalesce(F.col("k3"), c2 + F.col("q3"))
    whole = F.col("f4").startswith("10-K") & (F.abs("q4") > F.abs(F.col("c3")))
    c4 = F.coalesce(F.col("a"), F.when(F.col("c3").isNotNull(), F.when(whole, F.col("q4")).otherwise(F.col("c3") + F.col("q4"))))
    known = wide.select("*", c1.alias("c1"), c2.alias("c2"), c3.alias("c3")).withColumn("c4", c4)
    last = F.coalesce(*(F.when(F.col(f"c{k}").isNotNull(), k) for k in (4, 3, 2, 1)))
    filled = {0: F.lit(0)}
    for k in (1, 2, 3, 4):
        filled[k] = F.coalesce(F.col(f"c{k}"), filled[k - 1])
    rows = []
    for k in (1, 2, 3, 4):
        guessed = F.col(f"c{k}").isNull() | (F.col(f"c{k - 1}").isNull() if k > 1 else F.lit(False))
        estimated = guessed | (F.lit(k == 4) & F.col("q4").isNull())
        rows.append(F.when((F.lit(k) <= last) & (~guessed | zero), F.struct(F.lit(k).alias("q"), (filled[k] - filled[k - 1]).alias("val"), estimated.alias("is_estimated"))))
    return known.select("entity", "concept", "fy", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("entity", "concept", "fy", "x.q", "x.val", "x.is_estimated")


def per_share_quarters(cells: DataFrame) -> DataFrame:
    """entity, concept, fy, q, val of share counts and per-share values, which don't add up: quarters as reported.

    cells also has unit; a missing fourth quarter of a share count is the year's.
    """
    direct = cells.where("kind = 'Q'").groupBy("entity", "concept", "unit", "fy", "q").agg(F.max("val").alias("val"))
    year = cells.where("kind = 'A' and unit = 'shares'").groupBy("entity", "concept", "unit", "fy").agg(F.max("val").alias("year")).withColumn("q", F.lit(4))
    both = direct.join(year, ["entity", "concept", "unit", "fy", "q"], "full_outer")
    return both.select("entity", "concept", "fy", "q", F.coalesce("val", "year").alias("val"))


def row_source(cells: DataFrame) -> DataFrame:
    """entity, concept, source_tag: the tag that supplies most of the cells shown; ties alphabetically."""
    votes = cells.groupBy("entity", "concept", "source_tag").agg(F.count("*").alias("n"))
    return votes.groupBy("entity", "concept").agg(F.min_by("source_tag", F.struct((-F.col("n")).alias("n"), "source_tag")).alias("source_tag"))


def namespace(facts: DataFrame) -> DataFrame:
    """entity, ns: ifrs-full where an entity has fewer than 20 us-gaap tags and any ifrs-full one, else us-gaap."""
    tags = F.count_distinct(F.when(F.col("ns") == "us-gaap", F.col("tag")))
    ifrs = F.bool_or(F.col("ns") == "ifrs-full")
    return facts.groupBy("entity").agg(F.when((tags < 20) & ifrs, "ifrs-full").otherwise("us-gaap").alias("ns"))


def is_year_end(end: Column, month: Column) -> Column:
    """Whether a date lies within a month of the fiscal year's end."""
    return F.abs(F.date_diff(fiscal_year_end(end, month), end)) <= 31
