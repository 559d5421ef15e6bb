"""Filters, pickers and orders: which filings, facts, tags and concepts a question is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.calendar import half_up, period_index, span_days
from quillstone.operators.ranks import placed


def in_dates(filings: DataFrame, first: str, last: str) -> DataFrame:
    """Filings whose report date, or filing date where that is missing or empty, lies from first to last."""
    day = F.coalesce(F.nullif(F.col("report_date").cast("string"), F.lit("")), F.col("filing_date").cast("string"))
    return filings.where(day.cast("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def in_fiscal_range(df: DataFrame, period: str, first: str, last: str) -> DataFrame:
    """Rows whose period lies from first to last, a year counting as its fourth quarter, and rows whose period can't be read."""
    at = period_index(F.col(period))
    return df.where(at.isNull() | at.between(period_index(F.lit(first)), period_index(F.lit(last))))


def newest_first() -> list[Column]:
    """Filings by report date, filing date and accession, the latest first."""
    return [F.desc_nulls_last("report_date"), F.desc_nulls_last("filing_date"), F.desc("accession")]


def first_of_kind(filings: DataFrame, annual: tuple[str, ...], quarterly: tuple[str, ...], n_annual: int = 2, n_quarterly: int = 4) -> DataFrame:
    """The newest annual and quarterly filings of each entity, so many of each."""
    is_annual = F.col("form").isin(*annual)
    ranked = filings.where(is_annual | F.col("form").isin(*quarterly)).withColumn("annual", is_annual)
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("entity", "annual").orderBy(*newest_first())))
    return ranked.where(F.col("_r") <= F.when(F.col("annual"), n_annual).otherwise(n_quarterly)).drop("_r")


def by_form(filings: DataFrame, forms: list[str], n: int) -> DataFrame:
    """The first n filings of each entity by the place of their form in the list, then the newest filed."""
    place = F.array_position(F.array(*map(F.lit, forms)), F.col("form"))
    w = Window.partitionBy("entity").orderBy(place, F.desc("filing_date"), F.desc("accession"))
    return filings.where(F.col("form").isin(*forms)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def newest_filed(filings: DataFrame, forms: list[str], n: int) -> DataFrame:
    """The n newest filings of each entity among the forms, whichever of them."""
    w = Window.partitionBy("entity").orderBy(F.desc("filing_date"), F.desc("accession"))
    return filings.where(F.col("form").isin(*forms)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def with_history(recent: DataFrame, pages: DataFrame, first: str) -> DataFrame:
    """The recent filings, and where `first` is before the oldest of an entity's, those of its pages that reach it.

    pages: the columns of recent and filing_to, the last filing date of the page, which prunes partitions.
    """
    oldest = recent.groupBy("entity").agg(F.min("filing_date").alias("_oldest")).where(F.col("_oldest") > F.lit(first).cast("date"))
    wanted = pages.where(F.col("filing_to") >= F.lit(first).cast("date")).join(oldest.select("entity"), "entity", "left_semi")
    return recent.unionByName(wanted.select(*recent.columns))


def share_facts(facts: DataFrame) -> DataFrame:
    """Positive share counts of a quarter's length: more than 80 and fewer than 100 days."""
    days = span_days(F.col("start"), F.col("end"))
    return facts.where((F.col("val") > 0) & (days > 80) & (days < 100))


def per_share_facts(facts: DataFrame) -> DataFrame:
    """Positive per-share values of fewer than 100 days or of a year's length, 300 and 400 days excluded."""
    days = span_days(F.col("start"), F.col("end"))
    return facts.where((F.col("val") > 0) & ((days < 100) | ((days > 300) & (days < 400))))


def instants(facts: DataFrame, tags: list[str]) -> DataFrame:
    """entity, end, filed, val: positive instants of the first of the tags that an entity has, the first in its source of each end and filing."""
    some = facts.where(F.col("start").isNull() & (F.col("val") > 0) & F.col("tag").isin(*tags))
    place = F.array_position(F.array(*map(F.lit, tags)), F.col("tag"))
    one = some.withColumn("_p", place).withColumn("_first", F.min("_p").over(Window.partitionBy("entity"))).where("_p = _first")
    return one.groupBy("entity", "end", "filed").agg(F.min_by("val", "pos").alias("val"))


def filed_dates(facts: DataFrame) -> DataFrame:
    """entity, dates: the distinct filing dates in order."""
    return facts.select("entity", "filed").distinct().groupBy("entity").agg(F.array_sort(F.collect_list("filed")).alias("dates"))


def one_currency(facts: DataFrame, currencies: DataFrame) -> DataFrame:
    """Facts in the entity's currency (entity, currency), per share of it, or in shares; no other currency stands in."""
    own = facts.join(currencies.select("entity", F.col("currency").alias("_c")), "entity")
    return own.where((F.col("unit") == F.col("_c")) | (F.col("unit") == F.concat("_c", F.lit("/shares"))) | (F.col("unit") == "shares")).drop("_c")


def matches_kind(start: Column, end: Column, kind: Column) -> Column:
    """Whether a duration is of a segment column's kind: 300 to 400 days for A, 80 to 100 for Q; instants are of any."""
    days = half_up(span_days(start, end).cast("double"))
    return start.isNull() | F.when(kind == "A", days.between(300, 400)).otherwise(days.between(80, 100))


def shown(cells: DataFrame, concepts: DataFrame) -> DataFrame:
    """Cells of concepts that aren't internal.  concepts: concept, internal."""
    return cells.join(concepts.where("internal").select("concept"), "concept", "left_anti")


def classified(concepts: DataFrame) -> DataFrame:
    """concepts (statement, unit) with is_flow, of the statements of income and cash flow, and is_additive, not of shares or per share."""
    return concepts.withColumn("is_flow", F.col("statement").isin("IS", "CF")).withColumn("is_additive", ~F.col("unit").isin("shares", "USD/shares"))


def without_noise(tags: DataFrame, noise: tuple[str, ...], shortest: int, since: str) -> DataFrame:
    """Tags (tag, latest) of so many letters at least that hold none of the words, in any case, and were used since the day."""
    low = F.lower("tag")
    hit = F.lit(False)
    for word in noise:
        hit = hit | F.contains(low, F.lit(word.lower()))
    return tags.where(~hit & (F.length("tag") >= shortest) & (F.col("latest") >= F.lit(since).cast("date")))


def revenue_like(facts: DataFrame, hints: tuple[str, ...], since: int, least: int = 2) -> DataFrame:
    """entity, tag, unit, n, end, val: tags with a hint in their name, in a currency, with so many quarters that end in `since` or later; the newest of them."""
    named = F.lit(False)
    for word in hints:
        named = named | F.contains(F.col("tag"), F.lit(word))
    quarters = facts.where(named & F.col("unit").rlike("^[A-Z]{3}$") & span_days(F.col("start"), F.col("end")).between(45, 130) & (F.year("end") >= since))
    found = quarters.groupBy("entity", "tag", "unit").agg(F.count("*").alias("n"), F.max(F.struct("end", "val")).alias("_newest"))
    return found.where(F.col("n") >= least).select("entity", "tag", "unit", "n", "_newest.end", "_newest.val")


def common_label(labels: DataFrame) -> DataFrame:
    """tag, label: the label a tag has most often; ties alphabetically.  labels: tag, label."""
    votes = labels.groupBy("tag", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("tag").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label"))


def hole_labels(holes: DataFrame, label: str, least: int = 1) -> DataFrame:
    """label, n_entities: in how many companies a row has holes between values.  holes: entity, label, n_holes."""
    found = holes.where(F.col("n_holes") > 0).groupBy(label).agg(F.count_distinct("entity").alias("n_entities"))
    return found.where(F.col("n_entities") >= least)


def implied_latest(eps: DataFrame, income: DataFrame) -> DataFrame:
    """entity, d, implied: income over earnings per share on the newest day that has both, nought earnings skipped.  Both: entity, d, val."""
    both = eps.select("entity", "d", F.col("val").alias("_eps")).where("_eps <> 0").join(income, ["entity", "d"])
    newest = both.groupBy("entity").agg(F.max(F.struct("d", (F.col("val") / F.col("_eps")).alias("implied"))).alias("x"))
    return newest.select("entity", "x.d", "x.implied")


def column_places(periods: DataFrame) -> DataFrame:
    """periods (entity, end, kind) with place: years first, then quarters, each by their ends."""
    return periods.distinct().withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy(F.when(F.col("kind") == "A", 0).otherwise(1), "end")))


def in_config_order(df: DataFrame, config: DataFrame, name: str) -> DataFrame:
    """df with place, that of its name among all names in the order of the configuration (name, ordinal), what that lacks behind it by name.

    The configuration has some dozen rows; the names of the data may be many.  Rows without a name are left out.
    """
    ranked = df.where(F.col(name).isNotNull()).select(name).distinct().join(F.broadcast(config.select(name, "ordinal")), name, "left")
    return df.join(placed(ranked, [F.col("ordinal").asc_nulls_last(), F.col(name)]).drop("ordinal"), name)


def flattened(results: DataFrame, keys: list[str], values: str) -> DataFrame:
    """A row for each entry of nested maps period -> concept -> value; null values are left out."""
    periods = results.select(*keys, F.explode(values).alias("period", "_inner"))
    return periods.select(*keys, "period", F.explode("_inner").alias("concept", "value")).where("value is not null")


def verification_moves(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """was, now, n, move: how verification changed between two snapshots (keys, verified): better, worse, same, gained or lost.

    Being verified is better than not to be reconcilable, and that better than being contradicted.
    """

    def state(c: str) -> Column:
        return F.when(F.col(c).isNull(), "unknown").when(F.col(c), "ok").otherwise("bad")

    a, b = before.select(*keys, state("verified").alias("was")), after.select(*keys, state("verified").alias("now"))
    both = a.join(b, keys, "full_outer")
    rank = lambda c: F.when(F.col(c) == "ok", 2).when(F.col(c) == "unknown", 1).otherwise(0)
    move = F.when(F.col("was").isNull(), "gained").when(F.col("now").isNull(), "lost").when(rank("now") > rank("was"), "better").when(rank("now") < rank("was"), "worse").otherwise("same")
    return both.groupBy("was", "now").agg(F.count("*").alias("n")).withColumn("move", move)
