"""Joins by time, range and precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], slot: str = "month") -> DataFrame:
    """left with the values of the last row of right at or before left_time; null where there is none.

    Both sides are cut into time slots of a key, so a key with a third of all rows is spread over tasks.  Inside a slot
    the last values come from one window; what was last before the slot comes from a table with one row for each slot.
    Rows of right with equal keys and time: the greatest values win.
    """
    kept = [c for c in left.columns if c not in keys]
    asks = left.select(*keys, F.col(left_time).alias("_t"), F.struct(*kept).alias("_left"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_v"), F.lit(1).alias("_side"))
    has = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), F.lit(None).cast(asks.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_v"), F.lit(0).alias("_side"))
    both = asks.unionByName(has).withColumn("_slot", F.date_trunc(slot, F.col("_t").cast("timestamp_ntz")))
    last = both.groupBy(*keys, "_slot").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v")))["_v"].alias("_own"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(*keys, "_slot", F.last("_own", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy(*keys, "_slot").orderBy("_t", "_side", "_v")
    found = both.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    joined = found.join(before, [*keys, "_slot"], "left").withColumn("_got", F.coalesce("_in", "_before"))
    return joined.select(*keys, "_left.*", *(F.col(f"_got.{v}").alias(v) for v in values))


def first_at_or_after(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str) -> DataFrame:
    """left with the first right_time at or after left_time, null if there is none: as_of with time turned round."""
    origin = F.to_date(F.lit("2100-01-01"))
    turned = left.withColumn("_back", F.date_sub(origin, F.date_diff(F.col(left_time), F.to_date(F.lit("1970-01-01")))))
    days = right.select(*keys, right_time).distinct().withColumn("_at", F.date_sub(origin, F.date_diff(F.col(right_time), F.to_date(F.lit("1970-01-01")))))
    return as_of(turned, days, keys, "_back", "_at", [right_time], "year").drop("_back")


def within_days(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, low: int, high: int, values: list[str]) -> DataFrame:
    """left with the values of the first row of right whose day lies low to high days after left's.

    Days are dealt into bins of the interval's width, so a row meets two bins at most and never a key's whole history.
    """
    width = max(1, high - low + 1)
    epoch = F.to_date(F.lit("1970-01-01"))

    def bin_of(c: Column) -> Column:
        return F.floor(F.date_diff(c, epoch) / width)

    start = F.date_add(F.col(left_day), low)
    asks = left.select(*keys, left_day).distinct().select(*keys, left_day, F.explode(F.array_distinct(F.array(bin_of(start), bin_of(F.date_add(F.col(left_day), high))))).alias("_bin"))
    has = right.select(*keys, bin_of(F.col(right_day)).alias("_bin"), F.col(right_day).alias("_day"), F.struct(*values).alias("_v"))
    met = asks.join(has, [*keys, "_bin"]).where(F.date_diff("_day", F.col(left_day)).between(low, high))
    best = met.groupBy(*keys, left_day).agg(F.min(F.struct("_day", "_v")).alias("_best"))
    return left.join(best, [*keys, left_day], "left").select(*left.columns, F.col("_best._day").alias("matched_day"), *(F.col(f"_best._v.{v}").alias(v) for v in values))


def narrowest_range(df: DataFrame, value: str, ranges: DataFrame) -> DataFrame:
    """df with the name of the narrowest range (lo, hi, name, ordinal) that holds the value; the first listed on a tie.

    ranges is configuration of some dozen rows.
    """
    values = df.select(value).distinct()
    held = values.join(F.broadcast(ranges), F.col(value).between(F.col("lo"), F.col("hi")))
    best = held.groupBy(value).agg(F.min_by("name", F.struct((F.col("hi") - F.col("lo")).alias("span"), "ordinal")).alias("group_name"))
    return df.join(best, value, "left")


def first_spelling(asked: DataFrame, roster: DataFrame, name: str) -> DataFrame:
    """asked with the roster's row under the name as it is, with dots as dashes, or dashes as dots, in that order."""
    tries = F.array(F.upper(name), F.translate(F.upper(name), ".", "-"), F.translate(F.upper(name), "-", "."))
    spelled = asked.select("*", F.posexplode(tries).alias("_prio", "_try"))
    found = spelled.join(roster.withColumn("_try", F.upper("ticker")).withColumnRenamed("ticker", "found_ticker"), "_try")
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy("_prio", "found_ticker", *(c for c in roster.columns if c != "ticker")))).where("_r = 1")
    return asked.join(best.select(name, "found_ticker", *(c for c in roster.columns if c != "ticker")), name, "left")


def predecessors(filings: DataFrame, annual_forms: tuple[str, ...]) -> DataFrame:
    """entity, candidate: issuers that an accession number names, that filed annual reports and list the same accession."""
    named = filings.select("entity", "accession", F.substring("accession", 1, 10).cast("bigint").alias("candidate")).where("candidate <> entity")
    yearly = filings.where(F.col("form").isin(*annual_forms)).select(F.col("entity").alias("candidate")).distinct()
    listed = filings.select(F.col("entity").alias("candidate"), "accession")
    return named.join(yearly, "candidate", "left_semi").join(listed, ["candidate", "accession"], "left_semi").select("entity", "candidate").distinct()


def listed_siblings(companies: DataFrame, registrants: DataFrame) -> DataFrame:
    """entity, sibling, ticker: for companies without tickers, a co-registrant that lists the ticker asked for.

    companies: entity, tickers, wanted; registrants: entity, other.
    """
    without = companies.where(F.size("tickers") == 0).select("entity", F.upper("wanted").alias("want"))
    others = companies.select(F.col("entity").alias("other"), F.transform("tickers", F.upper).alias("theirs"))
    met = without.join(registrants, "entity").join(others, "other").where(F.array_contains("theirs", F.col("want")))
    return met.groupBy("entity", F.col("want").alias("ticker")).agg(F.min("other").alias("sibling"))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, old, new, change: gained, lost, moved or same, null being no value."""
    a, b = before.select(*keys, F.col(value).alias("old")), after.select(*keys, F.col(value).alias("new"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("old").eqNullSafe(F.col("new")), "same").when(F.col("old").isNull(), "gained").when(F.col("new").isNull(), "lost").otherwise("moved")
    return both.withColumn("change", change)


def overlap_agreement(primary: DataFrame, candidate: DataFrame, keys: list[str], entity: str, tolerance: float = 0.01) -> DataFrame:
    """candidate tag by candidate tag: overlapping cells, entities, share that agrees, median ratio, and acceptance.

    primary: keys, val; candidate: keys, tag, val.  Accepted: 30 cells, 3 entities, 90 % agreement at least.
    """
    met = candidate.join(primary.withColumnRenamed("val", "_val"), keys).where("_val <> 0").withColumn("ratio", F.col("val") / F.col("_val"))
    found = met.groupBy("tag").agg(F.count("*").alias("n_overlap"), F.count_distinct(entity).alias("n_entities"), F.avg((F.abs(F.col("ratio") - 1) < tolerance).cast("int")).alias("agreement"), F.median("ratio").alias("median_ratio"))
    return found.withColumn("accepted", (F.col("n_overlap") >= 30) & (F.col("n_entities") >= 3) & (F.col("agreement") >= 0.9))


def newest_filing_wins(cells: DataFrame, scope: list[str], member: str, order: list[Column]) -> DataFrame:
    """The cells of the newest filing of each scope, and of older filings only cells of members that the newest has.

    Within a cell the newest filing wins.  cells: scope, member, filing and further columns; order ranks filings.
    """
    claim = Window.partitionBy(*scope).orderBy(*order, "filing")
    marked = cells.withColumn("_claimant", F.first("filing").over(claim))
    members = marked.where(F.col("filing") == F.col("_claimant")).select(*scope, member).distinct()
    allowed = marked.join(members, [*scope, member], "left_semi")
    return allowed.withColumn("_r", F.row_number().over(Window.partitionBy(*scope, member).orderBy(*order, "filing"))).where("_r = 1").drop("_r", "_claimant")


def preferred_forms(filings: DataFrame, domestic: tuple[str, ...], foreign: tuple[str, ...]) -> DataFrame:
    """Domestic forms, or foreign ones of entities that file foreign but no domestic ones."""
    w = Window.partitionBy("entity")
    local, abroad = F.bool_or(F.col("form").isin(*domestic)).over(w), F.bool_or(F.col("form").isin(*foreign)).over(w)
    wanted = F.when(~local & abroad, F.col("form").isin(*foreign)).otherwise(F.col("form").isin(*domestic))
    return filings.withColumn("_wanted", wanted).where("_wanted").drop("_wanted")
