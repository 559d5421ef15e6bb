"""Share splits: observations across filings, clustering in time, a vote, confirmation, arbitration, adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.scalars import split_factor

#: Days by which an ex-date may precede the first filing on the new basis; days within which a detected event repeats one.
MATCH_DAYS, REPEAT_DAYS = 200, 540
EXACT, NEAR = 0.001, 0.08
#: Width of the bins in which places among deviations are counted first; they lie below NEAR, so there are some 84,000 at most.
BIN = 2.0**-20
# fixed values: the cells of the census report with what becomes of their events
REPORT = {
    "A1": "kept", "A2a": "kept", "A2b": "dropped", "A3": "kept", "A4": "kept", "B1": "kept", "B2": "dropped", "B3": "kept", "B4": "kept", "C1": "added", "D1": "merged", "D2": "merged",
}
QUANTILES = {"median_dev": 0.5, "p75_dev": 0.75, "p90_dev": 0.9}


def observations(points: DataFrame) -> DataFrame:
    """entity, lo, hi, factor, weight, ratio: clean ratios of one period's values in neighbouring filings.

    points: entity, period, kind (shares, per_share or instant), filed, val, pos.  Per-share values move the other way.
    Share counts weigh 2, per-share values 1.  The split lies after filing lo and not after filing hi.
    """
    w = Window.partitionBy("entity", "kind", "period").orderBy("filed", "pos", "val")
    nxt = points.where("val > 0").withColumn("hi", F.lead("filed").over(w)).withColumn("_next", F.lead("val").over(w))
    ratio = F.when(F.col("kind") == "per_share", F.col("val") / F.col("_next")).otherwise(F.col("_next") / F.col("val"))
    seen = nxt.withColumn("ratio", ratio).withColumn("factor", split_factor(F.col("ratio"))).where("factor is not null and filed < hi")
    return seen.select("entity", F.col("filed").alias("lo"), "hi", "factor", F.when(F.col("kind") == "per_share", 1).otherwise(2).alias("weight"), "ratio")


def stabbed(found: DataFrame, keys: list[str]) -> DataFrame:
    """found (lo, hi) with threshold: the least set of points such that each interval (lo, hi] holds one, by earliest end."""
    ends = F.array_sort(F.collect_set(F.struct("hi", "lo")))
    points = F.aggregate(ends, F.array().cast(f"array<{dict(found.dtypes)['hi']}>"), lambda acc, x: F.when((F.size(acc) == 0) | (x["lo"] >= F.element_at(acc, -1)), F.concat(acc, F.array(x["hi"]))).otherwise(acc))
    by_key = found.groupBy(*keys).agg(points.alias("_points"))
    first = F.array_min(F.filter("_points", lambda p: (p > F.col("lo")) & (p <= F.col("hi"))))
    return found.join(by_key, keys).withColumn("threshold", first).drop("_points")


def across(points: DataFrame, events: DataFrame) -> DataFrame:
    """entity, threshold, ratio: later over earlier value for pairs of one period's filings on both sides of a threshold.

    Filings of one period are few; pairs are made per event, of periods that have filings on both sides only.
    """
    shares = points.where("kind <> 'per_share' and val > 0").groupBy("entity", "kind", "period").agg(F.collect_list(F.struct("filed", "val")).alias("_all")).where(F.size("_all") > 1)
    met = events.select("entity", "threshold").distinct().join(shares, "entity")
    old, new = F.filter("_all", lambda x: x["filed"] < F.col("threshold")), F.filter("_all", lambda x: x["filed"] >= F.col("threshold"))
    pairs = met.select("entity", "threshold", F.explode(old).alias("o"), new.alias("_new")).select("entity", "threshold", "o", F.explode("_new").alias("n"))
    return pairs.select("entity", "threshold", (F.col("n.val") / F.col("o.val")).alias("ratio"))


def detected(points: DataFrame) -> DataFrame:
    """entity, threshold, factor, confirmed, dev, dev_raw of every split that share counts and per-share values show.

    Forward and reverse splits are clustered apart.  Factors are ranked by votes, then size; the first that a ratio
    across the threshold is within 8 % of is confirmed.  If none is and some ratio is about 1, there was no split.
    """
    seen = observations(points).withColumn("forward", F.col("factor") > 1)
    clustered = stabbed(seen, ["entity", "forward"])
    votes = clustered.groupBy("entity", "forward", "threshold", "factor").agg(F.sum("weight").alias("votes"), F.min(F.abs(F.col("ratio") / F.col("factor") - 1)).alias("dev_raw"))
    ratios = across(points, clustered).groupBy("entity", "threshold").agg(F.collect_list("ratio").alias("_ratios"))
    judged = votes.join(ratios, ["entity", "threshold"], "left").withColumn("_ratios", F.coalesce("_ratios", F.array().cast("array<double>")))
    judged = judged.withColumn("confirmed", F.exists("_ratios", lambda r: F.abs(r / F.col("factor") - 1) < NEAR)).withColumn("_flat", F.exists("_ratios", lambda r: F.abs(r - 1) < NEAR))
    judged = judged.withColumn("dev", F.when(F.col("confirmed"), F.array_min(F.transform("_ratios", lambda r: F.abs(r / F.col("factor") - 1)))))
    order = Window.partitionBy("entity", "forward", "threshold").orderBy(F.desc("confirmed"), F.desc("votes"), F.desc("factor"))
    best = judged.withColumn("_r", F.row_number().over(order)).where("_r = 1 and (confirmed or not _flat)")
    return best.select("entity", "threshold", "factor", "confirmed", "dev", "dev_raw")


def decided(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Detected events and the exchange's splits with the cell of the decision table that each falls into.

    found: entity, threshold, factor, confirmed, dev, dev_raw.  listed: entity, ex_date, factor, cover_start, first_filed
    (the first filing at or after the ex-date); a row with null ex_date only says from when the exchange covers the
    company.  Cells: both, repeat (of a matched split), not covered, exact, denied, no exchange data; exchange and unfiled
    are splits that no event matches.  A company has some dozen events at most, which are matched in one array.
    """
    events = found.withColumn("_e", F.row_number().over(Window.partitionBy("entity").orderBy("threshold", "factor")))
    splits = listed.where("ex_date is not null").withColumn("_s", F.row_number().over(Window.partitionBy("entity").orderBy("ex_date", "factor")))
    near = F.abs(F.col("_factor") / F.col("factor") - 1) < NEAR
    days = F.date_diff("threshold", "ex_date")
    other = splits.select("entity", "ex_date", F.col("factor").alias("_factor"), "_s")
    fits = events.join(other, "entity").where(near & days.between(0, MATCH_DAYS)).groupBy("entity", "_e").agg(F.array_sort(F.collect_list("_s")).alias("_fit"))

    # each event in turn takes the first split that none before it took
    empty = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<_e:int,_s:int>>").alias("pairs"))

    def take(done: Column, event: Column) -> Column:
        free = F.get(F.filter(event["_fit"], lambda s: ~F.array_contains(done["used"], s)), F.lit(0))
        taken = F.struct(F.concat(done["used"], F.array(free)).alias("used"), F.concat(done["pairs"], F.array(F.struct(event["_e"].alias("_e"), free.alias("_s")))).alias("pairs"))
        return F.when(free.isNull(), done).otherwise(taken)

    pairs = fits.groupBy("entity").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("_e", "_fit"))), empty, take)["pairs"].alias("p")).select("entity", F.inline("p"))
    used = pairs.join(other, ["entity", "_s"])
    repeats = events.join(used.select("entity", "ex_date", "_factor"), "entity").where(near & (F.abs(days) <= REPEAT_DAYS)).select("entity", "_e", F.lit(True).alias("_repeat")).distinct()
    start = listed.groupBy("entity").agg(F.min_by("cover_start", F.struct(F.col("cover_start").isNull(), "ex_date", "factor")).alias("_start"), F.lit(True).alias("_listed"))
    marked = events.join(start, "entity", "left").join(pairs, ["entity", "_e"], "left").join(repeats, ["entity", "_e"], "left")
    exact = F.coalesce(F.col("confirmed") & (F.col("dev") < EXACT) & (F.col("dev_raw") < EXACT), F.lit(False))
    cell = (
        F.when(F.col("_listed").isNull(), "no exchange data").when(F.col("_s").isNotNull(), "both").when(F.col("_repeat"), "repeat")
        .when(F.col("_start").isNull() | (F.date_diff("threshold", "_start") < MATCH_DAYS), "not covered").when(exact, "exact").otherwise("denied")
    )
    alone = splits.join(pairs.select("entity", "_s"), ["entity", "_s"], "left_anti")
    added = alone.select("entity", F.col("first_filed").alias("threshold"), "factor", F.lit(True).alias("confirmed"), F.lit(None).cast("double").alias("dev"), F.lit(None).cast("double").alias("dev_raw"), F.when(F.col("first_filed").isNull(), "unfiled").otherwise("exchange").alias("cell"))
    return marked.select("entity", "threshold", "factor", "confirmed", "dev", "dev_raw", cell.alias("cell")).unionByName(added)


def arbitrated(found: DataFrame, listed: DataFrame, ifrs: DataFrame | None = None) -> DataFrame:
    """The events that hold, and why (source); companies under IFRS (entity) have none."""
    kept = decided(found, listed).where(~F.col("cell").isin("repeat", "denied", "unfiled")).withColumnRenamed("cell", "source")
    return kept if ifrs is None else kept.join(ifrs.select("entity").distinct(), "entity", "left_anti")


def census(cells: DataFrame) -> DataFrame:
    """confirmed, cell, n_events, n_entities, mean_dev of decided()."""
    return cells.groupBy("confirmed", "cell").agg(F.count("*").alias("n_events"), F.count_distinct("entity").alias("n_entities"), F.avg("dev").alias("mean_dev"))


def report_cell(cell: Column, confirmed: Column) -> Column:
    """The report's name of a cell of decided(): a letter and number for the two witnesses."""
    sure = F.coalesce(confirmed, F.lit(False))
    number = F.when(cell == "both", "1").when(cell.isin("exact", "denied"), "2").when(cell == "not covered", "3").when(cell == "no exchange data", "4")
    fine = F.when(sure & (cell == "exact"), "a").when(sure & (cell == "denied"), "b").otherwise("")
    return F.when(cell.isin("exchange", "unfiled"), "C1").when(cell == "repeat", F.when(sure, "D1").otherwise("D2")).otherwise(F.concat(F.when(sure, "A").otherwise("B"), number, fine))


def order_statistics(rows: DataFrame, key: str, value: str, shares: dict[str, float], width: float = BIN, bins: Column | None = None) -> DataFrame:
    """key and, for each share, the value with floor(share * n) smaller places among the n non-null values of the key (the last at most).

    Exact, in two mergeable counts: values by bins of the width, whose running counts tell which bin holds each place, then the
    distinct values of those bins alone.  No task holds a key's values; (greatest - least value) / width bounds a key's bins, unless bins
    gives other ones, which must never fall as values rise.
    """
    binned = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"), (F.floor(F.col(value) / width) if bins is None else bins).alias("_bin"))
    counts = binned.groupBy("_k", "_bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_k")
    running = counts.withColumn("_upto", F.sum("_n").over(w.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(w))
    places = F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.floor(F.lit(q) * F.col("_all")), F.col("_all") - 1).alias("place")) for name, q in shares.items()))
    wanted = running.select("_k", "_bin", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", F.inline(places)).where("place >= _before and place < _upto").select("_k", "_bin", "_before", "name", "place")
    within = binned.join(wanted.select("_k", "_bin").distinct(), ["_k", "_bin"], "left_semi").groupBy("_k", "_bin", "_v").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_k", "_bin").orderBy("_v"))
    found = within.withColumn("_upto", upto).join(wanted, ["_k", "_bin"]).where("place >= _before + _upto - _n and place < _before + _upto")
    return found.groupBy(F.col("_k").alias(key)).agg(*(F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in shares))


def report(cells: DataFrame) -> DataFrame:
    """outcome, code, n_events, n_entities, over_2, over_4 (deviations of 2 and 4 % or more) and quantiles of the deviations.

    One row for each of the twelve cells of REPORT, zeros included, one for each outcome (code null) and one for all (both null);
    quantiles are those of cells, null where no event has a deviation.
    """
    code = report_cell(F.col("cell"), F.col("confirmed"))
    outcome = F.create_map(*(F.lit(x) for pair in REPORT.items() for x in pair))[F.col("code")]
    marked = cells.select("entity", "dev", code.alias("code")).withColumn("outcome", outcome)
    over = [F.count_if(F.col("dev") >= x).alias(f"over_{n}") for n, x in ((2, 0.02), (4, 0.04))]
    counted = marked.groupingSets([["outcome", "code"], ["outcome"], []], "outcome", "code").agg(F.count("*").alias("n_events"), F.count_distinct("entity").alias("n_entities"), *over)
    names = [*((o, c) for c, o in REPORT.items()), *((o, None) for o in dict.fromkeys(REPORT.values())), (None, None)]
    frame = cells.sparkSession.createDataFrame(names, "_outcome string, _code string")
    rows = frame.join(counted, F.col("_outcome").eqNullSafe(F.col("outcome")) & F.col("_code").eqNullSafe(F.col("code")), "left")
    quantiles = order_statistics(marked, "code", "dev", QUANTILES).withColumnRenamed("code", "_of")
    whole = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_events", "n_entities", "over_2", "over_4")]
    return rows.join(quantiles, F.col("_code") == F.col("_of"), "left").select(F.col("_outcome").alias("outcome"), F.col("_code").alias("code"), *whole, *QUANTILES)


def adjusted(values: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """values with val on the newest basis: times the factors of all later thresholds for shares, divided for per-share.

    values: entity, unit, filed, val; a company has some dozen events at most, which travel as one array.
    """
    lists = events.groupBy("entity").agg(F.collect_list(F.struct("threshold", "factor")).alias("_events"))
    joined = values.join(lists, "entity", "left")
    product = F.aggregate(F.coalesce(F.filter("_events", lambda e: e["threshold"] > F.col("filed")), F.array().cast("array<struct<threshold:date,factor:double>>")), F.lit(1.0), lambda acc, e: acc * e["factor"])
    val: Column = F.when(F.col("unit") == "shares", F.col("val") * product).otherwise(F.col("val") / product)
    return joined.withColumn("val", val).select(*keys, *(c for c in values.columns if c not in keys))
