"""How much of a market the configured concepts reach, and whether a further tag states the same as a concept's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.audits import derivable
from quillstone.operators.splits import order_statistics

#: Cells and companies that a comparison needs at least, the share that must agree, how close counts as equal, and
#: from what distance of the middle ratio the tag is said to be something else.
CELLS, COMPANIES, AGREEING, CLOSE, BIASED = 30, 3, 0.9, 0.01, 0.05


def market_coverage(facts: DataFrame, concepts: DataFrame, rules: dict[str, list[str]], groups: DataFrame | None = None, rounds: int = 4) -> DataFrame:
    """concept, stmt, n_all, n_direct, n_derived, n_dim_only, rate; with groups (entity and further columns) for each of them.

    facts: entity, concept, dimensioned; concepts: concept, stmt, the configuration.  n_all counts the companies with a fact without
    dimensions on any concept of the statement.  Of these a concept is direct where it has such a fact, else derived where the
    rules lead to it, else dim_only where it has facts with dimensions alone; rate counts the first two.  Concepts that nobody
    has stand there with noughts, those of statements that nobody filed don't.  Null concepts count nowhere.
    """
    by = [c for c in groups.columns if c != "entity"] if groups is not None else []
    clean = facts.where(~F.col("dimensioned") & F.col("concept").isNotNull()).select("entity", "concept").distinct()
    reach = derivable(clean, rules, rounds)
    dims = facts.where(F.col("dimensioned") & F.col("concept").isNotNull()).select("entity", "concept")
    ways = clean.withColumn("_way", F.lit(0)).unionByName(reach.withColumn("_way", F.lit(1))).unionByName(dims.withColumn("_way", F.lit(2)))
    best = ways.groupBy("entity", "concept").agg(F.min("_way").alias("_way")).join(concepts.select("concept", "stmt"), "concept")
    filed = clean.join(concepts.select("concept", "stmt"), "concept").select("entity", "stmt").distinct()
    met = best.join(filed, ["entity", "stmt"], "left_semi")
    if groups is not None:
        filed, met = filed.join(groups, "entity"), met.join(groups, "entity")
    n_all = filed.groupBy(*by, "stmt").agg(F.count("*").alias("n_all"))
    names = ("n_direct", "n_derived", "n_dim_only")
    counts = met.groupBy(*by, "concept").agg(*(F.count_if(F.col("_way") == k).alias(n) for k, n in enumerate(names)))
    keys = [*by, "concept"]
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    every = n_all.join(concepts.select("concept", "stmt").distinct(), "stmt").alias("a").join(counts.alias("c"), on, "left")
    told = every.select(*(F.col(f"a.{k}").alias(k) for k in keys), "stmt", "n_all", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names))
    return told.withColumn("rate", (F.col("n_direct") + F.col("n_derived")) / F.col("n_all"))


def tag_agreement(points: DataFrame, primaries: DataFrame, candidates: DataFrame, units: tuple[str, ...] = ("USD", "shares", "USD/shares")) -> DataFrame:
    """concept, tag, n_overlap, n_entities, agreement, median_ratio, accepted, reason: whether a candidate tag states what a concept's tags do.

    points: entity, tag, unit, start, end, val, filed; primaries: concept, tag, place; candidates: concept, tag.  Of each company, tag and
    (start, end), a null start being an instant, the latest filed value counts (of one day the greatest), and of a concept's tags the first
    by place.  Cells agree if both are nought or the ratio of concept to candidate is within `CLOSE` of 1.  median_ratio is the exact
    middle of all ratios to values other than nought.  reason: null if accepted, else `few`, `biased` or `differs`.
    """
    wanted = points.where(F.col("unit").isin(*units) & F.col("val").isNotNull())
    latest = wanted.groupBy("entity", "tag", "start", "end").agg(F.max_by(F.col("val").cast("double"), F.struct("filed", "val")).alias("val"))
    own = latest.join(primaries.select("concept", "tag", "place"), "tag").groupBy("concept", "entity", "start", "end").agg(F.min_by("val", F.struct("place", "tag")).alias("a"))
    other = latest.join(candidates.select("concept", "tag").distinct(), "tag")
    on = [F.col(f"c.{k}") == F.col(f"p.{k}") for k in ("concept", "entity", "end")] + [F.col("c.start").eqNullSafe(F.col("p.start"))]
    met = other.alias("c").join(own.alias("p"), on).select("c.concept", "c.tag", "c.entity", F.col("p.a"), F.col("c.val").alias("b"))
    ratio = F.when(F.col("b") != 0, F.col("a") / F.col("b"))
    met = met.withColumn("ratio", ratio).withColumn("same", F.coalesce(F.abs(ratio - 1) < CLOSE, F.col("a") == 0))
    found = met.groupBy("concept", "tag").agg(F.count("*").alias("n_overlap"), F.count_distinct("entity").alias("n_entities"), F.avg(F.col("same").cast("int")).alias("agreement"))
    # the upper middle of the ratios is that of place n / 2, the lower middle that of their negatives
    sides = met.select(F.explode(F.array(*(F.struct(F.struct("concept", "tag", F.lit(s).alias("side")).alias("key"), (F.col("ratio") * s).alias("r")) for s in (1, -1)))).alias("x")).select("x.key", "x.r")
    middles = order_statistics(sides, "key", "r", {"middle": 0.5}, bins=F.floor(F.signum("r") * F.log1p(F.abs("r")) * 1_000))
    median = middles.groupBy(F.col("key.concept").alias("concept"), F.col("key.tag").alias("tag")).agg(F.avg(F.col("middle") * F.col("key.side")).alias("median_ratio"))
    few = (F.col("n_overlap") < CELLS) | (F.col("n_entities") < COMPANIES)
    reason = F.when(few, "few").when(F.col("agreement") >= AGREEING, F.lit(None)).when(F.abs(F.col("median_ratio") - 1) > BIASED, "biased").otherwise("differs")
    return found.join(median, ["concept", "tag"], "left").withColumn("accepted", ~few & (F.col("agreement") >= AGREEING)).withColumn("reason", reason)
