"""From a ticker as it was typed to the company whose filings count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.matching import first_spelling

#: Issuers that a company's filings name and that are tried as its predecessor; predecessors followed.
CANDIDATES, HOPS = 4, 1


def found_in_rosters(asked: DataFrame, roster: DataFrame, feed: DataFrame, name: str = "asked") -> DataFrame:
    """asked with entity, ticker and how: `roster`, `spelling` (dots and dashes exchanged) or `feed`; null where nothing has it.

    roster: ticker, entity; feed: ticker, entity, what a search gives for what the roster lacks; only that is looked up there.
    """
    spelled = first_spelling(asked.select(name).distinct(), roster.select("ticker", "entity"), name)
    how = F.when(F.col("found_ticker") == F.upper(name), "roster").otherwise("spelling")
    known = spelled.where("entity is not null").select(name, "entity", F.col("found_ticker").alias("ticker"), how.alias("how"))
    left = spelled.where("entity is null").select(name).withColumn("_want", F.upper(name))
    others = feed.groupBy(F.upper("ticker").alias("_want")).agg(F.min("entity").alias("entity"))
    searched = left.join(others, "_want", "left").select(name, "entity", F.when(F.col("entity").isNotNull(), F.col("_want")).alias("ticker"), F.when(F.col("entity").isNotNull(), F.lit("feed")).alias("how"))
    return known.unionByName(searched)


def _newest_first() -> list[Column]:
    return [F.desc("filing_date"), F.desc("accession")]


def siblings(found: DataFrame, companies: DataFrame, registrants: DataFrame) -> DataFrame:
    """entity, ticker, sibling: for companies that list no ticker, the co-registrant of their newest 10-K or 10-Q that lists it.

    registrants: entity, accession, filing_date, place, other, as the headers of these filings name them; the first that fits counts.
    """
    silent = found.join(companies.where("coalesce(size(tickers), 0) <= 0").select("entity"), "entity", "left_semi").select("entity", "ticker").distinct()
    own = registrants.join(silent.select("entity").distinct(), "entity", "left_semi")
    last = own.withColumn("_r", F.dense_rank().over(Window.partitionBy("entity").orderBy(*_newest_first()))).where("_r = 1 and other <> entity")
    listed = companies.select(F.col("entity").alias("other"), F.explode("tickers").alias("_t")).select("other", F.upper("_t").alias("ticker")).distinct()
    met = silent.join(last.select("entity", "place", "other"), "entity").join(listed, ["other", "ticker"])
    return met.groupBy("entity", "ticker").agg(F.min_by("other", F.struct("place", "other")).alias("sibling"))


def predecessors_of(entities: DataFrame, filings: DataFrame, annual_forms: tuple[str, ...], candidates: int = CANDIDATES) -> DataFrame:
    """entity, predecessor: for companies without annual reports, the issuer whose number begins an accession of theirs.

    Of the issuers that their periodic reports name, newest first, `candidates` at most are tried; the first that has filed annual
    reports and lists the same accession counts.
    """
    yearly = filings.where(F.col("form").isin(*annual_forms)).select("entity").distinct()
    young = entities.join(yearly, "entity", "left_anti")
    named = filings.where(F.col("form").startswith("10-")).join(young, "entity", "left_semi").select("entity", "accession", "filing_date", F.substring("accession", 1, 10).try_cast("bigint").alias("candidate")).where("candidate <> entity")
    place = F.row_number().over(Window.partitionBy("entity", "candidate").orderBy(*_newest_first()))
    first = named.withColumn("_p", place)
    tried = first.where("_p = 1").withColumn("_try", F.row_number().over(Window.partitionBy("entity").orderBy(*_newest_first(), "candidate"))).where(F.col("_try") <= candidates)
    old = tried.join(yearly.select(F.col("entity").alias("candidate")), "candidate", "left_semi")
    same = filings.select(F.col("entity").alias("candidate"), "accession").distinct()
    met = old.join(same, ["candidate", "accession"], "left_semi")
    return met.groupBy("entity").agg(F.min_by("candidate", "_try").alias("predecessor"))


def resolved(asked: DataFrame, roster: DataFrame, feed: DataFrame, companies: DataFrame, registrants: DataFrame, filings: DataFrame, annual_forms: tuple[str, ...] = ("10-K", "10-K/A"), name: str = "asked", hops: int = HOPS) -> DataFrame:
    """asked, entity, ticker, how, sic: the issuer of each name that was asked for.

    how tells the way: the roster, another spelling or the feed, then `sibling` and `predecessor` where the company was exchanged for
    one.  Each step works on what the steps before left open.  Predecessors are followed `hops` times; a way that comes back to
    a company it has passed ends there.  sic is the last company's.
    """
    found = found_in_rosters(asked, roster, feed, name)
    exchanged = found.join(siblings(found.where("entity is not null"), companies, registrants), ["entity", "ticker"], "left")
    found = exchanged.select(name, F.coalesce("sibling", "entity").alias("entity"), "ticker", F.when(F.col("sibling").isNotNull(), F.concat("how", F.lit(" > sibling"))).otherwise(F.col("how")).alias("how"))
    found = found.withColumn("_way", F.array("entity"))
    for _ in range(hops):
        step = predecessors_of(found.where("entity is not null").select("entity").distinct(), filings, annual_forms)
        met = found.join(step, "entity", "left")
        new = F.col("predecessor").isNotNull() & ~F.array_contains("_way", F.col("predecessor"))
        found = met.select(
            name, F.when(new, F.col("predecessor")).otherwise(F.col("entity")).alias("entity"), "ticker", F.when(new, F.concat("how", F.lit(" > predecessor"))).otherwise(F.col("how")).alias("how"),
            F.when(new, F.concat("_way", F.array("predecessor"))).otherwise(F.col("_way")).alias("_way"),
        )
    return found.drop("_way").join(companies.select("entity", "sic"), "entity", "left").select(name, "entity", "ticker", "how", "sic")
