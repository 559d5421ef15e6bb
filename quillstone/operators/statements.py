"""From a grid of reported values to a repaired statement, and its valuation at market prices."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.formulas import fill_derived
from quillstone.operators import repairs, series, valuation
from quillstone.operators.matching import as_of


@dataclass
class Rules:
    """What the steps of a statement work on; a step without rules changes nothing.

    totals: concept, other, tags of totals, specific item or None, tolerance.  sources: name to column of other share counts.
    barred: concept to the groups it doesn't apply to.  weighted, diluted: average counts, the first of which that is there is what
    shares and earnings are held against.  annual: a boolean column, true for those that report years alone.
    """

    keys: list[str]
    shares: str | None = None
    weighted: str | None = None
    diluted: str | None = None
    net_income: str | None = None
    eps: str | None = None
    eps_diluted: str | None = None
    totals: list[tuple[str, str, list[str], str | None, float]] = field(default_factory=list)
    zeros: list[str] = field(default_factory=list)
    anchor: str = "total_assets"
    carried: list[str] = field(default_factory=list)
    source: str | None = None
    sources: dict[str, str] = field(default_factory=dict)
    derive: list[tuple[str, str]] = field(default_factory=list)
    listing: str | None = None
    annual: str | None = None
    group: str | None = None
    barred: dict[str, tuple[str, ...]] = field(default_factory=dict)
    internal: list[str] = field(default_factory=list)


def _averages(r: Rules) -> Column | None:
    columns = [F.nullif(F.col(c), F.lit(0)) for c in (r.weighted, r.diluted) if c]
    return F.coalesce(*columns) if columns else None


def _scale(df: DataFrame, r: Rules) -> DataFrame:
    """The averages first, by earnings alone; then the counts, for which they are an anchor too; then earnings per share by both."""
    if not (r.net_income and r.eps):
        return df
    for average in (r.weighted, r.diluted):
        df = repairs.repair_scale(df, r.keys, average, r.net_income, r.eps) if average else df
    both = _averages(r)
    if both is not None:
        df = df.withColumn("_average", both)
    if r.shares:
        df = repairs.repair_scale(df, r.keys, r.shares, r.net_income, r.eps, None if both is None else "_average")
    if both is not None:
        for eps in (r.eps, r.eps_diluted):
            df = repairs.repair_eps(df, eps, r.net_income, "_average") if eps else df
    return df.drop("_average")


def _totals(df: DataFrame, r: Rules) -> DataFrame:
    for concept, other, tags, specific, tolerance in r.totals:
        df = repairs.split_totals(df, concept, other, tags, specific, tolerance)
    return df


def _sources(df: DataFrame, r: Rules) -> DataFrame:
    average = _averages(r)
    if not (r.source and r.sources) or average is None:
        return df
    return repairs.arbitrate_shares(df.withColumn("_average", average), r.keys, r.shares, r.source, "_average", r.sources).drop("_average")


def _applicability(df: DataFrame, r: Rules) -> DataFrame:
    for concept, groups in r.barred.items():
        has = F.count(concept).over(Window.partitionBy(*r.keys)) > 0
        df = df.withColumn(f"{concept}_applicable", has | ~F.coalesce(F.col(r.group).isin(*groups), F.lit(False)))
    return df


STEPS: dict[str, Callable[[DataFrame, Rules], DataFrame]] = {
    "scale": _scale,
    "totals": _totals,
    "zeros": lambda df, r: repairs.zero_where_reported(df, r.zeros, r.anchor),
    "carry": lambda df, r: repairs.carry_forward(df, r.keys, r.carried),
    "sources": _sources,
    "derive": lambda df, r: fill_derived(df, r.derive),
    "listing": lambda df, r: series.before_listing(df, r.keys, r.listing, F.col(r.annual) if r.annual else None) if r.listing else df,
    "applicability": _applicability,
    "internal": lambda df, r: df.drop(*r.internal),
}


def statement(grid: DataFrame, rules: Rules) -> DataFrame:
    """The grid (keys, idx, a column for each concept) after all repairs in `repairs.ORDER`."""
    for step in repairs.ORDER:
        grid = STEPS[step](grid, rules)
    return grid


def valued(grid: DataFrame, prices: DataFrame, keys: list[str], end: str, currency: str | None = None, price_keys: list[str] | None = None) -> DataFrame:
    """valuation.multiples() of a statement with the last price at or before each period's end.

    prices: price_keys (keys, if they aren't given), d, price and, if currency is given, price_currency.  Where the statement's currency differs from the
    price's, or there is no price, price and all that depends on it are null.
    """
    values = ["price"] + (["price_currency"] if currency else [])
    priced = as_of(grid, prices, price_keys or keys, end, "d", values, "year")
    if currency:
        priced = priced.withColumn("price", F.when(F.col("price_currency") == F.col(currency), F.col("price"))).drop("price_currency")
    return valuation.multiples(priced, keys)
