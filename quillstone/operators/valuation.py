"""Valuation on a statement grid with prices as of each period's end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.scalars import over_positive
from quillstone.operators.series import growth, over_own_median, trailing


def bounded_zero(bound: Column, plus: list[str], minus: list[str], market_cap: str, share: float = 0.1) -> Column:
    """0 where the most an absent item can be, sum(plus) - sum(minus, absent ones nought), is a small share of the market cap.

    plus must all be there, the bound not negative and the market cap positive; else null.  bound is the item itself.
    """
    most = sum((F.col(c) for c in plus), F.lit(0.0)) - sum((F.coalesce(F.col(c), F.lit(0.0)) for c in minus), F.lit(0.0))
    small = (F.col(market_cap) > 0) & (most >= 0) & (most / F.col(market_cap) <= share)
    return F.coalesce(bound, F.when(small, F.lit(0.0)))


def multiples(grid: DataFrame, keys: list[str]) -> DataFrame:
    """grid with market_cap, trailing sums and the multiples.

    grid: keys, idx, price, shares, net_income, revenue, cfo, capex, operating_income, dna, equity, total_liabilities,
    cash, short_term_investments, short_term_debt, long_term_debt.  A multiple of something not positive is null; an
    absent short-term investment is nought; net debt needs both debts.
    """
    df = grid.withColumn("market_cap", F.col("price") * F.col("shares"))
    df = df.withColumn("_fcf", F.col("cfo") - F.col("capex")).withColumn("_ebitda", F.col("operating_income") + F.col("dna"))
    for name, of in (("net_income_ttm", "net_income"), ("revenue_ttm", "revenue"), ("fcf_ttm", "_fcf"), ("ebitda_ttm", "_ebitda")):
        df = df.withColumn(name, trailing(keys, of))
    cap = F.col("market_cap")
    liquid = F.col("cash") + F.coalesce("short_term_investments", F.lit(0.0))
    df = df.withColumn("pe", over_positive(cap, F.col("net_income_ttm"))).withColumn("ps", over_positive(cap, F.col("revenue_ttm")))
    df = df.withColumn("pfcf", over_positive(cap, F.col("fcf_ttm"))).withColumn("pb", over_positive(cap, F.col("equity")))
    df = df.withColumn("ev", cap + F.col("total_liabilities") - liquid).withColumn("ev_debt", cap + F.col("short_term_debt") + F.col("long_term_debt") - liquid)
    df = df.withColumn("ev_ebitda", over_positive(F.col("ev"), F.col("ebitda_ttm")))
    df = df.withColumn("_growth", growth(keys, "net_income_ttm", 4) * 100)
    df = df.withColumn("peg", over_positive(F.col("pe"), F.col("_growth"))).withColumn("ps_vs_median", over_own_median(keys, "ps"))
    return df.drop("_fcf", "_ebitda", "_growth")


def targets(df: DataFrame, eps_forecast: Column, growth_forecast: Column, price: str, pe: str) -> DataFrame:
    """Forward multiples and target price from a user's forecasts; where a forecast is null, input_required is true."""
    missing = eps_forecast.isNull() | growth_forecast.isNull()
    forward = over_positive(F.col(price), eps_forecast)
    out = df.withColumn("input_required", missing).withColumn("forward_pe", forward).withColumn("forward_peg", over_positive(forward, growth_forecast))
    out = out.withColumn("target_price", F.col(pe) * eps_forecast)
    return out.withColumn("upside", over_positive(F.col("target_price"), F.col(price)) - 1)
