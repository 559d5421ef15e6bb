"""From tickers to issuers, availability of metrics, statements of all repairs, names and splits."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import formulas, scalars
from quillstone.operators import issuers, statements
from quillstone.sources import filings


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_the_way_to_an_issuer(spark):
    asked = spark.createDataFrame([("brk.b",), ("EQR",), ("NEW",), ("odd",), ("none",), ("brk.b",)], "asked string")
    roster = spark.createDataFrame([("BRK-B", 1), ("EQR", 2), ("NEW", 4)], "ticker string, entity long")
    feed = spark.createDataFrame([("ODD", 7), ("EQR", 99)], "ticker string, entity long")
    companies = spark.createDataFrame([(1, ["BRK-B"], "a"), (2, [], "b"), (3, ["EQR"], "c"), (4, ["NEW"], "d"), (5, ["OLD"], "e"), (6, None, "f"), (7, ["ODD"], None)], "entity long, tickers array<string>, sic string")
    registrants = spark.createDataFrame([(2, "x", day(9), 0, 2), (2, "x", day(9), 1, 6), (2, "x", day(9), 2, 3), (2, "w", day(1), 0, 5)], "entity long, accession string, filing_date date, place int, other long")
    rows = [(4, "10-Q", "0000000006-24-000001", day(30)), (4, "10-Q", "0000000005-24-000002", day(20)), (4, "8-K", "0000000001-24-000003", day(40)), (5, "10-Q", "0000000005-24-000002", day(20)), (5, "10-K", "0000000005-24-000009", day(1)), (1, "10-K", "0000000001-24-000009", day(1)), (3, "10-K", "0000000003-24-000009", day(1)), (6, "10-K", "0000000006-24-000077", day(1))]
    table = spark.createDataFrame(rows, "entity long, form string, accession string, filing_date date")
    got = {r.asked: (r.entity, r.ticker, r.how, r.sic) for r in issuers.resolved(asked, roster, feed, companies, registrants, table).collect()}
    assert got == {"brk.b": (1, "BRK-B", "spelling", "a"), "EQR": (3, "EQR", "roster > sibling", "c"), "NEW": (5, "NEW", "roster > predecessor", "e"), "odd": (7, "ODD", "feed", None), "none": (None, None, None, None)}


def test_predecessors_in_a_circle_end(spark):
    """Two companies without annual reports that name each other, and one beyond."""
    rows = [(1, "10-Q", "0000000002-24-000001", day(3)), (2, "10-Q", "0000000002-24-000001", day(3)), (2, "10-K", "0000000009-24-000001", day(1)), (9, "10-K", "0000000009-24-000001", day(1))]
    table = spark.createDataFrame(rows, "entity long, form string, accession string, filing_date date")
    companies = spark.createDataFrame([(k, ["A"], "s") for k in (1, 2, 9)], "entity long, tickers array<string>, sic string")
    roster = spark.createDataFrame([("A", 1)], "ticker string, entity long")
    none = spark.createDataFrame([], "entity long, accession string, filing_date date, place int, other long")
    asked = spark.createDataFrame([("A",)], "asked string")
    for hops in (1, 3):
        assert [(r.entity, r.how) for r in issuers.resolved(asked, roster, roster, companies, none, table, hops=hops).collect()] == [(2, "roster > predecessor")]


def test_candidates_are_bounded(spark):
    rows = [(1, "10-Q", f"{k:010d}-24-000001", day(50 - k)) for k in range(2, 9)] + [(8, "10-K", "0000000008-24-000001", day(1))]
    table = spark.createDataFrame(rows, "entity long, form string, accession string, filing_date date")
    one = spark.createDataFrame([(1,)], "entity long")
    assert issuers.predecessors_of(one, table, ("10-K",)).count() == 0
    assert [r.predecessor for r in issuers.predecessors_of(one, table, ("10-K",), 7).collect()] == [8]


def test_availability(spark):
    rows = [(1, 0, 5.0, 1.0, None), (1, 1, 6.0, 1.0, 2.0), (1, 2, None, 1.0, 2.0), (1, 3, 7.0, 0.0, 2.0), (1, 4, 7.0, None, None)]
    df = spark.createDataFrame(rows, "k int, idx int, revenue double, cost double, equity double")
    metrics = {"roe": "(revenue - cost) / avg(equity)", "growth": "revenue / revenue[t-4] - 1", "deep": "growth + roe[t-1]", "x": "y", "y": "x + cost", "z": "x * 2", "days": "91.25 * 4"}
    got = {r.idx: r for r in formulas.with_availability(df, metrics, ["k"]).collect()}
    assert [got[k].roe_missing for k in range(5)] == ["equity", "equity[t-1]", "revenue", None, "cost"]
    assert [got[k].growth_available for k in range(5)] == [False] * 4 + [True]
    assert got[4].deep_available and got[3].deep_missing == "growth"
    assert not any(got[k].x_available or got[k].y_available or got[k].z_available for k in got) and got[0].z_missing == "z"
    assert got[0].days_available and formulas.circular(metrics) == {"x", "y", "z"}


def test_earnings_and_all_counts_are_rescaled(spark):
    n = 1_000.0
    rows = [(1, k, 1e6 * (1 + k % 3), n * (1000 if k == 2 else 1), n * (1000 if k == 3 else 1), n * (1000 if k == 1 else 1), 1e6 * (1 + k % 3) / n, 1e6 * (1 + k % 3) / n * (1000 if k == 4 else 1)) for k in range(6)]
    df = spark.createDataFrame(rows, "k int, idx int, ni double, shares double, basic double, diluted double, eps double, eps2 double")
    rules = statements.Rules(["k"], shares="shares", weighted="basic", diluted="diluted", net_income="ni", eps="eps", eps_diluted="eps2")
    got = statements.statement(df, rules).collect()
    assert all(abs(r[c] / n - 1) < 1e-9 for r in got for c in ("shares", "basic", "diluted")) and all(abs(r.eps2 / r.eps - 1) < 1e-9 for r in got)


def test_a_million_a_share_comes_back(spark):
    """Earnings of 1,000,000 a share where income over shares is 1,000; under 1,000 implied shares the earnings are no anchor."""
    df = spark.createDataFrame([(1, k, 5e8, 5e5, 1_000.0 if k else 1_000_000.0) for k in range(5)], "k int, idx int, ni double, basic double, eps double")
    got = statements.statement(df, statements.Rules(["k"], weighted="basic", net_income="ni", eps="eps")).orderBy("idx").collect()
    assert [r.eps for r in got] == pytest.approx([1_000.0] * 5)


def test_annual_reporters_keep_their_years(spark):
    df = spark.createDataFrame([(k, i, v, k == 1) for k in (1, 2) for i, v in enumerate([10.0, 100.0, 110.0])], "k int, idx int, n double, years boolean")
    got = statements.statement(df, statements.Rules(["k"], listing="n", annual="years")).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {1: 3, 2: 2}


def test_names_without_their_endings(spark):
    names = {"x:WestSegmentsMember": "West", "x:WestSegmentMember": "West", "x:WestMember": "West", "x:IPhoneMember": "IPhone", "x:SegmentsOfWest": "Segments Of West"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", scalars.spaced_name(F.col("n")).alias("s")).collect()} == names


def test_splits_of_a_clean_ratio_alone(spark, tmp_path):
    def chart(ticker, *splits):
        events = {"splits": {str(k): {"date": 1_700_000_000 + k * 86_400, "numerator": a, "denominator": b} for k, (a, b) in enumerate(splits)}}
        return {"ticker": ticker, "meta": {"currency": "USD", "regularMarketPrice": 1.0, "firstTradeDate": 1_600_000_000}, "timestamp": [1_650_000_000], "adjclose": [1.0], "events": events}

    for k, c in enumerate((chart("A", (4, 1), (10000, 9947)), chart("B", (1061, 1000)), chart("C"))):
        (tmp_path / f"{k}.json").write_text(json.dumps(c))
    got = sorted((r.ticker, r.factor, r.cover_start is not None) for r in filings.prices(spark, str(tmp_path))[1].collect())
    assert got == [("A", 4.0, True), ("B", None, True), ("C", None, True)]
