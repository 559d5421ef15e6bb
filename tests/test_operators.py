"""Operators on small frames with known results."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import calendar, formulas, scalars
from quillstone.operators import audits, facts, matching, repairs, segments, series, splits, valuation


def day(text):
    return dt.date.fromisoformat(text)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_segment_labels(spark):
    rows = [(day("2026-04-26"), 1, "FY2027 Q1"), (day("2026-06-27"), 9, "FY2026 Q3"), (day("2026-03-31"), 12, "FY2026 Q1"), (day("2026-06-30"), None, "2026-06")]
    df = spark.createDataFrame(rows, "e date, m int, want string")
    assert df.where(~calendar.segment_period(F.col("e"), F.col("m")).eqNullSafe(F.col("want"))).count() == 0


def test_fiscal_period_of_drifting_years(spark):
    rows = [(day("2025-11-02"), 10, 2025, 4), (day("2026-02-01"), 1, 2026, 4), (day("2024-09-28"), 9, 2024, 4), (day("2024-12-28"), 9, 2025, 1), (day("2024-03-31"), 12, 2024, 1), (day("2024-01-02"), 12, 2023, 4)]
    df = spark.createDataFrame(rows, "e date, m int, fy int, q int")
    fy, q = calendar.fiscal_period(F.col("e"), F.col("m"))
    assert df.where((fy != F.col("fy")) | (q != F.col("q"))).count() == 0


def test_period_keys(spark):
    row = one(spark, a=calendar.period_index(F.lit("FY2026 Q2")), b=calendar.period_index(F.lit("FY2024")), c=calendar.period_index(F.lit("soon")), d=calendar.epoch_date(F.lit(-86400)))
    assert (row.a, row.b, row.c, row.d) == (2026 * 4 + 2, 2024 * 4 + 4, None, day("1969-12-31"))


def test_scalars(spark):
    row = one(
        spark, split=scalars.split_factor(F.lit(2.05)), back=scalars.split_factor(F.lit(0.1)), none=scalars.split_factor(F.lit(1.2)), power=scalars.thousands(F.lit(9.8e5)),
        member=scalars.member_key(F.lit("aapl:IPhoneSegmentMember"), {"iphone": "phone"}), name=scalars.spaced_name(F.lit("x:GreaterChinaMember")), words=scalars.name_tokens(F.lit("USGaapNetIncome2024"), ("income",)),
        middle=scalars.upper_middle(F.array(*map(F.lit, (9.0, 1.0, 2.0, 3.0, 4.0)))), masked=scalars.custom_masked(F.lit("aapl:MacMember")), share=scalars.class_label(F.lit("us-gaap:CommonClassAMember")),
    )
    assert row.split == 2.0 and abs(row.back - 0.1) < 1e-12 and row.none is None and row.power == 6
    assert row.member == "phone" and row.name == "Greater China" and set(row.words) == {"us", "gaap", "net", "2024"}
    assert row.middle == 3.0 and row.masked == "custom" and row.share == "Class A"


CELLS = "entity int, concept string, fy int, q int, kind string, val double, form string"


def test_quarters_from_cumulative_values(spark):
    rows = [(1, "cfo", 2024, q, "C", v, "10-Q") for q, v in ((1, 10.0), (2, 30.0), (3, 60.0))] + [(1, "cfo", 2024, 4, "A", 100.0, "10-K")]
    got = {r.q: (r.val, r.is_estimated) for r in facts.quarters(spark.createDataFrame(rows, CELLS)).collect()}
    assert got == {1: (10.0, False), 2: (20.0, False), 3: (30.0, False), 4: (40.0, True)}


def test_year_alone_gives_no_quarters(spark):
    rows = [(1, "rnd", 2024, 4, "A", 58.2, "10-K")]
    assert facts.quarters(spark.createDataFrame(rows, CELLS)).count() == 0
    kept = facts.quarters(spark.createDataFrame(rows, CELLS), F.lit(True)).collect()
    assert {r.q: r.val for r in kept} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 58.2} and all(r.is_estimated for r in kept)


def test_fourth_quarter_that_is_the_year(spark):
    rows = [(1, "ni", 2024, q, "Q", v, "10-Q") for q, v in ((1, 50.0), (2, 60.0), (3, 50.0))] + [(1, "ni", 2024, 4, "Q", 218.65, "10-K")]
    got = {r.q: round(r.val, 2) for r in facts.quarters(spark.createDataFrame(rows, CELLS)).collect()}
    assert got[4] == round(218.65 - 160, 2)


def test_long_first_quarter_counts_twice(spark):
    rows = [(1, "t", day("2023-12-31"), day("2024-04-21"), 5.0, "10-Q", day("2024-05-01"))]
    df = spark.createDataFrame(rows, "entity int, tag string, start date, end date, val double, form string, filed date")
    months = spark.createDataFrame([(1, 12)], "entity int, fye_month int")
    assert {r.kind for r in facts.keyed(df, months).collect()} == {"Q", "C"}


def test_restatement_is_independent_of_row_order(spark):
    rows = [(1, "a", day("2024-01-01"), 1.0, 1), (1, "a", day("2024-05-01"), 2.0, 2), (1, "a", day("2024-05-01"), 3.0, 3)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "entity int, tag string, filed date, val double, pos int").repartition(3)
    got = facts.latest_restated(df, ["entity", "tag"], [F.desc("filed"), F.asc("pos")]).first()
    assert (got.val, got.orig_filed) == (2.0, day("2024-01-01"))


def test_namespace_and_currency(spark):
    df = spark.createDataFrame([(1, "ifrs-full", "Assets", "EUR"), (1, "us-gaap", "Assets", "USD"), (1, "ifrs-full", "Cash", "EUR"), (2, "us-gaap", "Cash", "shares")], "entity int, ns string, tag string, unit string")
    assert {r.entity: r.ns for r in facts.namespace(df).collect()} == {1: "ifrs-full", 2: "us-gaap"}
    assert {r.entity: r.currency for r in facts.reporting_currency(df).collect()} == {1: "EUR", 2: "USD"}


def series_of(spark, values):
    return spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "k int, idx int, v double")


def test_trailing_carry_and_average(spark):
    df = series_of(spark, [1.0, None, 3.0, 4.0, 5.0, 6.0, None, None, None, None])
    got = df.select("idx", series.trailing(["k"], "v").alias("t"), series.carried(["k"], "v").alias("c"), series.average_balance(["k"], "v").alias("a")).orderBy("idx").collect()
    assert [r.t for r in got][:6] == [None, None, None, None, None, 18.0]
    assert [r.c for r in got] == [1.0, 1.0, 3.0, 4.0, 5.0, 6.0, 6.0, 6.0, 6.0, None]
    assert [r.a for r in got][:4] == [1.0, None, None, 3.5]


def test_single_value_is_not_carried(spark):
    df = series_of(spark, [1.0, None])
    assert [r.c for r in df.select(series.carried(["k"], "v").alias("c")).collect()] == [1.0, None]


def test_listing_cut(spark):
    got = series.before_listing(series_of(spark, [10.0, 11.0, 100.0, 110.0]), ["k"], "v").select("idx").collect()
    assert sorted(r.idx for r in got) == [2, 3]


def test_scale_repair(spark):
    rows = [(1, k, 709.1e6 if k != 1 else 709.1, 1418.2e6, 2.0) for k in range(5)]
    df = spark.createDataFrame(rows, "k int, idx int, shares double, net_income double, eps double")
    got = repairs.repair_scale(df, ["k"], "shares", "net_income", "eps").orderBy("idx").collect()
    assert all(abs(r.shares / 709.1e6 - 1) < 1e-9 for r in got) and [r.shares_rescaled for r in got] == [False, True, False, False, False]


def test_total_tags(spark):
    df = spark.createDataFrame([(3672.0, "DebtTotal", 3672.0), (5000.0, "DebtTotal", 3672.0), (3672.0, "Own", 3672.0)], "debt double, debt_tag string, short double")
    got = [r.debt for r in repairs.split_totals(df, "debt", "short", ["DebtTotal"]).collect()]
    assert got == [0.0, 5000.0, 3672.0]


def test_share_source_arbitration(spark):
    rows = [(1, 0, 50.0, "cover", 100.0, 101.0), (1, 1, 100.0, "cover", 100.0, None), (1, 2, 115.0, "cover", 100.0, 99.0)]
    df = spark.createDataFrame(rows, "k int, idx int, shares double, src string, weighted double, other double")
    got = repairs.arbitrate_shares(df, ["k"], "shares", "src", "weighted", {"other": "other"}).orderBy("idx").collect()
    assert [r.shares for r in got] == [101.0, 100.0, 99.0]


def test_applicability(spark):
    cells = spark.createDataFrame([(1, "bank", "inventory", None), (1, "bank", "inventory", None), (2, "bank", "inventory", 5.0), (3, "other", "inventory", None)], "entity int, group_name string, concept string, value double")
    groups = spark.createDataFrame([("bank", "inventory", True)], "group_name string, concept string, structural boolean")
    got = {(r.entity, r.applicable) for r in repairs.applicability(cells, groups).collect()}
    assert got == {(1, False), (2, True), (3, True)}


def test_rules_and_metrics(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 3.0, None), (1, 2, 20.0, None, 1.0), (1, 3, 0.0, 1.0, 1.0)], "k int, idx int, a double, b double, c double")
    got = df.select("idx", formulas.derived("a - b - c?").alias("x"), formulas.derived("b / a").alias("y")).orderBy("idx").collect()
    assert [r.x for r in got] == [7.0, None, -2.0] and [r.y for r in got] == [0.3, None, None]
    with pytest.raises(ValueError):
        formulas.derived("- a")
    with pytest.raises(ValueError):
        formulas.ordered({"x": "y + 1", "y": "x + 1"})
    assert formulas.ordered({"margin": "gross / a", "gross": "a - b"}) == ["gross", "margin"]
    m = formulas.with_metrics(df, {"g": "a / a[t-1] - 1", "r": "a / b"}, ["k"], zero_means_inapplicable={"r": "b"}).orderBy("idx").collect()
    assert [r.g for r in m] == [None, 1.0, -1.0] and all(r.r_applicable for r in m)
    with pytest.raises(ValueError):
        formulas.metric("__import__('os')", ["k"])


def test_bounded_zero(spark):
    df = spark.createDataFrame([(100.0, 95.0, 1000.0), (100.0, None, 1000.0), (None, 95.0, 1000.0)], "total double, current double, cap double")
    got = [r.d for r in df.select(valuation.bounded_zero(F.lit(None).cast("double"), ["total"], ["current"], "cap").alias("d")).collect()]
    assert got == [0.0, 0.0, None]


def test_targets(spark):
    df = spark.createDataFrame([(100.0, 20.0, 5.0), (100.0, 20.0, None)], "price double, pe double, eps double")
    got = valuation.targets(df, F.col("eps"), F.lit(10.0), "price", "pe").collect()
    assert (got[0].forward_pe, got[0].target_price, got[0].input_required) == (20.0, 100.0, False) and got[1].input_required


POINTS = "entity int, period string, kind string, filed date, val double, pos int"


def test_split_detection(spark):
    rows = [(1, "2020Q1", "shares", day("2020-05-01"), 637.5, 0), (1, "2020Q1", "shares", day("2021-05-01"), 318.8, 1), (2, "2020Q1", "shares", day("2020-05-01"), 100.0, 0), (2, "2020Q1", "shares", day("2021-05-01"), 101.0, 1)]
    got = splits.detected(spark.createDataFrame(rows, POINTS)).collect()
    assert [(r.entity, r.factor, r.confirmed) for r in got] == [(1, 0.5, True)] and got[0].dev < 0.001


def test_two_splits_a_year_apart(spark):
    rows = [(1, day("2020-01-01"), day("2020-03-01")), (1, day("2020-02-01"), day("2020-04-01")), (1, day("2021-01-01"), day("2021-03-01"))]
    got = splits.stabbed(spark.createDataFrame(rows, "k int, lo date, hi date"), ["k"]).collect()
    assert {r.threshold for r in got} == {day("2020-03-01"), day("2021-03-01")}


def test_arbitration(spark):
    schema = "entity int, threshold date, factor double, confirmed boolean, dev double, dev_raw double"
    rows = [(1, day("2020-03-01"), 2.0, True, 0.0, 0.0), (1, day("2021-03-01"), 2.0, True, 0.0, 0.063), (1, day("2023-03-01"), 8.0, True, 0.04, 0.04), (1, day("2023-06-01"), 0.5, True, 0.0002, 0.0002), (2, day("2020-03-01"), 3.0, False, None, 0.01)]
    listed = spark.createDataFrame([(1, day("2020-02-01"), 2.0, day("2010-01-01"), day("2020-03-01")), (1, day("2022-01-10"), 35.0, day("2010-01-01"), day("2022-02-01"))], "entity int, ex_date date, factor double, cover_start date, first_filed date")
    got = {(r.entity, r.threshold, r.source) for r in splits.arbitrated(spark.createDataFrame(rows, schema), listed).collect()}
    assert got == {(1, day("2020-03-01"), "both"), (1, day("2023-06-01"), "exact"), (1, day("2022-02-01"), "exchange"), (2, day("2020-03-01"), "no exchange data")}


def test_split_adjustment(spark):
    values = spark.createDataFrame([(1, "shares", day("2019-01-01"), 10.0), (1, "USD/shares", day("2019-01-01"), 10.0), (1, "shares", day("2022-01-01"), 10.0)], "entity int, unit string, filed date, val double")
    events = spark.createDataFrame([(1, day("2020-01-01"), 2.0), (1, day("2021-01-01"), 3.0)], "entity int, threshold date, factor double")
    assert sorted(r.val for r in splits.adjusted(values, events, ["entity"]).collect()) == [10.0 / 6, 10.0, 60.0]


def test_as_of_against_plain_search(spark):
    rng = np.random.default_rng(0)
    base = dt.date(2020, 1, 1)
    right = {(int(k), base + dt.timedelta(int(d))): float(v) for k, d, v in zip(rng.integers(0, 3, 60), rng.integers(0, 400, 60), rng.random(60), strict=True)}
    left = [(int(k), base + dt.timedelta(int(d))) for k, d in zip(rng.integers(0, 4, 80), rng.integers(-20, 420, 80), strict=True)]
    got = matching.as_of(spark.createDataFrame(left, "k int, d date"), spark.createDataFrame([(k, d, v) for (k, d), v in right.items()], "k int, at date, v double"), ["k"], "d", "at", ["v"]).collect()
    for r in got:
        before = [(d, v) for (k, d), v in right.items() if k == r.k and d <= r.d]
        assert r.v == (max(before)[1] if before else None)
    assert len(got) == len(left)


def test_reconciliation_finds_parents(spark):
    rows = [(1, "axis", "revenue", p, "A", m, v, False) for p in ("2024", "2025") for m, v in (("iphone", 200.0), ("mac", 100.0), ("service", 100.0), ("product", 300.0))]
    values = spark.createDataFrame(rows, "entity int, axis string, concept string, period string, kind string, member string, val double, is_residual boolean")
    totals = spark.createDataFrame([(1, "revenue", p, 400.0) for p in ("2024", "2025")], "entity int, concept string, period string, total double")
    got = segments.reconciled(values, totals).collect()
    assert {r.member for r in got if r.is_parent} == {"product"} and all(r.verified for r in got)


def test_subset_choices():
    assert segments.possible_parents({"a": 200.0, "b": 100.0, "c": 100.0, "p": 300.0}, 400.0, 1.0) == [("p",)]
    assert segments.best_residual({"x": -1009.0, "y": 144.0}, -865.0, 1.0) == ("x", "y")
    many = {f"m{k}": 10.0 for k in range(20)} | {"sum": 200.0}
    assert segments.possible_parents(many, 200.0, 0.5) == [("sum",)]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("a", 1), ("b", 1), ("c", 2)], {"a": 1, "b": 1, "c": 2}),
        ([("a", 1), ("b", 2), ("c", 1), ("c", 2)], {}),
        ([("a", 1), ("b", 2), ("c", 3)], {"a": 1, "b": 2, "c": 3}),
        ([("a", 1), ("b", 2), ("c", 3), ("d", 4)], {}),
        ([("a", 1), ("a", 3), ("b", 2)], {"a": 1, "b": 2}),
    ],
)
def test_generations(spark, rows, want):
    df = spark.createDataFrame([(1, m, p) for m, p in rows], "k int, member string, period int")
    assert {r.member: r.generation for r in segments.generations(df, ["k"]).collect()} == want


def test_incomplete_projection_is_rejected(spark):
    cross = spark.createDataFrame([(1, "p", "x", m, "o", "revenue", v) for m, v in (("a", 50.0), ("b", 31.0))], "entity int, period string, axis string, member string, other string, concept string, val double")
    totals = spark.createDataFrame([(1, "p", "revenue", 100.0)], "entity int, period string, concept string, total double")
    direct = spark.createDataFrame([], "entity int, period string, axis string")
    assert segments.projected(cross, totals, direct).count() == 0


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([("a", k) for k in range(50)] + [("b", k) for k in range(3)], "s string, k int")
    got = audits.round_robin(df, "s", "k", 8, 1).collect()
    assert sum(r.s == "b" for r in got) == 3 and len(got) == 8


def test_empty_tables(spark):
    cells = spark.createDataFrame([], CELLS)
    assert facts.quarters(cells).count() == 0
    assert splits.detected(spark.createDataFrame([], POINTS)).count() == 0
    empty = spark.createDataFrame([], "k int, d date")
    assert matching.as_of(empty, spark.createDataFrame([], "k int, at date, v double"), ["k"], "d", "at", ["v"]).count() == 0


def test_share_classes(spark):
    from quillstone.operators import shares

    rows = [(1, "d", "A", 488450.0, True), (1, "d", "B", 1408035161.0, True), (2, "d", "A", 73641439.0, True), (2, "d", "C", 73641439.0, False), (3, "d", "A", 1.22e8, True), (3, "d", "B", 1.34e8, False)]
    classes = spark.createDataFrame(rows, "entity int, end string, class string, n double, earns boolean")
    implied = spark.createDataFrame([(3, "d", 1.25e8)], "entity int, end string, implied double")
    ratios = spark.createDataFrame([(1, "B", 1500.0)], "entity int, class string, ratio double")
    got = {r.entity: (r.total, r.basis) for r in shares.class_totals(classes, implied, ratios).collect()}
    assert got == {1: (488450.0 * 1500 + 1408035161.0, "converted"), 2: (73641439.0, "one total for every class"), 3: (1.22e8, "earning classes")}


def test_one_basis_by_continuity(spark):
    from quillstone.operators import shares

    rows = [(1, day("2024-01-01"), 10.0, 10.0, 10.0), (1, day("2024-04-01"), 11.0, None, 10.0), (1, day("2024-07-01"), 115.0, None, 10.0), (1, day("2024-10-01"), 5000.0, None, 10.0), (1, day("2025-01-01"), 120.0, 1.0, 10.0)]
    got = shares.on_one_basis(spark.createDataFrame(rows, "entity int, d date, val double, factor double, ratio double")).orderBy("d").collect()
    assert [r.val for r in got] == [100.0, 110.0, 115.0, 120.0]


def test_vocabulary_and_kin(spark):
    concepts = spark.createDataFrame([("a", ["x", "y"], False), ("a", ["y", "z"], False), ("i", ["x"], True)], "concept string, tokens array<string>, internal boolean")
    assert [(r.concept, r.tokens) for r in audits.vocabulary(concepts).collect()] == [("a", ["x", "y", "z"])]
    tags = spark.createDataFrame([("DebtNoncurrent",), ("Debt",), ("Cash",)], "tag string")
    assert [(r.tag, r.kin) for r in audits.kin_tags(tags, tags).collect()] == [("DebtNoncurrent", "Debt")]


def test_tag_scores_count_tokens_of_many_concepts(spark):
    concepts = spark.range(1300).selectExpr("id AS concept", "array(concat('own', id), if(id < 1200, 'common', 'other')) AS tokens")
    tags = spark.createDataFrame([("t", ["own7", "common"])], "tag string, tokens array<string>")
    got = audits.score_tags(tags, concepts).collect()
    assert [(r.tag, r.concept) for r in got] == [("t", 7)] and got[0].score == pytest.approx(math.log(1300) + math.log(1300 / 1200))


def test_counts_that_the_next_average_catches_up_with(spark):
    # 130 against 100, the next average being 109: it didn't move by a tenth, so the count goes; at 120 it stays
    rows = [(1, 0, 130.0, "cover", 100.0, 100.0), (1, 1, 109.0, "cover", 109.0, None), (2, 0, 130.0, "cover", 100.0, 100.0), (2, 1, 120.0, "cover", 120.0, None), (3, 0, 50.0, "x", 100.0, 0.0), (3, 1, 70.0, "x", None, 70.0)]
    df = spark.createDataFrame(rows, "k int, idx int, shares double, src string, weighted double, other double")
    got = {(r.k, r.idx): r.shares for r in repairs.arbitrate_shares(df, ["k"], "shares", "src", "weighted", {"other": "other"}).collect()}
    assert got == {(1, 0): 100.0, (1, 1): 109.0, (2, 0): 130.0, (2, 1): 120.0, (3, 0): 50.0, (3, 1): 70.0}
    convicted = spark.createDataFrame([(1, 0, 50.0, "x", 100.0, 101.0), (1, 1, 115.0, "x", 100.0, None), (1, 2, 70.0, "x", None, 70.0), (1, 3, 108.0, "x", 100.0, 100.0)], df.schema)
    got = {r.idx: (r.shares, r.src) for r in repairs.arbitrate_shares(convicted, ["k"], "shares", "src", "weighted", {"other": "other"}).collect()}
    assert got == {0: (101.0, "other"), 1: (None, "x"), 2: (None, "x"), 3: (108.0, "x")}


def test_listing_cut_counts_values_alone(spark):
    got = series.before_listing(series_of(spark, [None] * 10 + [10.0, None, 100.0, 110.0]), ["k"], "v").select("idx").collect()
    assert sorted(r.idx for r in got) == [12, 13]
    annual = series.before_listing(series_of(spark, [10.0, 100.0, 110.0]), ["k"], "v", F.lit(True))
    assert annual.count() == 3


def test_optional_factors_and_masks(spark):
    df = spark.createDataFrame([(6.0, None, 3.0), (6.0, 2.0, None), (6.0, 0.0, 3.0)], "a double, b double, c double")
    got = df.select(formulas.derived("a * b?").alias("x"), formulas.derived("a / c?").alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(6.0, 2.0), (12.0, 6.0), (None, 2.0)]
    assert one(spark, m=scalars.digits_masked(F.lit("a12b"))).m == "a##b"


def test_each_split_is_matched_once(spark):
    schema = "entity int, threshold date, factor double, confirmed boolean, dev double, dev_raw double"
    found = spark.createDataFrame([(1, day("2020-03-01"), 2.0, True, 0.0, 0.0), (1, day("2020-04-01"), 2.0, True, 0.0, 0.0), (1, day("2022-01-01"), 2.0, True, 0.5, 0.5)], schema)
    listed = spark.createDataFrame([(1, day("2020-02-01"), 2.0, day("2010-01-01"), day("2020-03-01")), (1, None, None, day("2010-01-01"), None)], "entity int, ex_date date, factor double, cover_start date, first_filed date")
    got = {(r.threshold, r.cell) for r in splits.decided(found, listed).collect()}
    assert got == {(day("2020-03-01"), "both"), (day("2020-04-01"), "repeat"), (day("2022-01-01"), "denied")}
    assert splits.arbitrated(found, listed, found.select("entity")).count() == 0


def test_statement_steps_run_in_order(spark):
    from quillstone.operators import statements

    seen = []
    steps = {name: (lambda df, _, name=name: seen.append(name) or df) for name in repairs.ORDER}
    kept = dict(statements.STEPS)
    assert tuple(kept) == repairs.ORDER
    try:
        statements.STEPS.update(steps)
        statements.statement(spark.range(1), statements.Rules(["id"]))
    finally:
        statements.STEPS.update(kept)
    assert tuple(seen) == repairs.ORDER


def test_valuation_needs_one_currency(spark):
    from quillstone.operators import statements

    names = ("net_income", "revenue", "cfo", "capex", "operating_income", "dna", "equity", "total_liabilities", "cash", "short_term_investments", "short_term_debt", "long_term_debt", "shares")
    rows = [(k, i, day(f"2024-0{3 * i}-28"), c, *[1.0 + i] * len(names)) for k, c in ((1, "USD"), (2, "EUR")) for i in (1, 2)]
    grid = spark.createDataFrame(rows, "k int, idx int, end date, currency string, " + ", ".join(f"{n} double" for n in names))
    prices = spark.createDataFrame([(k, day("2024-03-20"), 10.0, "USD") for k in (1, 2)] + [(1, day("2024-06-01"), 20.0, "USD")], "k int, d date, price double, price_currency string")
    got = {(r.k, r.idx): r.market_cap for r in statements.valued(grid, prices, ["k"], "end", "currency").collect()}
    assert got == {(1, 1): 20.0, (1, 2): 60.0, (2, 1): None, (2, 2): None}


def test_config_asset(spark, tmp_path):
    from quillstone.sources import config

    (tmp_path / "axes.json").write_text('{"axes": [{"name": "a", "priority": 2}, {"name": "b", "priority": 1}]}')
    got = config.asset(spark, str(tmp_path / "axes.json"), "axes array<struct<name:string,priority:int>>", "axes").collect()
    assert [(r.ordinal, r.name, r.priority) for r in got] == [(0, "a", 2), (1, "b", 1)]
