"""Share counts from all places, coverage of a market, agreement of tags, audits of grids, writers of lists: known results."""

import datetime as dt
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillstone.operators import audits, facts, grid_audit, market_coverage, picks, ranks, repairs, segments, series, share_sources, shares
from quillstone.sources import filings, sinks


def day(text):
    return dt.date.fromisoformat(text)


ENDS = [(1, f"P{k}", day(f"2024-{m:02d}-28")) for k, m in enumerate((3, 6, 9, 12), 1)] + [(2, "P1", day("2024-03-28")), (2, "P2", None)]
POINT, DATED = "entity int, period string, val double", "entity int, end date, val double"


def aligned(spark, **more):
    periods = spark.createDataFrame(ENDS, "entity int, period string, end date")
    reported = spark.createDataFrame([(1, "P1", 100.0), (1, "P9", 7.0)], POINT)
    cover = spark.createDataFrame([(1, "P1", 90.0), (1, "P2", 91.0)], POINT)
    averages = spark.createDataFrame([(1, "P3", None, 97.0), (1, "P4", 95.0, 98.0), (2, "P2", 5.0, None)], "entity int, period string, basic double, diluted double")
    out = share_sources.aligned(periods, reported, cover, averages, **more)
    return {(r.entity, r.period): r for r in out.collect()}


def test_every_place_stays_and_the_first_fills(spark):
    classes = spark.createDataFrame([(1, day("2024-07-01"), 80.0), (1, day("2024-06-28"), 81.0), (1, day("2024-06-28"), None), (1, day("2024-12-12"), 82.0), (1, day("2024-09-27"), 83.0), (1, None, 84.0), (2, day("2024-06-11"), 6.0)], DATED)
    got = aligned(spark, classes=classes, net=spark.createDataFrame([(1, day("2024-03-28"), 70.0), (2, day("2024-03-28"), 71.0)], DATED))
    assert len(got) == 6
    first = got[1, "P1"]
    assert (first.us_gaap, first.issued_treasury, first.cover, first.shares, first.shares_source, first.shares_estimated) == (100.0, 70.0, 90.0, 100.0, "us-gaap", False)
    second = got[1, "P2"]
    assert (second.cover, second.classes, second.shares, second.shares_source) == (91.0, 81.0, 91.0, "cover")
    third = got[1, "P3"]  # the cover of 12 December is 75 days after 28 September
    assert (third.classes, third.diluted, third.shares, third.shares_source, third.shares_estimated) == (82.0, 97.0, 82.0, "classes", True)
    assert (got[1, "P4"].shares, got[1, "P4"].shares_source) == (95.0, "average")
    # 11 June is 75 days after 28 March; net counts never fill
    assert (got[2, "P1"].shares, got[2, "P1"].issued_treasury) == (6.0, 71.0)
    assert (got[2, "P2"].shares, got[2, "P2"].shares_source) == (5.0, "average")


def test_averages_by_class_replace_each_kind_alone(spark):
    classes = spark.createDataFrame([(1, day("2024-12-23"), None, 60.0), (1, day("2025-01-02"), 50.0, 61.0), (1, day("2024-09-22"), 1.0, 2.0)], "entity int, end date, basic double, diluted double")
    got = aligned(spark, class_averages=classes)
    assert (got[1, "P4"].basic, got[1, "P4"].diluted, got[1, "P4"].shares) == (50.0, 60.0, 50.0)
    assert (got[1, "P3"].basic, got[1, "P3"].diluted, got[1, "P3"].shares) == (None, 97.0, 97.0)
    assert got[2, "P1"].shares is None and got[2, "P1"].shares_source is None and got[2, "P1"].shares_estimated is None


def test_places_feed_the_arbitration(spark):
    periods = spark.createDataFrame([(1, "P1", day("2024-03-31"), 1), (1, "P2", day("2024-06-30"), 2)], "entity int, period string, end date, idx int")
    point = lambda *rows: spark.createDataFrame(list(rows), POINT)
    averages = spark.createDataFrame([(1, "P1", 100.0, None), (1, "P2", 101.0, None)], "entity int, period string, basic double, diluted double")
    out = share_sources.aligned(periods, point((1, "P1", 160.0), (1, "P2", 161.0)), point((1, "P1", 99.0)), averages, net=spark.createDataFrame([(1, day("2024-06-30"), 102.0)], DATED))
    settled = repairs.arbitrate_shares(out, ["entity"], "shares", "shares_source", "basic", {"us-gaap": "us_gaap", "cover": "cover", "classes": "classes", "issued-treasury": "issued_treasury"}, "diluted")
    assert [(r.shares, r.shares_source) for r in settled.orderBy("idx").collect()] == [(99.0, "cover"), (102.0, "issued-treasury")]


def test_covers_of_annual_reporters(spark):
    rows = [(1, 2023, "FY", day("2024-02-01"), 10.0), (1, 2023, "FY", day("2024-03-01"), 11.0), (1, 2023, "Q1", day("2023-05-01"), 9.0), (1, 2022, "FY", day("2023-02-01"), 0.0), (2, 2023, None, day("2024-02-01"), 5.0)]
    dei = spark.createDataFrame(rows, "entity int, fy int, fp string, filed date, val double")
    assert [tuple(r) for r in shares.cover_counts(dei, annual=True).collect()] == [(1, "FY2023", 11.0)]
    assert sorted(r.period for r in shares.cover_counts(dei).collect()) == ["FY2023 Q1", "FY2023 Q4"]


FACT = "entity int, concept string, dimensioned boolean"


def test_coverage_of_a_market(spark):
    rows = [(1, "rev", False), (1, "rev", False), (1, "cogs", False), (1, "seg", True), (2, "rev", True), (2, "seg", False), (3, "cash", False), (3, "rev", True), (4, None, False), (5, "cash", True), (1, "rev", True)]
    concepts = spark.createDataFrame([("rev", "IS"), ("cogs", "IS"), ("gross", "IS"), ("seg", "IS"), ("cash", "BS"), ("flow", "CF")], "concept string, stmt string")
    got = {r.concept: tuple(r)[1:] for r in market_coverage.market_coverage(spark.createDataFrame(rows, FACT), concepts, {"gross": ["rev", "cogs"]}).collect()}
    # two companies filed an income statement, one a balance sheet, none a statement of cash flows
    assert got == {"rev": ("IS", 2, 1, 0, 1, 0.5), "cogs": ("IS", 2, 1, 0, 0, 0.5), "gross": ("IS", 2, 0, 1, 0, 0.5), "seg": ("IS", 2, 1, 0, 1, 0.5), "cash": ("BS", 1, 1, 0, 0, 1.0)}


def test_coverage_by_group_feeds_applicability(spark):
    rows = [(k, "rev", False) for k in range(30)] + [(0, "rare", False), (40, "rev", False)]
    concepts = spark.createDataFrame([("rev", "IS"), ("rare", "IS")], "concept string, stmt string")
    groups = spark.createDataFrame([(k, "banks") for k in range(30)] + [(40, None)], "entity int, sector string")
    rates = market_coverage.market_coverage(spark.createDataFrame(rows, FACT), concepts, {}, groups)
    assert {(r.sector, r.concept): (r.n_all, r.n_direct) for r in rates.collect()} == {("banks", "rev"): (30, 30), ("banks", "rare"): (30, 1), (None, "rev"): (1, 1), (None, "rare"): (1, 0)}
    few = audits.industry_applicability(rates, "sector")
    assert [tuple(r) for r in few.collect()] == [("banks", "rare", True)]
    assert [tuple(r) for r in sinks.grouped_lists(few, "sector").collect()] == [("banks", ["rare"])]


def test_empty_markets(spark):
    concepts = spark.createDataFrame([("rev", "IS")], "concept string, stmt string")
    assert market_coverage.market_coverage(spark.createDataFrame([], FACT), concepts, {"rev": ["x"]}).count() == 0
    points = spark.createDataFrame([], "entity int, tag string, unit string, start date, end date, val double, filed date")
    assert market_coverage.tag_agreement(points, spark.createDataFrame([("c", "t", 1)], "concept string, tag string, place int"), spark.createDataFrame([("c", "u")], "concept string, tag string")).count() == 0


def test_agreement_of_tags(spark):
    rows, ratios = [], {"same": [], "double": [], "noise": []}
    for entity in range(4):
        for k in range(12):
            end, start, filed = dt.date(2020, 1, 31) + dt.timedelta(30 * k), None if k % 2 else dt.date(2019, 12, 1), day("2024-01-01")
            own = 0.0 if (entity, k) == (0, 0) else 100.0 + k
            rows += [(entity, "A" if k < 6 else "B", "USD", start, end, own, filed), (entity, "A" if k < 6 else "B", "USD", start, end, -1.0, day("2023-01-01")), (entity, "B", "EUR", start, end, 55.0, day("2025-01-01"))]
            if k < 3:
                rows.append((entity, "B", "USD", start, end, 9.0, filed))  # A comes first
            for name, other in (("same", own), ("double", own / 2), ("noise", own * (0.97 if (entity + k) % 2 else 1.02))):
                rows.append((entity, name, "USD", start, end, other, filed))
                if other:
                    ratios[name].append(own / other)
    rows += [(0, "few", "USD", None, day("2020-03-01"), 102.0, day("2024-01-01")), (9, "A", "USD", None, None, 1.0, None), (9, "same", "USD", None, None, 1.0, None), (9, None, "USD", None, None, None, None)]
    points = spark.createDataFrame(rows, "entity int, tag string, unit string, start date, end date, val double, filed date")
    primaries = spark.createDataFrame([("c", "A", 1), ("c", "B", 2)], "concept string, tag string, place int")
    candidates = spark.createDataFrame([("c", t) for t in ("same", "double", "noise", "few", "absent")], "concept string, tag string")
    got = {r.tag: r for r in market_coverage.tag_agreement(points, primaries, candidates).collect()}
    assert sorted(got) == ["double", "few", "noise", "same"] and (got["few"].n_overlap, got["few"].agreement, got["few"].reason) == (1, 1.0, "few")
    assert [(got[t].n_overlap, got[t].n_entities, got[t].accepted, got[t].reason) for t in ("same", "double", "noise")] == [(48, 4, True, None), (48, 4, False, "biased"), (48, 4, False, "differs")]
    for t, values in ratios.items():
        assert got[t].median_ratio == pytest.approx(statistics.median(values), rel=1e-12)


def test_median_of_signs_and_noughts(spark):
    values = [(1.0, -3.0), (0.0, 5.0), (2.0, 0.0), (0.0, 0.0), (-4.0, 1.0), (6.0, 2.0)]
    rows = [(k, t, "USD", None, day("2024-01-01"), v[j], day("2024-02-01")) for k, v in enumerate(values) for j, t in enumerate(("A", "X"))]
    points = spark.createDataFrame(rows, "entity int, tag string, unit string, start date, end date, val double, filed date")
    got = market_coverage.tag_agreement(points, spark.createDataFrame([("c", "A", 1)], "concept string, tag string, place int"), spark.createDataFrame([("c", "X")], "concept string, tag string")).first()
    assert got.median_ratio == statistics.median([a / b for a, b in values if b]) and got.reason == "few"
    assert got.agreement == pytest.approx(1 / 6)  # both nought


CELL = "entity int, concept string, idx int, value double, kind string"


def cells(spark):
    def row(concept, *values):
        return [(1, concept, k, None if v is None else float(v[0] if isinstance(v, tuple) else v), v[1] if isinstance(v, tuple) else None) for k, v in enumerate(values, 1)]

    rows = row("sales", 1, 2, (3, "q4"), 4, 5, 6) + row("debt", None, 7, (7, "carry"), (7, "carry"), 9, (9, "carry")) + row("tax", 1, None, (0, "zero"), None, None, 2) + row("none", *[None] * 6)
    return spark.createDataFrame([*rows, (2, "sales", 1, None, "carry"), (2, "sales", 2, 5.0, "carry"), (2, "sales", 3, 5.0, "derive")], CELL)


def test_audit_of_concepts(spark):
    got = {(r.entity, r.concept): r for r in grid_audit.concept_audit(cells(spark)).collect()}
    tax, debt, own = got[1, "tax"], got[1, "debt"], got[2, "sales"]
    assert (tax.n_missing, tax.shape, tax.gaps, tax.n_zero, tax.longest_carry) == (3, "interior", [2, 4, 5], 1, 0)
    assert (debt.n_missing, debt.shape, debt.gaps, debt.n_carry, debt.longest_carry) == (1, "oldest only", [], 3, 2)
    assert (got[1, "none"].n_missing, got[1, "none"].shape, got[1, "none"].gaps) == (6, "none", [])
    assert (got[1, "sales"].n_q4, got[1, "sales"].shape) == (1, "complete")
    # carried with nothing before it: counted, but not behind anything; a kind without a value counts nowhere
    assert (own.n_periods, own.n_carry, own.n_derive, own.longest_carry) == (3, 1, 1, 0)


def test_audit_of_companies(spark):
    out = grid_audit.company_audit(cells(spark), ["sales", "debt", "tax", "none"], {"lever": "debt / sales", "growth": "sales / sales[t-1] - 1", "loop": "loop + 1"})
    got = {r.entity: r for r in out.collect()}
    one = got[1]
    assert one.full_miss == ["none"] and one.n_periods == 6
    assert {k: tuple(v) for k, v in one.holes.items()} == {"debt": (1, "oldest only"), "tax": (3, "interior")}
    assert one.metric_na == {"lever": 1, "growth": 1, "loop": 6}
    assert one.estimated == {"sales": {"q4": 1}, "debt": {"carry": 3}, "tax": {"zero": 1}} and one.stale == {"debt": 2}
    assert got[2].full_miss == [] and got[2].metric_na == {"lever": 3, "growth": 2, "loop": 3}
    plain = grid_audit.company_audit(cells(spark), ["sales"], {})
    assert {r.entity: r.metric_na for r in plain.collect()} == {1: {}, 2: {}}


def test_json_lines_there_and_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\n\"b\"", None), (2, None, 2.5)], "entity int, name string, v double")
    path = str(tmp_path / "lines")
    sinks.write_json_lines(df, path)
    lines = [json.loads(x) for f in sorted((tmp_path / "lines").glob("part-*")) for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["entity"]) == [{"entity": 1, "name": "a\n\"b\"", "v": None}, {"entity": 2, "name": None, "v": 2.5}]
    back = filings.snapshots(spark, path, df.schema.simpleString()[7:-1].replace(":", " "))
    assert sorted(tuple(r)[:3] for r in back.drop("file").collect()) == [(1, "a\n\"b\"", None), (2, None, 2.5)]
    assert back.where(F.col("file").contains("lines")).count() == 2


PAIR = "entity int, concept string"


def test_packed_lists_and_what_changed(spark, tmp_path):
    path = str(tmp_path / "lists")
    first = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "k")], PAIR)
    names = [*"abcdefghijk"]
    packed = sinks.packed(first, "entity", names)
    assert sorted(map(tuple, packed.collect())) == [(1, "0,1"), (2, "10")]
    assert sorted(map(tuple, filings.unpacked(packed, "places", names).collect())) == [(1, "a"), (1, "b"), (2, "k")]
    assert sinks.read_packed(spark, path, "entity") is None
    assert sorted(map(tuple, sinks.write_packed(first, path, "entity", names).collect())) == [(1, "a", "gained"), (1, "b", "gained"), (2, "k", "gained")]
    # another order of concepts: the lists of each generation are read by its own
    second = spark.createDataFrame([(1, "b"), (3, "c")], PAIR)
    assert sorted(map(tuple, sinks.write_packed(second, path, "entity", ["c", "b"]).collect())) == [(1, "a", "lost"), (2, "k", "lost"), (3, "c", "gained")]
    assert sorted(map(tuple, sinks.read_packed(spark, path, "entity").collect())) == [(1, "b"), (3, "c")]
    assert sorted(map(tuple, sinks.read_packed(spark, path, "entity", 0).collect())) == [(1, "a"), (1, "b"), (2, "k")]
    # a generation that was cut short doesn't count
    (tmp_path / "lists" / "generation=2" / "lists").mkdir(parents=True)
    assert sorted(map(tuple, sinks.read_packed(spark, path, "entity").collect())) == [(1, "b"), (3, "c")]


def test_unlisted_concepts_are_an_error(spark):
    with pytest.raises(Exception, match="not a listed concept: z"):
        sinks.packed(spark.createDataFrame([(1, "z")], PAIR), "entity", ["a"]).collect()


def test_places_over_many_ranges(spark):
    df = spark.range(5_000).select((F.col("id") * 7_919 % 5_000).alias("v"), (F.col("id") % 3).alias("other")).repartition(7)
    got = ranks.placed(df, [F.desc("v")], "at").collect()
    assert len(got) == 5_000 and all(r.at == 5_000 - r.v for r in got)
    ties = ranks.placed(df, [F.col("other"), F.col("v")]).orderBy("place").collect()
    assert [r.place for r in ties] == [*range(1, 5_001)] and [(r.other, r.v) for r in ties] == sorted((r.other, r.v) for r in ties)
    assert ranks.placed(df.where("v < 0"), [F.col("v")]).count() == 0


def test_names_behind_the_configuration(spark):
    df = spark.createDataFrame([("d",), ("b",), ("a",), ("c",), ("b",), (None,)], "name string")
    config = spark.createDataFrame([("c", 1), ("x", 2), ("b", 3)], "name string, ordinal int")
    got = picks.in_config_order(df, config, "name").select("name", "place").distinct().collect()
    assert sorted((r.place, r.name) for r in got) == [(1, "c"), (2, "b"), (3, "a"), (4, "d")]


def test_states_of_cells(spark):
    cells = lambda *rows: spark.createDataFrame(list(rows), "entity int, concept string")
    grid = cells(*((1, c) for c in "abcdef"))
    got = audits.gap_census(grid, cells((1, "a"), (1, "a"), (9, "a")), cells((1, "a"), (1, "b")), cells((1, "c")), cells((1, "d"), (1, "c")), cells((1, "e"), (1, "z")))
    assert sorted(map(tuple, got.collect())) == [(1, "a", "filled"), (1, "b", "dash"), (1, "c", "dim_only"), (1, "d", "fixable"), (1, "e", "custom"), (1, "f", "over_broad")]


def test_what_breakdowns_left_out(spark):
    rows = [("total", "t", "revenue", 1.0), (None, "t", "revenue", 2.0), ("residual", "t", "revenue", 3.0), ("cross_axis", "t", "revenue", -4.0), ("cross_axis", "t", "cost", 5.0), ("cross_axis", "u", "cost", 6.0), ("foreign_dim", "t", "revenue", None), ("foreign_dim", "t", "revenue", 7.0)]
    got = segments.drop_telemetry(spark.createDataFrame(rows, "reason string, tag string, concept string, val double"))
    assert sorted(map(tuple, got.collect())) == [("cross_axis", "t", 2, 4.0), ("cross_axis", "u", 1, 0.0), ("foreign_dim", "t", 2, 7.0)]


def test_where_a_cell_comes_from(spark):
    rows = [(1, "t", 5.0, "10-K", day("2024-02-01"), None, day("2023-12-31")), (2, "u", None, "10-Q", day("2024-05-01"), day("2024-04-01"), day("2024-03-31"))]
    df = spark.createDataFrame(rows, "entity int, tag string, val double, form string, filed date, orig_filed date, end date")
    got = {r.entity: tuple(r.cell) for r in facts.provenance(df, ["entity"], F.col("val") > 3).collect()}
    assert got[1] == (5.0, True, "t", "10-K", day("2024-02-01"), day("2024-02-01"), day("2023-12-31"))
    assert got[2] == (None, False, "u", "10-Q", day("2024-05-01"), day("2024-04-01"), day("2024-03-31"))
    assert facts.provenance(df.drop("orig_filed"), ["entity"], F.lit(False)).where("cell.orig_filed = cell.filed").count() == 2


def test_statements_take_their_own_spans(spark):
    sub = spark.createDataFrame([("a1", 7, "10-K"), ("a2", 8, "8-K")], "adsh string, cik bigint, form string")
    num = spark.createDataFrame(
        [("a1", "Cash", "us-gaap/2024", 0, None, None, 1.0), ("a1", "Cash", "us-gaap/2024", 4, None, None, 1.0), ("a1", "Sales", "us-gaap/2024", 0, None, None, 1.0), ("a1", "Sales", "us-gaap/2024", 1, "Seg=East", None, 1.0), ("a1", "Sales", "us-gaap/2024", 4, "", "Sub", 2.0),
         ("a1", "Sales", "us-gaap/2024", 4, "", "", 2.0), ("a1", "Sales", "own/2024", 4, "", "", 2.0), ("a1", "Sales", "us-gaap/2024", 4, "", "", None), ("a2", "Sales", "us-gaap/2024", 4, "", "", 2.0), ("a1", "Other", "us-gaap/2024", 4, "", "", 2.0)],
        "adsh string, tag string, version string, qtrs int, segments string, coreg string, value double",
    )
    tags = spark.createDataFrame([("cash", "BS", "Cash"), ("sales", "IS", "Sales")], "concept string, stmt string, tag string")
    got = filings.configured_facts(num, sub, tags, ("10-K",))
    assert sorted(map(tuple, got.collect())) == [(7, "cash", "BS", False), (7, "sales", "IS", False), (7, "sales", "IS", True), (7, "sales", "IS", True)]
    rates = market_coverage.market_coverage(got, tags, {})
    assert sorted(map(tuple, rates.collect())) == [("cash", "BS", 1, 1, 0, 0, 1.0), ("sales", "IS", 1, 1, 0, 0, 1.0)]


def test_stale_points_against_all_rows(spark):
    rng = random.Random(5)
    rows = [(k, dt.date(2015, 1, 1) + dt.timedelta(days=rng.randrange(3_000)), rng.choice([100.0, 103.0, 104.9, 106.0, 200.0, -50.0, 0.0])) for k in range(6) for _ in range(40)]
    rows += [(1, None, 100.0), (2, dt.date(2016, 1, 1), None), (None, dt.date(2016, 1, 1), 100.0), rows[0]]

    def stale(k, d, v):
        if k is None or d is None or v is None or v == 0:
            return False
        own = [x for x in rows if x[0] == k and x[1] is not None and x[2] is not None]
        last = max(x[1] for x in own if x[2] == v)
        return (last - d).days > 400 and any(d < x[1] < last and abs(x[2] / v - 1) > 0.05 for x in own)

    df = spark.createDataFrame(rows, "entity int, d date, v double")
    got = [tuple(r) for r in series.stale_points(df, ["entity"], "v", "d").collect()]
    want = [r for r in rows if not stale(*r)]
    assert 0 < len(want) < len(rows) and sorted(got, key=str) == sorted(want, key=str)


def test_groups_that_span_batches(spark):
    """Every group is settled once and whole, wherever Arrow batches end; missing values never add up."""
    rows = [(e, "axis", "tax", f"FY{2000 + p}", "A", m, v, False) for e in range(9) for p in range(5) for m, v in (("a", 1.0), ("b", 2.0), ("ab", 3.0))]
    rows += [(99, "axis", "tax", "FY2000", "A", "a", None, False), (99, "axis", "tax", "FY2000", "A", "b", 2.0, False), (98, "axis", "tax", "FY2000", "A", "r", 2.0, True)]
    values = spark.createDataFrame(rows, "entity int, axis string, concept string, period string, kind string, member string, val double, is_residual boolean")
    totals = spark.createDataFrame([(e, "tax", f"FY{2000 + p}", 3.0) for e in (*range(9), 98, 99) for p in range(5)], "entity int, concept string, period string, total double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        got = segments.reconciled(values, totals).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 9 * 15 + 2
    assert all(r.verified and r.is_parent == (r.member == "ab") for r in got if r.entity < 9)
    assert sorted((r.member, r.val, r.verified) for r in got if r.entity == 99) == [("a", None, None), ("b", 2.0, None)]
    assert segments.reconciled(values.where("entity < 0"), totals).count() == 0
