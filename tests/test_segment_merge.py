"""Filings of one company put together: who may speak of which members, totals, residual items and cross tables."""

from pyspark.sql import functions as F

from quillstone.operators import segment_merge

CELLS = "entity int, filing string, filed int, period string, axis string, member string, concept string, val double"
TOTALS = "entity int, filing string, filed int, period string, concept string, val double"
ITEMS = "entity int, filing string, filed int, period string, member string, concept string, val double"
CROSS = "entity int, filing string, filed int, period string, axis string, member string, other string, concept string, val double"


def merge(spark, cells=(), totals=(), items=(), cross=()):
    tables = (spark.createDataFrame(list(r), s) for r, s in ((cells, CELLS), (totals, TOTALS), (items, ITEMS), (cross, CROSS)))
    return segment_merge.merged(*tables, [F.desc("filed")])


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_a_new_structure_shuts_the_old_one_out(spark):
    cells = [(1, "new", 2, "p#A", "seg", m, "revenue", v) for m, v in (("americas", 120.0), ("asia", 105.0))]
    cells += [(1, "old", 1, "p#A", "seg", m, c, v) for m, c, v in (("hvac", "revenue", 150.0), ("cold", "revenue", 75.0), ("asia", "cogs", 60.0), ("asia", "revenue", 99.0))]
    cells += [(1, "old", 1, "p#A", "geo", m, "revenue", v) for m, v in (("us", 130.0), ("abroad", 90.0))]
    totals = [(1, "new", 2, "p#A", "revenue", 225.0), (1, "old", 1, "p#A", "revenue", 220.0), (1, "old", 1, "p#A", "cogs", 100.0)]
    got = merge(spark, cells, totals)
    assert rows(got.cells, "axis", "member", "concept", "val") == [("geo", "abroad", "revenue", 90.0), ("geo", "us", "revenue", 130.0), ("seg", "americas", "revenue", 120.0), ("seg", "asia", "cogs", 60.0), ("seg", "asia", "revenue", 105.0)]
    # geo is the old filing's: it is held against that filing's own total
    assert rows(got.totals, "axis", "concept", "total") == [("geo", "cogs", 100.0), ("geo", "revenue", 220.0), ("seg", "revenue", 225.0)]
    state = {(r.axis, r.concept): r.verified for r in got.reconciled(F.split("period", "#")[1]).collect()}
    assert state == {("geo", "revenue"): True, ("seg", "revenue"): True, ("seg", "cogs"): False}  # no total of its own


def test_totals_are_borrowed_where_a_filing_has_none_but_residual_items_are_not(spark):
    cells = [(1, "new", 2, "p", "seg", "a", "revenue", 60.0), (1, "new", 2, "p", "seg", "b", "revenue", 30.0)]
    totals = [(1, "old", 1, "p", "revenue", 90.0), (1, "older", 0, "p", "revenue", 80.0)]
    items = [(1, "old", 1, "p", "corporate", "revenue", -10.0)]
    got = merge(spark, cells, totals, items)
    assert rows(got.totals, "axis", "total", "is_borrowed") == [("seg", 90.0, True)] and got.residuals.count() == 0
    own = merge(spark, cells, [(1, "new", 2, "p", "revenue", 80.0), *totals], [(1, "new", 2, "p", "corporate", "revenue", -10.0), *items])
    assert rows(own.totals, "total", "is_borrowed") == [(80.0, False)] and rows(own.residuals, "axis", "member", "val") == [("seg", "corporate", -10.0)]
    assert {(r.member, r.is_residual, r.verified) for r in own.reconciled(F.lit("A")).collect()} == {("a", False, True), ("b", False, True), ("corporate", True, True)}


def test_cross_tables_are_taken_whole(spark):
    cross = [(1, "new", 2, "p", "product", m, "whole", "revenue", v) for m, v in (("parts", 60.0), ("service", 40.0))]
    cross += [(1, "old", 1, "p", "product", m, o, "revenue", 50.0) for m in ("parts", "service") for o in ("thermal", "green")]
    cross += [(1, "old", 1, "q", "product", "parts", "thermal", "revenue", 70.0)]
    totals = [(1, "new", 2, "p", "revenue", 100.0), (1, "old", 1, "q", "revenue", 70.0)]
    got = merge(spark, [], totals, [], cross)
    assert rows(got.cells, "period", "member", "val", "is_projected") == [("p", "parts", 60.0, True), ("p", "service", 40.0, True), ("q", "parts", 70.0, True)]
    assert rows(got.totals, "period", "axis", "total", "is_borrowed") == [("p", "product", 100.0, True), ("q", "product", 70.0, True)]
    # direct data for the axis in any period: no projection at all
    direct = merge(spark, [(1, "old", 1, "r", "product", "parts", "revenue", 1.0)], totals, [], cross)
    assert rows(direct.cells, "period", "member", "val") == [("r", "parts", 1.0)] and direct.crosses.count() == 3


def test_parents_that_the_totals_show(spark):
    """Children of 803 with a parent of 300 in annual columns, where 400 more is a parent too."""
    members = {"iphone": 200.0, "mac": 100.0, "service": 100.0, "product": 300.0, "region": 403.0}
    cells = [(1, "f", 1, p, "seg", m, "revenue", v) for p in ("2024#A", "2025#A") for m, v in members.items()]
    got = merge(spark, cells, [(1, "f", 1, p, "revenue", 803.0) for p in ("2024#A", "2025#A")])
    found = got.reconciled(F.split("period", "#")[1]).collect()
    assert {r.member for r in found if r.is_parent} == {"product"} and all(r.verified for r in found)
    assert sum(r.val for r in found if not r.is_parent and r.period == "2024#A") == 803.0


def test_empty(spark):
    got = merge(spark)
    assert got.cells.count() == got.totals.count() == got.residuals.count() == got.crosses.count() == 0
