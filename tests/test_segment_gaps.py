"""What breakdowns lack: telemetry of what was left out, suppression of what is told elsewhere, amounts without repetition."""

from pyspark.sql import functions as F

from quillstone.operators import segment_gaps, segments

LOST = "entity int, reason string, what string, axes array<string>, n bigint, amount double"
SEEN = "entity int, axis string, n bigint"
SHOWN = "entity int, axis string, member string, period string, kind string, concept string, val double"
CROSS = "entity int, period string, axis string, member string, other string, concept string, val double"
STATED = "entity int, concept string, period string, total double"
OWN = "entity int, axis string, concept string, period string, total double"
MARKED = "entity int, concept string, dims array<struct<axis:string,member:string>>, unit string, val double"


def found(spark, lost=(), touched=(), shown=(), crosses=(), stated=(), own=()):
    tables = (spark.createDataFrame(list(r), s) for r, s in ((lost, LOST), (touched, SEEN), (shown, SHOWN), (crosses, CROSS), (stated, STATED), (own, OWN)))
    return [(r.code, r.axis, r.cause, r.n, r.amount, r.single_segment) for r in segment_gaps.gaps(*tables).orderBy("entity", "rank").collect()]


def cells(axis, members, periods, val=10.0):
    return [(1, axis, m, p, "Q", "revenue", val) for m in members for p in periods]


def test_a_crossing_is_told_once(spark):
    lost = [(1, "cross_axis", "geo×seg", ["geo", "seg"], 4, 90.0)]
    shown = cells("seg", "ab", ["q1"])
    crosses = [(1, "q1", a, m, o, "revenue", v) for a, m, o, v in (("geo", "us", "a", 20.0), ("geo", "eu", "a", -5.0), ("seg", "a", "us", 20.0), ("seg", "a", "eu", -5.0))]
    # reported as a dropped axis: not again as lost facts; the crossed cells and what was left out make its amount
    assert found(spark, lost, [(1, "geo", 4), (1, "seg", 9)], shown, crosses) == [("axis_dropped", "geo", "cross_axis|geo×seg", 4, 115.0, False)]
    # both axes were emitted after all
    assert found(spark, lost, [(1, "geo", 4), (1, "seg", 9)], shown + cells("geo", "uv", ["q1"]), crosses) == []
    # a filing without an account of axes: lost facts, their cells counted once by the first axis
    assert found(spark, lost, [], shown, crosses) == [("dropped_facts", "cross_axis", "geo×seg", 4, 25.0, False)]
    assert found(spark, lost, [], shown) == [("dropped_facts", "cross_axis", "geo×seg", 4, 90.0, False)]


def test_only_what_could_be_mended(spark):
    lost = [(1, r, "x@seg", ["seg"], 1, a) for r, a in (("foreign_dim", 9.0), ("cons_not_operating", 8.0), ("member_excluded", 7.0))] + [(1, "member_excluded", "y@seg", ["seg"], 3, 0.0)]
    lost += [(1, "deep_cross", "a×b×seg", ["a", "b", "seg"], 2, 5.0)]
    # an excluded member is told of although its axis is there; deep crossings keep the tally's amount
    crosses = [(1, "q1", "a", "m", "o", "revenue", 1.0)]
    assert found(spark, lost, [], cells("seg", "ab", ["q1"]), crosses) == [("dropped_facts", "member_excluded", "x@seg", 1, 7.0, False), ("dropped_facts", "deep_cross", "a×b×seg", 2, 5.0, False)]


def test_severity_of_a_dropped_axis(spark):
    # what was left out of other grain is no reason, nor does it count
    lost = [(1, "kind_mismatch", "181", ["geo"], 1, 50.0), (1, "foreign_dim", "hedge@geo", ["geo"], 2, 3.0), (1, "member_excluded", "m@geo", ["geo"], 2, 4.0)]
    stated = [(1, "revenue", "q1", 100.0), (1, "revenue", "q2", -20.0), (1, "cogs", "q1", 7.0)]
    got = found(spark, lost, [(1, "geo", 5), (1, "lone", 2)], stated=stated)
    assert got == [("axis_dropped", "lone", None, 2, 120.0, False), ("axis_dropped", "geo", "member_excluded|m@geo", 5, 7.0, False), ("dropped_facts", "member_excluded", "m@geo", 2, 4.0, False)]


def test_single_segments(spark):
    shown = [*cells("seg", "a", ["q1", "q2"], 100.0), *cells("geo", "u", ["q1", "q2"], 100.0), *cells("geo", "v", ["q2"], 1.0)]
    own = [(1, a, "revenue", p, t) for a, p, t in (("seg", "q1", 100.3), ("seg", "q2", 100.0), ("geo", "q1", 100.0), ("geo", "q2", 101.0))]
    assert found(spark, shown=shown, own=own) == [("degenerate_axis", "seg", None, 2, 200.3, True), ("degenerate_axis", "geo", None, 1, 100.0, False)]
    # a member alone that isn't the total, or a period without one, says nothing
    assert found(spark, shown=cells("seg", "a", ["q1"]), own=[(1, "seg", "revenue", "q1", 99.0)]) == found(spark, shown=cells("seg", "a", ["q1"])) == []


def test_holes_are_counted_by_quarter(spark):
    shown = cells("a", "xy", ["q1", "q3"]) + cells("a", "z", ["q2"], 1.0) + [(1, "a", "x", "q2", "Q", "revenue", None)]
    assert found(spark, shown=shown) == [("period_hole", "a", None, 1, 20.0, False)]
    yearly = [(*r[:4], "A", *r[5:]) for r in shown]
    assert found(spark, shown=yearly) == []


def test_telemetry(spark):
    axes = segments.Axes(("seg", "geo", "prod"), ("cons",), ("x:OperatingSegmentsMember",))
    dims = [
        ("revenue", [("geo", "x:US"), ("seg", "x:A")], 10.0),
        ("cogs", [("seg", "x:A"), ("geo", "x:US")], 90.0),
        ("revenue", [("seg", "x:A"), ("geo", "x:US"), ("prod", "x:P")], None),
        ("revenue", [("seg", "x:A"), ("geo", "x:US"), ("hedge", "x:H")], -3.0),
        ("revenue", [("seg", "x:EliminationMember")], -4.0),
        ("revenue", [("seg", "x:A"), ("cons", "x:CorporateMember")], 5.0),
        ("revenue", [("hedge", "x:H"), ("case", "x:C")], 6.0),
        ("revenue", [("seg", "x:A")], 7.0),
        ("revenue", [], 8.0),
        ("revenue", [("cons", "x:CorporateMember")], 9.0),
    ]
    marked = segments.admitted(spark.createDataFrame([(1, c, d, "iso4217:USD", v) for c, d, v in dims], MARKED), axes)
    got = {(r.reason, r.what): (r.axes, r.n, r.amount) for r in segment_gaps.tally(marked, axes.segment).collect()}
    assert got == {
        ("cross_axis", "geo×seg"): (["geo", "seg"], 3, 13.0),
        ("deep_cross", "geo×prod×seg"): (["geo", "prod", "seg"], 1, 0.0),
        ("foreign_dim", "hedge@geo+seg"): (["geo", "seg"], 1, 3.0),
        ("member_excluded", "x:EliminationMember@seg"): (["seg"], 1, 4.0),
        ("cons_not_operating", "cons@seg"): (["seg"], 1, 5.0),
        ("residual_multi_dim", "case×hedge"): ([], 1, 6.0),
    }
    assert {r.axis: r.n for r in segment_gaps.seen(marked, axes.segment).collect()} == {"seg": 7, "geo": 4, "prod": 1}


def test_empty(spark):
    assert found(spark) == []
    empty = spark.createDataFrame([], MARKED).withColumn("reason", F.lit(None).cast("string"))
    assert segment_gaps.tally(empty, ("seg",)).count() == segment_gaps.seen(empty, ("seg",)).count() == 0
