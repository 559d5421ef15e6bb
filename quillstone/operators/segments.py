"""Segment breakdowns: which dimensional facts count, projection, reconciliation with totals, gaps, structure.

Facts are rows of (entity, filing, pos, concept, period, kind, dims array<struct<axis, member>>, unit, val).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.scalars import bare_name, member_key

#: Members whose subsets are all tried; more are taken off one by one, REMOVALS at most.
SUBSETS, RESIDUALS, REMOVALS = 18, 12, 8


@dataclass
class Axes:
    """What an axis configuration says."""

    segment: tuple[str, ...]
    consolidation: tuple[str, ...]
    operating: tuple[str, ...] = ()
    excluded: str = "(?i)eliminat|corporate|reconcil"
    passthrough: dict[str, str] = field(default_factory=dict)


def admitted(facts: DataFrame, axes: Axes) -> DataFrame:
    """facts with reason and, where it is null or 'total' or 'residual', the axis and member they count for.

    A fact counts for a member if it has exactly one segment axis, whose member isn't excluded, and all its other
    dimensions are consolidation axes with an operating member, or passthrough dimensions of a monetary unit.
    """
    seg, cons = F.array(*map(F.lit, axes.segment)), F.array(*map(F.lit, axes.consolidation))
    own = F.filter("dims", lambda d: F.array_contains(seg, d["axis"]))
    others = F.filter("dims", lambda d: ~F.array_contains(seg, d["axis"]))
    money = F.coalesce(F.col("unit").startswith("iso4217:"), F.lit(False))

    def through(d: Column) -> Column:
        fits = F.lit(False)
        for axis, pattern in axes.passthrough.items():
            fits = fits | ((d["axis"] == axis) & bare_name(d["member"]).rlike(pattern))
        return fits

    def is_cons(d: Column) -> Column:
        return F.array_contains(cons, d["axis"])

    def operating(d: Column) -> Column:
        listed = d["member"].isin(*axes.operating) if axes.operating else F.lit(False)
        return listed & ~bare_name(d["member"]).rlike(axes.excluded)

    n = F.size("_own")
    reason = (
        F.when(F.size("dims") == 0, "total")
        .when((n == 0) & (F.size("dims") == 1) & is_cons(F.get("dims", F.lit(0))), "residual")
        .when(n == 0, "residual_multi_dim")
        .when(F.exists("_others", lambda d: ~is_cons(d) & ~through(d)), "foreign_dim")
        .when(F.exists("_others", lambda d: ~is_cons(d) & through(d)) & ~money, "passthrough_not_monetary")
        .when(F.exists("_others", lambda d: is_cons(d) & ~operating(d)), "cons_not_operating")
        .when(n > 2, "deep_cross")
        .when(n == 2, "cross_axis")
        .when(bare_name(F.get("_own", F.lit(0))["member"]).rlike(axes.excluded), "member_excluded")
    )
    df = facts.withColumn("_own", own).withColumn("_others", others).withColumn("reason", reason)
    first = F.when(F.col("reason") == "residual", F.get("dims", F.lit(0))).otherwise(F.get("_own", F.lit(0)))
    df = df.withColumn("axis", first["axis"]).withColumn("member", member_key(first["member"]))
    return df.withColumn("clean", ~F.exists("_others", lambda d: ~is_cons(d))).drop("_own", "_others")


def drop_telemetry(marked: DataFrame, summed: str = "revenue", by: tuple[str, ...] = ()) -> DataFrame:
    """by, reason, tag, n, amount of the facts that `admitted` left out: how many, and the size of those of one concept.

    marked also has concept, tag and val.  Sizes of different concepts don't add up, so amount is that of `summed` alone, and
    nought where only others were left out.
    """
    lost = marked.where(F.col("reason").isNotNull() & ~F.col("reason").isin("total", "residual"))
    size = F.when(F.col("concept") == summed, F.abs("val"))
    return lost.groupBy(*by, "reason", "tag").agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("amount"))


def cells(marked: DataFrame) -> DataFrame:
    """One value for each entity, filing, period, axis, member and concept: clean facts before passthrough ones, then the last in the document."""
    w = Window.partitionBy("entity", "filing", "period", "axis", "member", "concept").orderBy(F.desc("clean"), F.desc("pos"))
    return marked.where("reason is null").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("entity", "filing", "period", "kind", "axis", "member", "concept", "val")


def crossed(facts: DataFrame, axes: Axes) -> DataFrame:
    """Cells of facts with several segment axes: a row for each of their axes, with the other axes' members as other."""
    seg = F.array(*map(F.lit, axes.segment))
    own = F.filter("dims", lambda d: F.array_contains(seg, d["axis"]))
    rows = facts.withColumn("_own", own).where(F.size("_own") >= 2).select("*", F.posexplode("_own").alias("_k", "_d"))
    rest = F.concat_ws("|", F.array_sort(F.transform(F.filter("_own", lambda d: d["axis"] != F.col("_d.axis")), lambda d: member_key(d["member"]))))
    return rows.select("entity", "filing", "period", "kind", F.col("_d.axis").alias("axis"), member_key(F.col("_d.member")).alias("member"), rest.alias("other"), "concept", "val")


def projected(cross: DataFrame, totals: DataFrame, direct: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Members of axes for which an entity has no direct data in any period, as sums over the other axis, where they make up the total.

    cross: entity, period, axis, member, other, concept, val; totals: entity, period, concept, total.
    """
    sums = cross.groupBy("entity", "period", "axis", "member", "concept").agg(F.sum("val").alias("val"))
    sums = sums.join(direct.select("entity", "axis").distinct(), ["entity", "axis"], "left_anti")
    with_total = sums.join(totals, ["entity", "period", "concept"])
    whole = with_total.groupBy("entity", "period", "axis", "concept").agg(F.sum("val").alias("_sum"), F.first("total").alias("_total"))
    closed = whole.where(F.abs(F.col("_sum") - F.col("_total")) <= F.abs("_total") * tolerance).select("entity", "period", "axis", "concept")
    return sums.join(closed, ["entity", "period", "axis", "concept"], "left_semi")


def subset_sums(values: np.ndarray) -> np.ndarray:
    """Sums of all subsets, bit k of the place standing for value k."""
    sums = np.zeros(1)
    for v in values:
        sums = np.concatenate([sums, sums + v])
    return sums


def possible_parents(values: dict[str, float], total: float, within: float) -> list[tuple[str, ...]]:
    """Sets of members to leave out so that the others make up the total: as few as possible, none if they do already."""
    names, amounts = sorted(values), None
    amounts = np.array([values[n] for n in names])
    if abs(amounts.sum() - total) <= within:
        return [()]
    if len(names) <= SUBSETS:
        hits = np.flatnonzero(np.abs(subset_sums(amounts) - total) <= within)
        hits = hits[hits > 0]
        if not len(hits):
            return []
        sizes = np.bitwise_count(hits)
        return [tuple(n for k, n in enumerate(names) if not mask >> k & 1) for mask in hits[sizes == sizes.max()].tolist()]
    gone: list[str] = []
    while len(gone) < REMOVALS and len(names) > 2:
        rest = sum(values[n] for n in names) - total
        hit = next((n for n in names if abs(rest - values[n]) <= within), None)
        if hit is None:
            return []
        names.remove(hit)
        gone.append(hit)
        if abs(sum(values[n] for n in names) - total) <= within:
            return [tuple(sorted(gone))]
    return []


def best_residual(values: dict[str, float], need: float, within: float) -> tuple[str, ...] | None:
    """The reconciling items whose sum comes closest to what is needed, within the tolerance; the fewer on a tie."""
    names = sorted(values)
    if not names or len(names) > RESIDUALS:
        return None
    error = np.abs(subset_sums(np.array([values[n] for n in names])) - need)
    error[0] = np.inf
    masks = np.flatnonzero(error <= within)
    if not len(masks):
        return None
    best = masks[np.lexsort((masks, np.bitwise_count(masks), error[masks]))[0]]
    return tuple(n for k, n in enumerate(names) if best >> k & 1)


def _vote(sets: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The set named most often; then the smaller, then the first in order."""
    return min(set(sets), key=lambda s: (-sets.count(s), len(s), s)) if sets else ()


def reconcile(rows: list[tuple], tolerance: float, must: bool) -> list[tuple]:
    """Parents, residual items and verification of one entity, axis and concept.

    rows: period, kind, member, val, is_residual, total (None if there is none); the result: period, kind, member, val, is_parent,
    is_residual, verified.
    """
    kind = {p: k for p, k, *_ in rows}
    total = {p: t for p, _, _, _, _, t in rows if t is not None}
    own: dict[str, dict[str, float]] = {}
    extra: dict[str, dict[str, float]] = {}
    for p, _, name, val, item, _ in rows:
        (extra if item else own).setdefault(p, {})[name] = math.nan if val is None else val
    periods = sorted(own)
    known = [p for p in periods if p in total]
    kinds = sorted({kind[p] for p in periods})
    parents = {k: _vote(list(chain.from_iterable(possible_parents(own[p], total[p], abs(total[p]) * tolerance) for p in known if kind[p] == k))) for k in kinds}

    def settle(chosen: dict[str, tuple[str, ...]]) -> tuple[dict[str, bool], tuple[str, ...]]:
        left = {p: [v for n, v in own[p].items() if n not in chosen[kind[p]]] for p in periods}
        short = {p: total[p] - sum(left[p]) for p in known if left[p]}
        bare = {p: p in short and abs(short[p]) <= abs(total[p]) * tolerance for p in periods}
        picks = [best_residual(extra[p], short[p], abs(total[p]) * tolerance) for p in short if not bare[p] and p in extra]
        item = _vote([x for x in picks if x])
        filled = {p: p in short and abs(short[p] - sum(extra.get(p, {}).get(n, 0.0) for n in item)) <= abs(total[p]) * tolerance for p in periods}
        return (filled, item) if item and sum(filled.values()) > sum(bare.values()) else (bare, ())

    for k in kinds:
        if parents[k]:
            without = {**parents, k: ()}
            count = lambda ok, k=k: sum(ok[p] for p in periods if kind[p] == k)
            if count(settle(without)[0]) >= count(settle(parents)[0]):
                parents = without
    ok, item = settle(parents)
    comparable = [p for p in known if any(n not in parents[kind[p]] for n in own[p])]
    structural = not must and comparable and not any(ok[p] for p in comparable)
    own, extra = ({p: {n: None if math.isnan(v) else v for n, v in g.items()} for p, g in x.items()} for x in (own, extra))
    out = [(p, kind[p], n, v, n in parents[kind[p]], False, None if structural else ok[p]) for p in periods for n, v in own[p].items()]
    out += [(p, kind[p], n, v, False, True, None if structural else ok.get(p, False)) for p in periods for n, v in extra.get(p, {}).items() if n in item]
    return out


_ROW = ("period", "kind", "member", "val", "is_residual", "total")


def reconciled(values: DataFrame, totals: DataFrame, tolerance: float = 0.005, must: tuple[str, ...] = ("revenue",)) -> DataFrame:
    """Cells with is_parent, is_residual and verified (null: the breakdown never adds up and needn't).

    values: entity, axis, concept, period, kind, member, val, is_residual; totals: entity, concept, period, total, and axis where
    axes have totals of their own.  A group is one company's axis and concept, some dozen periods of some dozen members, so its size
    doesn't follow the market's.  Groups lie one behind the other in Arrow batches; a task holds one batch and one group.
    """
    joined = values.join(totals, ["entity", "concept", "period", *(["axis"] if "axis" in totals.columns else [])], "left").withColumn("val", F.col("val").cast("double")).withColumn("total", F.col("total").cast("double"))
    keys = ["entity", "axis", "concept"]
    types = dict(joined.dtypes)
    said = [*keys, "period", "kind", "member"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, kinds = None, [], None

        def told(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in said} | {"val": pa.float64(), "is_parent": pa.bool_(), "is_residual": pa.bool_(), "verified": pa.bool_()}
            found: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, *_ROW)), strict=True):
                if group and row[:3] != key:
                    found += [(*key, *r) for r in reconcile(group, tolerance, key[2] in must)]
                    group = []
                key = row[:3]
                group.append(row[3:])
            yield told(found)
        if group:
            yield told([(*key, *r) for r in reconcile(group, tolerance, key[2] in must)])

    schema = ", ".join(f"{c} {types[c]}" for c in said) + ", val double, is_parent boolean, is_residual boolean, verified boolean"
    return joined.select(*keys, *_ROW).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, schema)


def verified_state(df: DataFrame, keys: list[str], part: str, total: str, must: Column | None = None, tolerance: float = 0.005) -> Column:
    """True or false by whether the parts make up the total; null where no period of keys does and it needn't."""
    fits = F.abs(F.col(part) - F.col(total)) <= F.abs(total) * tolerance
    any_ = F.bool_or(fits).over(Window.partitionBy(*keys))
    return F.when(any_ | (must if must is not None else F.lit(False)), fits)


def ratios(reconciled_: DataFrame) -> DataFrame:
    """total, share, gross and operating margin by entity, axis, period and member, parents left out of totals."""
    wide = reconciled_.where("not is_residual").groupBy("entity", "axis", "period", "member").agg(F.bool_or("is_parent").alias("is_parent"), *(F.max(F.when(F.col("concept") == c, F.col("val"))).alias(c) for c in ("revenue", "cogs", "gross_profit", "operating_income")))
    total = F.sum(F.when(~F.col("is_parent"), F.col("revenue"))).over(Window.partitionBy("entity", "axis", "period"))
    gross = F.coalesce(F.col("gross_profit"), F.col("revenue") - F.col("cogs"))
    share = F.when(~F.col("is_parent"), F.try_divide("revenue", "total"))
    return wide.withColumn("total", total).withColumn("share", share).withColumn("gross_margin", F.try_divide(gross, F.col("revenue"))).withColumn("operating_margin", F.try_divide("operating_income", "revenue"))


def generations(presence: DataFrame, keys: list[str]) -> DataFrame:
    """keys, member, generation: members linked by shared periods, where a breakdown has two or three such groups.

    presence: keys, member, period.  Groups are the connected components of members that share a period, folded over
    the members of one breakdown, which are some dozens.
    """
    kind = f"array<array<{dict(presence.dtypes)['period']}>>"
    members = presence.groupBy(*keys, "member").agg(F.array_sort(F.collect_set("period")).alias("_own"))

    def joined(acc: Column, x: Column) -> Column:
        met, rest = F.filter(acc, lambda a: F.arrays_overlap(a, x)), F.filter(acc, lambda a: ~F.arrays_overlap(a, x))
        return F.concat(rest, F.array(F.array_sort(F.array_distinct(F.concat(x, F.flatten(met))))))

    groups = members.groupBy(*keys).agg(F.array_sort(F.aggregate(F.collect_list("_own"), F.array().cast(kind), joined)).alias("_groups"))
    several = groups.where(F.size("_groups").between(2, 3))
    first = F.filter(F.sequence(F.lit(1), F.size("_groups")), lambda i: F.arrays_overlap(F.get("_groups", i - 1), F.col("_own")))
    return members.join(several, keys).select(*keys, "member", F.get(first, F.lit(0)).alias("generation"))
