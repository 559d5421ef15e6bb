"""Declared formulas as columns.

derived() reads gap-filling rules such as "a - b - c?": from left to right, without precedence.  metric() reads metrics
such as "net_income / avg(equity) * 4" or "revenue / revenue[t-4] - 1", written as Python expressions.  A null operand,
a missing period or a zero denominator gives null.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.series import line

_TERM = re.compile(r"\s*([-+*/]?)\s*([A-Za-z_]\w*)(\??)")
# fixed values: days of a quarter and of a year in day counts
QUARTER, YEAR = 91.25, 365.0


def derived(rule: str) -> Column:
    """An optional term (with ?) that is null is left out, a factor too; other factors that are null, and zero ones, give null."""
    out: Column | None = None
    at = 0
    while at < len(rule.rstrip()):
        found = _TERM.match(rule, at)
        if not found or bool(found[1]) == (out is None):
            raise ValueError(f"can't read the rule {rule!r} from {rule[at:]!r} on")
        op, name, optional = found.groups()
        at = found.end()
        term = F.col(name)
        if out is None:
            out = term
            continue
        value = {"+": out + term, "-": out - term, "*": F.when(term != 0, out * term), "/": F.try_divide(out, term)}[op]
        out = F.when(term.isNull(), out).otherwise(value) if optional else value
    return out


def fill_derived(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Null cells of each column filled by its rule, in the order given; <name>_derived says which were."""
    for name, rule in rules:
        filled = derived(rule)
        df = df.withColumn(f"{name}_derived", F.col(name).isNull() & filled.isNotNull()).withColumn(name, F.coalesce(F.col(name), filled))
    return df


def names(formula: str) -> set[str]:
    """What a formula refers to."""
    return {n.id for n in ast.walk(ast.parse(formula, mode="eval")) if isinstance(n, ast.Name)} - {"t", "avg"}


def metric(formula: str, keys: list[str], annual: bool = False) -> Column:
    """A metric over rows (keys, idx).  annual: periods are years, so [t-1] is null, [t-4] the year before, 4 quarters one year."""

    def read(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(YEAR if annual and node.value == QUARTER else float(node.value))
        if isinstance(node, ast.Name):
            return F.col(node.id).cast("double")
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name):
            back = _periods_back(node.slice)
            if annual and back % 4:
                return F.lit(None).cast("double")
            return F.lag(F.col(node.value.id).cast("double"), back // 4 if annual else back).over(line(keys)) if back else F.col(node.value.id).cast("double")
        if isinstance(node, ast.Call) and getattr(node.func, "id", "") == "avg" and len(node.args) == 1:
            now, before = read(node.args[0]), F.lag(read(node.args[0])).over(line(keys))
            return F.when(F.row_number().over(line(keys)) == 1, now).otherwise((now + before) / 2)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -read(node.operand)
        if isinstance(node, ast.BinOp):
            if annual and isinstance(node.op, ast.Mult) and isinstance(node.right, ast.Constant) and node.right.value == 4:
                return read(node.left)
            a, b = read(node.left), read(node.right)
            if isinstance(node.op, ast.Add):
                return a + b
            if isinstance(node.op, ast.Sub):
                return a - b
            if isinstance(node.op, ast.Mult):
                return a * b
            if isinstance(node.op, ast.Div):
                return F.try_divide(a, b)
        raise ValueError(f"{ast.unparse(node)!r} is no part of a metric")

    return read(ast.parse(formula, mode="eval").body)


def _periods_back(node: ast.expr) -> int:
    if isinstance(node, ast.Name) and node.id == "t":
        return 0
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Sub) and isinstance(node.left, ast.Name) and isinstance(node.right, ast.Constant):
        return int(node.right.value)
    raise ValueError(f"[{ast.unparse(node)}] is no period")


def ordered(formulas: dict[str, str]) -> list[str]:
    """The metrics such that each follows those it refers to; a circle raises an error."""
    out: list[str] = []
    open_: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        if name in open_:
            raise ValueError(f"{name} refers to itself")
        open_.append(name)
        for other in sorted(names(formulas[name]) & formulas.keys()):
            visit(other)
        open_.remove(name)
        out.append(name)

    for name in formulas:
        visit(name)
    return out


def needs(formula: str) -> list[tuple[str, int]]:
    """What a metric needs, as (name, periods back) in the order of the formula; an average needs this period and the one before."""
    found: list[tuple[str, int]] = []

    def read(node: ast.AST) -> None:
        if isinstance(node, ast.Name):
            found.append((node.id, 0))
        elif isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name):
            found.append((node.value.id, _periods_back(node.slice)))
        elif isinstance(node, ast.Call) and getattr(node.func, "id", "") == "avg":
            inner = [x for arg in node.args for x in needs(ast.unparse(arg))]
            found.extend(inner + [(name, back + 1) for name, back in inner])
        else:
            for child in ast.iter_child_nodes(node):
                read(child)

    read(ast.parse(formula, mode="eval").body)
    return list(dict.fromkeys(found))


def circular(formulas: dict[str, str]) -> set[str]:
    """The metrics that refer to themselves, by whatever way, and those that refer to such."""
    uses = {name: {n for n, _ in needs(f)} & formulas.keys() for name, f in formulas.items()}
    open_ = set(formulas)
    while True:
        done = {name for name in open_ if not uses[name] & open_}
        if not done:
            return open_
        open_ -= done


def with_availability(df: DataFrame, formulas: dict[str, str], keys: list[str]) -> DataFrame:
    """df (keys, idx, a column for each item) with <metric>_available and <metric>_missing for each metric.

    A metric is available in a period if all that it needs is there, in the periods that it needs it.  missing names the first
    need that isn't, `equity[t-1]` for an earlier period, and is the metric's own name where it refers to itself.  Names that are neither
    items nor metrics don't count.  All lags are over one window by keys, so there is one exchange however many metrics there are.
    """
    bad = circular(formulas)
    plain = {n: f for n, f in formulas.items() if n not in bad}
    items = sorted({n for f in plain.values() for n, _ in needs(f)} & set(df.columns) - formulas.keys())
    df = df.withColumns({f"_has_{n}": F.col(n).isNotNull() for n in items})
    for name in ordered(plain):
        met = [(f"{n}[t-{back}]" if back else n, F.coalesce(F.lag(f"_has_{n}", back).over(line(keys)) if back else F.col(f"_has_{n}"), F.lit(False))) for n, back in needs(plain[name]) if n in items or n in plain]
        lacks = F.coalesce(*(F.when(~ok, F.lit(label)) for label, ok in met), F.lit(None).cast("string"))
        df = df.withColumn(f"{name}_missing", lacks).withColumn(f"_has_{name}", F.col(f"{name}_missing").isNull())
    for name in formulas:
        if name in bad:
            df = df.withColumn(f"{name}_missing", F.lit(name)).withColumn(f"_has_{name}", F.lit(False))
        df = df.withColumnRenamed(f"_has_{name}", f"{name}_available")
    return df.drop(*(f"_has_{n}" for n in items))


def with_metrics(df: DataFrame, formulas: dict[str, str], keys: list[str], annual: bool = False, zero_means_inapplicable: dict[str, str] | None = None) -> DataFrame:
    """df with a column for each metric, and <name>_applicable where a zero of the named column makes it inapplicable."""
    for name in ordered(formulas):
        df = df.withColumn(name, metric(formulas[name], keys, annual))
    for name, of in (zero_means_inapplicable or {}).items():
        df = df.withColumn(f"{name}_applicable", F.coalesce(F.col(of) != 0, F.lit(True)))
    return df


def cash_cycle(dso: str, dio: str, dpo: str) -> Column:
    """Days of receivables and stock less those of payables, each nought where it is null."""
    return F.coalesce(F.col(dso), F.lit(0.0)) + F.coalesce(F.col(dio), F.lit(0.0)) - F.coalesce(F.col(dpo), F.lit(0.0))
