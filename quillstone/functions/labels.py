"""Labels and notes: keywords of names, where a value comes from, shares and amounts as text, preferred units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that only build a share class's name
CLASS_WORDS = ("member", "undefined", "common", "stock", "class", "series")
# fixed values: units in the order in which they are tried, by the unit of a concept; others are tried as USD
UNITS = {"USD": ("USD", "TWD", "EUR"), "shares": ("shares",), "USD/shares": ("USD/shares", "TWD/shares")}


def keywords(name: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """The words of more than three letters that aren't stop words, in order."""
    words = F.regexp_extract_all(name, F.lit("([A-Za-z]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 3) & ~(F.lower(w).isin(*stop_words) if stop_words else F.lit(False)))


def class_words(member: Column) -> Column:
    """A share class's lowered name without what only builds such names; empty for the plain common stock."""
    cut = F.lower(F.regexp_replace(member, "^[^:]*:", ""))
    for word in CLASS_WORDS:
        cut = F.replace(cut, F.lit(word), F.lit(""))
    return cut


def origin_note(estimated: Column, kind: Column, detail: Column) -> Column:
    """Where a value comes from, in words, by the kind of its estimate (see scalars.estimate_kind)."""
    note = (
        F.when(kind == "derive", F.concat(F.lit("computed from other items: "), F.coalesce(detail, F.lit("?")))).when(kind == "carry", "carried on from the period before")
        .when(kind == "zero", "not reported, taken as nought").when(kind == "approx", "approximated by the weighted average").otherwise("fourth quarter: year less nine months")
    )
    return F.when(F.coalesce(estimated, F.lit(False)), note).otherwise("as reported")


def percent(part: Column, whole: Column) -> Column:
    """A share with one decimal; a dash without a whole."""
    return F.when(whole > 0, F.concat(F.format_number(100 * part / whole, 1), F.lit("%"))).otherwise("-")


def amount(value: Column) -> Column:
    """Billions with one decimal, or whole millions."""
    size = F.abs(value)
    return F.when(size >= 1e9, F.concat(F.format_number(value / 1e9, 1), F.lit("B"))).otherwise(F.concat(F.format_number(value / 1e6, 0), F.lit("M")))


def preferred_units(unit: Column) -> Column:
    """The units to try for a concept's unit, in order."""
    out = F.array(F.lit("USD"))
    for name, tried in UNITS.items():
        out = F.when(unit == name, F.array(*map(F.lit, tried))).otherwise(out)
    return out
