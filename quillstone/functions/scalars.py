"""Scalar expressions of the engine: numbers, names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.calendar import half_up

# fixed values: share splits as they occur, forward or in reverse
CLEAN_SPLITS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 25, 30, 50)
# fixed values: endings of member names, longest first
MEMBER_ENDINGS = ("SegmentsMember", "SegmentMember", "Member")
SPLIT_TOLERANCE = 0.08
#: Borders of words in CamelCase: before a capital that follows a small letter or digit, before the last capital of
#: several that a small letter follows, between letters and digits.
_UP, _ACRONYM, _DIGITS = "(?<=[a-z0-9])(?=[A-Z])", "(?<=[A-Z])(?=[A-Z][a-z])", "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"


def split_factor(ratio: Column) -> Column:
    """The clean split that a ratio of share counts is within 8 % of, the first in order; null if there is none."""
    steps = F.array(*(F.lit(float(s)) for s in CLEAN_SPLITS))

    def first(r: Column) -> Column:
        return F.get(F.filter(steps, lambda s: F.abs(r - s) / s < SPLIT_TOLERANCE), F.lit(0))

    return F.when(ratio >= 1.5, first(ratio)).when((ratio > 0) & (ratio <= 0.67), F.lit(1.0) / first(F.lit(1.0) / ratio))


def clean_ratio(numerator: Column, denominator: Column) -> Column:
    """Both whole numbers within 0.01, from 1 to 100, and different."""
    a, b = half_up(numerator), half_up(denominator)
    return (F.abs(numerator - a) < 0.01) & (F.abs(denominator - b) < 0.01) & (a >= 1) & (b >= 1) & (a != b) & (F.greatest(a, b) <= 100)


def thousands(ratio: Column) -> Column:
    """The exponent of the power of 1000 nearest to a positive ratio, as a power of ten."""
    return (half_up(F.log10(ratio) / 3) * 3).cast("int")


def binary_round(x: Column, places: int) -> Column:
    """A double rounded as its binary value times a power of ten says, halves away from nought; F.round goes by its shortest decimal text."""
    return F.round(x * 10**places, 0) / 10**places


def over_positive(numerator: Column, denominator: Column) -> Column:
    """The quotient where the denominator is positive, else null."""
    return F.when(denominator > 0, numerator / denominator)


def pad_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def unpad_cik(cik: Column) -> Column:
    return cik.cast("bigint").cast("string")


def bare_name(qname: Column) -> Column:
    """What follows the first colon, or all of it."""
    return F.when(F.instr(qname, ":") > 0, F.regexp_replace(qname, "^[^:]*:", "")).otherwise(qname)


def member_key(qname: Column, aliases: dict[str, str] | None = None) -> Column:
    """Member names that mean the same made equal: bare, one ending less, lower case, letters and digits alone, aliases applied."""
    name = bare_name(qname)
    cut = name
    for ending in reversed(MEMBER_ENDINGS):
        cut = F.when(name.endswith(ending) & (F.length(name) > len(ending)), F.left(name, F.length(name) - len(ending))).otherwise(cut)
    key = F.regexp_replace(F.lower(cut), "[^a-z0-9]", "")
    for old, new in (aliases or {}).items():
        key = F.when(key == old, F.lit(new)).otherwise(key)
    return key


def spaced_name(qname: Column) -> Column:
    """CamelCase as words, without the ending of member names; a single capital goes with the word behind it."""
    parts = F.filter(F.split(F.regexp_replace(bare_name(qname), "(Segments?)?Member$", ""), f"{_UP}|{_ACRONYM}|[ ]"), lambda w: w != "")

    def put(done: Column, word: Column) -> Column:
        alone = F.coalesce(F.element_at(done, -1).rlike("^[A-Z]$"), F.lit(False))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.element_at(done, -1), word)))
        return F.when((F.size(done) > 0) & alone, joined).otherwise(F.concat(done, F.array(word)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), put), " ")


def name_tokens(name: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Distinct lowered words of a CamelCase name, digits as words, without the stop words."""
    parts = F.filter(F.split(name, f"[^A-Za-z0-9]+|{_UP}|{_ACRONYM}|{_DIGITS}"), lambda w: w != "")
    words = F.array_distinct(F.transform(parts, F.lower))
    return F.array_except(words, F.array(*(F.lit(w) for w in stop_words))) if stop_words else words


def class_label(member: Column) -> Column:
    """Class A, Class B ... of a share class's member name; else the name without its ending."""
    name = bare_name(member)
    letter = F.regexp_extract(name, "Class([A-Z][0-9]?)", 1)
    return F.when(letter != "", F.concat(F.lit("Class "), letter)).otherwise(F.replace(name, F.lit("Member"), F.lit("")))


def digits_masked(text: Column) -> Column:
    """Every digit as #, so that messages that differ in numbers of equal length are alike."""
    return F.regexp_replace(text, "[0-9]", "#")


def custom_masked(member: Column, standard: tuple[str, ...] = ("us-gaap", "srt", "country", "dei", "ifrs-full")) -> Column:
    """Members of a company's own namespace become one name."""
    prefix = F.substring_index(member, ":", 1)
    return F.when((F.instr(member, ":") > 0) & ~prefix.isin(*standard), F.lit("custom")).otherwise(member)


def estimate_kind(source: Column) -> Column:
    """Why a cell is an estimate, from its source's text."""
    return F.when(source.contains("zero"), "zero").when(source.contains("carried"), "carry").when(source.contains("approx"), "approx").when(source.contains("derived"), "derive").otherwise("q4")


def upper_middle(values: Column, last: int = 4, least: int = 3) -> Column:
    """The upper middle of the last so many absolute values that are neither null nor zero; null if there are too few."""
    kept = F.transform(F.filter(values, lambda v: v.isNotNull() & (v != 0)), F.abs)
    some = F.sort_array(F.slice(F.reverse(kept), 1, last))
    return F.when(F.size(some) >= least, F.get(some, F.floor(F.size(some) / 2).cast("int")))


def rank_percentile(values: Column, q: float) -> Column:
    """The value at place floor(q n) of n sorted values, the last at most."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * q).cast("int")))
