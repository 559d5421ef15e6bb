"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is read as words by one rule for every text: a code point of a script that is written without spaces is a word
of its own; what else stands between white space (of any kind) or such code points is a word if it has `LONGEST` code
points at most, otherwise each of its code points is one.  A k-mer is `K` words in a row.  It is chosen if, of its inner
sequences of `S` words, the one of least hash stands at its beginning or at its end.  That depends on the k-mer and
nothing around it, so a passage has the same chosen k-mers wherever it stands.  Likeness is the Jaccard similarity of
the sets of all chosen k-mers, so short common passages of long texts count.  The fingerprint, which is only shown, is
the `SIZE` least 32-bit hashes.

Anchors are chosen k-mers with their places.  `placed_edited` of fingerprints() is the share of anchors that stand at
the same place in the text and its edited form; passages() finds, for pairs of texts, the runs of anchors that both have
at one distance of places: where the common passages lie.

Long texts are read in stretches of `STRETCH` words that overlap by K - 1.  Texts meet their next one in ranges of
doc_id of about `RANGE_BYTES` bytes; from `RANGES` ranges on they grow instead, as one row of each passes through the
driver.

Null text is an empty one.  A text without a chosen k-mer, such as one of fewer than K words, counts as one k-mer at
place 0, so every text has a fingerprint; likeness of equal sets is 1.  Repeated rows stay; equal doc_id are ordered by
the hash of their texts; null doc_id come last.  A lone document is its own next one.  An empty table gives an empty
result.  Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BYTES, RANGES = 1 << 20, 100_000
#: The test of edges is written out for K - S + 1 = 3 inner sequences.
K, S, SIZE, STRETCH = 4, 2, 64, 4096
#: Of a stretch, so many of the least hashes are expected to be looked at first; all are, if they don't suffice.
LOOK = 256
LONGEST = 32
UNSPACED = "".join(rf"\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Javanese", "Balinese"))
#: White space of any kind; the first code point from which on scripts without spaces lie.
WHITE, FIRST_UNSPACED = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}", r"\x{E00}"
_RUN = rf"[^{WHITE}{UNSPACED}]"
#: A whole run of LONGEST code points or fewer, else a single code point; a text of white space alone is one word.
WORD = rf"(?<!{_RUN}){_RUN}{{1,{LONGEST}}}+(?!{_RUN})|[^{WHITE}]|\A[{WHITE}]*\z"


def words(text: Column) -> Column:
    """Hashes of a text's words in order; an empty text has one.  Texts of short runs in scripts with spaces are cut at white space alone, which gives the same words."""

    def cut(runs: Column) -> Column:
        odd = text.rlike(rf"[{FIRST_UNSPACED}-\x{{10FFFF}}]") | F.exists(runs, lambda w: F.char_length(w) > LONGEST) | (F.size(runs) == 0)
        return F.when(odd, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).otherwise(runs)

    runs = F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")
    return F.get(F.transform(F.transform(F.array(runs), cut), lambda x: F.transform(x, lambda w: F.xxhash64(w))), F.lit(0))


def _marked(own: Column) -> Column:
    """For each word the hash of the k-mer that begins there, or null if it isn't chosen."""

    def pairs(w: Column) -> Column:
        return F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1)))

    def kmers(p: Column) -> Column:
        # the last places have no whole k-mer; comparing with a null gives null
        last = F.size(p) - K
        return F.transform(p, lambda x, i: F.when((i <= last) & (F.least(x, F.get(p, i + 2)) <= F.get(p, i + 1)), F.xxhash64(x, F.get(p, i + 2))))

    # each step is named by a lambda, so that it is computed once
    return F.get(F.transform(F.transform(F.array(own), pairs), kmers), F.lit(0))


def anchors(text: Column) -> Column:
    """array<struct<pos, hash>> of the chosen k-mers of a text, pos counting words from 0."""
    found = F.get(F.transform(F.array(words(F.coalesce(text, F.lit("")))), lambda w: _by_stretch(w, lambda h, at: F.struct(at.alias("pos"), h.alias("hash")))), F.lit(0))
    return found


def _by_stretch(w: Column, of: Callable[[Column, Column], Column]) -> Column:
    """of(hash, place) for each chosen k-mer of an array of words, in order."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(w) - K, F.lit(0)) / STRETCH).cast("int"))

    def stretch(i: Column) -> Column:
        marked = _marked(F.slice(w, i * STRETCH + 1, F.lit(STRETCH + K - 1)))
        return F.array_compact(F.transform(marked, lambda h, at: F.when(h.isNotNull(), of(h, i * STRETCH + at))))

    return F.flatten(F.transform(starts, stretch))


def chosen(text: Column) -> Column:
    """all: the distinct 64-bit hashes of a text's chosen k-mers; placed: those of k-mers with their places.  text must not be null."""

    def of_words(w: Column) -> Column:
        one = F.xxhash64(F.array_join(F.transform(w, lambda x: x.cast("string")), " "))
        both = _by_stretch(w, lambda h, at: F.struct(h.alias("h"), F.xxhash64(h, at).alias("p")))
        some = F.get(F.transform(F.array(both), lambda x: F.when(F.size(x) == 0, F.array(F.struct(one.alias("h"), one.alias("p")))).otherwise(x)), F.lit(0))
        return F.get(F.transform(F.array(some), lambda x: F.struct(F.array_distinct(x["h"]).alias("all"), x["p"].alias("placed"))), F.lit(0))

    return F.get(F.transform(F.array(words(text)), of_words), F.lit(0))


def passages(pairs: DataFrame, least: int = 2) -> DataFrame:
    """a, b, shift, first, last, n: the places in text a of the first and last of n anchors that text b has `shift` places later.

    pairs: a, b, text_a, text_b; rows are of `least` anchors at least.  Anchors of both texts are joined within a pair, so
    a repeated passage meets each of its copies.
    """

    def side(which: str) -> DataFrame:
        return pairs.select("a", "b", F.explode(anchors(F.col(f"text_{which}"))).alias("x")).select("a", "b", F.col("x.pos").alias(f"pos_{which}"), F.col("x.hash").alias("hash"))

    met = side("a").join(side("b"), ["a", "b", "hash"])
    runs = met.groupBy("a", "b", (F.col("pos_b") - F.col("pos_a")).alias("shift")).agg(F.min("pos_a").alias("first"), F.max("pos_a").alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least)


def fingerprint(hashes: Column) -> Column:
    """The SIZE least distinct 32-bit hashes of chosen(), ascending."""

    def least(some: Column) -> Column:
        return F.slice(F.sort_array(F.array_distinct(some)), 1, SIZE)

    def of_all(short: Column) -> Column:
        bounds = F.array((F.lit(2.0**32 * LOOK) / F.size(short)).cast("long"))
        near = F.get(F.transform(bounds, lambda bound: F.filter(short, lambda h: h < bound)), F.lit(0))
        return F.get(F.transform(F.array(least(near)), lambda x: F.when(F.size(x) == SIZE, x).otherwise(least(short))), F.lit(0))

    return F.get(F.transform(F.array(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 32))), of_all), F.lit(0))


def as_text(print_: Column) -> Column:
    """Eight hexadecimal digits for each hash."""
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of common hashes among all of two sets."""
    both = F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.get(both, F.lit(0))


def _ranged(docs: DataFrame, parts: int) -> DataFrame:
    """docs with part, about `parts` ranges in the order of doc_id, null below all, and `turn`, the order within them.

    Bounds are quantiles of quantiles, so no list is longer than about the root of the number of ranges.  An id that
    fills several ranges is dealt out by ranges of its texts' hashes.
    """
    side, none = max(1, math.ceil(parts**0.5)), F.lit(-(1 << 63)).cast("long")
    keyed = docs.withColumn("turn", F.struct(F.coalesce("doc_id", none).alias("id"), F.col("doc_id").isNotNull().alias("known"), F.bitwise_not(F.xxhash64("text")).alias("hash")))
    if side == 1:
        return keyed.withColumn("part", F.lit(0).cast("long"))
    shares = [k / side for k in range(1, side)]
    whole = docs.agg(F.percentile_approx(F.coalesce("doc_id", none), shares, 100 * side).alias("b"), F.count("*").alias("n")).first()
    found = whole["b"] or []
    # rows above a cut lie beyond it; an id that is a bound twice has a range of its own
    cuts = F.array(*(F.lit(c).cast("long") for c in sorted({*found, *(b - 1 for b in found if found.count(b) > 1 and b > -(1 << 63))}))).cast("array<long>")
    coarse = keyed.withColumn("coarse", F.size(F.filter(cuts, lambda c: c < F.col("turn.id"))).cast("long"))
    alone = F.count_distinct("turn.id") == 1
    fine = coarse.groupBy("coarse").agg(F.when(alone, F.ceil(F.count("*") * parts / max(1, whole["n"]))).alias("_n"), F.percentile_approx("turn.id", shares, 100 * side).alias("_ids"))
    fine = fine.select(F.col("coarse").alias("_c"), "_n", F.array_distinct("_ids").alias("_ids"))
    dealt = coarse.join(F.broadcast(fine), F.col("coarse") == F.col("_c"))  # 2 * side rows of `side` bounds at most
    by_hash = F.floor((F.col("turn.hash") / F.lit(2.0**64) + 0.5) * F.col("_n"))
    by_id = F.size(F.filter("_ids", lambda c: c < F.col("turn.id"))).cast("long")
    return dealt.withColumn("part", F.col("coarse") * (1 << 32) + F.coalesce(by_hash, by_id)).drop("coarse", "_c", "_n", "_ids")


def with_next(docs: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """docs (doc_id, text) with, as next_<name>, the columns' values in the next row in descending doc_id, after the last in the first.

    Rows are dealt out by ranges of doc_id, and each range also gets the first row of the range below it, so no row
    looks beyond its range.  One row for each range passes through the driver.
    """
    dealt = _ranged(docs, parts)
    tops = sorted(((r["part"], r["top"]) for r in dealt.groupBy("part").agg(F.max("turn").alias("top")).collect()), reverse=True)
    rows = [(part, tuple(top), tops[k - 1][0]) for k, (part, top) in enumerate(tops)]
    kinds = dealt.schema["turn"].dataType.simpleString()
    named = docs.sparkSession.createDataFrame(rows, f"_part long, _top {kinds}, _to long")
    heads = dealt.join(F.broadcast(named), (F.col("part") == F.col("_part")) & (F.col("turn") == F.col("_top"))).dropDuplicates(["_to"])
    # as many tasks as the ranges need, where the session has fewer
    tasks, usual = -(-parts // 32), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = dealt.withColumn("head", F.lit(0)).unionByName(heads.withColumn("part", F.col("_to")).drop("_part", "_top", "_to").withColumn("head", F.lit(1)))
    both = both.repartition(tasks, "part") if tasks > usual else both
    line = Window.partitionBy("part").orderBy("head", F.desc("turn"))
    return both.select("*", *(F.lead(name).over(line).alias(f"next_{name}") for name in columns)).where("head = 0").drop("head", "part", "turn")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, placed_edited of every document.

    The edited text has its last half replaced by as many characters of the next document in descending doc_id.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    lined = with_next(source, ["text"], min(RANGES, -(-size // RANGE_BYTES)))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    whole = lined.select("doc_id", chosen(F.col("text")).alias("own"), chosen(F.col("next_text"))["all"].alias("next"), n.cast("long").alias("n_chars"), edited.alias("edited")).withColumn("changed", chosen(F.col("edited")))
    prints = as_text(fingerprint(F.col("own.all"))).alias("fingerprint"), as_text(fingerprint(F.col("changed.all"))).alias("edited_fingerprint")
    near = likeness(F.col("own.all"), F.col("changed.all")).alias("near_edited"), likeness(F.col("own.all"), F.col("next")).alias("near_next"), likeness(F.col("own.placed"), F.col("changed.placed")).alias("placed_edited")
    return whole.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), *prints, *near)
