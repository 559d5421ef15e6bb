"""Filter interaction audit: what each of five filters removes in each of the 120 orders of applying them.

A document fails

    A   with fewer than `LEAST_WORDS` words
    B   with fewer than `DISTINCT` distinct words in a hundred
    C   with more than `CAPITALS` of A-Z in a hundred code points
    D   with any of `SIGNS`
    E   with a text that a document of smaller doc_id has, anywhere in the table

E is found by sorting: texts are dealt by ranges of (fingerprint, doc_id), the fingerprint being SHA-256, so that neither the
driver's samples nor the bounds hold texts and a group of copies may span many ranges; within a range rows are sorted by
(fingerprint, text, doc_id) and each is compared with the one before.  A range puts out the texts at its two ends.  Whether one range
goes on with the last text of the range before is settled by a join of these rows, the smallest doc_id of the run being handed on
from range to range (some numbers for each range; no text goes to the driver).  The same pass takes the other failures.

Failures are a mask of five bits.  Rows of equal part, doc_id and mask are one row with their number before labels are joined;
parts then have one counter for each mask, of all, good and toxic documents.  Everything reported is a sum of these counters.

Null text is empty (it fails A; B and C aren't failed by a text without words or signs).  Null lang is the part ''.  A null doc_id never
fails E nor makes others fail, and has no labels.  Of repeated rows none fails E by the others, as no doc_id is smaller.  A document is good or toxic
if any of its labels says so.  Very long texts are read whole.  An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import slices, written

LEAST_WORDS, DISTINCT, CAPITALS, SIGNS = 100, 80, 10, "#$%&*|"
FILTERS = "ABCDE"
#: Orders of the filters; a document that fails k of them is removed by each in a k-th part of the orders.
ORDERS = math.factorial(len(FILTERS))
_SIGN = re.compile(b"[" + re.escape(SIGNS).encode() + b"]")
_CAPITAL = bytes(range(65, 91))
_ROW = {"part": "string", "doc_id": "long", "mask": "int", "range": "int", "first": "boolean", "edge": "int", "smallest": "long", "text": "string"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def failures(text: str) -> int:
    """Bits of A to D."""
    data = text.encode()
    words = data.split()
    few, plain = len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT * len(words)
    loud = 100 * (len(data) - len(data.translate(None, _CAPITAL))) > CAPITALS * len(text)
    return few | plain << 1 | loud << 2 | (_SIGN.search(data) is not None) << 3


def _compared(docs: DataFrame) -> DataFrame:
    """A row for each document, in the order of texts: its mask with what its own range tells of E.

    first: in the first run of equal texts of the range.  edge: 1 at the range's first row, 2 at its last, 3 where they are one,
    with the text there; smallest: the least doc_id of the row's run in this range.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        last: str | None = None
        smallest: int | None = None
        runs = mask = 0
        held: list[list] = []  # the row before, put out when another follows
        for batch in batches:
            for some in slices(batch, "text", 8 << 20):
                rows = held
                for part, doc_id, text in zip(*(some.column(c).to_pylist() for c in ("part", "doc_id", "text")), strict=True):
                    if text != last:
                        runs, mask, smallest, last = runs + 1, failures(text), doc_id, text
                    late = doc_id is not None and doc_id > smallest
                    start = not rows and runs == 1
                    rows.append([part, doc_id, mask | late << 4, number, runs == 1, int(start), smallest, text if start else None])
                held = rows[-1:]
                if len(rows) > 1:
                    yield _batch(rows[:-1])
        if held:
            held[0][5:] = [held[0][5] | 2, smallest, last]
            yield _batch(held)

    lang, text = F.col("lang").cast("string"), F.col("text").cast("string")
    source = docs.select(F.coalesce(lang, F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    keyed = source.withColumn("print", F.unhex(F.sha2("text", 256)))
    ranged = keyed.repartitionByRange("print", F.col("doc_id").asc_nulls_last()).sortWithinPartitions("print", "text", F.col("doc_id").asc_nulls_last())
    return ranged.select("part", "doc_id", "text").mapInArrow(compare, ", ".join(f"`{n}` {k}" for n, k in _ROW.items()))


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows, strict=True), _ROW.values(), strict=True)], names=list(_ROW))


def _handed_on(rows: DataFrame) -> DataFrame:
    """range, known: the smallest doc_id of the run that a range goes on with, for the ranges that do.

    A range has two rows of numbers here; texts are compared where they lie.
    """
    spark = rows.sparkSession
    numbers = [r["range"] for r in rows.where("edge > 0").select("range").distinct().orderBy("range").collect()]
    before = spark.createDataFrame(list(zip(numbers[1:], numbers[:-1], strict=True)), "after int, range int")
    ends = rows.where("(edge & 2) > 0").select("range", F.col("text").alias("ending"), "smallest", F.col("first").alias("single"))
    starts = rows.where("(edge & 1) > 0").select(F.col("range").alias("after"), F.col("text").alias("opening"))
    linked = ends.join(F.broadcast(before), "range").join(starts, "after").select("after", (F.col("opening") == F.col("ending")).alias("same"))
    same = {r["after"]: r["same"] for r in linked.collect()}
    last: dict[int, int | None] = {}
    known: list[tuple[int, int | None]] = []
    for k, r in enumerate(ends.select("range", "smallest", "single").orderBy("range").collect()):
        start = last[numbers[k - 1]] if same.get(r["range"]) else None
        if same.get(r["range"]):
            known.append((r["range"], start))
        last[r["range"]] = start if r["single"] and same.get(r["range"]) else r["smallest"]
    return spark.createDataFrame(known, "range int, known long")


def masks(docs: DataFrame) -> DataFrame:
    """part, doc_id, mask of every document."""
    rows = written(_compared(docs), "compared")
    late = F.col("first") & (F.col("doc_id") > F.col("known"))
    return rows.join(F.broadcast(_handed_on(rows)), "range", "left").select("part", "doc_id", F.when(late, F.col("mask").bitwiseOR(16)).otherwise(F.col("mask")).alias("mask"))


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part have a mask, and how many of them are good or toxic."""
    like = masked.groupBy("part", "doc_id", "mask").agg(F.count("*").alias("n"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(a) for c, a in (("quality", "is_good"), ("toxic", "is_toxic"))))
    both = like.join(said, F.col("doc_id") == F.col("label_id"), "left")
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(f"is_{a}") == 1, F.col("n")).otherwise(0)).alias(a) for a in ("good", "toxic")))


def report(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 entries at most
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    steps = parts.select("part", "counts", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    own = F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)")
    earlier = F.expr(f"aggregate(sequence(1, step), 0, (bits, k) -> if(k < step, bits | shiftleft(1, instr('{FILTERS}', substring(filter_order, k, 1)) - 1), bits))")
    steps = steps.withColumn("own", own).withColumn("earlier", earlier)

    def total(condition: str, what: str = "n") -> Column:
        return F.expr(f"aggregate(counts, 0L, (s, c) -> s + if({condition}, c.{what}, 0L))")

    fails, removed = "(c.mask & own) > 0", "(c.mask & own) > 0 and (c.mask & earlier) = 0"
    return steps.select(
        "part", "filter_order", "step",
        total("(c.mask & (own | earlier)) = 0").alias("kept"),
        total(removed).alias("removed"),
        total(f"{fails} and (c.mask & earlier) > 0").alias("redundant"),
        total("c.mask = own").alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        F.expr(f"aggregate(counts, 0L, (s, c) -> s + if({fails}, c.n * ({ORDERS} div greatest(bit_count(c.mask), 1)), 0L))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return report(counters(masks(docs), labels))
