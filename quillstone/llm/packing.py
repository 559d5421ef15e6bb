"""Packing of token sequences into fixed windows by best-fit decreasing.

A document longer than a window is first cut into full windows; what remains of it is one piece.  Best-fit
decreasing only looks at lengths, and a window has at most `window` of those, so the corpus is reduced to
the number of pieces of each length (one count per length, however many documents there are), the plan is made
from these counts in whole batches of equal windows, and every piece finds its place in the plan by its rank
among the pieces of its length.  The ranks come from counts by task, so no length is sorted in one task.

Null or empty text: the end id alone.  Repeated rows are packed as often as they occur.  Null doc_id stays null.
An empty table gives an empty result.  Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import SLICE_BYTES, slices, written
from quillstone.llm.encoding import encoder

WINDOW = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over the capacities finds the tightest that is enough."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = [0] * (2 * self.size)
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def add(self, capacity: int, first: int, count: int) -> None:
        if capacity <= 0 or count <= 0:
            return
        self.groups.setdefault(capacity, []).append((first, count))
        node = capacity + self.size
        while node:
            self.any[node] += 1
            node >>= 1

    def take(self, capacity: int) -> tuple[int, int]:
        """The newest group of windows with that capacity."""
        node = capacity + self.size
        while node:
            self.any[node] -= 1
            node >>= 1
        return self.groups[capacity].pop()

    def tightest(self, least: int) -> int | None:
        """Smallest capacity >= least with an open window."""
        node = least + self.size
        if self.any[node]:
            return least
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Best-fit decreasing for counts of pieces by length.

    Rows (length, first rank, number, first sequence, offset): the pieces of that length with these ranks go to
    consecutive sequences, each at the offset.  There are some thousands of rows at most, as a row ends a length
    or a group of equal windows.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    open_windows, sequences = OpenWindows(window), 0
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        rank, left = 0, counts[length]

        def fill(first: int, windows: int, capacity: int, each: int, length: int = length) -> None:
            """Put `each` pieces into every one of these windows."""
            nonlocal rank, left
            for k in range(each):
                rows.append((length, rank, windows, first, window - capacity + k * length))
                rank += windows
            left -= windows * each
            open_windows.add(capacity - each * length, first, windows)

        while left:
            capacity = open_windows.tightest(length)
            if capacity is None:
                capacity, first, count = window, sequences, -(-left // (window // length))
                sequences += count
            else:
                first, count = open_windows.take(capacity)
            each = capacity // length
            whole = min(count, left // each)
            if whole:
                fill(first, whole, capacity, each)
            if whole < count:
                over = count - whole
                if left:
                    fill(first + whole, 1, capacity, left)
                    open_windows.add(capacity, first + whole + 1, over - 1)
                else:
                    open_windows.add(capacity, first + whole, over)
    return np.array(rows, np.int64).reshape(-1, 5)


def ranks_within(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many equal values came before each, seen holding the numbers of earlier batches; seen is brought up to date."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(values) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(values)))
    out = np.zeros(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(starts, sizes) + seen[ordered]
    seen[ordered[starts]] += sizes
    return out


def cut(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, text_bytes: int = SLICE_BYTES) -> DataFrame:
    """The pieces of every document: full windows, then the remainder.  text_bytes: of so much text words and ids are held at a time."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, False, end_id).encode
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            for some in slices(batch, "text", text_bytes):
                ids, ends = encode(some.column("text"))
                tokens = np.diff(ends)
                number = -(-tokens // window)
                row = np.repeat(np.arange(len(tokens)), number)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)) * window
                length = np.minimum(tokens[row] - start, window)
                at, raw = (ends[:-1][row] + start) * 4, memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = np.fromiter((zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(row))
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc), pa.array(tokens[row]), pa.array(np.full(len(row), part, np.int32)), pa.array(ranks_within(length, seen))], schema=_PIECES)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, text_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = written(cut(docs, tokenizer_path, window, end_id, text_bytes), "pieces")
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most one row for each length of a window
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan(counts, window))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))] if len(rows) else rows
        # ranks of one length follow those of the one before it on a common scale
        most = int((rows[:, 1] + rows[:, 2]).max()) + 1 if len(rows) else 1
        scale = rows[:, 0] * most + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = rows[np.searchsorted(scale, length * most + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], schema=_PACKED)

    ranked = pieces.join(base, (pieces["part"] == base["p"]) & (pieces["length"] == base["l"])).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, PACKED)
