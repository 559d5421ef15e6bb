"""Phrases that belong together, found by growing contiguous patterns to the right.

1. Tasks count the words of each language.  A word is known by a 64-bit hash of language and word; words of equal hash
   raise an error.
2. Projection: every place of a frequent word (f >= `LEAST`) is a pointer with what can be grown from there, the next
   words of its piece up to `LONGEST` or the first word that isn't frequent.  Which words are frequent is broadcast as a
   bit map of 2**30 bits at most: a bit that is set by chance only lets a pointer through that growing drops later.
3. One prefix, one task: the pointers of a first word go to the task of its bucket, which has `BUCKET` pointers on average.
   There `grown` extends each frequent prefix by every next word, depth first, over its own run of the sorted pointers.
   Where the first word is hot (more than `BUCKET` / 4 places), a task's prefix has two words, and where both are hot, it is
   dealt out by the words that follow over as many tasks as the rarer of the two calls for; counts of phrases of hot words
   then may come in some parts, which are added up.  The hot words and their counts are broadcast, 2**20 of them at most.
4. Cuts, scores and what longer phrases cover are joins on phrases; joins on a part that many phrases share are salted.

Equal pointers of a block of text travel once with their number, so a passage that stands in a third of all texts takes few
bytes.  Null text is empty, null lang is `und`.  Very long texts are read whole.  Repeated rows count as often as they
stand.  Phrases that tie in score and a are ordered by their bytes.  An empty table gives no rows; columns other than
text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import heavy_join, remove, slices, written
from quillstone.llm.shingles import mixed
from quillstone.llm.words import Words

LEAST, LONGEST, TOP, COVER = 30, 4, 2_000, 80
#: Pointers of one task; text of one block when words are counted and when they are projected; text whose words are found at once.
BUCKET, COUNT_BLOCK, BLOCK, SLICE = 1_000_000, 4 << 20, 3 << 20, 1 << 20
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = _BREAK[10:14] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True


@dataclass
class Block:
    """Words of some texts: id, number of the piece, number of the language, and where they lie in raw."""

    ids: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    raw: bytes
    starts: np.ndarray
    lengths: np.ndarray
    langs: list[str]

    def word(self, k: int) -> str:
        return self.raw[self.starts[k] : self.starts[k] + self.lengths[k]].decode().translate(_LOWERED)


_LOWERED = {k: k + 32 for k in range(65, 91)}


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def block_of(texts: pa.Array, langs: pa.Array) -> Block:
    raw = np.frombuffer(("\n".join(texts.to_pylist()) + "\n").encode(), np.uint8)
    inside = ~_GAP[raw]
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1]))
    lengths = np.flatnonzero(~inside & np.append(False, inside[:-1])) - starts
    at = np.flatnonzero(inside)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.searchsorted(np.cumsum(sizes + 1), starts, side="right")
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    lang = coded.indices.to_numpy(zero_copy_only=False)[text].astype(np.int32)
    seeds = np.array([_seed(x) for x in names], np.uint64)
    hashes = Words(raw, at, at - np.repeat(starts, lengths), starts, lengths, np.zeros(1, np.int64)).hashes()
    ids = np.maximum(mixed(hashes + seeds[lang]), np.uint64(1)) if len(hashes) else hashes
    return Block(ids, np.cumsum(_BREAK[raw], dtype=np.int32)[starts], lang, raw.tobytes(), starts, lengths, names)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[Block]]:
    """Blocks of small slices, together about `most` bytes of text."""
    held: list[Block] = []
    size = 0
    for batch in batches:
        for some in slices(batch, "text", SLICE):
            held.append(block_of(some.column("text"), some.column("lang")))
            size += len(held[-1].raw)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame) -> DataFrame:
    """id, lang, word, f of every word of every language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, COUNT_BLOCK):
            ids, first, counts = np.unique(np.concatenate([b.ids for b in held]), return_index=True, return_counts=True)
            ends = np.cumsum([len(b.ids) for b in held])
            block = np.searchsorted(ends, first, side="right")
            words, langs = [], []
            for b, k in zip(block.tolist(), (first - (ends - [len(b.ids) for b in held])[block]).tolist() if len(first) else [], strict=True):
                words.append(held[b].word(k))
                langs.append(held[b].langs[held[b].lang[k]])
            for at in range(0, len(ids), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part].view(np.int64)), pa.array(langs[part], pa.string()), pa.array(words[part], pa.string()), pa.array(counts[part])], names=["id", "lang", "word", "f"])

    counted = _source(docs).mapInArrow(count, "id long, lang string, word string, f long")
    summed = counted.groupBy("id").agg(F.min(F.struct("lang", "word")).alias("least"), F.max(F.struct("lang", "word")).alias("most"), F.sum("f").alias("f"))
    clash = F.when(F.col("least") == F.col("most"), F.lit(None)).otherwise(F.raise_error(F.lit("two words have one hash")))
    return summed.select("id", "least.lang", "least.word", "f", clash.cast("string").alias("clash")).where("clash is null").drop("clash")


def _bit_map(ids: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits as 64-bit words, those of the ids set."""
    place = F.col("id").bitwiseAND((1 << bits) - 1)
    rows = ids.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("x")).toArrow()
    out = np.zeros(max(1, 1 << bits >> 6), np.uint64)
    out[np.asarray(rows.column("at"))] = np.asarray(rows.column("x")).view(np.uint64)
    return out


def _has(bit_map: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = ids & np.uint64(len(bit_map) * 64 - 1)
    return (bit_map[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


@dataclass
class Hot:
    """Words with more than `most` places, ascending, and their counts."""

    ids: np.ndarray
    counts: np.ndarray
    most: int

    def tasks(self, words: np.ndarray) -> np.ndarray:
        """Over how many tasks a word's places are to be dealt: 0 for those that aren't hot."""
        if not len(self.ids):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.ids, words), len(self.ids) - 1)
        return np.where(self.ids[at] == words, -(-self.counts[at] // self.most), 0)


def _dealt(found: np.ndarray, tasks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What names the task of each pointer, and from how many words on its phrases have all their pointers there.

    tasks: over how many tasks each of the first three words is dealt, 0 if it isn't hot.
    """
    hashes = [mixed(found[:, d] + np.uint64(d)) for d in range(LONGEST)]
    first, second, third = (tasks[:, d] > 0 for d in range(LONGEST - 1))
    key, whole = found[:, 0].copy(), np.ones(len(found), np.int64)
    key[first] = mixed(key[first] + hashes[1][first])
    whole[first] = 2
    both = first & second
    n = np.minimum(tasks[:, 0], tasks[:, 1])
    m = np.where(third, np.minimum(n, tasks[:, 2]), 1)
    some = np.flatnonzero(both & (n > 1))
    by = hashes[2][some] % n[some].astype(np.uint64)
    part = (by + hashes[3][some] % m[some].astype(np.uint64)) % n[some].astype(np.uint64)
    key[some] = mixed(key[some] + part + np.uint64(1))
    whole[some] = np.where(m[some] > 1, 4, 3)
    return key, whole


def pointers(held: list[Block], frequent: np.ndarray, hot: Hot, buckets: int) -> Iterator[tuple[int, int, str, np.ndarray, np.ndarray]]:
    """bucket, whole_from (see grown), language, the words that follow from each pointer (0: none), and how often."""
    ids = np.concatenate([b.ids for b in held])
    if not len(ids):
        return
    names = sorted({x for b in held for x in b.langs})
    lang = np.concatenate([np.array([names.index(x) for x in b.langs], np.int32)[b.lang] for b in held])
    ends = np.cumsum([0, *(b.piece[-1] + 1 if len(b.piece) else 0 for b in held)])
    piece = np.concatenate([b.piece + e for b, e in zip(held, ends[:-1].tolist(), strict=True)])
    words, first, code = np.unique(ids, return_index=True, return_inverse=True)
    often, tasks, of_lang = _has(frequent, words), hot.tasks(words), lang[first]
    pair = np.append((piece[1:] == piece[:-1]) & often[code[1:]] & often[code[:-1]], [False] * 3)
    at = np.flatnonzero(pair)
    if not len(at):
        return
    code = np.append(code + 1, [0] * 3).astype(np.int64)  # 0 stands for no word
    third = pair[at + 1]
    fourth = third & pair[at + 2]
    head = code[at] << 32 | code[at + 1]
    tail = np.where(third, code[at + 2], 0) << 32 | np.where(fourth, code[at + 3], 0)
    order = np.lexsort((tail, head))
    head, tail = head[order], tail[order]
    start = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])))
    times = np.diff(np.append(start, len(head)))
    head, tail = head[start], tail[start]
    codes = np.stack([head >> 32, head & 0xFFFFFFFF, tail >> 32, tail & 0xFFFFFFFF], axis=1)
    found = np.append(np.uint64(0), words)[codes]
    key, whole = _dealt(found, np.append(0, tasks)[codes[:, : LONGEST - 1]])
    bucket, of = (key % np.uint64(buckets)).astype(np.int64), of_lang[codes[:, 0] - 1]
    order = np.lexsort((of, whole, bucket))
    found, times, bucket, whole, of = found[order], times[order], bucket[order], whole[order], of[order]
    cut = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (whole[1:] != whole[:-1]) | (of[1:] != of[:-1])))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(of)], strict=True):
        yield int(bucket[a]), int(whole[a]), names[of[a]], found[a:b], times[a:b]


def _projected(docs: DataFrame, frequent: np.ndarray, hot: Hot, buckets: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((frequent, hot))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shrink = zstandard.ZstdCompressor(level=1)
        for held in _blocks(batches, BLOCK):
            rows: list[tuple] = []
            for bucket, whole, lang, found, times in pointers(held, *shared.value, buckets):
                data = found.T.tobytes() + times.astype("<u8").tobytes()
                rows.append((bucket, whole, lang, len(times), shrink.compress(data)))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary())
            for at in range(0, len(rows), 2_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 2_000], strict=True), kinds, strict=True)], names=["bucket", "whole_from", "lang", "n", "data"])

    return _source(docs).mapInArrow(project, "bucket long, whole_from int, lang string, n long, data binary")


def grown(found: np.ndarray, times: np.ndarray, least: int, whole_from: int = 1) -> Iterator[tuple[list[int], int, bool]]:
    """Phrases with f >= least that the pointers' prefixes grow to: words, f, True.

    Shorter phrases than whole_from words have pointers in other tasks too: they come with what this task has, and False.
    """
    order = np.lexsort(found.T[::-1])
    found, times = found[order], times[order]
    differs = found[1:] != found[:-1]
    changes = np.logical_or.accumulate(differs, axis=1)  # where the first d + 1 words change
    signed = found.view(np.int64)

    def extend(lo: int, hi: int, depth: int) -> Iterator[tuple[list[int], int, bool]]:
        inner = np.flatnonzero(changes[lo : hi - 1, depth])
        starts = np.append(lo, inner + lo + 1)
        sums = np.add.reduceat(times[lo:hi], starts - lo)
        part = depth + 1 < whole_from
        kept = np.flatnonzero((found[starts, depth] != 0) & ((sums >= least) | part))
        for k in kept.tolist():
            a, b = int(starts[k]), int(starts[k + 1]) if k + 1 < len(starts) else hi
            if depth:
                yield signed[a, : depth + 1].tolist(), int(sums[k]), not part
            if depth + 1 < LONGEST:
                yield from extend(a, b, depth + 1)

    if len(times):
        yield from extend(0, len(times), 0)


def _phrases(projected: DataFrame, least: int) -> DataFrame:
    """lang, words, a, whole of what the prefixes grow to."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()

        def one(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            parts = [np.frombuffer(expand.decompress(data), "<u8").reshape(LONGEST + 1, n) for *_, n, data in rows]
            both = np.concatenate(parts, axis=1)
            out: list[tuple[list[int], int, bool]] = []

            def batch() -> pa.RecordBatch:
                columns = [pa.array([rows[0][2]] * len(out), pa.string()), pa.array([x[0] for x in out], pa.list_(pa.int64())), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.bool_())]
                return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "a", "whole"])

            for x in grown(np.ascontiguousarray(both[:LONGEST].T), both[LONGEST].astype(np.int64), least, rows[0][1]):
                out.append(x)
                if len(out) == 20_000:
                    yield batch()
                    out = []
            if out:
                yield batch()

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "whole_from", "lang", "n", "data")), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield from one(held)
                    held = []
                held.append(row)
        if held:
            yield from one(held)

    dealt = projected.repartition("bucket", "whole_from", "lang").sortWithinPartitions("bucket", "whole_from", "lang")
    return dealt.mapInArrow(grow, "lang string, words array<long>, a long, whole boolean")


def _scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, words, a, l, r, score of the phrases that no longer one covers."""
    parts = phrases.select(F.col("words").alias("part"), F.col("a").alias("f")).unionByName(words.select(F.array("id").alias("part"), "f"))
    cuts = phrases.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("words", 1, F.col("k"))).withColumn("right", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))
    with_l = heavy_join(cuts, parts.withColumnRenamed("f", "l"), "left", "part", F.col("words")).drop("part", "left")
    with_r = heavy_join(written(with_l, "cuts"), parts.withColumnRenamed("f", "r"), "right", "part", F.col("words")).drop("part", "right")
    score = F.expr("cast(2000000 as decimal(38,0)) * a div (cast(l as decimal(20,0)) + r)")
    best = with_r.withColumn("score", score).groupBy("words").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), s -> transform(sequence(1, size(words) - s + 1), p -> slice(words, p, s))))")
    cover = phrases.where(F.size("words") > 2).select(F.explode(inner).alias("part"), "a").groupBy("part").agg(F.max("a").alias("longer"))
    kept = best.join(cover, F.col("words") == F.col("part"), "left").where(f"longer is null or cast(100 as decimal(38,0)) * longer < cast({COVER} as decimal(38,0)) * a")
    return kept.select("lang", "words", "a", "cut.l", "cut.r", "cut.score")


def _first(scored: DataFrame, top: int) -> DataFrame:
    """The rows of each language with a rank of top or better, with all that tie: in parts first, then over the parts."""
    better = [F.desc("score"), F.desc("a")]
    parts = scored.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(64)))
    few = parts.withColumn("p", F.rank().over(Window.partitionBy("lang", "part").orderBy(*better))).where(F.col("p") <= top).drop("p", "part")
    return few.withColumn("p", F.rank().over(Window.partitionBy("lang").orderBy(*better))).where(F.col("p") <= top).drop("p")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bucket: int = BUCKET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of each language."""
    counted = written(word_counts(docs), "words")
    frequent = counted.where(F.col("f") >= least)
    size = frequent.agg(F.count("*").alias("words"), F.coalesce(F.sum("f"), F.lit(0)).alias("places")).first()
    bits = min(30, max(10, (16 * size["words"]).bit_length()))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(8 * partitions, -(-size["places"] // bucket))
    most = max(bucket // 4, size["places"] >> 20)
    listed = frequent.where(F.col("f") > most).select("id", "f").toArrow()  # 2**20 rows at most
    ids, counts = np.asarray(listed.column("id")).view(np.uint64), np.asarray(listed.column("f"))
    hot = Hot(ids[np.argsort(ids)], counts[np.argsort(ids)], most)
    found = written(_phrases(_projected(docs, _bit_map(frequent, bits), hot, buckets), least), "grown")
    whole = found.where("whole").select("lang", "words", "a")
    parts = found.where("not whole").groupBy("words").agg(F.first("lang").alias("lang"), F.sum("a").alias("a")).where(F.col("a") >= least)
    phrases = written(whole.unionByName(parts.select("lang", "words", "a")), "phrases")
    remove(found)
    first = written(_first(_scored(phrases, frequent), top), "first")
    spelled = first.select("words", F.posexplode("words").alias("at", "w")).join(frequent.select("id", "word"), F.col("w") == F.col("id"))
    spelled = spelled.groupBy("words").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "word"))).getField("word"), " ").alias("phrase"))
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    rows = first.join(spelled, "words").join(totals, "lang")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
