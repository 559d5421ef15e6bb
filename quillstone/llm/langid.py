"""Language identification by compression.

Texts are lowered and everything between letters becomes one space.  Each learned language has a zstandard raw-content
dictionary made of such texts in it.  A text is compressed with every dictionary; the language whose dictionary makes
it smallest is predicted, the first in alphabetical order on a tie.  If the runner-up is not at least `MARGIN` larger,
the answer is marked as rejected.

The dictionaries are fitted on a bounded sample.  Whole texts are cut into passages of `PASSAGE` characters (the last
one is what remains); of each language, for each of `SAMPLES` residues of a passage's hash, the passage of least hash
goes into the dictionary.  So every part of every text may be drawn.  Whole texts are compressed for a prediction.

`und` with score 0: null and empty texts, texts without a letter, and all texts if no language was learned.
Rows with null lang teach nothing.  Equal texts get equal answers; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import remainder

SAMPLES, PASSAGE, LEVEL = 64, 2048, 6
#: Share of the smallest size by which the second smallest must exceed it.
MARGIN = 0.01
#: Evidence of one saved byte, in bits; below 8 as neighbouring bytes are not independent.
BITS = 0.5


def letters(text: Column) -> Column:
    """The lowered words of a text, runs of letters, with one space between them; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content of each language of docs (words, lang): at most SAMPLES * PASSAGE characters each."""
    known = docs.where(F.col("lang").isNotNull() & (F.col("words") != "")).select("lang", F.explode(F.regexp_extract_all("words", F.lit(f".{{1,{PASSAGE}}}"), F.lit(0))).alias("t"))
    keyed = known.withColumn("k", F.xxhash64("t"))
    least = keyed.groupBy("lang", F.pmod("k", F.lit(SAMPLES)).alias("part")).agg(F.min(F.struct("k", "t")).alias("x"))
    found: dict[str, list[str]] = {}
    for row in least.orderBy("lang", "part").collect():
        found.setdefault(row["lang"], []).append(row["x"]["t"])
    return {lang: "\n".join(texts).encode() for lang, texts in found.items()}


def predict(docs: DataFrame, learned: dict[str, bytes]) -> DataFrame:
    """lang_pred, score, rejected beside the columns of docs but its words."""
    names = sorted(learned)
    shared = docs.sparkSession.sparkContext.broadcast([learned[n] for n in names])
    kept = [c for c in docs.columns if c != "words"]

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pressers = []
        for content in shared.value:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            pressers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            lang, score, rejected = [], [], []
            for words in batch.column("words").to_pylist():
                if not words or not pressers:
                    lang.append("und")
                    score.append(0.0)
                    rejected.append(True)
                    continue
                data = words.encode()
                sizes = np.array([len(p.compress(data)) for p in pressers], float)
                best = int(sizes.argmin())
                others = np.delete(sizes, best)
                lang.append(names[best])
                score.append(float(1 / np.exp2(np.maximum((sizes[best] - sizes) * BITS, -1000)).sum()))
                rejected.append(bool(len(others) and others.min() < sizes[best] * (1 + MARGIN)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*kept, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "words")
    return docs.mapInArrow(classify, f"{schema}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learnt from the rows that are not held out."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), letters(F.col("text").cast("string")).alias("words"), F.col("lang").cast("string").alias("lang"), (remainder("doc_id", 3) == 1).alias("held_out"))
    learned = dictionaries(source.where("not held_out").select("words", "lang"))
    return predict(source.select("doc_id", "held_out", "words"), learned)
