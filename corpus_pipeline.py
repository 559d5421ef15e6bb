"""The corpus pipeline: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the docs of
the next.  All but the last return the columns of docs, whatever they are.  The classifiers learn from the documents
and labels of sf_dir, from the rows outside their held-out fold.

Null and empty texts are scored and kept or rejected as texts without words; they link with nothing and take one token
each when packed.  Very long texts are read whole, in windows where a stage needs them.  Equal texts are treated alike; of
repeated rows, and of rows of equal doc_id and text, near_duplicates keeps one: the one of least hash of all columns.  Rows
with null doc_id take part in all stages.  An empty table gives an empty result.  Columns of any name are kept by all
stages but the last; each stage numbers them while it works, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import neardup, packing, quality, toxicity
from quillstone.llm.common import table, written

#: Bytes of text whose words and ids a packing task holds at a time: the stages before it leave less memory than packing alone has.
PACKED_BYTES = 2 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The columns of docs as c0, c1, ... beside text, so that no name can clash with what a stage adds."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), F.col("text")), names


def _named(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    return df.select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score is `quality.THRESHOLD` or more."""
    model = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    numbered, names = _numbered(docs)
    return _named(quality.score(numbered, model, names).where("predicted = 1"), names, docs.columns)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain does not call toxic."""
    chain = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    numbered, names = _numbered(docs)
    return _named(toxicity.score(numbered, chain, names).where("toxic = 0"), names, docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One document of each group of near-duplicates, the one of least doc_id; of equal rows one."""
    return neardup.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """The pieces of all documents in sequences of `packing.WINDOW` tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), text_bytes=PACKED_BYTES)


STAGES: list[tuple[str, Stage]] = [("quality", good), ("toxicity", harmless), ("near_duplicates", distinct), ("packing", packed)]

#: Trained classifiers and the tokenizer have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
