"""The read-through store: each document is opened once, broken fills don't count."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillstone.sources import store


def document(folder, cik, *vals):
    points = [{"start": "2024-01-01", "end": "2024-03-31", "val": v, "fy": 2024, "fp": "Q1", "form": "10-Q", "filed": "2024-05-01"} for v in vals]
    with gzip.open(folder / f"CIK{cik:010d}.json.gz", "wt") as f:
        json.dump({"cik": cik, "entityName": f"E{cik}", "facts": {"us-gaap": {"Revenues": {"units": {"USD": points}}}} if vals else {}}, f)


@pytest.fixture
def place(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for cik, vals in ((1, (5.0, 6.0)), (2, (7.0,)), (3, ()), (4, (9.0,))):
        document(raw, cik, *vals)
    (raw / "other.txt").write_text("x")
    return raw, f"file://{tmp_path}/store"


def ask(spark, place, *ciks):
    raw, folder = place
    wanted = spark.createDataFrame([(c,) for c in ciks], "cik bigint")
    return sorted((r.cik, r.pos, r.val) for r in store.read_through(wanted, store.documents(spark, f"file://{raw}"), folder, 4).collect())


def test_documents_are_read_once(spark, place):
    raw, folder = place
    assert ask(spark, place, 1, 1, None, 3, 99) == [(1, 0, 5.0), (1, 1, 6.0)]
    # company 3 has no facts but is known; 1 and 3 can't be read any more
    for cik in (1, 3):
        (raw / f"CIK{cik:010d}.json.gz").write_bytes(b"broken")
    assert ask(spark, place, 1, 2, 3) == [(1, 0, 5.0), (1, 1, 6.0), (2, 0, 7.0)]
    files = set((raw.parent / "store").rglob("*.parquet"))
    assert ask(spark, place, 2) == [(2, 0, 7.0)] and set((raw.parent / "store").rglob("*.parquet")) == files
    # one that had no document is asked for again
    document(raw, 99, 1.0)
    assert ask(spark, place, 99) == [(99, 0, 1.0)]


def test_a_broken_fill_does_not_count(spark, place):
    raw, folder = place
    assert ask(spark, place, 1) == [(1, 0, 5.0), (1, 1, 6.0)]
    # facts without a key, as a fill leaves them that was ended between its two writes; and a second key of another fill
    stray = spark.read.parquet(f"{folder}/facts").withColumn("fill", F.lit("zz")).withColumn("val", F.lit(-1.0))
    stray.write.partitionBy("bucket").mode("append").parquet(f"{folder}/facts")
    assert ask(spark, place, 1) == [(1, 0, 5.0), (1, 1, 6.0)]
    spark.read.parquet(f"{folder}/keys").withColumn("fill", F.lit("zz")).write.mode("append").parquet(f"{folder}/keys")
    assert ask(spark, place, 1) == [(1, 0, 5.0), (1, 1, 6.0)]


def test_only_the_buckets_asked_for(spark, place):
    raw, folder = place
    ask(spark, place, 1, 2, 4)
    got = store.stored(spark.createDataFrame([(4,)], "cik bigint"), folder)
    assert [(r.cik, r.val) for r in got.collect()] == [(4, 9.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket#" in filters and " = " in filters


def test_empty(spark, place):
    assert ask(spark, place) == [] and ask(spark, place, 77) == []


def test_an_unreadable_document_is_an_error(spark, place):
    raw, _ = place
    (raw / "CIK0000000005.json").write_text("{no json")
    with pytest.raises(Exception, match="(?i)malformed"):
        ask(spark, place, 5)
    assert ask(spark, place, 2) == [(2, 0, 7.0)]
