"""The quarterly bulk archives as a data source: tab-separated members of zip files, read in parts by tasks.

    spark.dataSource.register(BulkZips)
    spark.read.format("bulk_zips").option("paths", "a.zip|b.zip").option("member", "num.txt").option("columns", "adsh,tag").load()

A partition is a run of `block` bytes of one member's text.  Deflated text can't be entered in its middle, so a task inflates what
precedes its run and throws it away, which is a small part of what splitting lines into fields costs; it never holds more than
a piece of `PIECE` bytes and one batch of rows.  A line belongs to the run in which it begins.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quillstone.sources.filings import BULK

BLOCK, PIECE, BATCH = 64 << 20, 1 << 20, 20_000


def _file(path: str) -> pa.NativeFile:
    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


@dataclass
class Run(InputPartition):
    path: str
    member: str
    start: int
    end: int


class BulkZips(DataSource):
    """Options: paths (separated by |), member, columns (separated by commas), block."""

    @classmethod
    def name(cls) -> str:
        return "bulk_zips"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in ["archive", *self.options["columns"].split(",")])

    def reader(self, schema: StructType) -> DataSourceReader:
        return BulkReader(self.options["paths"].split("|"), self.options["member"], self.options["columns"].split(","), int(self.options.get("block", BLOCK)))


class BulkReader(DataSourceReader):
    def __init__(self, paths: list[str], member: str, columns: list[str], block: int) -> None:
        self.paths, self.member, self.columns, self.block = paths, member, columns, block

    def partitions(self) -> list[InputPartition]:
        """Runs of all members of that name, in whatever folder of an archive they are."""
        found: list[InputPartition] = []
        for path in self.paths:
            with _file(path) as raw, zipfile.ZipFile(raw) as archive:
                for info in archive.infolist():
                    if info.filename.rsplit("/", 1)[-1] == self.member:
                        found += [Run(path, info.filename, at, min(at + self.block, info.file_size)) for at in range(0, info.file_size, self.block)]
        return found

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        with _file(partition.path) as raw, zipfile.ZipFile(raw) as archive, archive.open(partition.member) as text:
            header = text.readline().rstrip(b"\r\n").decode("utf-8-sig").split("\t")
            places = [header.index(c) if c in header else None for c in self.columns]
            name = partition.path.rsplit("/", 1)[-1]
            rows: list[list[str | None]] = []
            for fields in self._lines(text, partition, len(header)):
                rows.append([name, *(None if p is None or fields[p] == "" else fields[p] for p in places)])
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    def _lines(self, text: zipfile.ZipExtFile, run: Run, width: int) -> Iterator[list[str]]:
        """Fields of the lines that begin in the run and have the header's width."""
        at = text.tell()
        if run.start > at:
            while at < run.start - 1:
                at += len(text.read(min(PIECE, run.start - 1 - at)))
            at += len(text.readline())  # the rest of a line that begins before the run, or its end alone
        while at < run.end:
            line = text.readline()
            if not line:
                return
            at += len(line)
            fields = line.rstrip(b"\r\n").decode("utf-8", "replace").split("\t")
            if len(fields) >= width:
                yield fields

    def _batch(self, rows: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["archive", *self.columns])


def bulk_zips(spark: SparkSession, paths: list[str], kind: str, columns: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """archive and the columns of a bulk table (`sub`, `num` or `pre`), of several quarters at once.

    Only the columns asked for leave the tasks; values that don't fit a column's type are null, short lines are left out.
    """
    spark.dataSource.register(BulkZips)
    kinds = dict(c.split(" ") for c in BULK[kind].split(", "))
    wanted = [c for c in kinds if columns is None or c in columns]
    raw = spark.read.format("bulk_zips").option("paths", "|".join(paths)).option("member", f"{kind}.txt").option("columns", ",".join(wanted)).option("block", str(block)).load()
    return raw.select("archive", *(F.col(c).try_cast(kinds[c]).alias(c) for c in wanted))


def statement_tags(pre: DataFrame, sub: DataFrame, statements: tuple[str, ...] = ("BS", "IS", "CF")) -> DataFrame:
    """entity, stmt, tag, plabel of the standard tags that companies show on their statements, once for each filing."""
    shown = pre.where(F.col("stmt").isin(*statements) & F.col("version").rlike("^(us-gaap|ifrs|srt|dei)"))
    return shown.join(sub.select("archive", "adsh", F.col("cik").alias("entity")), ["archive", "adsh"]).select("entity", "adsh", "stmt", "tag", "plabel").distinct()


def cooccurrence_scan(pre: DataFrame, sub: DataFrame, direct: DataFrame, weak: DataFrame, least: int = 30, share: float = 0.5) -> DataFrame:
    """audits.cooccurrence over filings: how often a weak candidate is shown beside the tag of the concept itself.

    direct, weak: tag, concept.
    """
    from quillstone.operators.audits import cooccurrence

    shown = statement_tags(pre, sub).select(F.col("adsh").alias("entity"), "stmt", "tag")
    own = shown.join(F.broadcast(direct), "tag").select("entity", "stmt", "concept")  # configuration
    return cooccurrence(own, shown.join(F.broadcast(weak), "tag").select("entity", "stmt", "tag", "concept"), least, share)


def tag_audit(num: DataFrame, sub: DataFrame, known: DataFrame, forms: tuple[str, ...] = ("10-K", "10-Q"), least: int = 1) -> DataFrame:
    """tag, n_entities, n_values, example of standard tags with values in periodic reports that no concept has, commonest first by rank."""
    from quillstone.sources.filings import periodic_values

    values = periodic_values(num, sub, forms).join(known.select("tag").distinct(), "tag", "left_anti")
    found = values.groupBy("tag").agg(F.count_distinct("cik").alias("n_entities"), F.count("value").alias("n_values"), F.min("cik").alias("example"))
    return found.where(F.col("n_entities") >= least).orderBy(F.desc("n_entities"), "tag")
