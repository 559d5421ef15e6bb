"""Writers: statements as CSV, long provenance tables, JSON lines, versioned results, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def statement(cells: DataFrame, keys: list[str], periods: list[str], value: str = "value") -> DataFrame:
    """A column for each period.  The periods are given, so nothing is collected to find them."""
    return cells.groupBy(*keys).pivot("period", periods).agg(F.min(value))


def csv_field(x: Column) -> Column:
    """A field in quotes if it holds a comma, a quote or a line break; null as n/a."""
    text = F.coalesce(x.cast("string"), F.lit("n/a"))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(wide: DataFrame, columns: list[str]) -> DataFrame:
    """line: each row as CSV text; the file's own line ends follow."""
    return wide.select(F.concat_ws(",", *(csv_field(F.col(f"`{c}`")) for c in columns)).alias("line"))


def write_statement_csv(wide: DataFrame, columns: list[str], header: list[str], path: str) -> None:
    """CSV files with CRLF ends; the header with a byte order mark stands first in each file of the folder."""
    head = "﻿" + ",".join(f'"{h}"' if any(c in h for c in ',"\n') else h for h in header)

    def with_head(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([head])], schema=batch.schema)
                first = False
            yield batch

    csv_lines(wide, columns).mapInArrow(with_head, "line string").write.option("lineSep", "\r\n").text(path)


def long_cells(wide: DataFrame, keys: list[str], periods: list[str]) -> DataFrame:
    """keys, period, value: the raw-data table of a wide statement, absent cells left out."""
    return wide.unpivot(keys, periods, "period", "value").where("value is not null")


def results(df: DataFrame) -> DataFrame:
    """json: each row as one object, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json_lines(df: DataFrame, path: str, mode: str = "error", codec: str = "none") -> None:
    """Each row as one JSON object on a line of its own, nulls written out; `filings.snapshots` reads such folders."""
    results(df).write.mode(mode).option("compression", codec).text(path)


def packed(pairs: DataFrame, key: str, concepts: list[str]) -> DataFrame:
    """key, places: what a key has of the listed concepts, as places in the list, rising, such as "0,3,7".

    pairs: key, concept; repeated pairs count once.  A concept that isn't listed is an error, as it would be lost.  The opposite of
    `filings.unpacked`; the list bounds what a key gathers.
    """
    place = F.array_position(F.array(*map(F.lit, concepts)), F.col("concept")) - 1
    known = F.when(place >= 0, place).otherwise(F.raise_error(F.concat(F.lit("not a listed concept: "), F.coalesce("concept", F.lit("null")))).cast("bigint"))
    return pairs.select(key, known.alias("_place")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("_place")).cast("array<string>"), ",").alias("places"))


def grouped_lists(pairs: DataFrame, group: str) -> DataFrame:
    """group, concepts: the concepts of each group in order, as a list; pairs: group, concept."""
    return pairs.groupBy(group).agg(F.array_sort(F.collect_set("concept")).alias("concepts"))


def _generations(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in files.listStatus(at)] if files.exists(at) else []
    done = [p.getName() for p in names if files.exists(jvm.org.apache.hadoop.fs.Path(p, "concepts/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done if n.startswith("generation="))


def read_packed(spark: SparkSession, path: str, key: str, generation: int | None = None) -> DataFrame | None:
    """key, concept of a generation of write_packed, the newest if none is named; None if there is none."""
    found = _generations(spark, path)
    if not found:
        return None
    folder = f"{path}/generation={found[-1] if generation is None else generation}"
    lists = spark.read.parquet(f"{folder}/lists").withColumn("place", F.explode(F.split("places", ",").cast("array<bigint>")))
    return lists.join(F.broadcast(spark.read.parquet(f"{folder}/concepts")), "place").select(key, "concept")


def write_packed(pairs: DataFrame, path: str, key: str, concepts: list[str]) -> DataFrame:
    """Write packed lists as a new generation, and give key, concept, change against the one before: `gained` or `lost`.

    Older generations stay, so nothing that is being read is overwritten.  A generation carries its own list of concepts, written last:
    one without it was cut short and doesn't count.  Of a first generation all is gained.
    """
    spark = pairs.sparkSession
    before, found = read_packed(spark, path, key), _generations(spark, path)
    at = found[-1] + 1 if found else 0
    folder = f"{path}/generation={at}"
    packed(pairs, key, concepts).write.mode("overwrite").parquet(f"{folder}/lists")
    spark.createDataFrame(list(enumerate(concepts)), "place bigint, concept string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/concepts")
    now = read_packed(spark, path, key, at)
    if before is None:
        return now.withColumn("change", F.lit("gained"))
    gained, lost = now.join(before, [key, "concept"], "left_anti"), before.join(now, [key, "concept"], "left_anti")
    return gained.withColumn("change", F.lit("gained")).unionByName(lost.withColumn("change", F.lit("lost")))


def write_versioned(df: DataFrame, path: str, version: dict[str, str]) -> None:
    """Results under the partitions of their version; those of other versions stay."""
    out = df.withColumns({k: F.lit(v) for k, v in version.items()})
    out.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*version).parquet(path)


def read_versioned(spark: SparkSession, path: str, version: dict[str, str]) -> DataFrame | None:
    """The results of that version, or None if there are none."""
    jvm = spark.sparkContext._jvm
    folder = "/".join([path, *(f"{k}={v}" for k, v in version.items())])
    at = jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path).where(" and ".join(f"{k} = '{v}'" for k, v in version.items())).drop(*version)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose keys new hasn't."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def newly_listed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys that new has and old hadn't: what a writer should show before it replaces a file."""
    return new.select(*keys).distinct().join(old.select(*keys).distinct(), keys, "left_anti")


def safe_key(name: Column) -> Column:
    """A cache key of letters, digits, dots, dashes and underscores alone."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")
