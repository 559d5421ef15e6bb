"""Readers of raw filing data: JSON documents, tab-separated bulk files, XML instances, text and markup."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.calendar import epoch_date
from quillstone.functions.scalars import clean_ratio

POINT = "struct<start:date,end:date,val:double,fy:int,fp:string,form:string,filed:date,frame:string>"
COMPANY_FACTS = f"cik bigint, entityName string, facts map<string,map<string,struct<units:map<string,array<{POINT}>>>>>"
SUBMISSIONS = (
    "cik string, name string, tickers array<string>, sic string, sicDescription string, fiscalYearEnd string, "
    "filings struct<recent:struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>,reportDate:array<string>>>"
)
CHART = (
    "ticker string, meta struct<currency:string,regularMarketPrice:double,firstTradeDate:bigint>, timestamp array<bigint>, adjclose array<double>, "
    "events struct<splits:map<string,struct<date:bigint,numerator:double,denominator:double>>>"
)
# fixed values: the columns of the bulk files that are used
BULK = {
    "sub": "adsh string, cik bigint, name string, sic string, form string",
    "num": "adsh string, tag string, version string, ddate string, qtrs int, uom string, segments string, coreg string, value double",
    "pre": "adsh string, stmt string, tag string, version string, plabel string",
}


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """cik, entity_name, ns, tag, unit, pos and the fields of a point, from one JSON document for each company (gz or not)."""
    raw = spark.read.schema(COMPANY_FACTS).json(path, multiLine=True)
    return exploded_facts(raw)


def exploded_facts(raw: DataFrame) -> DataFrame:
    tags = raw.select("cik", F.col("entityName").alias("entity_name"), F.explode("facts").alias("ns", "_tags")).select("cik", "entity_name", "ns", F.explode("_tags").alias("tag", "_t"))
    units = tags.select("cik", "entity_name", "ns", "tag", F.explode("_t.units").alias("unit", "_points"))
    points = units.select("cik", "entity_name", "ns", "tag", "unit", F.posexplode("_points").alias("pos", "_p"))
    return points.select("cik", "entity_name", "ns", "tag", "unit", "pos", "_p.*")


def filings(spark: SparkSession, path: str) -> DataFrame:
    """cik, name, fiscal_year_end, form, filing_date, accession, primary_document, report_date, amended, url of the parallel arrays."""
    return listed_filings(spark.read.schema(SUBMISSIONS).json(path, multiLine=True))


def listed_filings(raw: DataFrame) -> DataFrame:
    """A row for each place of the parallel arrays of documents (SUBMISSIONS); shorter arrays give nulls, an empty report date is null."""
    rows = raw.select(F.col("cik").cast("bigint").alias("cik"), "name", F.col("fiscalYearEnd").alias("fiscal_year_end"), F.inline(F.arrays_zip(*(F.col(f"filings.recent.{c}").alias(c) for c in ("form", "filingDate", "accessionNumber", "primaryDocument", "reportDate")))))
    rows = rows.select("cik", "name", "fiscal_year_end", "form", F.to_date("filingDate").alias("filing_date"), F.col("accessionNumber").alias("accession"), F.col("primaryDocument").alias("primary_document"), F.to_date(F.nullif("reportDate", F.lit(""))).alias("report_date"))
    url = F.concat(F.lit("/Archives/edgar/data/"), F.col("cik").cast("string"), F.lit("/"), F.translate("accession", "-", ""), F.lit("/"), F.col("primary_document"))
    return rows.withColumn("amended", F.col("form").endswith("/A")).withColumn("url", url)


def roster(spark: SparkSession, *paths: str) -> DataFrame:
    """ticker, cik, title and all tickers of the company; of a ticker in several rosters the first roster's row."""
    kind = "map<string,struct<cik_str:bigint,ticker:string,title:string>>"
    each = [spark.read.text(p, wholetext=True).select(F.lit(k).alias("_prio"), F.explode(F.map_values(F.from_json("value", kind))).alias("r")) for k, p in enumerate(paths)]
    rows = each[0]
    for other in each[1:]:
        rows = rows.unionByName(other)
    rows = rows.select("_prio", F.upper("r.ticker").alias("ticker"), F.col("r.cik_str").alias("cik"), F.col("r.title").alias("title"))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy("_prio", "cik"))).where("_r = 1").drop("_r", "_prio")
    every = first.groupBy("cik").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    return first.join(every, "cik")


def bulk(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table of the quarterly bulk files: tab-separated, no quoting, short rows dropped, columns picked by the header."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("mode", "DROPMALFORMED").csv(path)
    wanted = [c.split(" ") for c in BULK[kind].split(", ")]
    return raw.select(*(F.col(n).try_cast(t).alias(n) if n in raw.columns else F.lit(None).cast(t).alias(n) for n, t in wanted))


def periodic_values(num: DataFrame, sub: DataFrame, forms: tuple[str, ...], versions: str = "^(us-gaap|ifrs|srt|dei)") -> DataFrame:
    """cik, adsh, tag, qtrs, value of undimensioned standard values of periodic reports, the company coming from the filing."""
    plain = F.coalesce(F.col("segments"), F.lit("")) == ""
    alone = F.coalesce(F.col("coreg"), F.lit("")) == ""
    return num.where(plain & alone & F.col("version").rlike(versions)).join(sub.where(F.col("form").isin(*forms)).select("adsh", "cik"), "adsh").select("cik", "adsh", "tag", "qtrs", "value")


def configured_facts(num: DataFrame, sub: DataFrame, tags: DataFrame, forms: tuple[str, ...], versions: str = "^(us-gaap|ifrs|srt|dei)") -> DataFrame:
    """entity, concept, stmt, dimensioned of the standard values of periodic reports under configured tags (concept, stmt, tag).

    A balance sheet takes instants alone (qtrs 0), income and cash flow statements spans alone; values of segments or of a
    co-registrant are dimensioned.  This feeds `market_coverage.market_coverage`.
    """
    fits = F.when(F.col("stmt") == "BS", F.col("qtrs") == 0).when(F.col("stmt").isin("IS", "CF"), F.col("qtrs") != 0).otherwise(True)
    dimensioned = F.concat_ws("", "segments", "coreg") != ""
    named = num.where(F.col("value").isNotNull() & F.col("version").rlike(versions)).join(F.broadcast(tags.select("concept", "stmt", "tag")), "tag").where(fits)
    return named.join(sub.where(F.col("form").isin(*forms)).select("adsh", F.col("cik").alias("entity")), "adsh").select("entity", "concept", "stmt", dimensioned.alias("dimensioned"))


def prices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ticker, d, adj_close) and (ticker, ex_date, factor, cover_start) of chart documents; null closes are left out.

    Splits are those of a clean ratio; others (10000 for 9947 is a spin-off) leave a company's row of what is covered alone.
    """
    raw = spark.read.schema(CHART).json(path, multiLine=True)
    daily = raw.select("ticker", F.inline(F.arrays_zip(F.col("timestamp").alias("t"), F.col("adjclose").alias("c")))).where("c is not null").select("ticker", epoch_date(F.col("t")).alias("d"), F.col("c").alias("adj_close"))
    start = F.greatest(epoch_date(F.col("meta.firstTradeDate")), epoch_date(F.array_min("timestamp")))
    clean = F.filter(F.map_values("events.splits"), lambda s: F.coalesce(clean_ratio(s["numerator"], s["denominator"]), F.lit(False)))
    splits = raw.select("ticker", start.alias("cover_start"), F.explode_outer(clean).alias("s"))
    return daily, splits.select("ticker", epoch_date(F.col("s.date")).alias("ex_date"), (F.col("s.numerator") / F.col("s.denominator")).alias("factor"), "cover_start")


def registrants(text: Column) -> Column:
    """All company numbers that a filing's header names."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"CENTRAL INDEX KEY:\s*(\d{10})"), F.lit(1)), lambda x: x.cast("bigint"))


def feed_company(text: Column) -> tuple[Column, Column]:
    """Company number and name from an atom feed, null where it has none."""
    cik = F.nullif(F.regexp_extract(text, r"<cik>\s*(\d+)\s*</cik>", 1), F.lit("")).try_cast("bigint")
    return cik, F.nullif(F.regexp_extract(text, r"<conformed-name>\s*([^<]+?)\s*</conformed-name>", 1), F.lit(""))


def instance_documents(names: DataFrame) -> DataFrame:
    """accession, name: the instance of a filing's directory: the first *_htm.xml, else the first dated one that is no linkbase."""
    ok = F.col("name").endswith("_htm.xml") | (F.col("name").rlike(r"-\d{8}\.xml$"))
    first = F.struct((~F.col("name").endswith("_htm.xml")).cast("int").alias("a"), "pos")
    return names.where(ok).groupBy("accession").agg(F.min_by("name", first).alias("name"))


# fixed values: where namespaces of standard taxonomies begin
STANDARD = ("http://fasb.org/us-gaap/", "http://fasb.org/srt/", "http://xbrl.sec.gov/", "http://xbrl.ifrs.org/taxonomy/", "http://www.xbrl.org/")
INSTANCE = (
    "path string, pos int, tag string, ctx string, unit string, val double, dims array<struct<axis:string,member:string,axis_standard:boolean,member_standard:boolean>>, typed boolean, start date, end date, "
    "instant date, uri string, name string, standard boolean"
)
_DIM = pa.struct([("axis", pa.string()), ("member", pa.string()), ("axis_standard", pa.bool_()), ("member_standard", pa.bool_())])
_FACT = pa.schema([
    ("path", pa.string()), ("pos", pa.int32()), ("tag", pa.string()), ("ctx", pa.string()), ("unit", pa.string()), ("val", pa.float64()), ("dims", pa.list_(_DIM)), ("typed", pa.bool_()), ("start", pa.date32()), ("end", pa.date32()),
    ("instant", pa.date32()), ("uri", pa.string()), ("name", pa.string()), ("standard", pa.bool_()),
])
FACTS_A_BATCH = 10_000


def instances(spark: SparkSession, path: str) -> DataFrame:
    """Numeric facts of XBRL instances with their contexts: path, pos, tag, ctx, unit, val, dims, typed, start, end, instant, uri, name, standard.

    Facts of elements with a unitRef.  end is an instant's day too; an instant has no start.  Empty and unreadable values are null.  A
    context with a typed dimension is marked, as it isn't the whole company's.  tag is the local name, uri its namespace, name that
    with the prefix that the document declares for it (of several, the one declared last).  Axes and members are names with
    the document's own prefixes; they are standard, as tags are, by the namespace their prefix stands for where it is used.

    Elements are read one after the other and dropped, so a task holds the contexts, one batch of facts and those facts that
    come before their context or unit, not the tree of a document.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                for fact in _numeric_facts(content):
                    rows.append({"path": name, **fact})
                    if len(rows) == FACTS_A_BATCH:
                        yield pa.RecordBatch.from_pylist(rows, _FACT)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _FACT)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, INSTANCE)


def _numeric_facts(content: bytes) -> Iterator[dict]:
    import io
    import xml.etree.ElementTree as ET
    from datetime import date

    declared: list[tuple[str, str]] = []  # prefixes in scope, the innermost last
    contexts: dict[str, dict] = {}
    units: dict[str, str] = {}
    early: list[tuple[dict, str]] = []  # facts before their context or unit

    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1]

    def day(text: str | None) -> date | None:
        return date.fromisoformat(text.strip()[:10]) if text and text.strip() else None

    def standard(qname: str) -> bool:
        prefix = qname.split(":")[0] if ":" in qname else ""
        return next((uri for p, uri in reversed(declared) if p == prefix), "").startswith(STANDARD)

    def context(e: ET.Element) -> dict:
        parts = {local(x.tag): x.text for x in e.iter()}
        pairs = [(x.get("dimension") or "", (x.text or "").strip()) for x in e.iter() if local(x.tag) == "explicitMember"]
        dims = [{"axis": a, "member": m, "axis_standard": standard(a), "member_standard": standard(m)} for a, m in pairs]
        instant = day(parts.get("instant"))
        return {"dims": dims, "typed": any(local(x.tag) == "typedMember" for x in e.iter()), "start": day(parts.get("startDate")), "end": day(parts.get("endDate")) or instant, "instant": instant}

    def number(text: str | None) -> float | None:
        try:
            return float(text)
        except (TypeError, ValueError):
            return None

    depth, pos, root = 0, -1, None
    for event, e in ET.iterparse(io.BytesIO(content), events=("start-ns", "end-ns", "start", "end")):
        if event == "start-ns":
            declared.append(e)
        elif event == "end-ns":
            declared.pop()
        elif event == "start":
            root = e if root is None else root
            depth += 1
        else:
            depth -= 1
            if depth != 1:
                continue
            pos += 1
            tag = local(e.tag)
            if tag == "context":
                contexts[e.get("id")] = context(e)
            elif tag == "unit":
                measures = [x.text.strip() for x in e.iter() if local(x.tag) == "measure" and x.text]
                units[e.get("id")] = measures[0] if len(measures) == 1 else ""
            elif e.get("unitRef") is not None and e.get("contextRef") is not None:
                uri = e.tag[1:].split("}", 1)[0] if e.tag.startswith("{") else ""
                prefix = next((p for p, u in reversed(declared) if u == uri), "")
                fact = {"pos": pos, "tag": tag, "ctx": e.get("contextRef"), "val": number(e.text), "uri": uri, "name": f"{prefix}:{tag}" if prefix else tag, "standard": uri.startswith(STANDARD)}
                if fact["ctx"] in contexts and e.get("unitRef") in units:
                    yield {**fact, "unit": units[e.get("unitRef")], **contexts[fact["ctx"]]}
                else:
                    early.append((fact, e.get("unitRef")))
            root.clear()
    yield from ({**fact, "unit": units.get(unit), **contexts[fact["ctx"]]} for fact, unit in early if fact["ctx"] in contexts)


def snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a snapshot folder, with the file each row came from."""
    return spark.read.schema(schema).json(path).withColumn("file", F.input_file_name())


def universe(rows: DataFrame, column: str) -> DataFrame:
    """ticker from terminal names such as "BRK/B UW Equity"; what has another form is left out."""
    ticker = F.replace(F.regexp_extract(column, r"^(\S+) [A-Z]{2} Equity$", 1), F.lit("/"), F.lit("."))
    return rows.withColumn("ticker", F.nullif(ticker, F.lit(""))).where("ticker is not null")


def unpacked(packed: DataFrame, column: str, concepts: list[str]) -> DataFrame:
    """A row for each concept of lists of places such as "0,3,7"."""
    listed = F.array(*(F.lit(c) for c in concepts))
    places = F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    return packed.withColumn("concept", F.explode(F.transform(places, lambda i: F.get(listed, i)))).drop(column)
