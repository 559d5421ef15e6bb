"""Readers and writers on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillstone.plans import source_queries
from quillstone.sources import filings, sinks
from quillstone.streaming.restatements import latest_restatements, windowed_counts


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_company_facts(spark, tmp_path):
    point = {"start": "2024-01-01", "end": "2024-03-31", "val": 5, "fy": 2024, "fp": "Q1", "form": "10-Q", "filed": "2024-05-01"}
    doc = {"cik": 7, "entityName": "X", "facts": {"us-gaap": {"Revenues": {"label": "r", "units": {"USD": [point, point | {"val": 6, "filed": "2024-06-01"}]}}}, "dei": {}}}
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump(doc, f)
    got = filings.company_facts(spark, f"file://{tmp_path}/a.json.gz").orderBy("pos").collect()
    assert [(r.cik, r.ns, r.tag, r.unit, r.pos, r.val) for r in got] == [(7, "us-gaap", "Revenues", "USD", 0, 5.0), (7, "us-gaap", "Revenues", "USD", 1, 6.0)]



def test_company_facts_places_run_over_years(spark):
    """Documents are of a year, places of a tag's whole history."""
    got = source_queries.company_facts_explode(spark, "/root/testdata/sf0.001").collect()
    lists = {}
    for r in got:
        lists.setdefault((r.cik, r.tag), []).append((r.pos, r.end))
    assert any(len({end.year for _, end in x}) > 3 for x in lists.values())
    for x in map(sorted, lists.values()):
        assert [pos for pos, _ in x] == list(range(len(x))) and [end for _, end in x] == sorted(end for _, end in x)


def test_filings(spark, tmp_path):
    recent = {"form": ["10-K", "10-Q/A"], "filingDate": ["2024-02-01", "2024-05-01"], "accessionNumber": ["0000000007-24-000001", "0000000007-24-000002"], "primaryDocument": ["a.htm", "b.htm"], "reportDate": ["2023-12-31", ""]}
    path = put(tmp_path / "s.json", json.dumps({"cik": "7", "name": "X", "fiscalYearEnd": "1231", "filings": {"recent": recent}}))
    got = filings.filings(spark, path).orderBy("filing_date").collect()
    assert got[0].url == "/Archives/edgar/data/7/000000000724000001/a.htm" and got[1].amended and got[1].report_date is None


def test_roster_and_universe(spark, tmp_path):
    a = put(tmp_path / "a.json", json.dumps({"0": {"cik_str": 1, "ticker": "goog", "title": "G"}, "1": {"cik_str": 1, "ticker": "GOOGL", "title": "G"}}))
    b = put(tmp_path / "b.json", json.dumps({"0": {"cik_str": 9, "ticker": "GOOG", "title": "other"}, "1": {"cik_str": 2, "ticker": "X", "title": "X"}}))
    got = {r.ticker: (r.cik, r.tickers) for r in filings.roster(spark, a, b).collect()}
    assert got == {"GOOG": (1, ["GOOG", "GOOGL"]), "GOOGL": (1, ["GOOG", "GOOGL"]), "X": (2, ["X"])}
    names = spark.createDataFrame([("BRK/B UW Equity",), ("nonsense",)], "n string")
    assert [r.ticker for r in filings.universe(names, "n").collect()] == ["BRK.B"]


def test_bulk_tables(spark, tmp_path):
    num = put(tmp_path / "num.txt", 'adsh\ttag\tversion\tddate\tqtrs\tuom\tsegments\tcoreg\tvalue\nA-1\tCash\tus-gaap/2024\t20240331\t0\tUSD\t\t\t5\nA-1\tOdd "quote\tus-gaap/2024\t20240331\t0\tUSD\tSeg=X;\t\t7\nA-1\tOwn\tA-1\t20240331\t0\tUSD\t\t\t8\n')
    sub = put(tmp_path / "sub.txt", "adsh\tcik\tname\tsic\tform\nA-1\t7\tX\t7372\t10-Q\n")
    got = filings.periodic_values(filings.bulk(spark, num, "num"), filings.bulk(spark, sub, "sub"), ("10-K", "10-Q")).collect()
    assert [(r.cik, r.tag, r.value) for r in got] == [(7, "Cash", 5.0)]


def test_prices(spark, tmp_path):
    doc = {"ticker": "X", "meta": {"currency": "USD", "firstTradeDate": -86400}, "timestamp": [0, 86400, 172800], "adjclose": [1.0, None, 3.0], "events": {"splits": {"1": {"date": 86400, "numerator": 2, "denominator": 1}}}}
    daily, split = filings.prices(spark, put(tmp_path / "p.json", json.dumps(doc)))
    assert [(str(r.d), r.adj_close) for r in daily.orderBy("d").collect()] == [("1970-01-01", 1.0), ("1970-01-03", 3.0)]
    assert [(str(r.ex_date), r.factor, str(r.cover_start)) for r in split.collect()] == [("1970-01-02", 2.0, "1970-01-01")]


INSTANCE = """<xbrl xmlns="i" xmlns:d="d" xmlns:g="g">
<context id="a"><entity><segment><d:explicitMember dimension="seg">x:EastMember</d:explicitMember></segment></entity><period><startDate>2024-01-01</startDate><endDate>2024-03-31</endDate></period></context>
<context id="b"><entity/><period><instant>2024-03-31</instant></period></context>
<context id="t"><entity><segment><d:typedMember dimension="q"><v>1</v></d:typedMember></segment></entity><period><instant>2024-03-31</instant></period></context>
<unit id="u"><measure>iso4217:USD</measure></unit><unit id="e"><divide><unitNumerator><measure>iso4217:USD</measure></unitNumerator><unitDenominator><measure>shares</measure></unitDenominator></divide></unit>
<g:Revenues contextRef="a" unitRef="u">5</g:Revenues><g:Assets contextRef="b" unitRef="u"/><g:Eps contextRef="b" unitRef="e">2</g:Eps><g:Text contextRef="b">words</g:Text><g:Cash contextRef="t" unitRef="u">9</g:Cash></xbrl>"""


def test_instances(spark, tmp_path):
    got = {r.tag: r for r in filings.instances(spark, put(tmp_path / "x.xml", INSTANCE)).collect()}
    assert set(got) == {"Revenues", "Assets", "Eps", "Cash"}
    assert got["Revenues"].dims[0].member == "x:EastMember" and got["Revenues"].unit == "iso4217:USD" and str(got["Revenues"].start) == "2024-01-01"
    assert got["Assets"].val is None and got["Assets"].start is None and got["Eps"].unit == "" and got["Cash"].typed


PREFIXED = """<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:gaap="http://fasb.org/us-gaap/2024" xmlns:us-gaap="http://fasb.org/us-gaap/2024" xmlns:own="http://own.com/2024">
<own:Early contextRef="a" unitRef="u">1</own:Early>
<xbrli:context id="a"><xbrli:entity><xbrli:segment><xbrldi:explicitMember dimension="gaap:SegmentAxis">own:EastMember</xbrldi:explicitMember><xbrldi:explicitMember dimension="own:Axis">gaap:WestMember</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>2024-03-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="l"><xbrli:entity><xbrli:segment><xbrldi:explicitMember xmlns:own="http://fasb.org/srt/2024" dimension="own:Axis">none</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-03-31T00:00:00</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>
<gaap:Cash contextRef="a" unitRef="u"> 2.5 </gaap:Cash><us-gaap:Debt contextRef="l" unitRef="u">3</us-gaap:Debt><own:Lost contextRef="none" unitRef="u">4</own:Lost><own:NoUnit contextRef="l" unitRef="gone">5</own:NoUnit></xbrli:xbrl>"""


def test_namespaces_of_instances(spark, tmp_path):
    got = {r.tag: r for r in filings.instances(spark, put(tmp_path / "x.xml", PREFIXED)).collect()}
    # two prefixes of one namespace give one name; what names a context that doesn't exist is left out
    assert {t: (r.name, r.standard, r.val, r.unit, r.pos) for t, r in got.items()} == {"Early": ("own:Early", False, 1.0, "iso4217:USD", 0), "Cash": ("us-gaap:Cash", True, 2.5, "iso4217:USD", 4), "Debt": ("us-gaap:Debt", True, 3.0, "iso4217:USD", 5), "NoUnit": ("own:NoUnit", False, 5.0, None, 7)}
    assert got["Cash"].uri == "http://fasb.org/us-gaap/2024" and str(got["Cash"].instant) == str(got["Cash"].end) == "2024-03-31" and got["Cash"].start is None
    assert [tuple(d) for d in got["Early"].dims] == [("gaap:SegmentAxis", "own:EastMember", True, False), ("own:Axis", "gaap:WestMember", False, True)]
    assert got["Debt"].instant is None and str(got["Debt"].end) == "2024-03-31"


def test_long_instances_come_in_batches(spark, tmp_path):
    n = 2 * filings.FACTS_A_BATCH + 1
    facts = "".join(f'<g:T contextRef="b" unitRef="u">{k}</g:T>' for k in range(n))
    text = f'<x xmlns:g="g"><context id="b"><period><instant>2024-03-31</instant></period></context><unit id="u"><measure>shares</measure></unit>{facts}</x>'
    got = filings.instances(spark, put(tmp_path / "x.xml", text)).agg(F.count("*"), F.sum("val"), F.max("pos")).first()
    assert tuple(got) == (n, n * (n - 1) / 2, n + 1)


def test_text_scans(spark):
    df = spark.createDataFrame([("CENTRAL INDEX KEY:\t0000000012\nCENTRAL INDEX KEY: 0000000034 <cik>0000000056</cik><conformed-name> A B </conformed-name>",)], "t string")
    cik, name = filings.feed_company(F.col("t"))
    row = df.select(filings.registrants(F.col("t")).alias("r"), cik.alias("c"), name.alias("n")).first()
    assert row.r == [12, 34] and row.c == 56 and row.n == "A B"


def test_instance_choice(spark):
    df = spark.createDataFrame([("1", 0, "x-20240331.xml"), ("1", 1, "x_htm.xml"), ("2", 0, "y-20240331_cal.xml"), ("2", 1, "y-20240331.xml")], "accession string, pos int, name string")
    assert {r.accession: r.name for r in filings.instance_documents(df).collect()} == {"1": "x_htm.xml", "2": "y-20240331.xml"}


def test_statement_csv(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', 1.5, None)], "name string, p1 double, p2 double").coalesce(1)
    sinks.write_statement_csv(df, ["name", "p1", "p2"], ["Name", "P1", "P2"], f"file://{tmp_path}/out")
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes() == b'\xef\xbb\xbfName,P1,P2\r\n"a ""b"", c",1.5,n/a\r\n'


def test_versioned_results(spark, tmp_path):
    path, df = f"file://{tmp_path}/r", spark.createDataFrame([(1, 2.0)], "k int, v double")
    assert sinks.read_versioned(spark, path, {"map_version": "1"}) is None
    sinks.write_versioned(df, path, {"map_version": "1"})
    sinks.write_versioned(df.withColumn("v", F.lit(9.0)), path, {"map_version": "2"})
    assert sinks.read_versioned(spark, path, {"map_version": "1"}).first().v == 2.0


@pytest.mark.filterwarnings("ignore")
def test_streams(spark, tmp_path):
    schema = "k int, filed string, val double"
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(([(1, "2024-01-01", 1.0), (2, "2024-01-01", 5.0)], [(1, "2024-02-01", 2.0)], [(1, "2024-01-15", 9.0)])):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(dict(zip(("k", "filed", "val"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    run = latest_restatements(stream, ["k"], f"file://{tmp_path}/state", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = max((tmp_path / "state").iterdir(), key=lambda p: int(p.name[2:]))
    assert {r.k: r.val for r in spark.read.parquet(f"file://{last}").select("k", "val").collect()} == {1: 2.0, 2: 5.0}
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert windowed_counts(events).first().n == 2
