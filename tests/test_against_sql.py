"""Queries against their SQL on small tables made for a case that the test tables don't have."""

import os

import duckdb

from quillstone.operators import segment_gaps
from quillstone.plans import catalog  # noqa: F401
from quillstone.plans.registry import ORACLE_SQL, QUERIES

LINES = "l_orderkey::BIGINT AS l_orderkey, l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, l_linenumber::INTEGER AS l_linenumber, 1.0::DOUBLE AS l_quantity, price::DOUBLE AS l_extendedprice, flag AS l_returnflag, status AS l_linestatus, ship::TIMESTAMP AS l_shipdate"
ORDERS = "o_orderkey::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, form AS o_orderpriority, filed::TIMESTAMP AS o_orderdate"


def save(folder, name, columns, rows, fields):
    values = ", ".join(map(str, rows))
    duckdb.sql(f"COPY (SELECT {columns} FROM (VALUES {values}) v({fields})) TO '{folder}/{name}.parquet' (FORMAT parquet)")


def facts(folder, lines, orders):
    save(folder, "lineitem", LINES, lines, "l_orderkey, l_partkey, l_suppkey, l_linenumber, price, flag, status, ship")
    save(folder, "orders", ORDERS, orders, "o_orderkey, form, filed")


def both(spark, name, folder):
    """The query's rows and its SQL's, sorted; equal to the last digit."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM '{folder}/{f}'")
    df = QUERIES[name](spark, str(folder))
    want = con.sql(ORACLE_SQL[name]).project(", ".join(df.columns)).fetchall()
    return sorted(map(tuple, df.collect()), key=str), sorted(want, key=str)


def test_shares_at_the_border_of_20_percent_and_at_a_half(spark, tmp_path):
    # 36513.45 * 1.045 / 7.31 is 5219.775, its double a little less; 1.2 times the average is not over 20 % off
    prices = {1: 36513.45, 6: 13634.26, 7: 43150.48}
    lines = [(1, 1, 1, 1, p, "N", "O", f"{2000 + (k - 1) // 4}-{(k - 1) % 4 * 3 + 3:02d}-28") for k, p in prices.items()]
    facts(tmp_path, lines, [(1, "1-URGENT", "2002-01-01")])
    got, want = both(spark, "share_arbitration", tmp_path)
    assert got == want and got[:2] == [(1, 1, 5219.77, "one"), (1, 6, 2238.18, "cover")]


def test_weights_count_documents_with_words_alone(spark, tmp_path):
    texts = [(1, "Alpha beta, ALPHA"), (2, None), (3, ""), (4, "12 34 éÉ ."), (5, "BİR alpha"), (6, "K"), (None, "alpha"), (5, "gamma")]
    rows = [tuple("NULL" if x is None else x if isinstance(x, int) else f"'{x}'" for x in r) for r in texts]
    save(tmp_path, "documents", "doc_id::BIGINT AS doc_id, 'web' AS source, text::VARCHAR AS text", [f"({i}, {t})" for i, t in rows], "doc_id, text")
    got, want = both(spark, "token_idf", tmp_path)
    # documents 1, 5 and 6 have words; a dotted capital I is a plain i
    assert got == want and dict((t, n) for t, n, _ in got) == {"alpha": 3, "beta": 1, "bir": 1, "gamma": 1, "k": 1} and ("bir", 1, 1.098612) in got


def gap_lines(entities):
    keys = [(e, n) for e in entities for n in range(1, 8)]
    return [(e * 10 + n % 3, n, e, n, 100.25 * n + e + k, "ANR"[(n + k) % 3], "FO"[k % 2], f"{1996 + k // 4}-{k % 4 * 3 + 3:02d}-28") for e, n in keys for k in (0, 1, 3, 6)]


def gap_orders(entities):
    return [(e * 10 + n, ("1-URGENT", "2-HIGH", "5-LOW")[(e + n) % 3], f"{1994 + n}-05-01") for e in entities for n in range(3)]


def test_gaps_read_facts_once_and_never_those_of_an_earlier_call(spark, tmp_path):
    for entities in ((3, 4, 5, 6), (5, 8, 9, 10, 12)):  # the second call finds other files at the same place
        facts(tmp_path, gap_lines(entities), gap_orders(entities))
        got, want = both(spark, "breakdown_gaps", tmp_path)
        assert got == want and {r[0] for r in got} == set(entities)
    plan = QUERIES["breakdown_gaps"](spark, str(tmp_path))._jdf.queryExecution().withCachedData()
    leaves = plan.collectLeaves()
    # everything is made of rows that were joined, sent and judged once
    assert {leaves.apply(k).nodeName().split()[0] for k in range(leaves.size())} == {"InMemoryRelation"}


def test_holes_leave_out_rows_without_company_or_quarter(spark):
    shown = [(1, "a", "x", "q1"), (1, "a", "x", "q3"), (1, "a", "y", "q2"), (1, "a", "x", None), (None, "a", "x", "q1"), (None, "a", "x", "q3"), (None, "a", "y", "q2")]
    df = spark.createDataFrame([(*r, "Q", "revenue", 10.0) for r in shown], "entity int, axis string, member string, period string, kind string, concept string, val double")
    assert [(r.entity, r.axis, r.n, r.amount) for r in segment_gaps._holes(df).collect()] == [(1, "a", 1, 10.0)]
