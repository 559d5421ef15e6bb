"""Every registered query of the engine against its SQL, on the smallest tables."""

import datetime
import math
import os
from decimal import Decimal

import duckdb
import pytest

from quillstone.plans import catalog  # noqa: F401
from quillstone.plans.registry import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM '{SMALL}/{f}'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.7g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(str(plain(r[k])) for k in order) for r in values))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    relation = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    assert rows(df.columns, got) == rows(relation.columns, relation.fetchall())
