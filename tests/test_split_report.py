"""The census report of splits: twelve cells with their roll-up, exact quantiles by counting."""

import random

from pyspark.sql import functions as F

from quillstone.operators import splits

CELLS = "entity int, confirmed boolean, cell string, dev double"


def test_order_statistics_are_exact(spark):
    rng = random.Random(3)
    values = {"many": [rng.choice([rng.random() * 0.08, 0.02, 0.0]) for _ in range(501)], "one": [0.07], "ties": [0.01] * 40, "two": [0.0, 0.05], "near": [0.03 + k * 1e-9 for k in range(100)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("many", None), ("none", None)]
    rng.shuffle(rows)
    got = {r.k: r for r in splits.order_statistics(spark.createDataFrame(rows, "k string, v double"), "k", "v", splits.QUANTILES).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, q in splits.QUANTILES.items():
            assert got[k][name] == sorted(vs)[min(len(vs) - 1, int(q * len(vs)))], (k, name)


def test_report(spark):
    rows = [(1, True, "both", 0.01), (1, True, "both", 0.03), (2, True, "both", 0.05), (2, False, "both", None), (3, True, "exact", 0.0), (3, True, "denied", 0.02), (4, False, "denied", None)]
    rows += [(5, True, "not covered", 0.0), (5, False, "not covered", None), (6, None, "no exchange data", None), (7, True, "exchange", None), (7, True, "unfiled", None), (8, True, "repeat", 0.0), (8, False, "repeat", None)]
    got = {(r.outcome, r.code): r for r in splits.report(spark.createDataFrame(rows, CELLS)).collect()}
    assert len(got) == 17
    assert {c: r.n_events for (_, c), r in got.items() if c} == {"A1": 3, "A2a": 1, "A2b": 1, "A3": 1, "A4": 0, "B1": 1, "B2": 1, "B3": 1, "B4": 1, "C1": 2, "D1": 1, "D2": 1}
    assert {o: (r.n_events, r.n_entities) for (o, c), r in got.items() if c is None} == {"kept": (8, 5), "dropped": (2, 2), "added": (2, 1), "merged": (2, 1), None: (14, 8)}
    a1 = got["kept", "A1"]
    assert (a1.n_entities, a1.over_2, a1.over_4, a1.median_dev, a1.p90_dev) == (2, 2, 1, 0.03, 0.05) and got["kept", "B1"].median_dev is None and got["kept", None].median_dev is None


def test_empty_report(spark):
    got = splits.report(spark.createDataFrame([], CELLS))
    assert got.count() == 17 and got.agg(F.sum("n_events")).first()[0] == 0
