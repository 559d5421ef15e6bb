"""Bulk archives as a data source; tags against concepts, kin tags, what rules reach, coverage sweeps."""

import datetime
import math
import random
import zipfile

import pytest

from quillstone.operators import audits, evidence
from quillstone.sources import filings, zips

NUM = "adsh\ttag\tversion\tddate\tqtrs\tuom\tsegments\tcoreg\tvalue"


def archives(folder):
    """Two quarters, with short lines, an empty member and text beyond ASCII."""
    r = random.Random(7)
    paths = []
    for q in (1, 2):
        lines = [f"{q}-{k}\tTag{r.randrange(9)}{'é' * (k % 3)}\tus-gaap/2024\t20240331\t{r.randrange(5)}\tUSD\t{'Seg' if k % 7 == 0 else ''}\t\t{k / 4 if k % 5 else 'x'}" for k in range(500)]
        lines[3], lines[100] = "cut\tshort", ""
        path = folder / f"2024q{q}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("num.txt", "\n".join([NUM, *lines]) + "\n" * (q == 1))
            z.writestr("sub.txt", "adsh\tcik\tname\tsic\tform\n" + "".join(f"{q}-{k}\t{k % 50}\tN\t1\t{'10-K' if k % 2 else '8-K'}\n" for k in range(500)))
            z.writestr("deep/pre.txt", "adsh\tstmt\ttag\tversion\tplabel\n" + "".join(f"{q}-{k}\tBS\t{t}\tus-gaap/2024\tL\n" for k in range(200) for t in ("Own", "Weak")[k % 2 :]))
        paths.append(str(path))
        plain = folder / f"plain{q}"
        plain.mkdir()
        with zipfile.ZipFile(path) as z:
            z.extract("num.txt", plain)
    return paths


@pytest.mark.parametrize("block", [100, 5_000, zips.BLOCK])
def test_archives_like_plain_files(spark, tmp_path, block):
    paths = archives(tmp_path)
    got = zips.bulk_zips(spark, paths, "num", block=block)
    want = [tuple(r) for q in (1, 2) for r in filings.bulk(spark, str(tmp_path / f"plain{q}" / "num.txt"), "num").collect()]
    assert sorted(map(str, (tuple(r)[1:] for r in got.collect()))) == sorted(map(str, want)) and len(want) == 996
    assert {r.archive: r["count"] for r in got.groupBy("archive").count().collect()} == {"2024q1.zip": 498, "2024q2.zip": 498}
    few = zips.bulk_zips(spark, [f"file://{paths[0]}"], "num", ["tag", "value"], block)
    assert few.columns == ["archive", "tag", "value"] and few.count() == 498


def test_scans_over_archives(spark, tmp_path):
    paths = archives(tmp_path)
    num, sub, pre = (zips.bulk_zips(spark, paths, k) for k in ("num", "sub", "pre"))
    direct = spark.createDataFrame([("Own", "c")], "tag string, concept string")
    weak = spark.createDataFrame([("Weak", "c")], "tag string, concept string")
    (row,) = zips.cooccurrence_scan(pre, sub, direct, weak).collect()
    assert (row.tag, row.n_both, row.n_alone, row.revoked) == ("Weak", 200, 200, True)
    known = spark.createDataFrame([("Tag0",)], "tag string")
    found = zips.tag_audit(num, sub.drop("archive"), known).collect()
    assert "Tag0" not in {r.tag for r in found} and [r.n_entities for r in found] == sorted((r.n_entities for r in found), reverse=True)
    assert zips.bulk_zips(spark, paths, "num").where("false").count() == 0


@pytest.mark.parametrize("least", [0.5, 3.0, 9.0])
def test_shared_weight_against_all_pairs(spark, least):
    r = random.Random(int(least * 10))
    words = [f"w{k}" for k in range(40)]
    concepts = {c: {w for w in words if r.random() < 6 / (3 + words.index(w))} for c in range(60)}
    tags = {t: {w for w in [*words, "unknown"] if r.random() < 5 / (4 + r.randrange(30))} for t in range(80)}
    df = {w: sum(w in s for s in concepts.values()) for w in words}
    idf = {w: math.log(60 / n) for w, n in df.items() if n}
    vocabulary = spark.createDataFrame([(c, w, idf[w]) for c, s in concepts.items() for w in s], "concept int, token string, idf double")
    asked = spark.createDataFrame([(t, w) for t, s in tags.items() for w in s] + [(0, next(iter(tags[0] or {"w0"})))], "tag int, token string")
    want = {(t, c): sum(idf[w] for w in a & b) for t, a in tags.items() for c, b in concepts.items()}
    got = {(x.tag, x.concept): x.score for x in audits.shared_weight(asked, vocabulary, least).collect()}
    sure = {k: s for k, s in want.items() if s >= least}
    assert got.keys() == sure.keys() and all(abs(got[k] - sure[k]) < 1e-9 for k in got) and (got or least > 8)
    assert {(x.tag, x.concept) for x in evidence.token_evidence(asked, vocabulary, least).collect()} == sure.keys()


def test_beginnings_meet_known_names(spark):
    tags = spark.createDataFrame([("DebtNoncurrentNet", 1), ("Debt", 2), ("", 3), (None, 4), ("XDebt", 5)], "tag string, n int")
    known = spark.createDataFrame([("Debt",), ("DebtNoncurrent",), ("DebtNoncurrentNet",), ("",)], "kin string")
    assert sorted((r.n, r.kin) for r in audits.begun_by(tags, known).collect()) == [(1, "Debt"), (1, "DebtNoncurrent")]
    plan = audits.begun_by(tags, known)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rules_reach_in_rounds_and_circles(spark):
    present = spark.createDataFrame([(1, "a"), (1, "b"), (1, "z"), (2, "a"), (2, "a"), (3, "q")], "entity int, concept string")
    rules = {"d": ["c"], "c": ["a", "b"], "e": ["f"], "f": ["e"], "g": ["d", "z"]}

    def reached(rounds):
        return sorted((r.entity, r.concept) for r in audits.derivable(present, rules, rounds).collect())

    base = [(1, "a"), (1, "b"), (1, "z"), (2, "a"), (3, "q")]
    assert reached(1) == sorted([*base, (1, "c")])
    assert reached(2) == sorted([*base, (1, "c"), (1, "d")])
    assert reached(4) == sorted([*base, (1, "c"), (1, "d"), (1, "g")])
    assert audits.derivable(present, rules, 4)._jdf.queryExecution().executedPlan().toString().count("ObjectHashAggregate") <= 4


def test_sweep(spark):
    day = datetime.date
    points = [(1, "Cash", None, day(2024, 12, 31), 5.0), (1, "Cash", None, day(2023, 12, 31), 4.0), (1, "CashAll", None, day(2025, 3, 31), 6.0), (1, "Sales", day(2024, 1, 1), day(2024, 12, 31), 1.0), (1, "Sales", day(2025, 1, 1), day(2025, 3, 31), 1.0), (1, "Costs", day(2024, 1, 1), day(2024, 12, 31), 1.0)]
    points += [(2, "SalesNetOfTax", day(2024, 1, 1), day(2024, 12, 31), 1.0), (2, "SalesEmpty", None, day(2024, 1, 1), None), (2, "OtherSales", None, day(2024, 1, 1), 1.0)]
    df = spark.createDataFrame(points, "entity int, tag string, start date, end date, val double")
    tags = spark.createDataFrame([("cash", "CashAndMore", 1), ("cash", "Cash", 2), ("cash", "CashAll", 3), ("sales", "Sales", 1), ("costs", "Costs", 1)], "concept string, tag string, place int")
    got = {(r.entity, r.concept): r for r in audits.coverage_sweep(df, tags, {"gross": ["sales", "costs"]}, {"debt": "cash"}).collect()}
    assert len(got) == 10
    cash, sales = got[1, "cash"], got[1, "sales"]
    assert (cash.state, cash.tag, cash.latest, cash.years, cash.kin) == ("hit", "Cash", day(2024, 12, 31), 2, []) and (sales.latest, sales.years) == (day(2025, 3, 31), 1)
    assert (got[1, "gross"].state, got[1, "debt"].state, got[2, "gross"].state, got[2, "debt"].state) == ("derived", "zeroed", "missing", "missing")
    assert (got[2, "sales"].state, got[2, "sales"].kin, got[2, "cash"].kin) == ("missing", ["SalesNetOfTax"], [])
