"""Approximate nearest neighbours against brute force."""

import numpy as np

from quillstone.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((-float((v * w).sum()), j) for j, w in good if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(400)]
    rows += [(400 + k, [1.0] * 8) for k in range(60)]  # ties
    rows += [(1000, None), (1005, [0.0] * 8), (1010, [1.0, None] + [1.0] * 6), (1015, [float("nan")] + [1.0] * 7), (1020, [1.0] * 3), (None, [1.0] * 8)]
    got = {}
    for r in neighbours.nearest(frame(spark, rows), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(rows, 5, 20)
    assert set(got) == set(want)
    found = sum(len({j for j, _ in want[q]} & {v[0] for v in got[q].values()}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    for q, ranks in got.items():
        listed = [ranks[k] for k in sorted(ranks)]
        assert sorted(ranks) == list(range(1, 21)) and listed == sorted(listed, key=lambda x: (-x[1], x[0])) and q not in {v[0] for v in listed}
    assert [j for j, _ in (got[400][k] for k in range(1, 21))] == [j for j, _ in want[400]]


def test_few_and_none(spark):
    got = neighbours.nearest(frame(spark, [(0, [1.0] * 8), (1, [0.5] * 8), (2, [1.0] * 8)]), 2).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(0, 1, 2), (0, 2, 1), (2, 1, 0), (2, 2, 1)}
    assert neighbours.nearest(frame(spark, []), 2).count() == 0
    assert neighbours.nearest(frame(spark, [(1, [1.0] * 8)]), 2).count() == 0


def test_pigeonhole_limits():
    rng = np.random.default_rng(2)
    for radius in (0, 3, 10, 101):
        limits = neighbours.thresholds(radius)
        for _ in range(200):
            parts = rng.multinomial(radius, [0.25] * 4)
            assert any(d <= t for d, t in zip(parts, limits, strict=True))
