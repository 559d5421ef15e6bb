"""The pipeline: its stages against plain versions, and on odd rows."""

import itertools
import random
from pathlib import Path
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import packing, quality, toxicity
from quillstone.llm.common import shared_folder, table
from quillstone.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def plain_shingles(t):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_kept(rows):
    """doc_id kept of (doc_id, text): the least of each component of pairs with similarity of 0.75 or more."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return set(least.values())


def plain_sequences(lengths):
    """Number of windows of best-fit decreasing, full windows cut first."""
    pieces = sorted((n for total in lengths for n in [packing.WINDOW] * (total // packing.WINDOW) + [total % packing.WINDOW] if n), reverse=True)
    open_ = []
    for n in pieces:
        fits = [c for c in open_ if c >= n]
        if fits:
            open_.remove(min(fits))
        open_.append((min(fits) if fits else packing.WINDOW) - n)
    return len(open_)


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_against_plain_versions(spark):
    docs = table(spark, SMALL, "documents")
    scores = {r.doc_id: r.score for r in quality.classify(docs, table(spark, SMALL, "labels")).collect()}
    good = STAGES["quality"](spark, docs, SMALL)
    assert good.columns == docs.columns and ids(good) == {i for i, s in scores.items() if s >= 0.3}
    bad = {r.doc_id for r in toxicity.classify(docs, table(spark, SMALL, "labels")).where("toxic = 1").collect()}
    harmless = STAGES["toxicity"](spark, good, SMALL)
    assert harmless.columns == docs.columns and ids(harmless) == ids(good) - bad
    rows = [(r.doc_id, r.text) for r in harmless.collect()]
    distinct = STAGES["near_duplicates"](spark, harmless, SMALL)
    assert distinct.columns == docs.columns and ids(distinct) == plain_kept(rows)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    lengths = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows if i in ids(distinct)}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == lengths
    assert len({r.sequence_id for r in pieces}) == plain_sequences(lengths.values())


def odd(spark, rows):
    """Rows whose further columns have names that stages use themselves."""
    rows = [(i, t, k, "x", 1.5, None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int, score string, toxic double, `part.id` string").repartition(2)


ROWS = [(1, None), (2, ""), (3, "a b"), (4, "the same five words here " * 30), (5, "the same five words here " * 30), (5, "the same five words here " * 30), (None, "no id at all"), (7, "word " * 40_000)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_rows(spark, name):
    df = odd(spark, ROWS)
    got = STAGES[name](spark, df, SMALL)
    assert got.columns == df.columns and [f.dataType for f in got.schema] == [f.dataType for f in df.schema]
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert all(row in ROWS for row in kept)
    # equal texts have one fate, but for near-duplicates
    if name == "near_duplicates":
        assert sorted(str(i) for i, _ in kept) == sorted(map(str, (1, 2, 3, 4, None, 7)))
        again = STAGES[name](spark, df.orderBy(F.desc("label")), SMALL)
        assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    else:
        assert sum(i in (4, 5) for i, _ in kept) in (0, 3)
    assert STAGES[name](spark, df.where("false"), SMALL).count() == 0


def test_packing_of_odd_rows(spark):
    df = odd(spark, ROWS)
    got = STAGES["packing"](spark, df, SMALL).collect()
    assert {r.doc_id for r in got} == {i for i, _ in ROWS} and STAGES["packing"](spark, df.where("false"), SMALL).count() == 0
    assert sum(r.length for r in got if r.doc_id in (1, 2)) == 2


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]


def near(seed, n=200):
    r = random.Random(seed)
    words = [f"w{r.randrange(10_000)}" for _ in range(n)]
    return " ".join(words), " ".join([*words[:-1], "other"])


def test_one_row_of_each_component(spark):
    """Near-duplicates whose doc_ids are null or equal: one row stays, whatever the order."""
    (a, b), (c, d), (e, f) = near(1), near(2), near(3)
    rows = [(None, a), (None, b), (5, c), (5, d), (None, e), (9, f), (None, None), (None, None), (3, ""), (3, ""), (None, "")]
    df = odd(spark, rows)
    got = [(r.doc_id, r.text) for r in STAGES["near_duplicates"](spark, df, SMALL).collect()]
    assert len(got) == 6
    assert sum(t in (a, b) for _, t in got) == sum(t in (c, d) for _, t in got) == 1 and (9, f) in got and (None, e) not in got
    assert {(None, None), (3, ""), (None, "")} <= set(got)
    again = [(r.doc_id, r.text) for r in STAGES["near_duplicates"](spark, df.orderBy(F.desc("label")), SMALL).collect()]
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_hot_pivot(spark):
    """A passage that a third of all texts is made of: its bucket's pivot is in most pairs."""
    r = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join([*passage, f"x{k}"])) for k in range(1_500)] + [(5_000 + k, " ".join(f"w{r.randrange(900)}" for _ in range(30))) for k in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = ids(STAGES["near_duplicates"](spark, df, SMALL))
    assert kept == {0, *(i for i, _ in rows[1_500:])}


def test_many_shuffle_partitions_make_few_files(spark):
    """Tables out of a shuffle of many partitions are written as few files, with all their rows."""
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(5_000)}" for _ in range(60)) for _ in range(150)]
    df = spark.createDataFrame([(2 * k + copy, t + " end" * copy) for k, t in enumerate(texts) for copy in range(2)], "doc_id long, text string")
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = {*folder.iterdir()}
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        kept = STAGES["near_duplicates"](spark, df, SMALL)
        assert ids(kept) == set(range(0, 300, 2)) and kept.count() == 150
        files = {d.name.rpartition("-")[0]: len(list(d.glob("part-*"))) for d in {*folder.iterdir()} - before}
        assert {"classes", "buckets", "members", "texts", "links", "edges"} <= files.keys()
        assert max(files.values()) <= 16, files
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_packing_cuts_little_text_at_a_time(spark, monkeypatch):
    """Of a large Arrow batch two megabytes of text are encoded at once, and every text is."""
    taken, run = [], []

    class Docs:
        sparkSession = spark  # noqa: N815

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):  # noqa: N802
            run.append(f)
            raise StopIteration  # nothing is written

    def encode(texts):
        taken.append(pc.sum(pc.binary_length(texts)).as_py())
        return np.ones(len(texts), np.uint32), np.arange(len(texts) + 1)

    monkeypatch.setattr(packing, "encoder", lambda *_: SimpleNamespace(encode=encode))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    with pytest.raises(StopIteration):
        STAGES["packing"](spark, Docs(), SMALL)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3_000)), pa.array(["word " * 600] * 3_000)], names=["doc_id", "text"])
    got = [i for part in run[0]([batch]) for i in part.column("doc_id").to_pylist()]
    assert got == [*range(3_000)] and sum(taken) == 9_000_000 and max(taken) <= 2 << 20


def test_contexts_are_sums_of_index_vectors():
    r = np.random.default_rng(5)
    numbers, bounds, hashes = r.integers(0, 50, 4_000), np.array([0, 0, 1, 700, 703, 4_000]), r.integers(0, 1 << 64, 50, np.uint64)
    places, signs = quality.index_places(hashes)
    index = np.zeros((50, quality.DIM))
    for k in range(quality.NONZERO):
        np.add.at(index, (np.arange(50), places[:, k]), signs[:, k])
    want = np.zeros((50, quality.DIM))
    for a, b in itertools.pairwise(bounds.tolist()):
        for x in range(a, b):
            for y in range(max(a, x - quality.WINDOW), min(b, x + quality.WINDOW + 1)):
                if x != y:
                    want[numbers[x]] += index[numbers[y]]
    out = np.zeros((50, quality.DIM))
    quality._contexts(out, numbers, bounds, places, signs)
    assert np.abs(out - want).max() < 1e-6 and np.abs(want).max() > 10
