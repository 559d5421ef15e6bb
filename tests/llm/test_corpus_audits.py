"""Phrases, the filter audit and WARC archives: plain versions, odd rows, hot keys, damage."""

import itertools
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import filters, phrases, queries, warc
from quillstone.llm.common import heavy_join

SMALL = "/root/testdata/sf0.001"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def docs(spark, rows):
    """Documents of (doc_id, text, lang) with columns whose names the operators use themselves."""
    rows = [(i, t, g, 1, "x", 2.5, None) for i, t, g in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, mask int, part string, n double, words string").repartition(3)


def plain_phrases(rows, least, top):
    f, totals = defaultdict(Counter), Counter()
    for _, t, g in rows:
        g = "und" if g is None else g
        for piece in re.split("[.,;:!?\n\v\f\r]", lowered(t or "")):
            w = tuple(x for x in re.split("[ \t]", piece) if x)
            totals[g] += len(w)
            for s in range(1, 5):
                f[g].update(w[k : k + s] for k in range(len(w) - s + 1))
    out = []
    for g, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[x : x + len(p)] == p for x in range(len(q))) for q, b in often.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, x, y) in enumerate(sorted(found)[:top], 1):
            out.append((g, rank, p.decode(), -a, x, y, totals[g], -score))
    return sorted(out)


def phrase_rows():
    r = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "delta", "Éta", "x\x00y", "日本", "new york"]
    rows = [(k, " ".join(r.choice(words) + r.choice(["", "", "", ",", ".\n", "!"]) for _ in range(r.randrange(60))), r.choice(["en", "de", None])) for k in range(120)]
    rows += [(k, "one two three four five; one two three", "en") for k in range(200, 240)]  # copies
    return rows + [(1, None, None), (None, "", "en"), (5, "   \t ", "fr"), (6, "a " * 30_000, "en"), (6, "a " * 30_000, "en"), (7, "A B " * 60, "und")]


@pytest.mark.parametrize("bucket", [40, 400, phrases.BUCKET])
def test_phrases(spark, bucket):
    """With a small bucket most words are hot, so that prefixes of all lengths are dealt out."""
    rows = phrase_rows()
    got = phrases.collocations(docs(spark, rows), 10, 25, bucket)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 10, 25)


def test_phrases_of_no_rows(spark):
    assert phrases.collocations(docs(spark, [])).collect() == []
    assert phrases.collocations(docs(spark, [(1, None, None), (2, "a few words", None)])).collect() == []


def test_phrase_blocks_take_little_memory():
    """Two tasks of an executor find words and pointers side by side."""
    words = np.random.default_rng(1).integers(0, 20_000, (400, 4_000))
    texts = pa.array([" ".join(f"w{k}" for k in w) for w in words.tolist()])
    batch = pa.RecordBatch.from_arrays([texts, pa.array(["en"] * len(texts))], names=["text", "lang"])
    every, none = np.full(1 << 14, np.uint64(0xFFFFFFFFFFFFFFFF)), phrases.Hot(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)
    found = 0
    tracemalloc.start()
    for held in phrases._blocks(iter([batch]), phrases.BLOCK):
        found += sum(int(times.sum()) for *_, times in phrases.pointers(held, every, none, 400))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 400 * 3_999 and peak < 200 << 20, peak


def test_scores_beyond_64_bits(spark):
    """Counts whose products pass 64 bits."""
    a, b = 4_000_000_000_000_000_001, 4_500_000_000_000_000_003
    found = spark.createDataFrame([("en", [1, 2], a)], "lang string, words array<long>, a long")
    words = spark.createDataFrame([(1, "x", b), (2, "y", a)], "id long, word string, f long")
    (row,) = phrases._scored(found, words).collect()
    assert (row.l, row.r, row.score) == (b, a, 2_000_000 * a // (a + b))


def test_hash_clash_is_an_error(spark, monkeypatch):
    import numpy as np

    found = phrases.block_of
    import pyarrow as pa

    block = found(pa.array(["ab cd ab. ef", ""]), pa.array(["en", "de"]))
    assert [block.word(k) for k in range(4)] == ["ab", "cd", "ab", "ef"] and block.ids[0] == block.ids[2] and len(np.unique(block.ids)) == 3
    assert block.piece[2] != block.piece[3]


def test_heavy_join(spark):
    many = spark.range(40_000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), "id")
    one = spark.createDataFrame([(0, "a"), (3, "b"), (9, "c"), (None, "d")], "j long, what string")
    got = heavy_join(many, one, "k", "j", F.col("id")).groupBy("k", "what").count().collect()
    want = Counter((k, {0: "a", 3: "b"}[k]) for k in (i % 7 * (i % 2) for i in range(40_000)) if k in (0, 3))
    assert {(r.k, r.what): r["count"] for r in got} == want
    assert heavy_join(many, one, "k", "j", F.col("id"), "left").count() == 40_000


def plain_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    told = []
    for i, t, g in rows:
        t = t or ""
        w = [x for x in re.split("[ \t\n\v\f\r]", t) if x]
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t])
        told.append((g or "", dict(zip("ABCDE", fails, strict=True)), any(x == i is not None and q == 1 for x, q, _ in labels), any(x == i is not None and p == 1 for x, _, p in labels)))
    out = []
    for part in {t[0] for t in told}:
        own, shares, lines = [t for t in told if t[0] == part], Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [t for t in left if t[1][x]]
                left = [t for t in left if not t[1][x]]
                shares[x] += len(gone)
                failing = [t for t in own if t[1][x]]
                lines.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(sum(t[1].values()) == 1 for t in failing), sum(t[2] for t in gone), sum(t[3] for t in gone)))
        out += [(*x, shares[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def audit_rows():
    r = random.Random(4)

    def text(n, pool, end=""):
        return " ".join(r.choice(pool) for _ in range(n)) + end

    plain, loud = [f"word{k}" for k in range(3000)], [f"WORD{k}" for k in range(3000)]
    rows = [(k, text(r.choice([20, 99, 100, 140]), r.choice([plain, loud, plain[:30]]), r.choice(["", " #", " | x"])), r.choice(["en", "de", None, ""])) for k in range(60)]
    rows += [(k, rows[k % 4][1], "en") for k in range(100, 180)]  # copies, a group of which spans ranges
    return rows + [(1, None, None), (2, "", "en"), (3, "  ", "en"), (None, rows[0][1], "en"), (None, "only without id", "en"), (None, "only without id", "en"), (170, rows[1][1], "de"), (170, rows[1][1], "de"), (4, "long " * 50_000, "fr"), (5, "Ünï 日本\x00  ", None)]


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (100, 1, 1), (101, 1, 0), (150, 0, 1), (None, 1, 1), (9_999, 1, 1)]


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_filter_audit(spark, ranges):
    rows = audit_rows()
    labels = spark.createDataFrame([(*x, "y") for x in LABELS], "doc_id long, quality int, toxic int, part string")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = filters.audit(docs(spark, rows), labels)
        assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert sorted(map(tuple, got.collect())) == plain_audit(rows, LABELS)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_filter_audit_of_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(docs(spark, []), labels).collect() == []
    assert len(filters.audit(docs(spark, [(1, None, None)]), labels).collect()) == 600


PAGES = [(1, "http://b.a.org/x?q#top", "<p>same</p>"), (2, "https://b.a.org:443/x?q", "<p>same</p>"), (3, None, "<p>same</p>"), (None, "http://b.a.org/x?q", "<p>same</p>"), (4, "", None), (5, "http://c.org", ""), (5, "http://c.org", ""),
         (None, "x", "no id"), (None, "x", "no id"), (6, "http://u@[::1]:8080/a b", "Ünï 日本 \x00\r\n\r\nHTTP/1.1"), (7, "http://c.org/" + "long/" * 300, "z" * 2_000_000), (8, "HTTP://C.org", "<p>Same</p>"), (8, "http://c.org/2", "other")]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", 1, "p") for i, u, h in rows], "page_id long, url string, html string, key string, place int, payload string").repartition(3)


def plain_pages(rows, least=0):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [x for x, _, y in rows if (y or "") == (h or "") and x is not None]
        largest = max(same, default=None) if len(data) >= least else None
        again = largest is not None and (i is None or i < largest)
        out.append((i, len(data), warc.payload_digest(data), "revisit" if again else "response", largest if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "lines", "size"), [(0, 1, 1), (0, 1_024, 1 << 30), (12, 2, 700)])
def test_warc(spark, tmp_path, least, lines, size):
    path = f"file://{tmp_path}"
    warc.write_archives(pages(spark, PAGES), path, least, size, lines)
    found = warc.lookup(warc.keys_of(pages(spark, PAGES)), path)
    got = warc.read_captures(found, path, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain_pages(PAGES, least)
    stored = Counter(((r.page_id, r.payload.decode()) for r in got if r.record_type == "response"))
    want = Counter(((i, h or "") for (i, _, h) in PAGES if (i, len((h or "").encode()), warc.payload_digest((h or "").encode()), "response", None) in plain_pages(PAGES, least)))
    assert stored == want
    # an archive is a gzip file whose members are the records
    import gzip

    for f in (tmp_path / "archives").glob("*.warc.gz"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_lookup_of_some_urls(spark, tmp_path):
    path, rows = f"file://{tmp_path}", [(k, f"http://{'hot' if k % 3 else f'h{k}'}.example.org/{k % 50}", f"page {k}") for k in range(600)]
    warc.write_archives(pages(spark, rows), path, lines=5, part_captures=60)
    asked = [warc.surt(f"http://hot.example.org/{k}") for k in (1, 2)] + [warc.surt("http://h33.example.org/33"), "nowhere)/", "", "zzz)/", warc.surt("http://hot.example.org/1")]
    keys = spark.createDataFrame([(k,) for k in asked], "key string")
    got = warc.read_captures(warc.lookup(keys, path), path).collect()
    assert sorted(r.page_id for r in got) == sorted(k for k, u, _ in rows if warc.surt(u) in asked)
    assert spark.read.parquet(f"{path}/parts").count() > 1


def test_damage_is_found(spark, tmp_path):
    path = f"file://{tmp_path}"
    good = warc.record(1, "http://a.org/", b"payload", warc.payload_digest(b"payload"), None)
    assert warc.parsed(good)["payload"] == b"payload"
    for bad in (good.replace(b"payload\r\n\r\n", b"Payload\r\n\r\n"), good.replace(b"payload\r\n\r\n", b"payloads\r\n\r\n")):
        with pytest.raises(ValueError, match="stored|length"):
            warc.parsed(bad)
    warc.write_archives(pages(spark, PAGES), path)
    archive = max((tmp_path / "archives").glob("*.warc.gz"), key=lambda f: f.stat().st_size)
    data = bytearray(archive.read_bytes())
    data[len(data) // 2] ^= 0xFF
    archive.write_bytes(bytes(data))
    with pytest.raises(Exception, match="stored|length|decompress"):
        warc.read_captures(warc.lookup(warc.keys_of(pages(spark, PAGES)), path), path).collect()


def test_warc_of_no_rows(spark):
    assert warc.archive_and_read(pages(spark, [])).collect() == []


def test_surt():
    assert warc.surt("http://user:pw@www.Example.org:80/A?b#c") == "org,example,www)/A?b"
    assert warc.surt("https://example.org:8443") == "org,example:8443)/"
    assert warc.surt("//x.y/z") == "y,x)/z" and warc.surt(None) == ")" and warc.surt("mailto:a b") == ")mailto:a%20b"


@pytest.mark.parametrize("name", ["op11_phrases", "op12_filter_audit", "op13_warc"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = want.project(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str) and rows
