"""The corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import hmm, langid, neardup, packing, quality, sentencepieces, syncmers, tokenstore, toxicity
from quillstone.llm.common import least_hashed, remainder
from quillstone.llm.encoding import PieceEncoder
from quillstone.llm.words import words_of

WORDS = [a + b for a in ("ba", "no", "ti", "re", "lo", "mun") for b in ("ra", "ne", "sti", "gon", "l", "der")]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    """Documents with columns whose names operators add themselves."""
    rows = [(i, t, None, None, 0, 9.5, "x") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, part string").repartition(3)


ODD = [(1, None), (2, ""), (3, "   "), (4, "one"), (5, text(5, 40)), (6, text(5, 40)), (7, text(7, 6000)), (7, text(7, 6000)), (None, "no id"), (9, "Ünï 日本 🦊\x00 <s> ~ </w>"), (10, "A\n\n\tb  c   d ~~ ")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_packing(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs(spark, rows), path).collect()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    want = {}
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append(ids)
    for i, lists in want.items():
        pieces = [r for r in got if r.doc_id == i]
        assert sum(r.length for r in pieces) == sum(map(len, lists))
        for r in pieces:
            part = lists[0][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(lists[0])
    for _, run in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in run:
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing_plan_is_best_fit():
    r = random.Random(1)
    counts = {n: r.randrange(5) for n in range(1, 65)}
    rows = packing.plan(counts, 64)
    used = {}
    for length, _, number, first, offset in rows.tolist():
        for k in range(number):
            used.setdefault(first + k, []).append((offset, length))
    assert sum(r[2] for r in rows.tolist()) == sum(counts.values())
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    plain = []  # capacities, by the textbook
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [c for c in plain if c >= length]
        if fits:
            plain.remove(min(fits))
        plain.append((min(fits) if fits else 64) - length)
    assert len(used) == len(plain)


@pytest.mark.parametrize("rows", [ODD, []])
def test_token_store(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokenstore.store_and_read(docs(spark, rows), path).orderBy("start").collect()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    start = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0])), strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_store_finds_damage(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    store = f"file://{tmp_path}/s"
    tokenstore.write_store(docs(spark, ODD), store, path)
    chunks = spark.read.parquet(f"{store}/chunks")
    chunks.withColumn("digest", F.substring(F.concat(F.lit(b"\0"), "digest"), 1, 16)).write.parquet(f"{store}/broken")
    (tmp_path / "s/chunks").rename(tmp_path / "s/old")
    (tmp_path / "s/broken").rename(tmp_path / "s/chunks")
    with pytest.raises(Exception, match="does not hold"):
        tokenstore.read_digests(spark, store).collect()


def test_token_store_files_are_in_order(spark, tmp_path, monkeypatch):
    path, store = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/s"
    monkeypatch.setattr(tokenstore, "PAGE", 4)
    rows = [((7 * k) % 100, text(k, 20)) for k in range(100)] + [(None, "a"), (50, "b"), (50, "c")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        tokenstore.write_store(docs(spark, rows), store, path)
        files = sorted((tmp_path / "s/recipes").glob("*.parquet"))
        read = [(r["part"], r["doc_id"], r["before"], r["n_tokens"]) for f in files for r in pq.read_table(f).to_pylist()]
        assert len(files) > 4 and [i for _, i, _, _ in read] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
        assert [p for p, _, _, _ in read] == sorted(p for p, _, _, _ in read)
        at = 0
        got = {r.start: r for r in tokenstore.read_ids(spark, store).collect()}
        plain = Tokenizer.from_file(path)
        for _, i, _, n in read:
            assert got[at].doc_id == i and len(got[at].ids) == n
            assert plain.decode(got[at].ids[:-1]) in [t for k, t in rows if k == i]
            at += n
        assert len(got) == len(rows) and len(tokenstore.check_manifest(spark, store)) == 32
        # a lost recipe, and a recipe that another takes the place of, are noticed
        first = spark.read.parquet(f"{store}/recipes")
        first.where("doc_id is null or doc_id <> 42").write.parquet(f"{store}/less")
        (tmp_path / "s/recipes").rename(tmp_path / "s/kept")
        (tmp_path / "s/less").rename(tmp_path / "s/recipes")
        with pytest.raises(ValueError, match="manifest"):
            tokenstore.read_digests(spark, store)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(("name", "spaced", "end"), [("word_bpe_49k.json", False, 1), ("byte_bpe_50k.json", True, 0)])
def test_piece_encoder(name, spaced, end):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = [t or "" for _, t in ODD] + ["  lead", "trail  ", "a b  c", "x" * 300, "don't stop ~ here", "\n \n", " \t "]
    ids, ends = PieceEncoder(path, spaced, end).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == [*plain.encode(t, add_special_tokens=False).ids, end]


def shingles(t):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def edited(t, seed, share):
    r = random.Random(seed)
    return " ".join("zz" + str(r.randrange(10**6)) if r.random() < share else w for w in t.split(" "))


def near_rows():
    rows = [(100 + k, edited(text(1, 150), k, 0.004 * (k % 12))) for k in range(60)]
    rows += [(200 + k, text(2, 80) + " " + text(50 + k, 60)) for k in range(40)]  # a common passage
    rows += [(300 + k, text(3, 30)) for k in range(25)]
    return rows + ODD


def test_near_duplicates_against_all_pairs(spark):
    rows = near_rows()
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

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
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    want = sorted((str(i), len(sets[k]), str(least.get(top(k)))) for k, (i, _) in enumerate(rows))
    got = neardup.near_duplicates(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id if r.component_id is not None else True) for r in got)
    kept = neardup.deduplicated(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert kept.count() == len({(r.doc_id) for r in got if r.kept})


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_sequential_test_bounds():
    steps = neardup.least_matches()
    assert [n for n, _ in steps] == list(range(16, 145, 16)) and all(0 < m < 0.75 * n for n, m in steps[1:])


@pytest.mark.parametrize("rows", [ODD, []])
def test_fingerprints(spark, rows):
    got = syncmers.fingerprints(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    if rows:
        assert by_id[6].near_next == 1.0  # the next one is its copy
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.fingerprint for r in got)
        assert by_id[1].n_chars == 0 and by_id[9].n_chars == len(dict(ODD)[9])


def test_edited_texts(spark):
    rows = [(k, text(k, 30 + 7 * k)) for k in range(1, 12)]
    got = {r.doc_id: r for r in syncmers.fingerprints(docs(spark, rows)).collect()}
    for k, t in rows:
        other = dict(rows)[k - 1 if k > 1 else 11]
        half = len(t) // 2
        assert got[k].edited_sha256 == hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest()
        assert got[k].near_edited > got[k].near_next


def test_anchors_do_not_depend_on_context(spark):
    inner = text(1, 60)
    df = spark.createDataFrame([(inner, text(2, 9) + " " + inner)], "a string, b string").select(syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b"))
    a, b = df.first()
    assert {(x.pos + 9, x.hash) for x in a} <= {(x.pos, x.hash) for x in b} and a


def test_words_do_not_depend_on_a_single_space(spark):
    r = random.Random(8)
    ws = text(3, 80).split()
    joined = [s.join(ws) for s in (" ", "\t", "\n", "\u3000", " \r\n ")]
    read = [row[0] for row in spark.createDataFrame([(t,) for t in joined], "t string").select(syncmers.words(F.col("t"))).collect()]
    assert len(read[0]) == 80 and all(x == read[0] for x in read)
    han, latin = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(900)), "".join(r.choice("abcdefgh") for _ in range(600))
    odd = ["", "   ", "a" * 32, "a" * 33, "🦊" * 33 + " b", "ab漢字cd e"]
    sizes = [row[0] for row in spark.createDataFrame([(t,) for t in odd], "t string").select(F.size(syncmers.words(F.col("t")))).collect()]
    assert sizes == [1, 1, 1, 33, 34, 5]
    # a space or two, or spaced words in the last half, leave the common half recognised
    rows = [(6, han[:600]), (5, han[:300] + " " + han[600:]), (4, text(4, 90)), (3, latin[:400]), (2, latin[:200] + " " + latin[400:]), (1, text(5, 60))]
    got = {row.doc_id: row for row in syncmers.fingerprints(docs(spark, rows)).collect()}
    assert got[6].near_next > 0.15 and got[3].near_next > 0.15
    assert all(got[k].near_edited > 0.15 for k in (5, 2))


def plain_words(t):
    """Words of a text without scripts that are written without spaces."""
    out = []
    for run in re.split(r"\s+", t):
        out += [run] if 0 < len(run) <= syncmers.LONGEST else list(run)
    return out or [t]


def spark_hash(t):
    return int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))


def plain_anchors(t):
    """(place, hash) of the chosen k-mers, by the definition of closed syncmers."""
    def of_longs(a, b):
        return int(np.uint64(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42))).astype(np.int64))

    w = [spark_hash(x) for x in plain_words(t)]
    out = []
    for k in range(len(w) - syncmers.K + 1):
        inner = [of_longs(w[k + i], w[k + i + 1]) for i in range(syncmers.K - syncmers.S + 1)]
        if min(inner[0], inner[-1]) <= min(inner):
            out.append((k, of_longs(inner[0], inner[2])))
    if not out:
        joined = spark_hash(" ".join(map(str, w)))
        return {joined}, {(0, joined)}
    return {h for _, h in out}, set(out)


def plain_likeness(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("range_bytes", [1 << 24, 700])
def test_fingerprints_against_plain_version(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(syncmers, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(syncmers, "STRETCH", 16)
    rows = [(3 * k, text(k % 9, 5 + 3 * (k % 20))) for k in range(60)] + [(1, None), (4, ""), (7, "one"), (8, "two  words"), (None, text(70, 40)), (None, "")]
    rows += [(31, text(100 + k, 30)) for k in range(40)]  # an id with a third of all rows
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), spark_hash(r[1] or "")))
    got = sorted(syncmers.fingerprints(docs(spark, rows)).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.fingerprint, r.edited_fingerprint))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        (own, placed), (new, new_placed), (other, _) = map(plain_anchors, (t, changed, after))
        shown = ["".join(f"{h:08x}" for h in sorted({h % 2**64 >> 32 for h in x})[: syncmers.SIZE]) for x in (own, new)]
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), *shown, *(round(x, 12) for x in (plain_likeness(own, new), plain_likeness(own, other), plain_likeness(placed, new_placed)))))
    want.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[3], r[4]))
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12), round(r.placed_edited, 12)) for r in got] == want


def test_passages(spark):
    shared = text(1, 60)
    rows = [(1, 2, text(2, 30) + " " + shared + " " + text(3, 20), text(4, 50) + " " + shared), (1, 3, text(2, 30), text(5, 30))]
    got = syncmers.passages(spark.createDataFrame(rows, "a long, b long, text_a string, text_b string"), 10).collect()
    assert [(r.a, r.b, r.shift) for r in got] == [(1, 2, 20)] and got[0]["first"] >= 28 and got[0].last <= 30 + 60 and got[0].n > 25


def test_likeness_is_of_all_anchors(spark):
    r = random.Random(9)
    common = [f"c{k}" for k in range(60)]
    rows = [(k, " ".join([f"{k}w{r.randrange(10**6)}" for _ in range(5000)] + common + [f"{k}w{r.randrange(10**6)}" for _ in range(4000)])) for k in (2, 1)]
    got = {row.doc_id: row for row in syncmers.fingerprints(docs(spark, rows)).collect()}
    found = spark.createDataFrame(rows, "doc_id long, text string").select(syncmers.anchors(F.col("text")).alias("a")).collect()
    a, b = ({x.hash for x in row.a} for row in found)
    assert len(a & b) > 20 and np.isclose(got[2].near_next, len(a & b) / len(a | b), rtol=0, atol=1e-12)
    assert len(got[2].fingerprint) == 8 * syncmers.SIZE
    # texts of which no k-mer is chosen are alike only if they are equal
    short = [(k, text(k, 4)) for k in range(20, 60)]
    got = syncmers.fingerprints(docs(spark, short)).collect()
    assert all(row.fingerprint and row.near_next < 1 for row in got) and len({row.fingerprint for row in got}) == 40


def test_hidden_markov_against_all_paths(monkeypatch):
    rng = np.random.default_rng(0)
    share = rng.dirichlet(np.ones(12))
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(12), 3).T)
    sequences = [rng.integers(0, 12, n) for n in (1, 4, 6, 4, 2)]
    ratios = model.ratios(share, np.float64)
    logs, counts = [], np.zeros((16, 3))
    for x in sequences:
        total, own = 0.0, np.zeros((16, 3))
        for path in itertools.product(range(3), repeat=len(x)):
            weight = model.start[path[0]] * ratios[x[0], path[0]]
            for a, b, c in zip(path, path[1:], x[1:], strict=False):
                weight *= model.move[a, b] * ratios[c, b]
            total += weight
            for c, s in zip(x, path, strict=True):
                own[c, s] += weight
            for a, b in zip(path, path[1:], strict=False):
                own[12 + a, b] += weight
            own[-1, path[0]] += weight
        logs.append(np.log10(total))
        counts += own / total
    assert np.allclose(hmm.Steps(sequences).log10(model, ratios), logs)
    assert np.allclose(hmm.counted(hmm.Steps(sequences), model, ratios), counts)
    monkeypatch.setattr(hmm, "BLOCK", 2)  # values at the beginnings of spans, the others computed again
    steps = hmm.Steps(sequences)
    assert len(steps.spans()) > 2 and np.allclose(hmm.counted(steps, model, ratios), counts)


def test_hidden_markov_scores(spark):
    rows = ODD + [(k, text(k, 50)) for k in range(20, 90)]
    got = hmm.score(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    counts = {}
    tokens = []
    for i, t in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\v\f\r":
            words = words.replace(c, " ")
        own = [w for w in words.split(" ") if w] + [None]
        tokens.append(own)
        if zlib.crc32(str(i).encode()) % 10 and i is not None:
            for w in own:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(x), sum(w in counts for w in x), round(sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in x), 6)) for (i, _), x in zip(rows, tokens, strict=True))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert hmm.score(docs(spark, [])).count() == 0


def test_hidden_markov_starts_from_all_texts(spark, monkeypatch):
    """No sample: the first model sees every training token."""
    df, begin, seen = docs(spark, [(k, f"w{k % 40} x{k % 7} y{k % 3} " * 400) for k in range(1_300)]), hmm.begin, []

    def spied(share, training):
        sequences = [np.frombuffer(x.classes, "<u2") for x in training.select("classes").collect()]
        sums, model = hmm.contexts(training, len(share)), begin(share, training)
        assert np.array_equal(sums, hmm._contexts_of(sequences, hmm._signs(len(share))))
        assert np.allclose(model.emit, begin(share, sequences).emit)
        seen.append((len(sequences), int(sums[:, -1].sum())))
        return model

    monkeypatch.setattr(hmm, "begin", spied)
    rows = hmm.score(df).collect()
    trained = sum(not r.held_out for r in rows)
    assert seen == [(trained, rows[0].train_tokens)] and seen[0] == (trained, trained * 1_201)


def test_hidden_markov_learns_every_token(spark, monkeypatch):
    """Probabilities of all training tokens and an unknown one add up to 1 in each state, rare tokens joined; scores against a plain recursion."""
    monkeypatch.setattr(hmm, "FREQUENT", 30)
    monkeypatch.setattr(hmm, "OWN", 10)
    r = random.Random(4)
    rows = [(k, " ".join((f"a{r.randrange(60)}" if k % 2 else f"b{r.randrange(60)}") for _ in range(80))) for k in range(60)] + [(100, "never seen"), (101, "a1 a2 never a3")]
    df = docs(spark, rows)
    source = df.select("doc_id", "text", (remainder("doc_id", 10) == 0).alias("held_out"))
    counts = hmm.count_tokens(source.where("not held_out"))
    known = hmm.vocabulary(counts)
    encoded = hmm.encode(source, known)
    training = encoded.where("not held_out")
    model = hmm.begin(known.share, [np.frombuffer(x.classes, "<u2") for x in training.select("classes").collect()])
    profiles = hmm.token_profiles(training, known, model)
    learnt = hmm.emissions(profiles, known)
    table = {x.token: x for x in profiles.collect()}
    assert {t: x.c for t, x in table.items()} == {x.token: x.c for x in counts.collect()} and len(table) > 100 > len(known.tokens)
    c, bucket, profile = (np.array([getattr(x, n) for x in table.values()]) for n in ("c", "bucket", "profile"))
    ratios = learnt.ratios(c.astype(float), bucket, profile)
    base = (c + hmm.ADDED) / known.total
    assert np.allclose(base @ ratios + hmm.ADDED / known.total * learnt.unknown, 1)
    by_token = dict(zip(table, ratios, strict=True))
    whole = hmm._scored(encoded.withColumn("met", F.expr("cast(array() as array<struct<place:int,c:bigint,bucket:int,profile:bigint>>)")).withColumn("rare", F.size("rare").cast("long")), model, learnt)
    assert whole.count() == len(rows)
    monkeypatch.setattr(hmm, "ROUNDS", 0)
    monkeypatch.setattr(hmm, "begin", lambda *_: model)
    got = {x.doc_id: x for x in hmm.score(df).collect()}
    for i, t in rows:
        hashes = hmm.tokens_of(pa.array([t]))[0].view(np.int64).tolist()
        now = model.start * by_token.get(hashes[0], learnt.unknown)
        for h in hashes[1:]:
            now = now @ model.move * by_token.get(h, learnt.unknown)
        assert np.isclose(got[i].score - got[i].base_score, np.log10(now.sum()))
    held = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_lookup():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    found = hmm.Lookup(keys, 12)
    assert (found(keys) == np.arange(5000)).all() and (found(keys + np.uint64(1)) == -1).all()


@pytest.mark.parametrize("rows", [ODD, []])
def test_sentencepiece(spark, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = sentencepieces.encode(docs(spark, rows), path, with_ids=True)
    assert all(r.parity and r.round_trip for r in got.collect()) and got.count() == len(rows)
    back = {r.doc_id: r.text for r in sentencepieces.decode(got, path).collect()}
    assert all(back[i] == (t or "") for i, t in rows)


def test_unigram_model(tmp_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor

    model = pb.ModelProto()
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("ab", -4.0, 1), ("▁a", -3.5, 1), ("▁ab", -3.9, 1), ("ba", -5.0, 1)]
    pieces += [(f"<0x{k:02X}>", -9.0, 6) for k in range(256)]
    for piece, score, kind in pieces:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", True
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    own, other = sentencepieces.Backend(str(path)), SentencePieceProcessor(model_file=str(path))
    texts = ["ab ab", "  abba  ba ", "", "aéb", "bbb aab"]
    ids, ends, parity = own.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == other.encode(t)
    assert parity.all()


def test_sentencepiece_of_whole_texts(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, other = sentencepieces.Backend(path), SentencePieceProcessor(model_file=path)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + [t or "" for _, t in ODD]
    ids, ends, parity = own.encode(pa.array(texts))
    assert parity.all()
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == other.encode(t)
    assert own.decode(ids, ends) == [t.replace("▁", " ") for t in texts]
    assert own.decode(np.array([1, *other.encode("a b"), 2]), np.array([0, 2 + len(other.encode("a b"))])) == ["a b"]
    # ids stay the backend's own where the libraries differ
    own._forget()
    own.other = SentencePieceProcessor(model_file=path)
    own.other.encode = lambda texts, **_: [[0] for _ in texts]
    again, _, wrong = own.encode(pa.array(texts))
    assert (again == ids).all() and not wrong[[len(t) > 0 for t in texts]].any()


def labelled(spark):
    rows, marks = [], []
    for k in range(300):
        good, bad = k % 3 > 0, k % 5 == 0
        t = text(k, 60) if good else "##" + " $$ ".join(text(k, 3) for _ in range(15))
        rows.append((k, t + (" vile slur vile curse" if bad else "")))
        marks.append((k, int(good), int(bad)))
    marks += [(0, None, None), (None, 1, 1), (10**6, 1, 0)]
    return docs(spark, rows + ODD), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), rows


def test_quality(spark):
    table, labels, rows = labelled(spark)
    got = quality.classify(table, labels).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 11 and r.doc_id < 300]
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.95
    empty = labels.where("false")
    assert {r.score for r in quality.classify(table, empty).collect()} == {0.5}
    assert quality.classify(table.where("false"), labels).count() == 0


def test_toxicity(spark):
    table, labels, rows = labelled(spark)
    got = [r for r in toxicity.classify(table, labels).collect() if r.doc_id is not None and 11 <= r.doc_id < 300]
    assert np.mean([r.toxic == (r.doc_id % 5 == 0) for r in got if r.held_out]) > 0.95
    assert {r.toxic for r in toxicity.classify(table, labels.where("false")).collect()} == {0}


def test_classifiers_against_plain_versions(spark):
    """Scores of the fitted models, word by word."""
    table, labels, _ = labelled(spark)
    drawn = quality.sample(table, labels, "quality")
    model, texts = quality.fit(drawn), [t or "" for _, t in ODD] + [text(k, 40) for k in range(5)] + ["## $$ " + text(1, 5)]
    number = {int(h): k for k, h in enumerate(model.vocabulary)}
    for t, got in zip(texts, model.scores(pa.array(texts)), strict=True):
        found = words_of(pa.array([t]))
        hashes, shapes = found.hashes().tolist(), found.shapes().tolist()
        mean = lambda rows, width: np.mean(rows, axis=0) if len(rows) else np.zeros(width)
        same = [[float(k >= lag and hashes[k] == hashes[k - lag]) for lag in range(1, quality.LAGS + 1)] for k in range(len(hashes))]
        x = np.concatenate([mean([model.words[number.get(h, len(number))] for h in hashes], quality.DIM), mean([model.shapes[s] for s in shapes], quality.DIM), mean(same, quality.LAGS), [np.log1p(len(hashes))]])
        w1, b1, w2, b2 = model.weights
        logit = np.tanh((x - model.mean) / model.scale @ w1 + b1) @ w2 + b2[0]
        assert np.isclose(got, 1 / (1 + np.exp(-np.clip(logit / model.temperature, -60, 60))), atol=1e-6)
    chain = toxicity.fit(quality.sample(table, labels, "toxic"))
    texts.append("vile slur vile curse " + text(2, 10))
    for t, got in zip(texts, chain.probabilities(pa.array(texts)), strict=True):
        held = set(toxicity.occurrences(pa.array([t]))[0].tolist())
        x = [float(int(h) in held) for h in chain.features]
        for k, w in enumerate(chain.weights):
            p = 1 / (1 + np.exp(-np.clip(np.dot(x, w[:-1]) + w[-1], -40, 40)))
            assert np.isclose(got[k], p, atol=1e-4)
            x.append(p)
    assert chain.lexicon.any() and got[-1] > 0.3


def test_features_of_a_fold_do_not_see_its_labels(spark):
    """With labels of one fold turned round, the features chosen without it stay."""
    table, labels, _ = labelled(spark)
    drawn = quality.sample(table, labels, "toxic").withColumn("fold", toxicity.fold_of(F.col("doc_id")))
    turned = drawn.withColumn("label", F.when(F.col("fold") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    shares = dict.fromkeys((-1, *range(toxicity.FOLDS)), 0.2)
    a, b = (toxicity._chosen(toxicity._counts(df), shares, 1) for df in (drawn, turned))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[1].any()
    c = toxicity._chosen(toxicity._counts(turned), shares, None)
    assert len(c[0]) != len(a[0]) or (c[0] != a[0]).any() or (c[1] != a[1]).any()


def test_toxicity_of_nothing(spark):
    table, labels, _ = labelled(spark)
    assert toxicity.classify(table.where("false"), labels).count() == 0
    assert {r.toxic for r in toxicity.classify(docs(spark, [(1, None), (2, "")]), spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")).collect()} == {0}


def test_classifiers_learn_from_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 60)
    rows, marks = [], []
    for k in range(100):
        good, bad = k % 3 > 0, k % 4 == 0
        t = text(k, 3000) if good else "## $$ " + " $$ ".join(text(k, 3) for _ in range(800))
        rows.append((k, t + (" vile slur vile curse" if bad else "")))
        marks.append((k, int(good), int(bad)))
    assert min(len(t) for _, t in rows) > 12_000
    marks += [(10**6 + k, 1, 0) for k in range(2000)]  # labels without a document take no place in the sample
    table, labels = docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert quality.sample(table, labels, "quality").count() == 60
    got = quality.classify(table, labels).collect()
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in got]) > 0.95
    got = toxicity.classify(table, labels).collect()
    assert np.mean([r.toxic == (r.doc_id % 4 == 0) for r in got]) > 0.95


def test_language(spark):
    r = random.Random(3)
    kinds = {"aa": ["the", "of", "and", "weather", "house"], "bb": ["der", "und", "nicht", "wetter", "haus"]}
    rows = [(k, " ".join(r.choice(kinds[lang]) for _ in range(40)), lang) for k in range(120) for lang in [("aa", "bb")[k % 2]]]
    rows += [(600 + k, " ".join(r.choice(kinds[lang]) for _ in range(20_000)), lang) for k in range(2) for lang in [("aa", "bb")[k % 2]]]  # very long
    rows += rows[:5]
    odd = [(500, None, "aa"), (501, "", "bb"), (502, "123 ...", "aa"), (503, "the house", None), (None, "und nicht", "bb")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {row.doc_id: row for row in langid.identify(df).collect()}
    assert np.mean([got[k].lang_pred == lang for k, _, lang in rows]) > 0.98
    assert [got[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and [got[k].score for k in (500, 501)] == [0.0, 0.0]
    # plain compression with the same dictionaries, and the dictionaries by hand
    import zstandard

    known = df.select("doc_id", "lang", langid.letters(F.col("text")).alias("words"), (remainder("doc_id", 3) == 1).alias("held_out"))
    learned = langid.dictionaries(known.where("not held_out").select("words", "lang"))
    least = {}
    for row in known.where("not held_out").collect():
        for k in range(0, len(row.words or ""), langid.PASSAGE) if row.lang else ():
            passage = row.words[k : k + langid.PASSAGE]
            h = np.uint64(xxhash.xxh64_intdigest(passage.encode(), 42)).astype(np.int64)
            at = (row.lang, int(h % langid.SAMPLES))
            least[at] = min(least.get(at, (h, passage)), (h, passage))
    assert learned == {lang: "\n".join(least[at][1] for at in sorted(least) if at[0] == lang).encode() for lang in ("aa", "bb")}
    for row in known.collect():
        if row.words:
            sizes = {lang: len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(row.words.encode())) for lang, content in learned.items()}
            assert got[row.doc_id].lang_pred == min(sorted(sizes), key=sizes.get) and 0 < got[row.doc_id].score <= 1
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {row.lang_pred for row in none.collect()} == {"und"}
    assert langid.identify(df.where("false")).count() == 0


def test_least_hashed(spark):
    df = spark.range(5000)
    got = {r.id for r in least_hashed(df, "id", 7, "id").collect()}
    assert got == {r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(7).collect()}
