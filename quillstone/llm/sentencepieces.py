"""SentencePiece encoding and decoding with the tokenizers library.

The model file is parsed as protobuf wire format.  From it a Tokenizer is rebuilt: the normaliser (character map,
extra white space, dummy prefix), the metaspace marker, the model (unigram scores, or merges derived from the scores
of a BPE vocabulary) and byte fallback.  Control, unknown and byte pieces never match a text.

If no piece holds a metaspace marker behind another sign, no piece crosses the place before a marker.  Texts are then
cut there and each distinct word reaches the tokenizer once while a worker remembers it; new words and uncut texts go
to it in batches, which it encodes on `THREADS` threads.  All that reaches the tokenizer is also encoded by the
sentencepiece library.  A text has `parity` if the ids of all its parts are the same in both; the ids returned are those
of the tokenizers library in any case.  Decoding is that library's, too: marker, byte fallback, dummy prefix.

Null and empty texts have no ids and decode to an empty text.  Repeated rows stay; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import slices

THREADS = 2
#: Distinct words that a worker remembers; longer ones than LONGEST bytes are encoded each time.
REMEMBERED, LONGEST = 400_000, 64
#: Fixed values of the model format: the marker, kinds of pieces, kinds of models.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_workers: dict[str, Backend] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message; groups don't occur."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file says.  The defaults are those of the format."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model: int = UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    fewer_spaces: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    @property
    def cuttable(self) -> bool:
        """No piece that can match crosses the place between another sign and a marker."""
        return all(MARK not in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k == NORMAL)


def parse(data: bytes) -> Model:
    out = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            out.pieces.append(piece[1].decode())
            out.scores.append(float(np.frombuffer(piece[2], "<f4")[0]))
            out.kinds.append(piece[3])
        elif number == 2:
            spec = dict(_fields(value))
            out.model, out.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            out.char_map, out.dummy_prefix, out.fewer_spaces, out.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    if out.model not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models have a counterpart in the tokenizers library")
    if USER_DEFINED in out.kinds:
        raise ValueError("user-defined pieces have no counterpart here")
    return out


def merges(model: Model) -> list[tuple[str, str]]:
    """The merges of a BPE vocabulary: every way to put a piece together from two, best score first."""
    known = {p: k for k, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == NORMAL}
    found = []
    for piece, k in known.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in known and right in known:
                found.append((-model.scores[k], known[left], known[right]))
    return [(model.pieces[a], model.pieces[b]) for _, a, b in sorted(found)]


def build(model: Model):  # noqa: ANN201
    """The Tokenizer of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.model == BPE:
        tokenizer = Tokenizer(models.BPE({p: k for k, p in enumerate(model.pieces)}, merges(model), unk_token=model.pieces[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0))
    else:
        # what must not match a text gets a score that no path takes
        scores = [s if kind == NORMAL else -1e9 for s, kind in zip(model.scores, model.kinds, strict=True)]
        tokenizer = Tokenizer(models.Unigram(list(zip(model.pieces, scores, strict=True)), model.unknown, model.byte_fallback))
    steps = [normalizers.Precompiled(model.char_map)] if model.char_map else []
    if model.fewer_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if model.cuttable:
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tokenizer.decoder = decoders.Sequence([decoders.Replace(model.pieces[model.unknown], " \u2047 "), decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


class Backend:
    """encode() gives the ids of all texts, the texts' offsets in them and their parity; decode() the texts of ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            data = f.read()
        self.model = parse(data)
        self.tokenizer = build(self.model)
        self.plain = self.model.cuttable and not self.model.char_map and not self.model.fewer_spaces and self.model.dummy_prefix and self.model.escape
        self.control = np.array([k == CONTROL for k in self.model.kinds])
        self.other = SentencePieceProcessor(model_file=path)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.first, self.length, self.same = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def batch(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of texts, encoded on several threads, and whether the sentencepiece library gives the same."""
        if not texts:
            return [], []
        os.environ |= {"RAYON_NUM_THREADS": str(THREADS), "TOKENIZERS_PARALLELISM": "true"}
        own = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return own, [a == b for a, b in zip(own, self.other.encode(texts, num_threads=THREADS), strict=True)]

    def _rows(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter((i for r in rows for i in r), np.int64, int(length.sum())), length

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not self.plain:
            rows, same = self.batch(texts.to_pylist())
            flat, length = self._rows(rows)
            return flat, np.append(0, np.cumsum(length)), np.array(same, bool)
        if len(self.index) > REMEMBERED:
            self._forget()
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, MARK), pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.equal(texts, "")))))
        odd = odd.to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        new = [w for w in words if w not in self.index and w and len(w) <= LONGEST]
        if new:
            rows, same = self.batch(new)
            flat, length = self._rows(rows)
            self.index.update(zip(new, range(len(self.length), len(self.length) + len(new)), strict=True))
            self.first = np.append(self.first, len(self.flat) + np.cumsum(length) - length)
            self.flat, self.length, self.same = np.append(self.flat, flat), np.append(self.length, length), np.append(self.same, same)
        # what is not remembered follows: long words, uncut texts, nothing
        long = [w for w in words if len(w) > LONGEST]
        whole = np.flatnonzero(odd)
        rows, same = (x + y + [z] for x, y, z in zip(self.batch(long), self.batch(texts.take(pa.array(whole)).to_pylist()), ([], True), strict=True))
        flat, length = self._rows(rows)
        base = len(self.length)
        first, length, same = np.append(self.first, len(self.flat) + np.cumsum(length) - length), np.append(self.length, length), np.append(self.same, same)
        flat = np.append(self.flat, flat)
        extra = dict(zip(long, range(base, base + len(long)), strict=True))
        own = np.fromiter((extra[w] if w in extra else self.index[w] if w else len(length) - 1 for w in words), np.int64, len(words))
        number = own[numbers] if len(words) else np.zeros(0, np.int64)
        number[bounds[:-1][whole]] = base + len(long) + np.arange(len(whole))
        sizes = length[number]
        total = np.append(0, np.cumsum(sizes))
        places = np.repeat(first[number] - total[:-1], sizes) + np.arange(total[-1])
        bounds = bounds - bounds[0]
        wrong = np.append(0, np.cumsum(~same.astype(bool)[number]))
        return flat[places], total[bounds], wrong[bounds[1:]] == wrong[bounds[:-1]]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of ids, ends being offsets as encode() gives them; control pieces have no text."""
        if len(ends) < 2:
            return []
        kept = ~self.control[ids]
        ends = np.append(0, np.cumsum(kept))[ends].tolist()
        ids = ids[kept].tolist()
        os.environ |= {"RAYON_NUM_THREADS": str(THREADS), "TOKENIZERS_PARALLELISM": "true"}
        return self.tokenizer.decode_batch([ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], skip_special_tokens=False)


def backend(path: str) -> Backend:
    """The worker's own backend of that file."""
    if path not in _workers:
        _workers[path] = Backend(path)
    return _workers[path]


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit), parity, round_trip; ids array<long> if asked for.

    parity: the sentencepiece library gives the same ids.  round_trip: decoding the ids gives the normalised text back.
    """
    out = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<long>" * with_ids

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = backend(path)
        for batch in batches:
            for some in slices(batch, "text", 4 << 20):
                texts = pc.fill_null(some.column("text"), "")
                ids, ends, parity = own.encode(texts)
                plain = texts.to_pylist()
                surface = plain if own.plain else [own.other.normalize(t).removeprefix(MARK if own.model.dummy_prefix else "") for t in plain]
                same = [a == b.replace(MARK, " ") for a, b in zip(own.decode(ids, ends), surface, strict=True)]
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = {"doc_id": some.column("doc_id"), "n_tokens": pa.array(np.diff(ends)), "ids_crc32": pa.array(crc, pa.int64()), "parity": pa.array(parity), "round_trip": pa.array(same, pa.bool_())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(apply, out)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of doc_id, ids array<long>; null ids give a null text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = backend(path)
        for batch in batches:
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = own.decode(lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes)))
            given = lists.is_valid().to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([t if ok else None for t, ok in zip(texts, given, strict=True)], pa.string())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids")).mapInArrow(apply, "doc_id long, text string")
