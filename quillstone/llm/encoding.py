"""Whole-text encoding with the tokenizers library, each distinct word-like piece being encoded once.

Both public BPE files split a text before their merges run, so that no token crosses certain spaces.
Texts are cut there, the pieces of a batch are counted as a dictionary, and only pieces not met before in
this Python worker reach the tokenizer.  A text whose spacing leaves the cut in doubt is encoded in one go.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000
#: Longer pieces are encoded again each time.
LONGEST = 64
#: Any white space, a superset of what either tokenizer's patterns call so.
_WS = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]"
_workers: dict[tuple, PieceEncoder] = {}


class PieceEncoder:
    """ids of texts.  spaced: a piece keeps the space before it (byte-level files); else white space only separates.

    encode() gives the ids of all texts, each followed by end_id, and the offsets of the texts in them.
    """

    def __init__(self, path: str, spaced: bool, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced, self.end_id = spaced, end_id
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        if spaced:
            self.opens = np.zeros(max(vocab.values()) + 1, bool)
            self.opens[[i for piece, i in vocab.items() if piece.startswith("Ġ")]] = True
        else:
            self.between = vocab["~</w>"]
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.count = 0
        self._add([[self.end_id], []])  # numbers 0 and 1: the end, and a piece without ids

    def _add(self, rows: list) -> None:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.concatenate([np.asarray(r, np.uint32) for r in rows]) if len(rows) < 4096 else np.fromiter((i for r in rows for i in r), np.uint32, int(lengths.sum()))
        self._add_flat(ids, lengths)

    def _add_flat(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(lengths) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + len(ids)] = ids
        to = self.count + len(lengths)
        self.length[self.count : to] = lengths
        self.first[self.count : to] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.count = to

    def _singly(self, texts: list[str]) -> list[list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # other operators in this worker may have set it
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces, many in one text where their ids can be told apart again."""
        plain = [p for p in pieces if p and not p[0].isspace() and not p[-1].isspace() and "~" not in p]
        rest = [p for p in pieces if not p or p[0].isspace() or p[-1].isspace() or "~" in p]
        for at in range(0, len(plain), 256):
            some = plain[at : at + 256]
            joined = " " + " ".join(some) if self.spaced else " ~ ".join(some) + " ~"
            ids = np.asarray(self._singly([joined])[0], np.uint32)
            if self.spaced:
                starts = np.flatnonzero(self.opens[ids]) if len(ids) else np.zeros(0, np.int64)
                lengths = np.diff(np.append(starts, len(ids)))
                ok = len(starts) == len(some) and starts[0] == 0
            else:
                ends = np.flatnonzero(ids == self.between)
                lengths = np.diff(np.append(-1, ends)) - 1
                ok = len(ends) == len(some)
                ids = ids[ids != self.between]
            if not ok:
                rest += some
                continue
            self.index.update(zip(some, range(self.count, self.count + len(some)), strict=True))
            self._add_flat(ids, lengths)
        if rest:
            self.index.update(zip(rest, range(self.count, self.count + len(rest)), strict=True))
            self._add(self._singly([" " + p for p in rest] if self.spaced else rest))

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number of each piece."""
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.index]
        if new:
            self._learn(new)
        own = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return own[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(len(pieces), np.int64)

    def _once(self, texts: list[str]) -> np.ndarray:
        """Numbers for texts that are not remembered by content."""
        at = self.count
        self._add(self._singly(texts) if texts else [])
        return np.arange(at, self.count)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if self.count > REMEMBERED:
            self._forget()
        texts = pc.fill_null(texts, "")
        whole = None
        if self.spaced:
            whole = pc.match_substring_regex(texts, f"{_WS} {_WS}").to_numpy(zero_copy_only=False)
            if whole.any():
                cut = pc.if_else(pa.array(whole), "", texts)
            else:
                cut, whole = texts, None
        else:
            cut = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(cut, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.flatten()
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        bounds = bounds - bounds[0]
        small = pc.less_equal(pc.binary_length(pieces), LONGEST).to_numpy(zero_copy_only=False)
        numbers = self._numbers(pieces if small.all() else pc.if_else(pa.array(small), pieces, ""))
        kept_count, kept_used = self.count, self.used
        if not small.all():
            far = np.flatnonzero(~small)
            numbers[far] = self._once([(" " if self.spaced else "") + w for w in pieces.take(pa.array(far)).to_pylist()])
        firsts = bounds[:-1]
        if self.spaced:
            heads = pieces.take(pa.array(firsts)).dictionary_encode()
            own = self._once([w for w in heads.dictionary.to_pylist()])
            numbers[firsts] = own[heads.indices.to_numpy(zero_copy_only=False)]
            if whole is not None:
                at = np.flatnonzero(whole)
                numbers[firsts[at]] = self._once(texts.take(pa.array(at)).to_pylist())
        else:
            numbers[pc.equal(pieces, "").to_numpy(zero_copy_only=False)] = 1
        # each text's pieces, then the end
        places = np.arange(len(numbers)) + np.repeat(np.arange(len(texts)), np.diff(bounds))
        order = np.zeros(len(numbers) + len(texts), np.int64)
        order[places] = numbers
        lengths = self.length[order]
        total = np.cumsum(lengths)
        places = np.repeat(self.first[order] - (total - lengths), lengths)
        places += np.arange(total[-1])
        ids = self.flat[places]
        ends = total[bounds[1:] + np.arange(len(texts))]
        self.count, self.used = kept_count, kept_used  # what _once added is forgotten
        return ids, np.append(0, ends)


def encoder(path: str, spaced: bool, end_id: int) -> PieceEncoder:
    """The worker's own encoder of that file."""
    key = (path, spaced, end_id)
    if key not in _workers:
        _workers[key] = PieceEncoder(path, spaced, end_id)
    return _workers[key]
