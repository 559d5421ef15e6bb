"""Words of many texts at once as arrays: where they lie in the bytes, hashes, prefix hashes, shapes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillstone.llm.shingles import mixed

_POWER = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bits of the kinds of bytes: lower, upper, digit, beyond ASCII, stop or comma, other sign.
_KIND = np.full(256, 32, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[[44, 46]] = 1, 2, 4, 8, 16


@dataclass
class Words:
    """bounds: the words of text k are those from bounds[k] to bounds[k + 1]."""

    raw: np.ndarray
    at: np.ndarray
    inside: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hashes of the lowered words, or of their first bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        power = np.full(int(self.lengths.max()), _POWER, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        if prefix is None:
            lengths, at, inside = self.lengths, self.at, self.inside
        else:
            near = self.inside < prefix
            lengths, at, inside = np.minimum(self.lengths, prefix), self.at[near], self.inside[near]
        sums = np.add.reduceat(_BYTE[_LOWER[self.raw[at]]] * power[inside], np.cumsum(lengths) - lengths)
        return mixed(sums + lengths.astype(np.uint64) + np.uint64(0 if prefix is None else prefix << 32))

    def shapes(self) -> np.ndarray:
        """A small number for the kinds of signs in a word, its first sign and its length."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        kinds = _KIND[self.raw]
        seen = np.bitwise_or.reduceat(kinds[self.at], np.cumsum(self.lengths) - self.lengths).astype(np.int64)
        first = np.log2(kinds[self.starts]).astype(np.int64)
        return (seen * 6 + first) * 8 + np.minimum(self.lengths // 2, 7)


SHAPES = 64 * 6 * 8


def words_of(texts: pa.Array, letters_only: bool = False) -> Words:
    """Words cut at ASCII white space; letters_only: runs of letters, digits and bytes beyond ASCII."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(("\n".join(x or "" for x in texts.to_pylist()) + "\n").encode(), np.uint8)
    inside = _LETTER[raw] if letters_only else ~_SPACE[raw]
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1]))
    ends = np.flatnonzero(~inside & np.append(False, inside[:-1]))
    lengths = ends - starts
    at = np.flatnonzero(inside)
    return Words(raw, at, at - np.repeat(starts, lengths), starts, lengths, np.append(0, np.searchsorted(starts, np.cumsum(sizes + 1))))
