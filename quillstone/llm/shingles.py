"""Word shingles of whole texts as 64-bit hashes, for whole slices of documents at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.default_rng(20240501).integers(0, 1 << 64, 256, np.uint64)
_PLACE = np.random.default_rng(20240502).integers(0, 1 << 64, WORDS + 1, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _POWER, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered, cut at ASCII white space), and the bounds of each text's words."""
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "\n".join(x or "" for x in texts.to_pylist()).encode()
    raw = _LOWER[np.frombuffer(joined + b"\n", np.uint8)]
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    bounds = np.append(0, np.searchsorted(starts, np.cumsum(sizes + 1)))
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    ends = np.flatnonzero(space & np.append(False, ~space[:-1]))
    lengths = ends - starts
    at = np.flatnonzero(~space)
    inside = at - np.repeat(starts, lengths)
    hashes = np.add.reduceat(_BYTE[raw[at]] * _powers(int(lengths.max()))[inside], np.cumsum(lengths) - lengths)
    return mixed(hashes + lengths.astype(np.uint64)), bounds


def shingle_hashes(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The set of each text: hashes of its distinct shingles, ascending.  Fewer words than a shingle's make one shingle; no words make none."""
    hashes, bounds = word_hashes(texts)
    long = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        long += hashes[k : k + len(long)] * _PLACE[k]
    long = mixed(long)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(long[a : b - words + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            out.append(mixed((hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _PLACE[words:] * np.uint64(b - a)))
        else:
            out.append(long[:0])
    return out
