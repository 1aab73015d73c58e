"""Hashes of word shingles, for Arrow columns of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import codes_of, list_lengths, starts_of

_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0x5851F42D4C957F2D)


def mix(h: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: spreads every input bit over the word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hash of each string."""
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()), np.uint64, len(values))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words per text, hash per word) over Unicode white space."""
    lists = pc.utf8_split_whitespace(texts)
    codes, distinct = codes_of(lists.flatten())
    per = list_lengths(lists)
    if len(distinct) == 0:
        return per, np.zeros(0, np.uint64)
    blank = pc.equal(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)
    if blank.any():  # white space at an end splits off an empty word
        keep = ~blank[codes]
        per = np.add.reduceat(np.concatenate([keep, [False]]).astype(np.int64), starts_of(per)[:-1]) * (per > 0)
        codes = codes[keep]
    return per, hash_strings(distinct)[codes]


def shingle_hashes(per: np.ndarray, words: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingles per text, hash per shingle), with repeats.

    A text of fewer than ``size`` words has one shingle of them all; one without words has the empty shingle.
    """
    n = len(words)
    rolled = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        rolled *= _STEP
        rolled += words[k:k + len(rolled)]
    start = starts_of(per)
    count = np.maximum(per - size + 1, 1)
    out_start = starts_of(count)
    full = per >= size
    index = np.arange(out_start[-1], dtype=np.int64) + np.repeat(start[:-1] - out_start[:-1], count)
    if len(rolled):
        out = rolled[np.minimum(index, len(rolled) - 1)]
    else:
        out = np.zeros(len(index), np.uint64)
    for i in np.flatnonzero(~full):
        h = _EMPTY
        for w in words[start[i]:start[i + 1]]:
            h = np.uint64((int(h) * int(_STEP) + int(w) + 1) & 0xFFFFFFFFFFFFFFFF)
        out[out_start[i]] = h
    return count, mix(out)
