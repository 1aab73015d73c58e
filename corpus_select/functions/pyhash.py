"""Python's seeded string hash for columns of strings.

The reference's fast bucket is ``abs(hash(s)) % B`` of the running interpreter. Its value is
SipHash-1-3 over the string's internal form (1, 2 or 4 bytes a character, whichever its widest
character needs) under a key drawn from ``PYTHONHASHSEED``. Here it is computed for
given seeds, in any process and for many strings at once: strings with equally many
8-byte blocks go through the rounds together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# SipHash's four starting words, and the linear congruence that stretches a hash seed.
START = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
MULTIPLIER, INCREMENT = 214013, 2531011


def key_of_seed(seed: int) -> tuple[int, int]:
    """The 128-bit key of ``PYTHONHASHSEED=seed``; seed 0 has the zero key."""
    if not 0 <= seed < 1 << 32:
        raise ValueError("a hash seed has 32 bits")
    if seed == 0:
        return 0, 0
    x, out = seed, bytearray()
    for _ in range(16):
        x = (x * MULTIPLIER + INCREMENT) & 0xFFFFFFFF
        out.append(x >> 16 & 0xFF)
    return int.from_bytes(out[:8], "little"), int.from_bytes(out[8:], "little")


def _left(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint64(k) | x >> np.uint64(64 - k)


def _round(a, b, c, d):
    a = a + b
    c = c + d
    b = _left(b, 13) ^ a
    d = _left(d, 16) ^ c
    a = _left(a, 32) + d
    c = c + b
    d = _left(d, 21) ^ a
    b = _left(b, 17) ^ c
    return a, b, _left(c, 32), d


def sip13(blocks: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """SipHash-1-3 of rows of 64-bit blocks; the last block holds the last bytes and the length."""
    k = [np.uint64(x) for x in (*key, *key)]
    a, b, c, d = (np.full(len(blocks), s, np.uint64) ^ x for s, x in zip(map(np.uint64, START), k))
    for block in blocks.T:
        a, b, c, d = _round(a, b, c, d ^ block)
        a = a ^ block
    c = c ^ np.uint64(0xFF)
    for _ in range(3):
        a, b, c, d = _round(a, b, c, d)
    return a ^ b ^ c ^ d


def internal_bytes(s: str) -> bytes:
    """The string as the interpreter keeps it."""
    widest = max(s, default="")
    return s.encode("latin-1" if widest <= "\xff" else "utf-16-le" if widest <= "\uffff" else "utf-32-le", "surrogatepass") if widest else b""


def python_hashes(strings: Sequence[str], seed: int = 0) -> np.ndarray:
    """``hash(s)`` of each string under ``PYTHONHASHSEED=seed``, as signed 64-bit numbers."""
    raw = [internal_bytes(s) for s in strings]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    out, key = np.zeros(len(raw), np.uint64), key_of_seed(seed)
    for n in np.unique(size // 8).tolist():
        at = np.flatnonzero((size // 8 == n) & (size > 0))
        if not len(at):
            continue
        padded = b"".join(raw[i].ljust(8 * n + 8, b"\0") for i in at.tolist())
        blocks = np.frombuffer(padded, "<u8").reshape(len(at), n + 1).copy()
        blocks[:, -1] |= (size[at].astype(np.uint64) & np.uint64(0xFF)) << np.uint64(56)
        out[at] = sip13(blocks, key)
    signed = out.view(np.int64).copy()
    signed[signed == -1] = -2
    return signed


def python_buckets(strings: Sequence[str], num_buckets: int, seed: int = 0) -> np.ndarray:
    """``abs(hash(s)) % num_buckets`` of each string."""
    h = python_hashes(strings, seed)
    return np.where(h < 0, (~h).view(np.uint64) + np.uint64(1), h.view(np.uint64)).astype(np.uint64) % np.uint64(num_buckets)
