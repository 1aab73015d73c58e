"""Stable hashing: sha-256 buckets, fast xxhash64 buckets, seeded uniforms.

Every random draw in the library is a pure function of (seed, salt, id), so a
selection is identical under any partitioning and on recomputation after an
executor loss.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def sha256_bucket_py(text: str, num_buckets: int = 10000) -> int:
    """Python reference for one string: ``int(sha256(utf8)) % num_buckets``."""
    return int.from_bytes(hashlib.sha256(text.encode("utf-8")).digest(), "big") % num_buckets


def sha256_bucket(col: Column | str, num_buckets: int = 10000) -> Column:
    """JVM-side sha-256 bucket of a string column (exact, no UDF).

    The 256-bit digest is read as eight 32-bit words; the bucket is
    ``pmod(sum(word_i * (2^(32*(7-i)) mod B)), B)``. Exact for B < 2^28.
    """
    if num_buckets >= 1 << 28:
        raise ValueError("num_buckets must be < 2^28 for the SQL bucket expression")
    c = F.col(col) if isinstance(col, str) else col
    h = F.sha2(c, 256)
    total = None
    for i in range(8):
        coef = pow(2, 32 * (7 - i), num_buckets)
        word = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")
        term = word * F.lit(coef)
        total = term if total is None else total + term
    return F.pmod(total, F.lit(num_buckets)).cast("int")


def xxhash_bucket(col: Column | str, num_buckets: int = 10000) -> Column:
    """Fast bucket (role of the reference's process-seeded ``hash``): stable across runs."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.xxhash64(c), F.lit(num_buckets)).cast("int")


def seeded_uniform(seed: int, salt: str, id_col: Column | str) -> Column:
    """u in (0,1): (first 13 hex digits of sha256('seed:salt:id') + 0.5) / 2^52."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), c.cast("string"))
    head = F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(TWO_POW_52)


def gumbel(seed: int, salt: str, id_col: Column | str) -> Column:
    """Standard Gumbel(0,1) draw: -ln(-ln u)."""
    return -F.log(-F.log(seeded_uniform(seed, salt, id_col)))


def pareto(seed: int, salt: str, id_col: Column | str, shape: float = 9.0) -> Column:
    """Lomax / numpy-style Pareto(shape) draw: (1-u)^(-1/shape) - 1."""
    return F.pow(F.lit(1.0) - seeded_uniform(seed, salt, id_col), F.lit(-1.0 / shape)) - F.lit(1.0)


def seeded_order_key(seed: int, salt: str, id_col: Column | str) -> Column:
    """A 52-bit integer sort key from the same digest (for seeded shuffles)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), c.cast("string"))
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("bigint")
