"""Hashed n-gram feature table (featurizer hook) and per-example metadata.

Feature rows are sparse and per document:
``(doc_id, n_tokens, buckets ARRAY<INT>, counts ARRAY<INT>)``.

The default word/punctuation tokenizer runs in Arrow's C++ string kernels
inside the task (other tokenizers are JVM expressions). Building n-grams and
hashing them is done by the same vectorised Arrow function per batch
(``mapInArrow``): n-grams are formed with
Arrow string kernels, de-duplicated per batch, and only the distinct strings
are sha-256 hashed. Per-document counts come from one ``np.unique`` over
``row * B + bucket``. The whole step is a narrow map: no shuffle, and the
output is far smaller than the text.
"""

from __future__ import annotations

import hashlib
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import sha256_bucket, xxhash_bucket
from ..functions.pyhash import python_buckets
from ..functions.text import example_length, get_tokenizer, ngrams

FEATURE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.IntegerType()),
    T.StructField("buckets", T.ArrayType(T.IntegerType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())),
])

def _sha_bucket_factory(num_buckets: int) -> Callable[[bytes], int]:
    sha = hashlib.sha256
    frombytes = int.from_bytes

    def f(b: bytes) -> int:
        return frombytes(sha(b).digest(), "big") % num_buckets
    return f


def _xxh_bucket_factory(num_buckets: int) -> Callable[[bytes], int]:
    import xxhash
    h = xxhash.xxh64_intdigest

    def f(b: bytes) -> int:
        return h(b) % num_buckets
    return f


def _python_bucket_factory(seed: int) -> Callable[[int], Callable[[bytes], int]]:
    def factory(num_buckets: int) -> Callable[[bytes], int]:
        def f(b: bytes) -> int:
            return int(python_buckets([b.decode()], num_buckets, seed)[0])
        f.many = lambda grams: python_buckets([g.decode() for g in grams], num_buckets, seed)
        return f
    return factory


HASHERS = {"sha256": _sha_bucket_factory, "xxh64": _xxh_bucket_factory}


def hasher(hash_fn: str) -> Callable[[int], Callable[[bytes], int]]:
    """``sha256``, ``xxh64``, or ``python:seed``: the interpreter's own hash under ``PYTHONHASHSEED=seed``."""
    if hash_fn.startswith("python:"):
        return _python_bucket_factory(int(hash_fn.removeprefix("python:")))
    if hash_fn not in HASHERS:
        raise ValueError(f"unknown hash_fn {hash_fn!r}")
    return HASHERS[hash_fn]


# Unicode whitespace (as Python's str.isspace) and the "other
# non-space" class of the word/punctuation tokenizer, in RE2 syntax.
_WS_RE2 = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
_PUNCT_RUN_RE2 = r"([^\p{L}\p{N}_\s\p{Z}\x0B\x1C-\x1F\x85]+)"


def _arrow_wordpunct(texts: pa.Array):
    """Word/punctuation tokens with Arrow's C++ kernels: lower-case, pad every
    punctuation run with spaces, split on Unicode whitespace. Same tokens as
    ``regexp_extract_all(lower(text), WORDPUNCT_PATTERN)``."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), pattern=_PUNCT_RUN_RE2, replacement=r" \1 ")
    parts = pc.split_pattern_regex(spaced, pattern=_WS_RE2 + "+")
    flat = pc.list_flatten(parts)
    par = pc.list_parent_indices(parts)
    keep = pc.not_equal(flat, "")
    values = flat.filter(keep)
    parent = par.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)
    lens = np.bincount(parent, minlength=len(texts)).astype(np.int64)
    return values, parent, lens


# Text bytes worked on at once: record counts alone do not bound a batch of long documents. Tokens, n-grams, their
# joined strings and sort keys take about 50 (n = 2) to 90 (n = 3) times the text, so the slice is small.
SLICE_BYTES = 2 << 20
# Stored feature entries (bucket, count) worked on at once by what reads features.
SLICE_ENTRIES = 1 << 18


def _byte_slices(rb: pa.RecordBatch, col: str):
    """Parts of a batch with at most SLICE_BYTES of text (one row at least)."""
    c = rb.column(rb.schema.get_field_index(col))
    if pa.types.is_list(c.type):
        size = np.bincount(pc.list_parent_indices(c).to_numpy(), pc.fill_null(pc.binary_length(pc.list_flatten(c)), 0).to_numpy(zero_copy_only=False), len(c))
    else:
        size = pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    yield from _cut(rb, size, SLICE_BYTES)


def entry_slices(rb: pa.RecordBatch, width: int = 1, col: str = "buckets"):
    """Parts of a batch of features with at most SLICE_ENTRIES / ``width`` list entries (one row at least)."""
    size = pc.fill_null(pc.list_value_length(rb.column(rb.schema.get_field_index(col))), 0).to_numpy(zero_copy_only=False)
    yield from _cut(rb, size, max(1, SLICE_ENTRIES // width))


def _cut(rb: pa.RecordBatch, size: np.ndarray, limit: int):
    """Parts of a batch whose rows' sizes add up to ``limit`` at most (one row at least)."""
    ends = np.cumsum(size.astype(np.int64))
    start = 0
    while start < rb.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield rb.slice(start, stop - start)
        start = stop


def _batch_features(rb: pa.RecordBatch, n: int, num_buckets: int, bucket_of,
                    id_col: str, tok_col: str, arrow_tokenize: bool = False) -> pa.RecordBatch:
    ids = rb.column(rb.schema.get_field_index(id_col))
    col = rb.column(rb.schema.get_field_index(tok_col))
    nrows = len(col)
    if arrow_tokenize:
        values, parent, lens = _arrow_wordpunct(col)
    else:
        lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = pc.list_flatten(col).cast(pa.large_string())
        parent = np.repeat(np.arange(nrows, dtype=np.int64), lens)
    gram_arrays = [values]
    gram_parent = [parent]
    total = len(values)
    for i in range(2, n + 1):
        m = total - i + 1
        if m <= 0:
            break
        idx = np.nonzero(parent[:m] == parent[i - 1:i - 1 + m])[0]
        if len(idx) == 0:
            continue
        parts = [values.take(pa.array(idx + k)) for k in range(i)]
        gram_arrays.append(pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())))
        gram_parent.append(parent[idx])
    grams = pa.concat_arrays([g.cast(pa.large_string()) for g in gram_arrays])
    gp = np.concatenate(gram_parent) if gram_parent else np.zeros(0, np.int64)
    if len(grams):
        # distinct n-grams of the batch, hashed once each, as UTF-8 bytes
        enc = pc.dictionary_encode(grams)
        uniq = enc.dictionary.cast(pa.large_binary()).to_pylist()
        many = getattr(bucket_of, "many", None)
        ub = many(uniq).astype(np.int64) if many else np.fromiter(map(bucket_of, uniq), dtype=np.int64, count=len(uniq))
        bk = ub[enc.indices.to_numpy(zero_copy_only=False)]
        key = gp * num_buckets + bk
        ukey, cnt = np.unique(key, return_counts=True)
    else:
        ukey = np.zeros(0, np.int64)
        cnt = np.zeros(0, np.int64)
    doc_of = ukey // num_buckets
    offs = np.searchsorted(doc_of, np.arange(nrows + 1, dtype=np.int64)).astype(np.int32)
    off = pa.array(offs, type=pa.int32())
    buckets = pa.ListArray.from_arrays(off, pa.array((ukey % num_buckets).astype(np.int32)))
    counts = pa.ListArray.from_arrays(off, pa.array(cnt.astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), pa.array(lens.astype(np.int32)), buckets, counts],
        names=["doc_id", "n_tokens", "buckets", "counts"])


def ngram_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2,
                   num_buckets: int = 10000, tokenizer: str | Callable[[Column], Column] = "wordpunct",
                   hash_fn: str = "sha256") -> DataFrame:
    """Sparse hashed n-gram counts per document (featurizer, F1/T7).

    ``hash_fn``: ``sha256`` (stable, the reference's bucket values), ``xxh64``
    (fast), ``python:seed`` (the interpreter's own ``hash``). Null texts are dropped (they never count as ``''``).
    """
    from ..session import ship_package
    factory = hasher(hash_fn)
    ship_package(df.sparkSession)
    # the default tokenizer runs inside the same Arrow task (one string per
    # document crosses the JVM/Python boundary); others are JVM expressions
    arrow_tok = tokenizer == "wordpunct"
    if arrow_tok:
        base = df.where(F.col(text_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("tokens"))
    else:
        tok = get_tokenizer(tokenizer)
        base = df.where(F.col(text_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("doc_id"), tok(F.col(text_col)).alias("tokens"))

    def fn(batches):
        bucket_of = factory(num_buckets)
        for rb in batches:
            for part in _byte_slices(rb, "tokens"):
                yield _batch_features(part, n, num_buckets, bucket_of, "doc_id", "tokens", arrow_tok)

    return base.mapInArrow(fn, FEATURE_SCHEMA)


def ngram_features_sql(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2,
                       num_buckets: int = 10000, tokenizer: str | Callable[[Column], Column] = "wordpunct",
                       hash_fn: str = "sha256") -> DataFrame:
    """Long-form ``(doc_id, bucket, cnt)`` counts with no Python: explode + aggregate.

    Slower than :func:`ngram_features` for sha-256 (the digest is computed per
    occurrence) but useful as a cross-check and for the ``xxhash64`` mode,
    which is fully JVM-side.
    """
    tok = get_tokenizer(tokenizer)
    bucket = sha256_bucket if hash_fn == "sha256" else xxhash_bucket
    g = df.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.explode(ngrams(tok(F.col(text_col)), n)).alias("g"))
    return g.groupBy("doc_id", bucket("g", num_buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


def features_long(features: DataFrame) -> DataFrame:
    """Sparse arrays to long form ``(doc_id, bucket, cnt)``; a narrow explode."""
    z = features.select("doc_id", F.explode(F.arrays_zip("buckets", "counts")).alias("z"))
    return z.select("doc_id", F.col("z.buckets").alias("bucket"), F.col("z.counts").cast("long").alias("cnt"))


def with_length(features: DataFrame, n: int) -> DataFrame:
    """Add the reference's per-example length (formula on the token count, P4)."""
    return features.withColumn("length", example_length("n_tokens", n))


def total_ngrams(n_tokens: Column | str, n: int) -> Column:
    """Number of n-grams (1..n) of a document with L tokens."""
    L = F.col(n_tokens) if isinstance(n_tokens, str) else n_tokens
    g = None
    for i in range(1, n + 1):
        term = F.greatest(L - F.lit(i - 1), F.lit(0))
        g = term if g is None else g + term
    return g.cast("long")
