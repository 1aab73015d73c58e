"""Document fingerprints: one-permutation MinHash with optimal densification, kept as packed low-order bits.

Each distinct five-word shingle is hashed once; the hash's high bits choose a
bin and the rest compete for the bin's minimum. An empty bin copies a filled bin,
which it finds by its own fixed pseudo-random probe order (the same in every
document, so equal sets agree and similar sets agree as often as they should).
Only the low ``BITS`` bits of each minimum are stored. Two unequal minima agree
there with probability 2^-BITS, which the estimate corrects for.

Defined results: null text is empty; a text without words has the fingerprint of
the empty shingle; fewer than five words make one shingle; equal ids are ordered
by a hash of their texts, null ids come last; a lone document is its own next.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, record_batch, slices, stored, texts_of
from .shingles import mix, shingle_hashes, word_hashes

BINS, BITS, SIZE = 512, 4, 5
ROWS = 2048  # documents worked at a time: ROWS x BINS minima are in memory
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache
def _probes(bins: int) -> np.ndarray:
    """For each bin, the order in which it looks for a filled one: a random permutation, the same everywhere."""
    return np.argsort(mix(np.arange(bins * bins, dtype=np.uint64)).reshape(bins, bins), axis=1).astype(np.uint16)


def signatures(texts: pa.Array, bins: int = BINS, bits: int = BITS, size: int = SIZE) -> np.ndarray:
    """Low-order bits (uint8, texts x bins); ``bins`` is a power of two."""
    per, words = word_hashes(texts)
    count, hashes = shingle_hashes(per, words, size)
    shift = np.uint64(64 - bins.bit_length() + 1)
    least = np.full(len(count) * bins, _NONE, np.uint64)
    cell = (hashes >> shift).astype(np.int64) + np.repeat(np.arange(len(count), dtype=np.int64) * bins, count)
    np.minimum.at(least, cell, hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    least = least.reshape(len(count), bins)
    order = _probes(bins)
    filled = least != _NONE
    row, col = np.nonzero(~filled)
    source = least.copy()
    for t in range(bins):
        if not len(row):
            break
        at = order[col, t]
        hit = filled[row, at]
        least[row[hit], col[hit]] = source[row[hit], at[hit]]
        row, col = row[~hit], col[~hit]
    # a copied minimum is mixed with its bin's number, so that unequal minima agree by chance in each bin apart
    return (mix(least + np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(sig: np.ndarray, bits: int = BITS) -> list[str]:
    """Hex strings of the signatures' bits in a row."""
    flat = ((sig[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).reshape(len(sig), -1)
    return [r.tobytes().hex() for r in np.packbits(flat, axis=1)]


def unpacked(fingerprints: list[str], bits: int = BITS) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), -1)
    flat = np.unpackbits(raw, axis=1).reshape(len(fingerprints), -1, bits)
    return (flat << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of signatures, row by row: agreement less what chance gives."""
    chance = 1.0 / (1 << bits)
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every text."""
    docs = texts_of(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                yield record_batch({"doc_id": part.column("doc_id"), "fingerprint": pa.array(packed(signatures(part.column("text").cast(pa.large_string()))))})
    return arrow_map(docs, run, f"doc_id {kind}, fingerprint string")


def _compare(texts: list[str], following: list[str], sig: np.ndarray, next_sig: np.ndarray) -> dict:
    """Columns about texts, their edited texts and the documents that follow them."""
    half = [len(t) // 2 for t in texts]
    edited = [t[:len(t) - h] + n[:h] for t, h, n in zip(texts, half, following)]
    edited_sig = signatures(pa.array(edited, pa.large_string()))
    return {
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        "fingerprint": pa.array(packed(sig), pa.string()),
        "edited_fingerprint": pa.array(packed(edited_sig), pa.string()),
        "near_edited": pa.array(likeness(sig, edited_sig), pa.float64()),
        "near_next": pa.array(likeness(sig, next_sig), pa.float64()),
    }


_DONE = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk():
    """Over one range of documents in order: all rows but the last are done; the first and the last go out with their texts."""
    def edge(part, kind, doc, text):
        return record_batch({"part": pa.array([part], pa.int32()), "edge": pa.array([kind], pa.int32()), "doc_id": doc, "text": pa.array([text], pa.string()),
                             "n_chars": pa.array([None], pa.int64()), "edited_sha256": pa.array([None], pa.string()), "fingerprint": pa.array([None], pa.string()),
                             "edited_fingerprint": pa.array([None], pa.string()), "near_edited": pa.array([None], pa.float64()), "near_next": pa.array([None], pa.float64())})

    def run(batches):
        part, held = TaskContext.get().partitionId(), None
        for b in slices(batches):
            for k in range(0, b.num_rows, ROWS):
                s = b.slice(k, ROWS)
                docs, texts = s.column("doc_id"), s.column("text").to_pylist()
                sig = signatures(s.column("text").cast(pa.large_string()))
                if held is None:
                    yield edge(part, 1, docs.slice(0, 1), texts[0])
                else:
                    docs, texts, sig = pa.concat_arrays([held[0], docs]), [held[1], *texts], np.concatenate([held[2], sig])
                n = len(texts) - 1
                if n:
                    yield record_batch({"part": pa.array(np.full(n, part), pa.int32()), "edge": pa.array(np.zeros(n), pa.int32()), "doc_id": docs.slice(0, n),
                                        "text": pa.nulls(n, pa.string())} | _compare(texts[:-1], texts[1:], sig[:-1], sig[1:]))
                held = docs.slice(n, 1), texts[-1], sig[-1:]
        if held is not None:
            yield edge(part, 2, held[0], held[1])
    return run


def _close(batches):
    """The ranges' last documents, each with the text that follows it."""
    for b in slices(batches):
        texts, following = b.column("text").to_pylist(), b.column("following").to_pylist()
        sig, next_sig = signatures(pa.array(texts, pa.large_string())), signatures(pa.array(following, pa.large_string()))
        yield record_batch({"doc_id": b.column("doc_id")} | _compare(texts, following, sig, next_sig))


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (second half taken from the next document, by descending id).

    Documents are range-partitioned by id once; neighbours inside a range meet
    in its task, and the ranges' ends (two rows a range) meet in a join.
    """
    docs = texts_of(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ranged = (docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))
    done = stored(arrow_map(ranged, _walk(), f"part int, edge int, doc_id {kind}, text string, {_DONE}"), "fingerprints")
    firsts = done.where("edge = 1").select("part", F.col("text").alias("following"))
    lasts = done.where("edge = 2").select("part", "doc_id", "text")
    # next range that has rows, by number alone: one row per range
    ring = W.orderBy("part")
    parts = firsts.select("part", F.lead("part").over(ring).alias("next"), F.min("part").over(ring).alias("first"))
    joined = (lasts.join(parts, "part").withColumn("to", F.coalesce("next", "first"))
              .join(firsts.withColumnRenamed("part", "to"), "to").select("doc_id", "text", "following"))
    names = ["doc_id", *[c.split()[0] for c in _DONE.split(", ")]]
    return done.where("edge = 0").select(*names).unionByName(arrow_map(joined, _close, f"doc_id {kind}, {_DONE}"))
