"""BPE encoding and decoding through a table of distinct words.

1. Texts are split on white space in Arrow maps. A block of texts (bounded by
   bytes) keeps a code per word occurrence and lists its distinct words once, dealt
   by hash into buckets. Blocks are written once, as a table bucketed by block.
2. The word lists are shuffled by bucket, so all blocks' copies of a word meet;
   there each distinct word is encoded once. A very common word is one entry per
   block, whatever its count.
3. The ids return to their block, in the order of its word lists; the blocks stay
   where they are, since their table is bucketed by the join's key. Each text's ids are
   gathered by its codes.
4. Decoding joins ids with the id-to-piece table. Its size is the tokenizer's
   vocabulary, so it is broadcast and joined by position in Arrow maps.

Defined results: null text is empty; an empty text has no ids and decodes to
''; rows with equal or null ids are kept apart, one row out per row in; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, binary_array, codes_of, gathered, large, ragged_take, record_batch, starts_of, stored_bucketed, texts_of
from .shingles import hash_strings
from .words import coder, split_words

OUT_BYTES = 8 << 20


def _squeezed(a: np.ndarray | bytes) -> bytes:
    raw = a if isinstance(a, bytes) else a.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _opened(b: bytes) -> bytes:
    return pa.decompress(memoryview(b)[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, low bytes first: high bytes of small numbers compress to nothing."""
    return _squeezed(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _unplaned(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_opened(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(buckets: int):
    def run(batches):
        context = TaskContext.get()
        task, k = context.partitionId() if context else 0, 0
        for t in gathered(batches):
            counts, codes, distinct = split_words(large(t.column("text")))
            often = np.floor(np.log2(np.maximum(np.bincount(codes, minlength=len(distinct)), 1))).astype(np.int8)
            # small codes for common words, and like words side by side: both compress
            order = pc.sort_indices(pa.table({"often": pa.array(-often), "word": distinct}), [("often", "ascending"), ("word", "ascending")])
            words = distinct.take(order)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            bucket = (hash_strings(words) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            by = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[by], np.arange(buckets + 1))
            lists = words.take(pa.array(by))
            parts = [(i, _squeezed("\n".join(lists.slice(a, b - a).to_pylist()).encode())) for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if b > a]
            yield record_batch({
                "block": pa.array([(task << 32) + k], pa.int64()),
                "ids": pa.array([t.column("doc_id").to_pylist()], pa.list_(t.schema.field("doc_id").type)),
                "counts": pa.array([_planes(counts)], pa.binary()),
                "codes": pa.array([_planes(rank[codes])], pa.binary()),
                "dealt": pa.array([_squeezed(bucket.astype("<u4"))], pa.binary()),
                "words": pa.array([[{"bucket": i, "list": w} for i, w in parts]], pa.list_(pa.struct([("bucket", pa.int32()), ("list", pa.binary())]))),
            })
            k += 1
    return run


def block_table(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of texts: ids, words per text, codes of the word occurrences, buckets of the codes, and the distinct words by bucket."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = arrow_map(docs, _blocks(buckets), f"block long, ids array<{kind}>, counts binary, codes binary, dealt binary, words array<struct<bucket:int,list:binary>>")
    return stored_bucketed(made, "bpe_blocks", "block", buckets)


def _encode(path: str):
    """Word lists of a bucket -> the words' ids, each distinct word of a batch encoded once (and word pieces once while remembered)."""
    def run(batches):
        own = coder(path)
        for b in batches:
            lists = [_opened(x).decode().split("\n") for x in b.column("list").to_pylist()]
            size = np.array([len(x) for x in lists], np.int64)
            codes, distinct = codes_of(pa.array([w for x in lists for w in x], pa.large_string()))
            ids, n = own.words(distinct.to_pylist())
            start, ends = starts_of(n)[:-1], starts_of(size)
            rows = [codes[a:z] for a, z in zip(ends[:-1], ends[1:])]
            yield record_batch({"block": b.column("block"), "bucket": b.column("bucket"),
                                "n": pa.array([_planes(n[r]) for r in rows], pa.binary()), "tokens": pa.array([_planes(ragged_take(ids, start, n, r)) for r in rows], pa.binary())})
    return run


def word_ids(blocks: DataFrame, path: str, buckets: int) -> DataFrame:
    """(block, own): for each bucket the ids of the block's words, in the order of its lists."""
    lists = blocks.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.list")
    coded = arrow_map(lists.repartition(buckets, "bucket"), _encode(path), "block long, bucket int, n binary, tokens binary")
    return coded.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "tokens"))).alias("own"))


def piece_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, width) of the pieces by id, each with a blank after it: as many as the vocabulary has."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocab.values()) + 1)
    for p, i in vocab.items():
        pieces[i] = p.encode() + b" "
    width = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), starts_of(width)[:-1], width


def decoded_texts(ids: np.ndarray, ends: np.ndarray, pieces: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """Texts of the id runs between ``ends``: their pieces with a blank between."""
    flat, start, width = pieces
    size = np.concatenate([[0], np.cumsum(width[ids])])[ends]
    chars = ragged_take(flat, start, width, ids)
    busy = np.diff(size) > 0
    keep = np.ones(len(chars), bool)
    keep[size[1:][busy] - 1] = False  # no blank after the last
    return binary_array(chars[keep], size - np.concatenate([[0], np.cumsum(busy)])).cast(pa.large_string()).cast(pa.string())


def _assemble(pieces):
    def run(batches):
        table = pieces.value
        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k] for c in b.schema.names}
                counts = _unplaned(r["counts"].as_py()).astype(np.int64)
                codes = _unplaned(r["codes"].as_py()).astype(np.int64)
                bucket = np.frombuffer(_opened(r["dealt"].as_py()), "<u4")
                own = r["own"].as_py() or []
                by = np.argsort(bucket, kind="stable")
                per = np.concatenate([_unplaned(o["n"]) for o in own]).astype(np.int64) if own else np.zeros(0, np.int64)
                flat = np.concatenate([_unplaned(o["tokens"]) for o in own]) if own else np.zeros(0, np.uint32)
                n, start = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
                n[by], start[by] = per, starts_of(per)[:-1]
                doc, ends = r["ids"].values, starts_of(counts)
                at = np.concatenate([[0], np.cumsum(n[codes])])[ends]
                first = 0
                while first < len(counts):
                    last = max(first + 1, int(np.searchsorted(at, at[first] + OUT_BYTES // 8, side="right")) - 1)
                    ids = ragged_take(flat, start, n, codes[ends[first]:ends[last]])
                    own_ends = at[first:last + 1] - at[first]
                    yield record_batch({
                        "doc_id": doc.slice(first, last - first), "n_tokens": pa.array(np.diff(own_ends), pa.int64()),
                        "ids": binary_array(ids.astype("<u4"), own_ends * 4).cast(pa.binary()), "decoded": decoded_texts(ids, own_ends, table)})
                    first = last
    return run


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (text of the ids, special tokens kept)."""
    docs = texts_of(df, id_col, text_col)
    spark = df.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = block_table(docs, buckets)
    whole = blocks.drop("words").join(word_ids(blocks, path, buckets).hint("merge"), "block", "left")
    return arrow_map(whole, _assemble(spark.sparkContext.broadcast(piece_table(path))), f"doc_id {kind}, n_tokens long, ids binary, decoded string")
