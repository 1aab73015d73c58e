"""Best-fit packing of texts' tokens into sequences of one capacity.

Packing sees only lengths, so it is planned on their histogram (at most
``capacity`` numbers, whatever the corpus) and carried out by Spark:

1. Pieces longer than a third of the capacity are matched greedily, the longest
   with the longest that still fits beside it: at most two of them share a sequence.
2. Shorter pieces, in decreasing length, go where the least room is left that
   holds them; equal sequences are handled together as an interval of numbers.
3. The plan says, for each length, which sequences its 1st, 2nd, ... piece
   takes. A piece's number within its length is its place in its task's file plus
   the counts of the files before; no window spans a length.

The plan has at most a few segments per (length, interval): its size depends on
the capacity alone and is what is broadcast.

Defined results: null text is empty; an empty text is one piece (its end id
alone); equal or null ids stay separate rows; an empty table packs to nothing.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, gathered, large, one_array, ragged_take, record_batch, starts_of, stored, texts_of
from .words import coder, split_words

SEGMENTS = "length int, first long, count long, bin long, per int, offset int"


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first, count, bin, per, offset).

    Of the pieces of ``length``, those numbered ``first`` to ``first + count - 1``
    go, ``per`` to a sequence, to the sequences from ``bin`` on; the j-th of a
    sequence starts at ``offset + j * length``.
    """
    left = {n: c for n, c in lengths.items() if c > 0}
    used = dict.fromkeys(left, 0)
    room: dict[int, list[tuple[int, int]]] = {}  # gap -> intervals (first sequence, count)
    out, bins = [], 0

    def put(n: int, count: int, at: int, per: int) -> None:
        out.append((n, used[n], count, at, per, 0))
        used[n] += count
        left[n] -= count

    big = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in big:
        while left[n]:
            fit = next((m for m in big if m <= capacity - n and left[m] > (m == n)), None)
            if fit is None:
                count = left[n]
                put(n, count, bins, 1)
                gap = capacity - n
            elif fit == n:
                count = left[n] // 2
                put(n, 2 * count, bins, 2)
                gap = capacity - 2 * n
            else:
                count = min(left[n], left[fit])
                put(n, count, bins, 1)
                out.append((fit, used[fit], count, bins, 1, n))
                used[fit] += count
                left[fit] -= count
                gap = capacity - n - fit
            if gap:
                room.setdefault(gap, []).append((bins, count))
            bins += count
    gaps = list(room)
    heapq.heapify(gaps)
    open_gaps = sorted(room)
    for n in sorted((n for n in left if 3 * n <= capacity and left[n]), reverse=True):
        while left[n]:
            k = int(np.searchsorted(open_gaps, n))
            if k == len(open_gaps):
                per = capacity // n
                whole, rest = divmod(left[n], per)
                for count, each in ((whole, per), (1 if rest else 0, rest)):
                    if count:
                        out.append((n, used[n], count * each, bins, each, 0))
                        used[n] += count * each
                        left[n] -= count * each
                        if gap := capacity - each * n:
                            if gap not in room:
                                open_gaps.insert(int(np.searchsorted(open_gaps, gap)), gap)
                            room.setdefault(gap, []).append((bins, count))
                        bins += count
                break
            gap = open_gaps[k]
            at, count = room[gap].pop()
            if not room[gap]:
                del room[gap]
                del open_gaps[k]
            per = gap // n
            whole = min(count, left[n] // per)
            rest = left[n] - whole * per if whole < count else 0
            pieces = [(at, whole, per), (at + whole, 1 if rest else 0, rest), (at + whole + (1 if rest else 0), count - whole - (1 if rest else 0), 0)]
            for first, many, each in pieces:
                if not many:
                    continue
                if each:
                    out.append((n, used[n], many * each, first, each, capacity - gap))
                    used[n] += many * each
                    left[n] -= many * each
                if new := gap - each * n:
                    if new not in room:
                        open_gaps.insert(int(np.searchsorted(open_gaps, new)), new)
                    room.setdefault(new, []).append((first, many))
    return out


def _cut(path: str, capacity: int, end: int, keep_ids: bool):
    def run(batches):
        own, seen, file = coder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for t in gathered(batches):
            counts, codes, distinct = split_words(large(t.column("text")))
            ids, n = own.words(distinct.to_pylist())
            word_start = starts_of(n)[:-1]
            ends = starts_of(counts)
            tokens = np.concatenate([[0], np.cumsum(n[codes])])[ends]
            total = np.diff(tokens) + 1  # with the end id
            flat = ragged_take(ids, word_start, n, codes)
            # room for each text's end id
            whole = np.full(int(total.sum()), end, np.uint32)
            keep = np.ones(len(whole), bool)
            keep[np.cumsum(total) - 1] = False
            whole[keep] = flat
            pieces = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), pieces)
            piece = np.arange(len(doc)) - np.repeat(starts_of(pieces)[:-1], pieces)
            start = piece * capacity
            length = np.minimum(capacity, total[doc] - start)
            at = starts_of(total)[:-1][doc] + start
            raw = memoryview(whole.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a:4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())]
            # number within the length, in this file
            order = np.argsort(length, kind="stable")
            same = length[order]
            new = np.concatenate([[True], same[1:] != same[:-1]])
            run_start = np.maximum.accumulate(np.where(new, np.arange(len(same)), 0))
            number = np.empty(len(same), np.int64)
            number[order] = np.arange(len(same)) - run_start
            number += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = {
                "doc_id": one_array(t.column("doc_id")).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "file": pa.array(np.full(len(doc), file), pa.int32()), "number": pa.array(number, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array([bytes(raw[4 * a:4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())], pa.binary())
            yield record_batch(columns)
    return run


def cut_texts(df: DataFrame, path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Stored pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, file, number (within file and length)."""
    docs = texts_of(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, file int, number long" + ", ids binary" * keep_ids
    return stored(arrow_map(docs, _cut(path, capacity, end, keep_ids), schema), "pack-pieces")


def _place(segments):
    """Sequence and offset from (length, number within the length)."""
    length, first, _, at, per, offset = (np.asarray(c, np.int64) for c in zip(*segments)) if segments else (np.zeros(0, np.int64),) * 6
    order = np.lexsort((first, length))
    length, first, at, per, offset = (c[order] for c in (length, first, at, per, offset))

    def run(batches):
        for b in batches:
            n, k = b.column("length").to_numpy(), b.column("number").to_numpy()
            lo, hi = np.searchsorted(length, n, side="left"), np.searchsorted(length, n, side="right")
            # last segment of the length that starts at or before k
            while (open_ := hi - lo > 1).any():
                mid = (lo + hi) // 2
                up = open_ & (first[mid] <= k)
                lo, hi = np.where(up, mid, lo), np.where(open_ & ~up, mid, hi)
            j = k - first[lo]
            out = {c: b.column(c) for c in b.schema.names if c != "number"}
            out["sequence_id"] = pa.array(at[lo] + j // per[lo], pa.int64())
            out["offset"] = pa.array(offset[lo] + j % per[lo] * n, pa.int64())
            yield record_batch(out)
    return run


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Stored pieces (from ``cut_texts``) with sequence_id and offset; offsets are gapless within a sequence."""
    per_file = pieces.groupBy("length", "file").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in per_file.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    segments = plan(histogram, capacity)
    # files before this one, by length: a window over counts, one row per file and length
    before = per_file.select("length", "file", (F.sum("n").over(W.partitionBy("length").orderBy("file")) - F.col("n")).alias("before"))
    numbered = pieces.join(before, ["length", "file"]).withColumn("number", F.col("number") + F.col("before"))
    names = [c for c in pieces.columns if c not in ("file", "number")]
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    return arrow_map(numbered.select(*names, "number"), _place(segments), ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")
