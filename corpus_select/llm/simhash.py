"""SimHash near duplicates through a hierarchical index over fingerprints in Gray order.

1. A fingerprint has the bits that are set in over half of the 64-bit hashes of a text's
   word shingles. Equal fingerprints are one code.
2. Codes are sorted by Gray rank (the rank of a code among all 64-bit numbers in Gray
   order), so neighbours differ in few bits and runs of codes share most of their leading
   ones. The order, made by a range partitioning, is cut into blocks of ``BLOCK`` codes.
3. In a block, runs of ``FANOUT`` ^ k codes are the nodes of level k. A node has the mask of
   the bits its codes share, and their values. Differences between two nodes on bits shared by
   both are differences between any two codes under them. They only grow from a node to its
   children, so a pair of nodes with more than ``RADIUS`` is dropped with all below.
4. The roots of all blocks (16 bytes a block) form the uppermost level. Each block finds
   its partners there, so blocks that are far apart never meet. Each pair of blocks that
   is left goes to one task, which descends both at once.
5. Codes already connected are not compared again, and a task returns a star per connected
   set: links grow with the codes, not with their pairs. Connected codes are one component.

Defined results: null text is empty; a text without words has fingerprint zero and links
like any other; fewer words than a shingle are one shingle; rows with the same id keep a row
each; a component without any id has a null id; an empty table gives an empty one; other
columns are not read and may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, record_batch, slices, starts_of, stored, texts_of
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
BLOCK, FANOUT, LEAF = 32768, 8, 8
ROOTS = 1 << 18  # blocks at most: beyond them blocks become larger, so the shipped level has 4 MB at most
PAIRS = 1 << 19  # pairs of nodes or codes that a task holds at once
PART_BYTES = 2 << 20  # text that is split to words at once
HEAVY = 1000  # codes with more than 1 / HEAVY of all rows (fewer than HEAVY of them) are joined apart


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased (A-Z) words between ASCII white space, repeats included."""
    words = text.encode().lower().split()  # on bytes both mean ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate([[0], ends[:-size]]).tolist()
    last = (ends[size - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(first, last)), np.uint64, len(first))


def majority(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Per group of ``per`` consecutive hashes: the bits set in over half of them (none for an empty group)."""
    out = np.zeros(len(per), np.uint64)
    busy = np.flatnonzero(per)
    if not len(busy):
        return out
    n, start = per[busy], starts_of(per)[:-1][busy]
    # eight one-byte counters in a word hold up to 255, so groups are summed in parts of 255
    parts = -(-n // 255)
    first = starts_of(parts)
    cut = np.repeat(start, parts) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], parts))
    counts = np.zeros((len(cut), 64), np.uint8)
    for a in range(0, len(cut), 1024):
        b = min(a + 1024, len(cut))
        end = cut[b] if b < len(cut) else len(hashes)
        bits = np.unpackbits(hashes[cut[a]:end].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[a:b] = np.add.reduceat(bits.view("<u8").reshape(-1, 8), cut[a:b] - cut[a], axis=0).view(np.uint8).reshape(-1, 64)
    counts = np.add.reduceat(counts, first[:-1], axis=0, dtype=np.int64)
    out[busy] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(size: int, seed: int):
    def run(batches):
        for b in slices(batches, limit=PART_BYTES):
            hashes = [shingle_hashes(t, size, seed) for t in b.column("text").to_pylist()]
            per = np.array([len(h) for h in hashes], np.int64)
            codes = majority(np.concatenate(hashes), per)
            yield record_batch({"doc_id": b.column("doc_id"), "code": pa.array(codes.view(np.int64))})
    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Stored (doc_id, code) per row; the code is the fingerprint as a signed long."""
    docs = texts_of(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(arrow_map(docs, _fingerprint(size, seed), f"doc_id {kind}, code long"), "simhash")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Where each code stands in Gray order."""
    rank = codes.astype(np.uint64, copy=True)
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


def _ranked(batches):
    for b in batches:
        rank = gray_rank(b.column("code").to_numpy().view(np.uint64))
        yield record_batch({"code": b.column("code"), "rank": pa.array((rank ^ np.uint64(1 << 63)).view(np.int64))})  # signed, in the same order


def node(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of shared bits, their values) of the runs of codes that begin at ``starts``."""
    some, all_ = np.bitwise_or.reduceat(codes, starts), np.bitwise_and.reduceat(codes, starts)
    mask = ~(some ^ all_)
    return mask, all_ & mask


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` members; places after the end hold zero."""
    out = np.zeros(-(-len(a) // width) * width, a.dtype)
    out[:len(a)] = a
    return out.reshape(-1, width)


class Tree:
    """Levels of nodes over codes in Gray order; level 0 are the leaves of ``LEAF`` codes.

    ``members[k]`` has the (mask, value) rows of the nodes (or codes) below each node of level k,
    ``sizes[k]`` how many of them there are.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.widths, self.members, self.sizes = [], [], []
        below, width = (np.full(len(codes), ~np.uint64(0)), codes), LEAF
        while True:
            self.widths.append(width)
            self.sizes.append(len(below[0]))
            self.members.append(tuple(_padded(x, FANOUT if len(self.widths) > 1 else LEAF) for x in below))
            below = node(codes, np.arange(0, len(codes), width))
            self.root = below
            if len(below[0]) <= 1:
                return
            width *= FANOUT

    def raise_to(self, levels: int) -> None:
        """Let the root stand on upper levels too."""
        while len(self.widths) < levels:
            self.widths.append(self.widths[-1] * FANOUT)
            self.sizes.append(1)
            self.members.append(tuple(_padded(x, FANOUT) for x in self.root))


class Sets:
    """Connected sets of 0 .. n - 1, joined by arrays of links; ``label`` is the least member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def _one_set(tree: Tree, label: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
    """Per node, the label all its codes have, or -1."""
    width = tree.widths[level]
    own = label[np.minimum(nodes[:, None] * width + np.arange(width), len(tree.codes) - 1)]
    return np.where((own == own[:, :1]).all(axis=1), own[:, 0], -1)


def linked(left: Tree, right: Tree | None, radius: int, sets: Sets, base: int = 0) -> None:
    """Join in ``sets`` the codes within ``radius`` bits: inside ``left`` if ``right`` is None, else across.

    Codes of ``left`` are numbered from 0, those of ``right`` from ``base``. ``PAIRS`` pairs of
    nodes or codes are compared at once, the deepest first.
    """
    same = right is None
    right = left if same else right
    top = max(len(left.widths), len(right.widths))
    for t in (left, right):
        t.raise_to(top)
    todo = [(top - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        width = FANOUT if level else LEAF
        step = PAIRS // width ** 2
        if len(i) > step:  # the others wait
            todo.append((level, i[step:], j[step:]))
            i, j = i[:step], j[:step]
        if level <= 1:  # what is connected already is not compared again
            done = _one_set(left, sets.label, level, i)
            open_ = (done < 0) | (done != _one_set(right, sets.label if same else sets.label[base:], level, j))
            i, j = i[open_], j[open_]
        (m1, v1), (m2, v2) = left.members[level], right.members[level]
        apart = v1[i][:, :, None] ^ v2[j][:, None, :]
        if level:
            apart &= m1[i][:, :, None]
            apart &= m2[j][:, None, :]
        pair, a, b = np.nonzero(np.bitwise_count(apart) <= radius)
        a, b = i[pair] * width + a, j[pair] * width + b
        keep = (a < left.sizes[level]) & (b < right.sizes[level])
        if same:
            keep &= a <= b if level else a < b
        a, b = a[keep], b[keep]
        if level:
            if len(a):
                todo.append((level - 1, a, b))
        else:
            sets.join(a, b if same else base + b)


def _runs(size: int):
    """Codes of one range, in order -> (part, at, codes) rows of at most ``size`` codes; ``at`` counts within the range."""
    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            codes = b.column("code").to_numpy().view(np.uint64)
            for a in range(0, len(codes), size):
                own = codes[a:a + size]
                yield record_batch({"part": pa.array([part], pa.int32()), "at": pa.array([at], pa.int64()), "n": pa.array([len(own)], pa.int64()), "codes": pa.array([own.tobytes()], pa.binary())})
                at += len(own)
    return run


def _dealt(before: dict[int, int], size: int):
    """Runs -> the same codes cut where a block of ``size`` codes ends."""
    def run(batches):
        for b in batches:
            for part, at, codes in zip(*(b.column(c).to_pylist() for c in ("part", "at", "codes"))):
                codes, at = np.frombuffer(codes, np.uint64), at + before[part]
                while len(codes):
                    own = codes[:size - at % size]
                    yield record_batch({"block": pa.array([at // size], pa.int64()), "at": pa.array([at], pa.int64()), "codes": pa.array([own.tobytes()], pa.binary())})
                    codes, at = codes[len(own):], at + len(own)
    return run


def _blocks(batches):
    """Runs sorted by (block, at) -> a row per block; one block is held at a time."""
    def row(block: int, held: list):
        codes = np.frombuffer(b"".join(held), np.uint64)
        mask, value = node(codes, np.zeros(1, np.int64))
        return record_batch({"block": pa.array([block], pa.int64()), "codes": pa.array([codes.tobytes()], pa.binary()),
                             "mask": pa.array(mask.view(np.int64)), "value": pa.array(value.view(np.int64))})

    held, last = [], None
    for b in batches:
        for block, codes in zip(b.column("block").to_pylist(), b.column("codes").to_pylist()):
            if block != last and held:
                yield row(last, held)
                held = []
            last = block
            held.append(codes)
    if held:
        yield row(last, held)


def gray_blocks(codes: DataFrame, n: int, size: int) -> DataFrame:
    """Stored (block, codes, mask, value): ``n`` distinct codes in Gray order, cut every ``size`` codes."""
    ranked = arrow_map(codes, _ranked, "code long, rank long")
    ordered = ranked.repartitionByRange(max(1, math.ceil(n / size)), "rank").sortWithinPartitions("rank")
    runs = stored(arrow_map(ordered, _runs(size), "part int, at long, n long, codes binary"), "simhash-runs")
    sizes = {r.part: r.n for r in runs.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row per range
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    dealt = arrow_map(runs, _dealt(before, size), "block long, at long, codes binary")
    return stored(arrow_map(dealt.repartition("block").sortWithinPartitions("block", "at"), _blocks, "block long, codes binary, mask long, value long"), "simhash-blocks")


class Roots:
    """The level above the blocks: nodes over their masks and values, in order."""

    def __init__(self, names: np.ndarray, masks: np.ndarray, values: np.ndarray):
        self.names, self.levels = names, [(masks, values)]
        while len(self.levels[-1][0]) > 1:
            masks, values = self.levels[-1]
            starts = np.arange(0, len(masks), FANOUT)
            shared = np.bitwise_and.reduceat(masks, starts)
            some, all_ = np.bitwise_or.reduceat(values & np.repeat(shared, FANOUT)[:len(values)], starts), np.bitwise_and.reduceat(values, starts)
            mask = shared & ~(some ^ (all_ & shared))
            self.levels.append((mask, all_ & mask))

    def near(self, mask: np.uint64, value: np.uint64, radius: int) -> np.ndarray:
        """The blocks a block with this mask and value has to meet."""
        at = np.zeros(1, np.int64)
        for masks, values in reversed(self.levels):
            at = at[at < len(masks)]
            at = at[np.bitwise_count((values[at] ^ value) & masks[at] & mask) <= radius]
            found, at = at, (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return self.names[found]


def _met(roots: Roots, radius: int):
    """Block rows -> a copy per block they have to meet, under the pair's name."""
    def run(batches):
        for b in batches:
            masks, values = (b.column(c).to_numpy().view(np.uint64) for c in ("mask", "value"))
            for k, (block, codes) in enumerate(zip(b.column("block").to_pylist(), b.column("codes").to_pylist())):
                for other in roots.near(masks[k], values[k], radius).tolist():
                    yield record_batch({"i": pa.array([min(block, other)], pa.int64()), "j": pa.array([max(block, other)], pa.int64()),
                                        "block": pa.array([block], pa.int64()), "codes": pa.array([codes], pa.binary())})
    return run


def _link(radius: int):
    """Rows sorted by (i, j, block) -> a star of links per connected set; a pair's two blocks are held at a time."""
    def stars(rows: list) -> pa.RecordBatch:
        codes = [np.frombuffer(c, np.uint64) for c in rows]
        sets = Sets(sum(map(len, codes)))
        if len(codes) == 1:
            linked(Tree(codes[0]), None, radius, sets)
        else:
            linked(Tree(codes[0]), Tree(codes[1]), radius, sets, len(codes[0]))
        all_ = np.concatenate(codes).view(np.int64)
        leaf = np.flatnonzero(sets.label != np.arange(len(all_)))
        return record_batch({"a": pa.array(all_[leaf]), "b": pa.array(all_[sets.label[leaf]])})

    def run(batches):
        held, pair = [], None
        for b in batches:
            for i, j, codes in zip(*(b.column(c).to_pylist() for c in ("i", "j", "codes"))):
                if pair != (i, j):
                    if held:
                        yield stars(held)
                    held, pair = [], (i, j)
                held.append(codes)
        if held:
            yield stars(held)
    return run


def gray_links(codes: DataFrame, n: int, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect what is within ``radius`` bits, over ``n`` distinct codes (column code: long)."""
    size = max(block, math.ceil(n / ROOTS))
    blocks = gray_blocks(codes, n, size)
    roots = blocks.select("block", "mask", "value").toArrow()  # at most ROOTS rows
    order = np.argsort(roots.column("block").to_numpy())
    names, mask, value = (roots.column(c).to_numpy()[order] for c in ("block", "mask", "value"))
    if not len(names):
        return codes.select(F.col("code").alias("a"), F.col("code").alias("b")).limit(0)
    pairs = arrow_map(blocks, _met(Roots(names, mask.view(np.uint64), value.view(np.uint64)), radius), "i long, j long, block long, codes binary")
    return arrow_map(pairs.repartition("i", "j").sortWithinPartitions("i", "j", "block"), _link(radius), "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED,
                    radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(doc_id, code, n_copies, component_id) per row: the fingerprint, how many rows have it, and the least id reachable by links."""
    docs = fingerprints(df, id_col, text_col, size, seed)
    codes = stored(docs.groupBy("code").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_copies")), "simhash-codes")
    n, rows = codes.agg(F.count(F.lit(1)), F.sum("n_copies")).first()
    linked_codes = components(gray_links(codes.select("code"), n, radius, block), "simhash-links")
    rooted = codes.join(linked_codes.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(least, "root").select("code", "n_copies", "component_id"), "simhash-components")
    # codes of many rows are few, so their rows stay where they are; the others' rows move to their code
    heavy = F.col("n_copies") > (rows or 0) / HEAVY
    many, few = named.where(heavy), named.where(~heavy)
    done = docs.join(F.broadcast(many), "code")
    rest = docs.join(F.broadcast(many.select("code")), "code", "left_anti").join(few, "code")
    return done.unionByName(rest).select("doc_id", "code", "n_copies", "component_id")


def hex_code(code: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(code), 16, "0"))
