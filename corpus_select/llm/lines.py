"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence per connected group.

1. Lines are normalised (words in lower case, letters and digits only, single
   blanks) and get a 128-bit class. Equal normalised lines are one class.
2. A class has a SimHash of 128 bits over its words. A word weighs as much as it has letters, up to
   ``HEAVIEST``: short words are the frequent ones, which unlike lines share.
3. The SimHash is cut into 10 blocks of 12 bits. Classes that share a block meet in it. Of the
   pairs that meet, those go on whose lengths allow the edit similarity and whose
   SimHashes differ by at most ``radius`` bits (by length), each in the first block it shares.
   Blocks are dealt to tasks by their sizes; a block value beyond ``CROWD`` classes is cut into groups
   that meet pair by pair, so no task holds an unbounded one.
4. Pairs that went on form candidate groups. Texts are fetched for their lines alone. Inside a group,
   classes whose lines have an edit similarity (by words) of at least ``SIMILARITY`` are
   linked. A pair is not compared if it is already connected there: a group gives a spanning
   forest, never all pairs. Groups beyond ``BLOCK`` classes are dealt as pairs of blocks.
5. Connected classes are one group, whose first occurrence (by id, text hash, line
   number) stays.

Lines that share no block of 12 bits, or differ by more bits than the radius, are not found: the README
has the measured share by length.

Defined results: null text is empty; lines without letters or digits stay; a
document that loses all lines stays with an empty text; rows with the same id and
the same text keep the same lines; null ids come last; extra columns pass through.
"""

from __future__ import annotations

import functools
import operator
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import codes_of, forget, gathered, large, list_lengths, one_array, record_batch, starts_of, stored
from .components import components
from .shingles import mix
from .simhash import Sets

SIMILARITY, BLOCK = 0.8, 2048
WIDTH, BLOCKS = 12, 10  # bits of a block, blocks of the 128 bits
RADIUS = ((20, 32), (50, 28), (100, 27), (1 << 30, 25))  # lines below so many words: bits that near ones may differ by
CROWD, TASK = 1 << 16, 1 << 18  # classes of a block value, and of a task, that are compared together
HEAVY = 1000  # groups of more than 1 / HEAVY of the grouped lines (fewer than HEAVY of them) are joined apart
PAIRS = 1 << 16  # pairs of classes compared at once: what a core's cache holds
HEAVIEST = 7  # the most that one word weighs
BITMAP_BITS = 23  # of the map of wanted lines: it spares work and decides nothing
CHUNK = 1 << 15  # bytes of task-wide arrays that travel together
SLICE = 4 << 20  # bytes of text that are worked on at once
OTHER = r"[^\p{L}\p{N}]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)
arrow_map = functools.partial(common.arrow_map, batch_bytes=8 << 20)  # words take several times the room of their text
_SEEDS = (np.uint64(0), np.uint64(0x6A09E667F3BCC909))
_ROW = np.dtype([("s1", "<u8"), ("s2", "<u8"), ("high", "<i8"), ("words", "<u2"), ("block", "u1"), ("side", "u1")])


def most_edits(n, similarity: float):
    """Edits that lines of at most ``n`` words may differ by, as ``edit_similarity`` has it."""
    return ((1 - similarity) * np.asarray(n) + 1e-9).astype(np.int64)


def least_words(similarity: float) -> int:
    """Lines of fewer words are near none but themselves."""
    return next(n for n in range(1, 1 << 20) if most_edits(n + 1, similarity) > 0) if similarity < 1 else 1 << 30


def normal_words(words: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(words), OTHER, "")


def normal_line(line: str) -> str:
    """The normalised line, as the classes have it."""
    return " ".join(w for w in normal_words(pa.array(_SPLIT.split(line), pa.string())).to_pylist() if w)


_SPLIT = re.compile("[ \t\n\r\x0b\x0c]+")


# -- arrays that all tasks add up -----------------------------------------------------

def _sent(array: np.ndarray):
    raw = array.tobytes()
    return record_batch({"chunk": pa.array(range(-(-len(raw) // CHUNK)), pa.int32()), "data": pa.array([raw[a:a + CHUNK] for a in range(0, len(raw), CHUNK)], pa.binary())})


def _met(how, kind: str):
    """Rows sorted by chunk -> one row per chunk."""
    def run(batches):
        last, held = None, None
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist()):
                own = np.frombuffer(data, kind)
                if chunk == last:
                    held = how(held, own)
                    continue
                if last is not None:
                    yield record_batch({"chunk": pa.array([last], pa.int32()), "data": pa.array([held.tobytes()], pa.binary())})
                last, held = chunk, own
        if last is not None:
            yield record_batch({"chunk": pa.array([last], pa.int32()), "data": pa.array([held.tobytes()], pa.binary())})
    return run


def _over_tasks(df: DataFrame, fn, how, kind: str, size: int) -> np.ndarray:
    """The arrays of all tasks (``fn`` yields one each), combined chunk by chunk; ``size`` is a constant of this module."""
    rows = arrow_map(df, fn, "chunk int, data binary").repartition("chunk").sortWithinPartitions("chunk")
    found = sorted((r.chunk, r.data) for r in arrow_map(rows, _met(how, kind), "chunk int, data binary").collect())
    return np.frombuffer(b"".join(d for _, d in found), kind) if found else np.zeros(size, kind)


# -- classes and SimHashes ------------------------------------------------------------

def word_codes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word: its 8-byte blocks mixed in one after the other, all words at once."""
    raw = words.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, np.int64)[raw.offset:raw.offset + len(raw) + 1]
    padded = np.zeros((data.size if data else 0) + 8, np.uint8)
    if data:
        padded[:data.size] = np.frombuffer(data, np.uint8)
    anywhere = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    start, size = ends[:-1], np.diff(ends)
    out = mix(size.astype(np.uint64) + _STEP)
    at, k = np.flatnonzero(size > 0), 0
    while len(at):
        left = size[at] - k
        block = anywhere[start[at] + k]
        short = left < 8
        block[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        out[at] = mix(out[at] ^ block)
        k += 8
        at = at[left > 8]
    return out


def _line_words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words per line, code per word, hash per distinct word, weight per distinct word) of the normalised lines."""
    lists = pc.ascii_split_whitespace(lines)
    codes, distinct = codes_of(lists.flatten())
    normal = normal_words(distinct)
    if not len(distinct):
        return list_lengths(lists), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    keep = (pc.binary_length(normal).to_numpy(zero_copy_only=False) > 0)[codes]
    ends = np.concatenate([[0], np.cumsum(keep)])[starts_of(list_lengths(lists))]
    return np.diff(ends), codes[keep], word_codes(normal), np.minimum(pc.utf8_length(normal).to_numpy(zero_copy_only=False), HEAVIEST).astype(np.uint8)


# a byte's bits as eight one-byte counters
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def simhashes(per: np.ndarray, codes: np.ndarray, hashes: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit SimHashes per line: bits set in over half of its words' weight."""
    out = [np.zeros(len(per), np.uint64) for _ in _SEEDS]
    busy = np.flatnonzero(per)
    if not len(busy):
        return out
    n, start = per[busy], starts_of(per)[:-1][busy]
    total = np.add.reduceat(own[codes].astype(np.int64), start)
    # eight one-byte counters in a word hold up to 255, so the words of a line are summed 36 at a time
    parts = -(-n // 36)
    first = starts_of(parts)
    cut = np.repeat(start, parts) + 36 * (np.arange(first[-1]) - np.repeat(first[:-1], parts))
    # both SimHashes' counters of a word stand side by side, so a word's are gathered at once
    mixed = np.stack([mix(hashes ^ seed) for seed in _SEEDS], axis=1).astype("<u8").view(np.uint8).reshape(-1, 16)
    table = _LANES[mixed] * own[:, None].astype(np.uint64)
    counts = np.zeros((len(cut), 128), np.uint8)
    for a in range(0, len(cut), 2048):
        b = min(a + 2048, len(cut))
        end = cut[b] if b < len(cut) else len(codes)
        counts[a:b] = np.add.reduceat(table[codes[cut[a]:end]], cut[a:b] - cut[a], axis=0).view(np.uint8).reshape(-1, 128)
    sums = np.add.reduceat(counts, first[:-1], axis=0, dtype=np.int32)
    bits = np.packbits(2 * sums > total[:, None], axis=1, bitorder="little").view("<u8")
    for k in range(len(_SEEDS)):
        out[k][busy] = bits[:, k]
    return out


def line_hashes(lines: pa.Array) -> tuple[np.ndarray, ...]:
    """(words, class high, class low, SimHash, SimHash) per line."""
    per, codes, hashes, weights = _line_words(lines)
    n, ends = len(per), starts_of(per)
    high, low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    busy = per > 0
    if len(codes):
        h, at = hashes[codes], ends[:-1][busy]
        place = np.arange(len(h), dtype=np.uint64) - np.repeat(ends[:-1].astype(np.uint64), per)
        high[busy] = mix(np.add.reduceat(mix(h + place * _STEP), at))
        low[busy] = mix(np.add.reduceat(mix((h ^ _STEP) * np.uint64(0xD1342543DE82EF95) + place * np.uint64(0xA0761D6478BD642F)), at))
    return per, high, low, *simhashes(per, codes, hashes, weights)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def raw_hashes(lines: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines.cast(pa.large_binary()).to_pylist()), np.uint64, len(lines))


def _hash_lines(batches):
    for t in gathered(batches, limit=SLICE):
        lists = pc.split_pattern(large(t.column("text")), "\n")
        per, flat = list_lengths(lists), lists.flatten()
        row = np.repeat(np.arange(len(per)), per)
        number = np.arange(len(row)) - np.repeat(starts_of(per)[:-1], per)
        words, high, low, s1, s2 = line_hashes(flat)
        keep = np.flatnonzero(words > 0)
        rows = pa.array(row[keep])
        yield record_batch({"doc_id": one_array(t.column("doc_id")).take(rows), "version": one_array(t.column("version")).take(rows), "line": pa.array(number[keep], pa.int32()),
                            "high": _signed(high[keep]), "low": _signed(low[keep]), "words": pa.array(words[keep], pa.int32()), "raw": _signed(raw_hashes(flat.take(pa.array(keep)))),
                            "s1": _signed(s1[keep]), "s2": _signed(s2[keep])})


def line_table(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, version, line, high, low, words, raw, s1, s2) of every line with words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(arrow_map(docs, _hash_lines, f"doc_id {kind}, version long, line int, high long, low long, words int, raw long, s1 long, s2 long"), "lines")


# -- candidates -----------------------------------------------------------------------

def block_values(s1: np.ndarray, s2: np.ndarray, block: int) -> np.ndarray:
    """Bits 12 b to 12 b + 11 of the 128."""
    at = block * WIDTH
    if at >= 64:
        v = s2 >> np.uint64(at - 64)
    else:
        v = s1 >> np.uint64(at)
        if at + WIDTH > 64:
            v = v | s2 << np.uint64(64 - at)
    return (v & np.uint64((1 << WIDTH) - 1)).astype(np.int64)


def _count_blocks(batches):
    counts = np.zeros(BLOCKS << WIDTH, np.int64)
    for b in batches:
        s1, s2 = (b.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2"))
        for k in range(BLOCKS):
            counts += np.bincount((k << WIDTH) + block_values(s1, s2, k), minlength=len(counts))
    yield _sent(counts)


def deal_blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bucket, groups) per block value: small ones share a bucket, one beyond ``CROWD`` has a bucket per pair of its groups."""
    groups = np.maximum(1, -(-counts // CROWD))
    small = np.where(groups == 1, counts, 0)
    bucket = (np.cumsum(small) - small) // TASK
    own = np.where(groups > 1, groups * (groups + 1) // 2, 0)
    return np.where(groups > 1, int(bucket.max(initial=0)) + 1 + np.cumsum(own) - own, bucket), groups


def _deal(counts: np.ndarray):
    """Classes -> packed rows per bucket."""
    first, groups = deal_blocks(counts)

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            rows = np.zeros(n, _ROW)
            rows["s1"], rows["s2"] = (b.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2"))
            rows["high"], rows["words"] = b.column("high").to_numpy(), np.minimum(b.column("words").to_numpy(), 65535)
            rows["side"] = 2
            spread = (mix(rows["high"].view(np.uint64)) >> np.uint64(20)).astype(np.int64)
            buckets, parts = [], []
            for k in range(BLOCKS):
                rows["block"] = k
                key = (k << WIDTH) + block_values(rows["s1"], rows["s2"], k)
                g = groups[key]
                buckets.append(first[key[g == 1]])
                parts.append(rows[g == 1])
                own = spread % g
                for other in range(int(g.max()) if g.max() > 1 else 0):  # a crowded value: its classes meet every group of it
                    at = np.flatnonzero((g > 1) & (g > other))
                    x, y = np.minimum(own[at], other), np.maximum(own[at], other)
                    copy = rows[at]
                    copy["side"] = np.where(x == y, 2, own[at] > other)
                    buckets.append(first[key[at]] + x * g[at] - x * (x - 1) // 2 + y - x)
                    parts.append(copy)
            bucket, all_ = np.concatenate(buckets), np.concatenate(parts)
            order = np.argsort(bucket, kind="stable")
            bucket, all_ = bucket[order], all_[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(at[1:], len(bucket))
            yield record_batch({"bucket": pa.array(bucket[at], pa.int64()), "rows": pa.array([all_[x:y].tobytes() for x, y in zip(at.tolist(), ends.tolist())], pa.binary())})
    return run


def _radius(words: np.ndarray) -> np.ndarray:
    return np.array([r for _, r in RADIUS])[np.searchsorted([n for n, _ in RADIUS], words, side="right")]


def keys_of(rows: np.ndarray) -> np.ndarray:
    """Block and block value of packed rows."""
    out = rows["block"].astype(np.int64) << WIDTH
    for k in np.unique(rows["block"]).tolist():
        at = rows["block"] == k
        out[at] |= block_values(rows["s1"][at], rows["s2"][at], k)
    return out


def near_pairs(rows: np.ndarray, similarity: float):
    """Pairs (i, j) of rows, in parts, that share a block value, may be near by length and are by SimHash, in the first block they share."""
    n, block, key = rows["words"].astype(np.int64), rows["block"].astype(np.int64), keys_of(rows)
    order = np.lexsort((n, key))
    key, n, block, s1, s2, side = key[order], n[order], block[order], rows["s1"][order], rows["s2"][order], rows["side"][order]
    # rows of a key in order of length: the fewest words a longer line may be near to grow with it
    end = np.searchsorted(key << 20 | (n - most_edits(n, similarity)), key << 20 | n, side="right")
    per = np.maximum(end - np.arange(len(n)) - 1, 0)
    total, a = np.cumsum(per), 0
    radius = _radius(n)
    while a < len(n):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        i = np.repeat(np.arange(a, b), per[a:b])
        j = np.arange(len(i)) - np.repeat(total[a:b] - per[a:b] - done, per[a:b]) + i + 1
        a = b
        x1, x2 = s1[i] ^ s1[j], s2[i] ^ s2[j]
        near = np.bitwise_count(x1).astype(np.int16) + np.bitwise_count(x2) <= radius[j]
        near &= (side[i] == 2) | (side[i] != side[j])  # of two groups, pairs across them
        i, j, x1, x2 = i[near], j[near], x1[near], x2[near]
        for k in range(BLOCKS - 1):  # shared in an earlier block: that one has it
            earlier = (block[i] > k) & (block_values(x1, x2, k) == 0)
            i, j, x1, x2 = i[~earlier], j[~earlier], x1[~earlier], x2[~earlier]
        yield order[i], order[j]


def _candidates(similarity: float):
    """Packed rows sorted by bucket -> (group, high) of the rows in a near pair; one bucket is held at a time."""
    def groups(bucket: int, parts: list[bytes]):
        rows = np.frombuffer(b"".join(parts), _ROW)
        sets, hit = Sets(len(rows)), np.zeros(len(rows), bool)
        waiting, n = [], 0
        for i, j in near_pairs(rows, similarity):
            hit[i] = hit[j] = True
            waiting.append((i, j))
            n += len(i)
            if n > 16 * PAIRS:  # joining passes over all labels, so many pairs are joined at once
                sets.join(*map(np.concatenate, zip(*waiting)))
                waiting, n = [], 0
        if waiting:
            sets.join(*map(np.concatenate, zip(*waiting)))
        at = np.flatnonzero(hit)
        # a group is named by its block value, bucket and least member, so a task that is run again names it alike
        least = rows["high"].copy()
        np.minimum.at(least, sets.label, rows["high"])
        key = keys_of(rows)[at].astype(np.uint64)
        name = mix(mix(least[sets.label[at]].view(np.uint64)) + mix(key + np.uint64(1)) + mix(np.full(1, bucket, np.uint64) + _STEP))
        return record_batch({"key": _signed(name), "high": pa.array(rows["high"][at])})

    def run(batches):
        last, held = None, []
        for b in batches:
            for bucket, rows in zip(b.column("bucket").to_pylist(), b.column("rows").to_pylist()):
                if held and bucket != last:
                    yield groups(last, held)
                    held = []
                last = bucket
                held.append(rows)
        if held:
            yield groups(last, held)
    return run


def candidates(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Stored (key, high): candidate groups of classes (high, words, s1, s2)."""
    rows = classes.where(F.col("words") >= least_words(similarity)).select("high", "words", "s1", "s2")
    counts = _over_tasks(rows.select("s1", "s2"), _count_blocks, np.add, "<i8", BLOCKS << WIDTH)
    dealt = arrow_map(rows, _deal(counts), "bucket long, rows binary")
    return stored(arrow_map(dealt.repartition("bucket").sortWithinPartitions("bucket"), _candidates(similarity), "key long, high long"), "line-candidates")


# -- verification ---------------------------------------------------------------------

def edit_similarity(a, b, least: float) -> bool:
    """Whether 1 - distance / longer length is at least ``least``, for strings or lists of words; bit-parallel over the part that differs."""
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if len(a) == len(b) and sum(map(operator.ne, a, b)) <= most:  # replacements alone suffice
        return True
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i:len(a) - j], b[i:len(b) - j]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b) <= most
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    where: dict = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    up, down, score = mask, 0, len(a)
    for k, c in enumerate(b):
        eq = where.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        plus, minus = down | (~(d | up) & mask), up & d
        if plus & top:
            score += 1
        if minus & top:
            score -= 1
        if score - (len(b) - 1 - k) > most:
            return False
        plus = (plus << 1 | 1) & mask
        minus = (minus << 1) & mask
        up, down = minus | (~(d | plus) & mask), plus & d
    return score <= most


def spanning_links(nodes: list[int], words: list[list[str]], sides: list[int], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect what is near by edit similarity; with two sides, only pairs across them count."""
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(nodes) <= 8:  # most groups: counting words would take longer than comparing them
        out = []
        for i in range(1, len(nodes)):
            for j in range(i):
                u, v = find(i), find(j)
                if u != v and (sides[0] == sides[-1] or sides[i] != sides[j]) and edit_similarity(words[i], words[j], similarity):
                    out.append((nodes[i], nodes[j]))
                    parent[u] = v
        return out
    # counts of the words in 256 buckets: each edit changes them by two at most
    own: dict[str, int] = {}
    counts = np.stack([np.bincount([own.setdefault(w, len(own)) & 255 for w in x], minlength=256) for x in words]).astype(np.int32)
    out, side, size = [], np.array(sides), np.array([len(x) for x in words])
    two = side[0] != side[-1]
    for i in range(1, len(nodes)):
        most = most_edits(np.maximum(size[:i], size[i]), similarity)
        close = np.abs(size[:i] - size[i]) <= most
        if two:
            close &= side[:i] != side[i]
        js = np.flatnonzero(close)
        js = js[np.abs(counts[js] - counts[i]).sum(axis=1) <= 2 * most[js]]
        for j in js.tolist():
            u, v = find(i), find(j)
            if u != v and edit_similarity(words[i], words[j], similarity):
                out.append((nodes[i], nodes[j]))
                parent[u] = v
    return out


def _link(similarity: float):
    """Rows sorted by (key, i, j, side) -> links; one key (or pair of blocks of it) is held at a time."""
    def run(batches):
        held, key, out = [], None, []

        def close():
            if len(held) > 1:
                out.extend(spanning_links(*(list(c) for c in zip(*held)), similarity))

        def flush():
            return record_batch({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

        for b in batches:
            for k, i, j, side, node, text in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "side", "node", "text"))):
                if key != (k, i, j):
                    close()
                    held, key = [], (k, i, j)
                    if len(out) > 50_000:
                        yield flush()
                        out = []
                held.append((node, text.split(" "), side))
        close()
        yield flush()
    return run


def _normalise(batches):
    for b in batches:
        lists = pc.ascii_split_whitespace(b.column("text").cast(pa.large_string()))
        codes, distinct = codes_of(lists.flatten())
        words = normal_words(distinct).to_pylist()
        ends = starts_of(list_lengths(lists)).tolist()
        yield record_batch({"high": b.column("high"), "text": pa.array([" ".join(words[c] for c in codes[x:y] if words[c]) for x, y in zip(ends[:-1], ends[1:])], pa.string())})


def _mark_wanted(batches):
    bits = np.zeros(1 << BITMAP_BITS, bool)
    for b in batches:
        bits[b.column("raw").to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS)] = True
    yield _sent(np.packbits(bits))


def _wanted_lines(bitmap: np.ndarray):
    def run(batches):
        bits = np.unpackbits(bitmap).astype(bool)
        for t in gathered(batches, limit=SLICE):
            flat = pc.split_pattern(large(t.column("text")), "\n").flatten()
            raw = raw_hashes(flat)
            at = np.flatnonzero(bits[raw >> np.uint64(64 - BITMAP_BITS)])
            at = at[np.unique(raw[at], return_index=True)[1]]
            yield record_batch({"raw": _signed(raw[at]), "text": flat.take(pa.array(at)).cast(pa.string())})
    return run


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored (high, text), normalised, of the wanted classes (high, raw): documents are read again, and lines of a map of the wanted ones leave the scan."""
    bitmap = _over_tasks(wanted.select("raw"), _mark_wanted, np.bitwise_or, "u1", 1 << BITMAP_BITS - 3)
    lines = arrow_map(docs.select("text"), _wanted_lines(bitmap), "raw long, text string")
    texts = lines.join(wanted, "raw").groupBy("high").agg(F.first("text").alias("text"))
    return stored(arrow_map(texts, _normalise, "high long, text string"), "line-texts")


def fuzzy_links(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): links between classes, named by ``high``; and the stored tables they are read from."""
    found = candidates(classes, similarity)
    wanted = stored(classes.join(found.select("high").distinct().hint("shuffle_hash"), "high", "left_semi").select("high", "raw"), "line-wanted")
    texts = line_texts(docs, wanted)
    # groups beyond BLOCK classes become pairs of blocks of their classes
    sizes = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("high"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = found.join(sizes, "key").withColumn("own", own).select("key", "high", "own", F.explode(pairs).alias("p"))
    rows = dealt.join(texts, "high").select("key", "p.i", "p.j", F.col("own").alias("side"), F.col("high").alias("node"), "text")
    return arrow_map(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side"), _link(similarity), "a long, b long").distinct(), [found, wanted, texts]


def line_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(documents with their version, dropped lines: doc_id, version, lines)."""
    docs = df.withColumn("__text", F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).select(F.col(f"`{id_col}`").alias("doc_id"), F.col("__text").alias("text"), F.xxhash64("__text").alias("version"))
    lines = line_table(docs)
    classes = stored(lines.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("words", "raw", "s1", "s2")]), "line-classes")
    links, used = fuzzy_links(docs, classes, similarity)
    linked = components(links, "line-links")
    forget(*used)
    # lines that are equal or linked to others; a class that is not linked is its own group
    named = classes.join(linked.withColumnRenamed("node", "high").hint("shuffle_hash"), "high", "left").where("root is not null or n > 1").select("high", "low", F.coalesce("root", "high").alias("group"))
    together = stored(lines.select("doc_id", "version", "line", "high", "low").join(named.hint("shuffle_hash"), ["high", "low"]).drop("high", "low"), "line-groups")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version", "line")
    firsts = stored(together.groupBy("group").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "line-firsts")
    # groups of many lines are few: their first lines are shipped, and only the other groups' lines move
    total = firsts.agg(F.sum("n")).first()[0] or 0
    many = F.broadcast(firsts.where(F.col("n") > total / HEAVY).drop("n"))
    both = together.join(many, "group").unionByName(together.join(many.select("group"), "group", "left_anti").join(firsts.where(F.col("n") <= total / HEAVY).drop("n"), "group"))
    moved = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version")) & (F.col("line") == F.col("first.line")))
    dropped = both.where(moved).groupBy("doc_id", "version").agg(F.collect_set("line").alias("lines"))
    return docs, dropped


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with the text's repeated lines taken out; all rows and columns stay."""
    names = df.columns
    _, dropped = line_groups(df, id_col, text_col, similarity)
    base = df.toDF(*[f"c{i}" for i in range(len(names))])
    doc, text = F.col(f"c{names.index(id_col)}"), F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit(""))
    # line numbers are hashed and not sorted beside the texts: a partition has few of them
    lists = dropped.select(F.col("doc_id").alias("d"), F.col("version").alias("w"), F.col("lines").alias("gone")).hint("shuffle_hash")
    marked = base.withColumn("v", F.xxhash64(text)).join(lists, F.col("v").eqNullSafe(F.col("w")) & doc.eqNullSafe(F.col("d")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = [F.when(F.col("gone").isNull(), F.col(f"c{i}")).otherwise(kept).alias(f"c{i}") if n == text_col else F.col(f"c{i}") for i, n in enumerate(names)]
    return marked.select(*out).toDF(*names)
