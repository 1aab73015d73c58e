"""Near-duplicate join on word shingles: a MinHash LSH forest with exact verification.

1. Texts become words (lower case, letters and digits only) and sets of five-word
   shingles. Texts with the same words are one class; only classes are compared.
2. A class has ``TREES`` x ``DEPTH`` MinHash values. Each tree is a trie over its
   ``DEPTH`` values, kept as rows sorted by tree and values. Along the sorted rows, each class is
   linked to the first one of the deepest prefix it shares: a prefix of n classes
   gives n - 1 links, never its pairs.
3. A pair of similarity s shares a prefix of length d in some tree with probability
   1 - (1 - s^d)^TREES. The search starts with the longest prefixes and shortens them until the
   share of weak links that they show reaches ``RECALL``; see ``prefix_length``. Each class counts
   once there, so no large family decides it for the others. Classes joined by links of that prefix
   are a family, and all pairs inside it are verified.
4. In a family, pairs first compare their MinHash values (a pair at the threshold fails
   that by chance once in tens of thousands), then their whole shingle sets. Families
   beyond ``BLOCK`` classes are dealt as pairs of blocks. A task gives each class's number
   of links and a spanning forest, so nothing that leaves it grows with the pairs.

Defined results: null text is empty; texts without words are one class and are
near nothing else; texts of one to four words have one shingle of them all; rows
with the same id and text are one document listed as often as it occurs; null ids
come last; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, codes_of, gathered, large, list_lengths, one_array, record_batch, slices, starts_of, stored
from .components import components
from .lines import normal_words
from .shingles import hash_strings, mix, shingle_hashes

TREES, DEPTH, FLOOR = 24, 8, 6
SIMILARITY, RECALL, SIZE = 0.8, 0.999, 5
SLACK = 0.12  # sketches of TREES * DEPTH values: over four standard deviations at the threshold
BLOCK = 512

_A = (mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) + np.uint64(1 << 32)) >> np.uint64(32)).astype(np.uint32)


def normal_word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words per text, hash per word) of the normalised words; a word without letters and digits is none."""
    lists = pc.ascii_split_whitespace(texts)
    codes, distinct = codes_of(lists.flatten())
    per = list_lengths(lists)
    if not len(distinct):
        return per, np.zeros(0, np.uint64)
    normal = normal_words(distinct)
    keep = (pc.binary_length(normal).to_numpy(zero_copy_only=False) > 0)[codes]
    ends = np.concatenate([[0], np.cumsum(keep)])[starts_of(per)]
    return np.diff(ends), hash_strings(normal)[codes[keep]]


def minhashes(per: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(texts, TREES * DEPTH) low 16 bits of the minima."""
    count, hashes = shingle_hashes(per, words, SIZE)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    starts = starts_of(count)
    out = np.empty((len(count), len(_A)), np.uint16)
    i = 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + 4096, side="right")) - 1)
        part = np.full((j - i, len(_A)), 0xFFFFFFFF, np.uint32)
        for a in range(int(starts[i]), int(starts[j]), 4096):  # a very long text goes in parts
            b = min(a + 4096, int(starts[j]))
            own = np.maximum(starts[i:j] - a, 0)
            live = (own < b - a) & (starts[i + 1:j + 1] > a)
            values = (h[a:b, None] ^ _B) * _A
            part[live] = np.minimum(part[live], np.minimum.reduceat(values, own[live], axis=0))
        out[i:j] = part & np.uint32(0xFFFF)
        i = j
    return out


def _describe(batches):
    for t in gathered(batches, limit=12 << 20):
        texts = large(t.column("text"))
        per, words = normal_word_hashes(texts)
        place = np.arange(len(words), dtype=np.uint64) - np.repeat(starts_of(per)[:-1].astype(np.uint64), per)
        busy, at = per > 0, starts_of(per)[:-1][per > 0]
        high, low = np.zeros(len(per), np.uint64), np.zeros(len(per), np.uint64)
        if len(words):
            high[busy] = mix(np.add.reduceat(mix(words + place * np.uint64(0x9E3779B97F4A7C15)), at))
            low[busy] = mix(np.add.reduceat(mix((words ^ np.uint64(0xA0761D6478BD642F)) + place * np.uint64(0xD1342543DE82EF95)), at))
        values = minhashes(per, words)
        yield record_batch({"doc_id": one_array(t.column("doc_id")), "version": one_array(t.column("version")), "high": pa.array(high.view(np.int64)), "low": pa.array(low.view(np.int64)),
                            "values": pa.array([v.tobytes() for v in values], pa.binary())})


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))


def _trie_rows(batches):
    """A class's row in each tree: the tree's values, first four and last four, as sortable numbers."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        v = np.frombuffer(b"".join(b.column("values").to_pylist()), np.uint16).reshape(n, TREES, 2, 4).astype(np.uint64)
        word = (v << np.array([48, 32, 16, 0], np.uint64)).sum(axis=3, dtype=np.uint64)
        for k in range(0, n, 1000):
            m = min(1000, n - k)
            yield record_batch({"tree": pa.array(np.tile(np.arange(TREES, dtype=np.int32), m)), "front": pa.array(word[k:k + m, :, 0].ravel().view(np.int64)),
                                "back": pa.array(word[k:k + m, :, 1].ravel().view(np.int64)), "node": pa.array(np.repeat(b.column("high").to_numpy()[k:k + m], TREES))})


def _trie_links(batches):
    """Sorted rows of the tries -> (a, b, depth): each row and the first row of the deepest prefix it shares.

    Rows come sorted by (prefix, back, node); what is kept between batches is the last
    row and the first node of its prefix at each depth.
    """
    shifts = [16 * (DEPTH - d) for d in range(FLOOR, DEPTH + 1)]
    last, firsts = None, None
    for batch in batches:
        prefix, node, back = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("prefix", "node", "back"))
        if not len(prefix):
            continue
        b = back.view(np.uint64)
        first_of, starts = [], []
        for level, shift in enumerate(shifts):
            key = (b >> np.uint64(shift)) if shift < 32 else np.zeros(len(b), np.uint64)
            new = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (key[1:] != key[:-1])])
            goes_on = last is not None and last[0] == prefix[0] and (shift >= 32 or last[1] >> shift == int(b[0]) >> shift)
            new[0] = not goes_on
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            first_of.append(np.where(at >= 0, node[np.maximum(at, 0)], firsts[level] if firsts else 0))
            starts.append(new)
        a, depth = np.zeros(len(node), np.int64), np.zeros(len(node), np.int32)
        for level in range(len(shifts)):  # the deepest prefix that the row does not open
            inside = ~starts[level]
            a[inside], depth[inside] = first_of[level][inside], FLOOR + level
        linked = (depth > 0) & (a != node)
        yield record_batch({"a": pa.array(a[linked], pa.int64()), "b": pa.array(node[linked], pa.int64()), "depth": pa.array(depth[linked], pa.int32())})
        last, firsts = (prefix[-1], int(b[-1])), [f[-1] for f in first_of]


def trie_links(classes: DataFrame) -> DataFrame:
    """Stored (a, b, depth, t6, t7, t8): links along the sorted tries, each pair with the longest prefix that links it and the
    number of trees in which a prefix of each length does."""
    rows = arrow_map(classes.select("values", "high"), _trie_rows, "tree int, front long, back long, node long")
    tries = rows.select(F.xxhash64("tree", "front", F.shiftrightunsigned("back", 32)).alias("prefix"), "node", F.col("back").bitwiseAND(F.lit(0xFFFFFFFF)).alias("back"))
    linked = arrow_map(tries.repartition("prefix").sortWithinPartitions("prefix", "back", "node"), _trie_links, "a long, b long, depth int")
    trees = [F.sum((F.col("depth") >= d).cast("int")).alias(f"t{d}") for d in range(FLOOR, DEPTH + 1)]
    return stored(linked.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("depth").alias("depth"), *trees), "trie-links")


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    per, words = normal_word_hashes(texts)
    count, hashes = shingle_hashes(per, words, SIZE)
    ends = starts_of(count)
    return [np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of parts of the incidence matrix; shingles of one set alone are left out."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[place] > 1
    column = (np.cumsum(often > 1) - 1)[place[keep]]
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [a, a + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[i:j], column[i:j] - a] = 1
        out += part @ part.T
    return out


def near_pairs(values: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of all pairs of rows that are near; with two sides, pairs across them."""
    n = len(sets)
    if sides[0] != sides[-1]:
        cut = int(np.searchsorted(sides, sides[-1]))
        likely = [(i, cut + np.flatnonzero((values[cut:] == values[i]).mean(axis=1) >= similarity - SLACK)) for i in range(cut)]
    else:
        likely = [(i, i + 1 + np.flatnonzero((values[i + 1:] == values[i]).mean(axis=1) >= similarity - SLACK)) for i in range(n - 1)]
    i = np.concatenate([np.full(len(js), k) for k, js in likely]) if likely else np.zeros(0, np.int64)
    j = np.concatenate([js for _, js in likely]) if likely else np.zeros(0, np.int64)
    if not len(i):
        return i, j, np.zeros(0)
    size = np.array([len(s) for s in sets])
    if len(i) > 8 * n:
        used = np.unique(np.concatenate([i, j]))
        both = _shared([sets[k] for k in used])[np.searchsorted(used, i), np.searchsorted(used, j)]
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.float64)
    s = both / (size[i] + size[j] - both)
    near = s >= similarity - 1e-9
    return i[near], j[near], s[near]


_FOUND = "root long, size long, kind int, a long, b long, n long"
DEGREE, LINK = 0, 1


def _report(root: int, size: int, nodes: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Rows of a verified block: links per class and a spanning forest."""
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest, left = [], len(nodes) - 1
    for x, y in zip(i.tolist(), j.tolist()):
        u, v = find(x), find(y)
        if u != v:
            parent[u] = v
            forest.append((x, y))
            left -= 1
            if not left:
                break
    degree = np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
    with_links = np.flatnonzero(degree)
    a = np.concatenate([nodes[with_links], nodes[[x for x, _ in forest]]]).astype(np.int64)
    b = np.concatenate([np.zeros(len(with_links), np.int64), nodes[[y for _, y in forest]]])
    kind = np.repeat([DEGREE, LINK], [len(with_links), len(forest)])
    n = np.concatenate([degree[with_links], np.ones(len(forest), np.int64)])
    return {"root": np.full(len(a), root), "size": np.full(len(a), size), "kind": kind, "a": a, "b": b, "n": n}


def _verify(similarity: float):
    """Rows sorted by (root, i, j, side) -> reports of the families' blocks; one block pair is held at a time."""
    def run(batches):
        held: list[tuple] = []
        key, out, rows = None, [], 0

        def close():
            values = np.stack([h[2] for h in held])
            i, j, _ = near_pairs(values, [h[3] for h in held], np.array([h[1] for h in held]), similarity)
            return _report(key[0], key[3], np.array([h[0] for h in held], np.int64), i, j) if len(i) else None

        def flush():
            return record_batch({c: pa.array(np.concatenate([r[c] for r in out]), pa.int32() if c == "kind" else pa.int64()) for c in out[0]})

        for b in slices(batches, limit=4 << 20):
            sets = shingle_sets(b.column("text").cast(pa.large_string()))
            columns = [b.column(c).to_pylist() for c in ("root", "i", "j", "size", "side", "node", "values")]
            for root, i, j, size, side, node, values, own in zip(*columns, sets):
                if key != (root, i, j, size):
                    if len(held) > 1 and (r := close()):
                        out.append(r)
                        rows += len(r["a"])
                    held, key = [], (root, i, j, size)
                    if rows > 50_000:
                        yield flush()
                        out, rows = [], 0
                held.append((node, side, np.frombuffer(values, np.uint16), own))
        if len(held) > 1 and (r := close()):
            out.append(r)
        if out:
            yield flush()
    return run


def prefix_length(tries: DataFrame, similarity: float, recall: float) -> int:
    """The longest prefix that still shows a share of ``recall`` of the weak links, at least FLOOR.

    A pair of similarity s shares FLOOR values in about TREES * s^FLOOR trees, so links found in as
    few trees as pairs from 0.2 below to 0.05 above the threshold are the weak ones. Of each class
    its weakest link counts. Where there are none, the longest prefix does.
    """
    low, high = (TREES * max(0.0, min(1.0, similarity + x)) ** FLOOR for x in (-0.2, 0.05))
    weak = tries.where(F.col(f"t{FLOOR}").between(max(1, int(low)), int(high)))
    weakest = weak.groupBy("b").agg(F.min(F.struct(*[f"t{d}" for d in range(FLOOR, DEPTH + 1)])).alias("t"))
    seen = weakest.agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col(f"t.t{d}") > 0).cast("long")).alias(f"n{d}") for d in range(FLOOR, DEPTH + 1)]).first()
    return next((d for d in range(DEPTH, FLOOR, -1) if not seen["n"] or seen[f"n{d}"] >= recall * seen["n"]), FLOOR)


def links(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Verified links between classes, named by ``high``: (root, size, kind, a, b, n); see ``_report``."""
    tries = trie_links(classes.where("not (high = 0 and low = 0)"))
    tries = tries.where(F.col("depth") >= prefix_length(tries, similarity, recall))
    # texts of all classes that a prefix links, fetched once
    wanted = tries.select(F.explode(F.array("a", "b")).alias("high")).distinct().join(classes.select("high", "first", "values"), "high")
    wanted = wanted.select("high", "values", F.col("first.doc_id").alias("own_id"), F.col("first.version").alias("own_version"))
    same = docs["doc_id"].eqNullSafe(wanted["own_id"]) & (docs["version"] == wanted["own_version"])
    texts = stored(docs.join(wanted, same).select(F.col("high").alias("node"), "values", "text").dropDuplicates(["node"]), "family-texts")
    families = components(tries.select("a", "b"), "families")
    sizes = stored(families.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "family-sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    side = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least("side", o).alias("i"), F.greatest("side", o).alias("j")))
    dealt = families.join(sizes, "root").withColumn("side", side).select("root", "size", "node", "side", F.explode(pairs).alias("p"))
    rows = dealt.join(texts, "node").select("root", "size", "p.i", "p.j", "side", "node", "values", "text")
    sorted_rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side")
    return stored(arrow_map(sorted_rows, _verify(similarity), _FOUND), "verified")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per row of ``df``: doc_id, version, class_id, n_copies, n_links, group_id, first.

    class_id is the least id of the documents with the same words, n_copies their
    number, n_links the number of different texts that are near, group_id the
    least id of the connected group and first (last, doc_id, version) the document
    that stands for it.
    """
    docs = documents(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = stored(arrow_map(docs, _describe, f"doc_id {kind}, version long, high long, low long, values binary"), "minhashes")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version", "values")
    classes = described.groupBy("high", "low").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("n_copies"))
    classes = stored(classes.select("high", "low", F.struct("p.last", "p.doc_id", "p.version").alias("first"), "p.values", "n_copies"), "classes")
    found = links(docs, classes, similarity, recall)
    degree = found.where(F.col("kind") == DEGREE).groupBy(F.col("a").alias("high")).agg(F.sum("n").alias("n_links"))
    linked = components(found.where(F.col("kind") == LINK).select("a", "b")).withColumnRenamed("node", "high")
    about = classes.select("high", "low", "first", "n_copies").join(degree, "high", "left").join(linked, "high", "left")
    heads = about.where("root is not null").groupBy("root").agg(F.min("first").alias("head"))
    about = about.join(heads, "root", "left").select("high", "low", "first", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("head", "first").alias("head"))
    return described.select("doc_id", "version", "high", "low").join(about, ["high", "low"]).select(
        "doc_id", "version", F.col("first.doc_id").alias("class_id"), "n_copies", "n_links", F.col("head.doc_id").alias("group_id"), F.col("head").alias("first"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one document of each near-duplicate group: the one of the least id (null ids last), all columns."""
    names = df.columns
    near = near_duplicates(df, id_col, text_col, similarity)
    stands = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    heads = stored(near.where(stands).groupBy(F.col("doc_id").alias("d"), F.col("version").alias("w")).agg(F.count(F.lit(1)).alias("n")), "group-heads")
    base = df.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index(id_col)}", F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit(""))
    kept = base.withColumn("v", F.xxhash64(text)).join(heads, F.col(key).eqNullSafe(F.col("d")) & (F.col("v") == F.col("w")), "left_semi")
    if heads.where("n > 1").limit(1).count():  # a document that stands for its group occurs as several equal rows
        kept = kept.dropDuplicates([key, "v"])
    return kept.drop("v").toDF(*names)
