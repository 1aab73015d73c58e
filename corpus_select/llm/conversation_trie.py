"""Prefix trie of rebuilt conversations by composable fingerprints.

A conversation is rebuilt from the first turns of another one (its base) and its own turns
after as many. No rebuilt text is ever made:

1. A sequence of turns has the fingerprint sum(x_i * g^i) modulo the prime 2^61 - 1, twice
   with different g and turn hashes x_i (122 bits). The fingerprint of two sequences one
   after the other is a + g^len(a) * b, so fingerprints form a monoid. Prefix fingerprints of
   the original conversations are made once: rows are range-partitioned by (conversation, turn),
   summed within a partition, and a partition's first conversation takes up what the
   partitions before it have (one product per partition).
2. A rebuilt prefix is head of the base + g^(taken - head) * (own prefix - own head), from three
   stored numbers. Heads are at most ``max_head`` turns; one row per rebuilt turn of a few
   numbers is all that moves, dealt by conversation and block of turns.
3. Equal (depth, fingerprint) is one node. It is verified: all members must refer to the
   same stored turn, and equal turn hashes must refer to one (role, text). As a fingerprint and its
   last turn determine the fingerprint before, the members then agree on the parent too,
   and so on up to the root. Were any two to clash, all is drawn again with other hashes.
4. A node belongs to its smallest member. The nodes of one member are a chain: the trie is cut into
   at most one chain per conversation. Subtree sums are a chain's own sums from the node down
   and the totals of chains whose conversations pass the node, so no level-wise iteration is needed.
5. The ids that end at a node are sorted over all partitions, joined to pieces of at most
   ``PIECE`` ids, and only those pieces go through one running digest per node.

Defined results: null role or text is empty; turns are ordered, null first, ties by
their hashes; repeated rows are repeated turns; rows with a null conversation take no part; a base
that is absent or shorter gives what it has; rebuilt conversations may have no turn, they are
members of the root; an empty table gives an empty one; other columns are not read and may
have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, record_batch, stored

PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
BLOCK = 4096  # turns of one conversation that meet its row in one task
PIECE = 1 << 16  # ids that are joined to one piece of a digest
HEAVY = 1000  # parents with more than 1 / HEAVY of all chains (fewer than HEAVY of them) are joined apart
ATTEMPTS = 8
NODE = ["depth", "f1", "f2"]


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for numbers below it."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    mid = a1 * b0 + a0 * b1  # below 2^62
    out = (a1 * b1 << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half) + a0 * b0
    out = (out & _P) + (out >> np.uint64(61))
    return np.where(out >= _P, out - _P, out)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = a + b
    return np.where(s >= _P, s - _P, s)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return add(a, _P - b)


def powers(base: int, exponent: np.ndarray) -> np.ndarray:
    out, square = np.ones(len(exponent), np.uint64), base % PRIME
    e = exponent.astype(np.uint64)
    for _ in range(int(e.max(initial=0)).bit_length()):
        out = np.where(e & np.uint64(1) == 1, mul(out, np.uint64(square)), out)
        e >>= np.uint64(1)
        square = square * square % PRIME
    return out


def turn_values(hashes: np.ndarray) -> np.ndarray:
    """Turn hashes as numbers from 1 to the prime - 1."""
    return hashes.view(np.uint64) % np.uint64(PRIME - 1) + np.uint64(1)


def bases(seed: int) -> tuple[int, int]:
    digest = hashlib.sha256(f"base {seed}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 8], "big") % (PRIME - 1000) + 500 for i in (0, 8))


def running(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums modulo the prime, anew from each row where ``first`` holds (the index of each row's group start)."""
    low = np.uint64((1 << 31) - 1)
    halves = []
    for part in (values & low, values >> np.uint64(31)):  # sums of 31 bits fit for 2^32 rows
        total = np.cumsum(part)
        halves.append(total - (total - part)[first])
    return add(halves[0] % _P, mul(halves[1] % _P, np.uint64(1 << 31)))


def _col(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


def _u(b: pa.RecordBatch, name: str) -> np.ndarray:
    return _col(b, name).view(np.uint64)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _groups(key: np.ndarray) -> np.ndarray:
    """Per row of a sorted column, the index of its group's first row."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def _prefixes(g: tuple[int, int]):
    """Turns sorted by conversation -> with their place and prefix fingerprints, as far as this partition knows them."""
    def run(batches):
        from pyspark import TaskContext

        part, last, n, sums = TaskContext.get().partitionId(), None, 0, [0, 0]
        for b in batches:
            if not b.num_rows:
                continue
            conv = _col(b, "conv")
            first = _groups(conv)
            place = np.arange(len(conv)) - first
            carried = (first == 0) & (last is not None and conv[0] == last)
            place = place + np.where(carried, n, 0)
            prefixes = []
            for k in (0, 1):
                own = running(mul(turn_values(_col(b, f"h{k + 1}")), powers(g[k], place)), first)
                prefixes.append(add(own, np.where(carried, np.uint64(sums[k]), np.uint64(0))))
            last, n, sums = conv[-1], int(place[-1]) + 1, [int(p[-1]) for p in prefixes]
            yield record_batch({"part": pa.array(np.full(len(conv), part, np.int32)), "conv": b.column("conv"), "place": pa.array(place), "h1": b.column("h1"), "h2": b.column("h2"),
                                "n_bytes": b.column("n_bytes"), "p1": _signed(prefixes[0]), "p2": _signed(prefixes[1])})
    return run


def _continued(before: dict, g: tuple[int, int]):
    """What the partitions before hold of a partition's first conversation, put before its turns."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            part, conv, place, p = _col(b, "part"), _col(b, "conv"), _col(b, "place").copy(), [_u(b, "p1").copy(), _u(b, "p2").copy()]
            for one in np.unique(part).tolist():
                if one in before:
                    owner, n, sums = before[one]
                    at = np.flatnonzero((part == one) & (conv == owner))
                    place[at] += n
                    for k in (0, 1):
                        p[k][at] = add(mul(p[k][at], np.uint64(pow(g[k], n, PRIME))), np.uint64(sums[k]))
            yield record_batch({"conv": b.column("conv"), "place": pa.array(place), "h1": b.column("h1"), "h2": b.column("h2"), "n_bytes": b.column("n_bytes"), "p1": _signed(p[0]), "p2": _signed(p[1])})
    return run


def prefix_fingerprints(turns: DataFrame, g: tuple[int, int]) -> DataFrame:
    """(conv, place, h1, h2, n_bytes, p1, p2): turns numbered from 0 with the fingerprints of the prefixes they end."""
    keys = ["conv", F.col("turn").asc_nulls_first(), "h1", "h2", "row"]
    ordered = turns.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "h1", "h2", "n_bytes")
    local = stored(arrow_map(ordered, _prefixes(g), "part int, conv long, place long, h1 long, h2 long, n_bytes long, p1 long, p2 long"), "trie-turns")
    ends = local.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "place", "p1", "p2")).alias("last")).collect()  # one row per partition
    before, tail = {}, None
    for r in sorted(ends, key=lambda r: r.part):
        n, sums = r.last.place + 1, (r.last.p1, r.last.p2)
        if tail is not None and tail[0] == r.first:
            before[r.part] = tail
            if r.last.conv == r.first:
                sums = tuple((tail[2][k] + pow(g[k], tail[1], PRIME) * sums[k]) % PRIME for k in (0, 1))
                n += tail[1]
        tail = (r.last.conv, n, sums)
    return arrow_map(local, _continued(before, g), "conv long, place long, h1 long, h2 long, n_bytes long, p1 long, p2 long")


def _composed(g: tuple[int, int]):
    """Own turns with their conversation's numbers -> their rebuilt prefixes' fingerprints."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            head, taken, place = _col(b, "head"), _col(b, "taken"), _col(b, "place")
            out = []
            for k in (0, 1):
                back = powers(pow(g[k], -1, PRIME), head - taken)  # head >= taken: own turns move forward by as many
                out.append(add(_u(b, f"b{k + 1}"), mul(back, sub(_u(b, f"p{k + 1}"), _u(b, f"o{k + 1}")))))
            depth = taken + place - head + 1
            yield record_batch({"conv": b.column("conv"), "depth": pa.array(depth), "f1": _signed(out[0]), "f2": _signed(out[1]), "h1": b.column("h1"), "h2": b.column("h2"),
                                "n_bytes": b.column("n_bytes"), "last": pa.array(depth == _col(b, "length"))})
    return run


def rebuilt_prefixes(turns: DataFrame, base: Column, head: Column, max_head: int, g: tuple[int, int]) -> DataFrame:
    """Stored (conv, depth, f1, f2, h1, h2, n_bytes, last): every prefix of every rebuilt conversation, the root included.

    ``base`` and ``head`` are columns of ``conv``; h1, h2 refer to the turn a prefix ends with.
    """
    placed = prefix_fingerprints(turns, g)
    heads = F.sort_array(F.collect_list(F.when(F.col("place") < max_head, F.struct("place", "p1", "p2", "h1", "h2", "n_bytes"))))
    convs = stored(placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), heads.alias("heads")), "trie-convs")
    wanted = F.when(head.between(0, max_head), head.cast("long")).otherwise(F.raise_error(F.lit("a head is negative or longer than max_head")).cast("long"))
    own = convs.select("conv", "n", base.cast("long").alias("base"), wanted.alias("head"), F.col("heads").alias("own"))
    other = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    taken = F.least("head", F.coalesce("base_n", F.lit(0)))
    plan = own.join(other, "base", "left").withColumn("taken", taken).withColumn("tail", F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    last_of = {"o": ("own", F.least("head", "n")), "b": ("base_heads", F.col("taken"))}
    numbers = [F.coalesce(F.get(F.col(c), (at - 1).cast("int"))[f"p{k}"], F.lit(0)).alias(f"{x}{k}") for x, (c, at) in last_of.items() for k in (1, 2)]
    plan = stored(plan.select("conv", "n", "head", "taken", "tail", (F.col("taken") + F.col("tail")).alias("length"), *numbers,
                              F.when(F.col("taken") > 0, F.slice("base_heads", 1, F.greatest(F.col("taken"), F.lit(1)).cast("int"))).alias("shared")), "trie-plan")
    zero = F.lit(0).cast("long")
    root = plan.select("conv", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), zero.alias("h1"), zero.alias("h2"), zero.alias("n_bytes"), (F.col("length") == 0).alias("last"))
    shared = plan.select("conv", "length", F.explode("shared").alias("t")).select(
        "conv", (F.col("t.place") + 1).alias("depth"), F.col("t.p1").alias("f1"), F.col("t.p2").alias("f2"), "t.h1", "t.h2", "t.n_bytes", (F.col("t.place") + 1 == F.col("length")).alias("last"))
    # a conversation's row goes once to each block of its turns, so a long one is not one task's
    dealt = plan.where("tail > 0").select("conv", "head", "taken", "length", "o1", "o2", "b1", "b2", F.explode(F.sequence(zero, F.expr(f"(n - 1) div {BLOCK}"))).alias("block"))
    tails = placed.withColumn("block", F.expr(f"place div {BLOCK}")).join(dealt, ["conv", "block"]).where("place >= head")
    kinds = "conv long, depth long, f1 long, f2 long, h1 long, h2 long, n_bytes long, last boolean"
    return stored(root.unionByName(shared).unionByName(arrow_map(tails, _composed(g), kinds)), "trie-prefixes")


def _chains(g: tuple[int, int]):
    """Nodes sorted by (owner, depth downwards) -> sums from the chain's end and the parent's fingerprint."""
    def run(batches):
        from pyspark import TaskContext

        part, last, total, leaf = TaskContext.get().partitionId(), None, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            owner, depth, n = _col(b, "owner"), _col(b, "depth"), _col(b, "n_convs")
            first = _groups(owner)
            carried = (first == 0) & (last is not None and owner[0] == last)
            saved = (n - 1) * _col(b, "n_bytes")
            sums = np.cumsum(saved)
            sums = sums - (sums - saved)[first] + np.where(carried, total, 0)
            leaves = np.where(carried, leaf, (_col(b, "n_ends") == n)[first])
            parent = []
            for k in (0, 1):
                value = mul(turn_values(_col(b, f"h{k + 1}")), powers(g[k], np.maximum(depth - 1, 0)))
                parent.append(np.where(depth > 0, sub(_u(b, f"f{k + 1}"), value), np.uint64(0)))
            last, total, leaf = owner[-1], int(sums[-1]), bool(leaves[-1])
            yield record_batch({"part": pa.array(np.full(len(owner), part, np.int32)), **{c: b.column(c) for c in ("owner", "depth", "f1", "f2", "n_convs", "goes_on")},
                                "saved": pa.array(sums), "leaf": pa.array(leaves), "p1": _signed(parent[0]), "p2": _signed(parent[1])})
    return run


def owned_chains(nodes: DataFrame, g: tuple[int, int]) -> DataFrame:
    """Nodes with ``saved``, the sum over their chain from them down, ``leaf``, whether the chain ends in one, and the parent's fingerprint p1, p2."""
    keys = [F.col("owner"), F.col("depth").desc()]
    kinds = "part int, owner long, depth long, f1 long, f2 long, n_convs long, goes_on boolean, saved long, leaf boolean, p1 long, p2 long"
    local = stored(arrow_map(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys), _chains(g), kinds), "trie-chains")
    ends = local.groupBy("part").agg(F.min("owner").alias("first"), F.max(F.struct("owner", "saved", "leaf")).alias("last")).collect()  # one row per partition
    before, tail = [], None
    for r in sorted(ends, key=lambda r: r.part):
        saved, leaf = r.last.saved, r.last.leaf
        if tail is not None and tail[0] == r.first:
            before.append((r.part, *tail))
            if r.last.owner == r.first:
                saved, leaf = saved + tail[1], tail[2]
        tail = (r.last.owner, saved, leaf)
    carried = local.sparkSession.createDataFrame(before, "part int, owner long, more long, own_leaf boolean")
    both = local.join(F.broadcast(carried), ["part", "owner"], "left")
    return both.select(*[c for c in local.columns if c not in ("part", "saved", "leaf")], (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), F.coalesce("own_leaf", "leaf").alias("leaf"))


def _pieces(batches):
    """Rows sorted by (node, conv) -> joined ids, at most ``PIECE`` in a row."""
    key, held = None, []

    def row():
        return record_batch({**{c: pa.array([v], pa.int64()) for c, v in zip((*NODE, "first"), (*key, held[0]))}, "piece": pa.array([",".join(map(str, held)).encode()], pa.binary())})

    def joined(rows):
        return pa.Table.from_batches(rows).combine_chunks().to_batches()

    rows = []
    for b in batches:
        for *node, conv in zip(*(b.column(c).to_pylist() for c in (*NODE, "conv"))):
            if held and (node != key or len(held) == PIECE):
                rows.append(row())
                held = []
            key = node
            held.append(conv)
        if rows:
            yield from joined(rows)
            rows = []
    if held:
        yield row()


def _digests(batches):
    """Pieces sorted by (node, first) -> one digest per node; a digest's state is all that is held."""
    key, state, out = None, None, []

    def flush():
        return record_batch({**{c: pa.array([k[i] for k, _ in out], pa.int64()) for i, c in enumerate(NODE)}, "ends_sha256": pa.array([d for _, d in out], pa.string())})

    for b in batches:
        for *node, piece in zip(*(b.column(c).to_pylist() for c in (*NODE, "piece"))):
            if node == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = node, hashlib.sha256()
            state.update(piece)
        if out:
            yield flush()
            out = []
    if key is not None:
        out.append((key, state.hexdigest()))
        yield flush()


def end_digests(prefixes: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of the nodes where a rebuilt conversation ends."""
    ends = prefixes.where("last").select(*NODE, "conv")
    kind = "depth long, f1 long, f2 long"
    pieces = arrow_map(ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv"), _pieces, f"{kind}, first long, piece binary")
    return arrow_map(pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first"), _digests, f"{kind}, ends_sha256 string")


def _clash(turns: DataFrame, nodes: DataFrame) -> bool:
    """Whether a turn hash stands for two texts, or a node's members refer to different turns."""
    stored_turns = turns.groupBy("h1", "h2", "role", "text").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return bool(stored_turns.where("n > 1").limit(1).count() or nodes.where("h1 <> last_h1 or h2 <> last_h2").limit(1).count())


def _nodes(turns: DataFrame, base: Column, head: Column, max_head: int, g: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    prefixes = rebuilt_prefixes(turns, base, head, max_head, g)
    nodes = prefixes.groupBy(*NODE).agg(
        F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.min("h1").alias("h1"), F.min("h2").alias("h2"), F.max("h1").alias("last_h1"),
        F.max("h2").alias("last_h2"), F.sum(F.col("last").cast("long")).alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv"))).alias("first_end"))
    nodes = nodes.withColumn("goes_on", ~F.col("first_end").eqNullSafe(F.col("owner"))).drop("first_end")
    return prefixes, stored(nodes, "trie-nodes")


def prefix_trie(df: DataFrame, base: Column | None = None, head: Column | None = None, max_head: int = 8, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``base`` and ``head`` are expressions over a column ``conv``: the conversation whose first turns
    are taken, and how many (0 to ``max_head``). Without them every conversation is its own.
    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    ``hash_bits`` shortens the turn hashes, to test that clashes are found.
    """
    base = F.col("conv") if base is None else base
    head = F.lit(0) if head is None else head
    empty = F.lit("")
    own = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), empty).alias("role"),
                    F.coalesce(F.col(f"`{text_col}`"), empty).alias("text")).where("conv is not null")
    for seed in range(ATTEMPTS):
        hashes = [F.shiftrightunsigned(F.xxhash64(F.lit(2 * seed + k), "role", "text"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(F.lit(2 * seed + k), "role", "text") for k in (0, 1)]
        turns = own.select("conv", "turn", "role", "text", hashes[0].alias("h1"), hashes[1].alias("h2"))
        light = turns.select("conv", "turn", "h1", "h2", F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
        g = bases(seed)
        prefixes, nodes = _nodes(light, base, head, max_head, g)
        if not _clash(turns, nodes):
            return _described(prefixes, nodes, g)
    raise RuntimeError(f"turn hashes clashed in {ATTEMPTS} draws")


def _described(prefixes: DataFrame, nodes: DataFrame, g: tuple[int, int]) -> DataFrame:
    chains = stored(owned_chains(nodes, g), "trie-sums")
    # one row per chain: where it leaves its parent, and its totals
    tops = stored(chains.groupBy("owner").agg(F.min(F.struct("depth", "p1", "p2")).alias("top"), F.max("saved").alias("saved"), F.max("leaf").alias("leaf"))
                  .select("owner", "top.depth", F.col("top.p1").alias("f1"), F.col("top.p2").alias("f2"), "saved", F.col("leaf").cast("long").alias("leaf")), "trie-tops")
    # what passes a node owned by another: the chain's totals, at every depth above it
    zero = F.lit(0).cast("long")
    above = tops.where("depth > 0").select(F.col("owner").alias("conv"), F.col("depth").alias("top"), "saved", "leaf", F.explode(F.sequence(zero, F.expr(f"(depth - 1) div {BLOCK}"))).alias("block"))
    passing = prefixes.select("conv", *NODE, F.expr(f"depth div {BLOCK}").alias("block")).join(above, ["conv", "block"]).where("depth < top")
    passing = passing.groupBy(*NODE).agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaves"))
    # parents of chains: those of many chains are few
    hung = tops.where("depth > 0").select(F.col("owner").alias("child"), (F.col("depth") - 1).alias("depth"), "f1", "f2")
    branches = stored(hung.groupBy(*NODE).agg(F.count(F.lit(1)).alias("branches")), "trie-branches")
    total = branches.agg(F.sum("branches")).first()[0] or 0
    parents = stored(branches.join(chains.select(*NODE, F.col("owner").alias("parent")), NODE), "trie-parents")
    many = parents.where(F.col("branches") > total / HEAVY)
    done = hung.join(F.broadcast(many), NODE)
    rest = hung.join(F.broadcast(many.select(*NODE)), NODE, "left_anti").join(parents, NODE)
    tied = done.unionByName(rest).select(F.col("child").alias("owner"), (F.col("depth") + 1).alias("depth"), "parent")
    out = (chains.join(tied, ["owner", "depth"], "left").join(branches, NODE, "left").join(passing, NODE, "left").join(end_digests(prefixes), NODE, "left"))
    none = F.lit(0).cast("long")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "owner")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("branches", none) + F.col("goes_on").cast("long")).alias("n_children"), (F.col("leaf").cast("long") + F.coalesce("more_leaves", none)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", none)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
