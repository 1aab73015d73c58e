"""Approximate nearest neighbours by an inverted multi-index.

1. Each half of the vectors has its own codebook, fitted by k-means on a bounded
   sample (``SAMPLE`` vectors by hash, or 16 per centroid). Centroids grow with the root of the
   vectors, so that a cell has about ``CELL`` of them. A vector's cell is its pair of nearest centroids.
   Every vector is indexed.
2. A query visits centroid pairs by the sum of its distances to the two centroids,
   smallest first, with a heap (the multi-sequence walk), until it has seen the share of
   all entries that gave ``RECALL`` on the sample.
3. Entries of the visited cells are ranked by their exact distance.

Cells lie in shards of about ``SHARD`` entries (a larger cell is dealt to several), and a
query goes only to shards that hold cells it visits. Each entry moves once: what a task holds is
one shard's entries, and any number of queries stream past them. Of equal vectors only the eleven least ids can be among anyone's
ten nearest, so the others are indexed through them (a limited ranking before the
shuffle keeps a very common vector from filling a task).

Defined results: vectors that are null, zero, or hold null or non-finite numbers take no
part, nor do those of another length than most; null ids take no part; rows with the same
id and vector are one; equal distances go by the smaller id; fewer candidates than asked for give
fewer rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, prepare, record_batch, stored

CENTROIDS, SAMPLE, PROBES, RECALL = 64, 20_000, 256, 0.97
SHARD, CELL = 8192, 64


@dataclass
class Codebooks:
    left: np.ndarray
    right: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = self.left.shape[1]
        return _nearest(x[:, :half], self.left) * len(self.right) + _nearest(x[:, half:], self.right)

    def walk(self, q: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
        """Cells in order of the query's summed distance, until they hold ``wanted`` entries; empty cells are passed over."""
        half = self.left.shape[1]
        d, e = ((self.left - q[:half]) ** 2).sum(1), ((self.right - q[half:]) ** 2).sum(1)
        a, b = np.argsort(d, kind="stable"), np.argsort(e, kind="stable")
        d, e, width = d[a].tolist(), e[b].tolist(), len(b)
        heap, seen, out, count = [(d[0] + e[0], 0, 0)], {(0, 0)}, [], 0
        while heap and count < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(a[i]) * width + int(b[j])
            if sizes[cell]:
                out.append(cell)
                count += int(sizes[cell])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(d) and y < len(e) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (d[x] + e[y], x, y))
        return out


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids ** 2).sum(1) - 2 * (x @ centroids.T)).argmin(1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds from a seeded choice of distinct rows; an empty centroid keeps its place."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def fit(sample: np.ndarray, k: int = CENTROIDS, recall: float = RECALL, probes: int = PROBES, top: int = 10) -> tuple[Codebooks, float]:
    """(codebooks, share of the entries to visit): the least share with which ``probes`` sampled queries find ``recall`` of their exact neighbours."""
    half = sample.shape[1] // 2
    books = Codebooks(kmeans(sample[:, :half], k), kmeans(sample[:, half:], k))
    cells = books.cells(sample)
    sizes = np.bincount(cells, minlength=len(books.left) * len(books.right))
    chosen = np.linspace(0, len(sample) - 1, min(probes, len(sample))).astype(int)
    norms = (sample ** 2).sum(1)
    need: list[int] = []
    for i in np.unique(chosen):
        d = norms - 2 * (sample @ sample[i])
        d[i] = np.inf
        near = np.argpartition(d, min(top, len(d) - 1))[:top] if len(d) > top else np.flatnonzero(np.isfinite(d))
        order = books.walk(sample[i], sizes, len(sample))
        seen = dict(zip(order, np.cumsum(sizes[order]).tolist()))
        need += [seen[int(cells[j])] for j in near]
    if not need:
        return books, 1.0
    need.sort()
    return books, min(1.0, need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)] / len(sample))


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, h1, h2) of the vectors that take part; h1 and h2 name the vector."""
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    rows = rows.where(F.size("v") == (size["n"] if size else 0))
    return rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assign(books: Codebooks):
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield record_batch({"cell": pa.array(books.cells(_matrix(b.column("v"))), pa.int32()), "vec_id": b.column("vec_id"), "v": b.column("v")})
    return run


def _shards(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each cell; cells are dealt in order, so that near cells share shards."""
    first, many = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32)
    shard, held = 0, 0
    for c, n in enumerate(sizes.tolist()):
        if held and held + n > SHARD:
            shard, held = shard + 1, 0
        first[c] = shard
        if n > SHARD:
            many[c] = -(-n // SHARD)
            shard += int(many[c])
        else:
            held += n
    return first, many


def _route(books: Codebooks, sizes: np.ndarray, wanted: int, first: np.ndarray, many: np.ndarray):
    """Distinct query vectors -> one row for each shard they visit, with the cells to look at there."""
    def run(batches):
        for b in batches:
            x = _matrix(b.column("v")) if b.num_rows else np.zeros((0, 0))
            for k, q in enumerate(x):
                to: dict[int, list[int]] = {}
                for c in books.walk(q, sizes, wanted):
                    for s in range(first[c], first[c] + many[c]):
                        to.setdefault(int(s), []).append(c)
                n = len(to)
                yield record_batch({"shard": pa.array(list(to), pa.int32()), "h1": pa.array([b.column("h1")[k].as_py()] * n, pa.int64()), "h2": pa.array([b.column("h2")[k].as_py()] * n, pa.int64()),
                                    "v": pa.array([q.tolist()] * n, pa.list_(pa.float64())), "cells": pa.array(list(to.values()), pa.list_(pa.int32()))})
    return run


def _nearest_of(entries: list[tuple], queries: pa.RecordBatch, top: int) -> dict[str, list]:
    """The nearest of a shard's entries, of the cells each query visits there."""
    out: dict[str, list] = {"h1": [], "h2": [], "vec_id": [], "score": []}
    ids, cells, e = (np.concatenate(x) for x in zip(*entries))
    norms, asked = (e ** 2).sum(1), _matrix(queries.column("v"))
    visits = queries.column("cells").to_pylist()
    for k, (h1, h2) in enumerate(zip(queries.column("h1").to_pylist(), queries.column("h2").to_pylist())):
        q = asked[k]
        at = np.flatnonzero(np.isin(cells, visits[k]))
        if not len(at):
            continue
        d = norms[at] - 2 * (e[at] @ q)
        if len(at) > top:  # products round: all that may be among the nearest are measured exactly
            edge = np.partition(d, top - 1)[top - 1]
            at = at[d <= edge + 1e-9 * (1 + abs(edge) + (q ** 2).sum())]
        score = np.sqrt(((e[at] - q) ** 2).sum(1))
        best = np.lexsort((ids[at], score))[:top]
        out["h1"] += [h1] * len(best)
        out["h2"] += [h2] * len(best)
        out["vec_id"] += ids[at][best].tolist()
        out["score"] += score[best].tolist()
    return out


def _rank(top: int):
    """Rows sorted by (shard, kind): a shard's entries, which are held, then its queries, which stream past -> each query's nearest."""
    def run(batches):
        shard, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            name, kind = (b.column(c).to_numpy() for c in ("shard", "kind"))
            cuts = np.flatnonzero((name[1:] != name[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(name)]):
                part = b.slice(i, j - i)
                if name[i] != shard:
                    shard, held = name[i], []
                if kind[i] == 0:
                    held.append((part.column("vec_id").to_numpy(), part.column("cell").to_numpy(), _matrix(part.column("v"))))
                elif held:
                    yield record_batch({c: pa.array(v, pa.float64() if c == "score" else pa.int64()) for c, v in _nearest_of(held, part, top).items()})
    return run


def codebook_size(n: int, least: int = CENTROIDS) -> int:
    """Centroids of each half: cells of about ``CELL`` entries, ``least`` at least."""
    return max(least, math.ceil(math.sqrt(n / CELL)))


def search(df: DataFrame, is_query, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of every row for which ``is_query`` (a column over vec_id) holds, among all other rows."""
    prepare(df.sparkSession)
    rows = usable(df, id_col, vector_col)
    # equal vectors: the least top + 1 ids; Spark limits each partition's ranking before the shuffle
    same = W.partitionBy("h1", "h2").orderBy("vec_id")
    kept = stored(rows.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("r", F.row_number().over(same)).where(F.col("r") <= top + 1).select("vec_id", "v", "h1", "h2"), "vectors")
    queries = rows.where(is_query).select("vec_id", "h1", "h2", "v")
    centroids = codebook_size(kept.count(), centroids)
    drawn = kept.orderBy(F.xxhash64("vec_id"), "vec_id", "h1").limit(max(sample, 16 * centroids)).select("v").toArrow()
    if not drawn.num_rows:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books, share = fit(_matrix(drawn.column("v").combine_chunks()), centroids, recall, top=top)
    index = stored(arrow_map(kept.select("vec_id", "v"), _assign(books), "cell int, vec_id long, v array<double>"), "cells")
    sizes = np.zeros(len(books.left) * len(books.right), np.int64)
    for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most the product of the codebooks' sizes
        sizes[r["cell"]] = r["n"]
    first, many = _shards(sizes)
    wanted = max(math.ceil(share * int(sizes.sum())), 20 * (top + 1))
    asked = queries.dropDuplicates(["h1", "h2"]).select("h1", "h2", "v")
    empty = F.lit(None)
    routed = arrow_map(asked, _route(books, sizes, wanted, first, many), "shard int, h1 long, h2 long, v array<double>, cells array<int>")
    routed = routed.select("shard", F.lit(1).alias("kind"), empty.cast("long").alias("vec_id"), empty.cast("int").alias("cell"), "v", "h1", "h2", "cells")
    places = df.sparkSession.createDataFrame([(c, int(first[c]), int(many[c])) for c in np.flatnonzero(sizes).tolist()], "cell int, base int, many int")  # one row per cell
    entries = index.join(F.broadcast(places), "cell").select((F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int").alias("shard"), F.lit(0).alias("kind"),
                                                             "vec_id", "cell", "v", empty.cast("long").alias("h1"), empty.cast("long").alias("h2"), empty.cast("array<int>").alias("cells"))
    near = arrow_map(entries.unionByName(routed).repartition("shard").sortWithinPartitions("shard", "kind"), _rank(top + 1), "h1 long, h2 long, vec_id long, score double")
    best = near.withColumn("r", F.row_number().over(W.partitionBy("h1", "h2").orderBy("score", "vec_id"))).where(F.col("r") <= top + 1)
    own = queries.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(best.drop("r"), ["h1", "h2"]).where("query_id <> vec_id")
    order = W.partitionBy("query_id", "h1", "h2").orderBy("score", "vec_id")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
