"""Learned text vectors: latent semantic factors by a distributed randomised SVD.

Documents are rows of a sparse matrix X of weighted n-gram buckets, each of length one. A few power
passes Z = X^T (X Q) find the leading right singular vectors. A pass is one narrow map over stored
features: a task gathers its rows' entries of Q, multiplies, and scatters into its own Z; the
tasks' sums are added up in a tree. Only Q (buckets x directions, a size that is a parameter)
is shipped, and only that much comes back: documents never move. The small matrices are
made orthogonal on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .embedding import STATS_SCHEMA, _stats_batch, _tree_sum
from .features import entry_slices, ngram_features

MAX_NUMBERS = 1 << 26  # of buckets x directions, shipped to every task
CHUNK = 1 << 17  # numbers of Z that travel together
ROWS = 2000  # documents whose products are held at once; their entries are bounded too


@dataclass
class LatentModel:
    """Right singular vectors (buckets, dim), singular values, and how texts become rows."""
    directions: np.ndarray
    values: np.ndarray
    weights: np.ndarray  # per bucket, by document frequency
    ngrams: int = 2
    tokenizer: str = "wordpunct"
    hash_fn: str = "xxh64"

    def save(self, spark: SparkSession, path: str) -> None:
        rows = pa.table({"bucket": pa.array(np.arange(len(self.weights)), pa.int64()), "weight": pa.array(self.weights), "direction": pa.array(list(self.directions))})
        spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{path}/directions")
        one = [(self.values.tolist(), self.ngrams, self.tokenizer, self.hash_fn)]
        spark.createDataFrame(one, "values array<double>, ngrams int, tokenizer string, hash_fn string").coalesce(1).write.mode("overwrite").json(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LatentModel":
        rows = spark.read.parquet(f"{path}/directions").toArrow().sort_by("bucket")
        s = spark.read.schema("values array<double>, ngrams int, tokenizer string, hash_fn string").json(f"{path}/settings").first()
        return cls(np.array(rows.column("direction").to_pylist()), np.array(s["values"]), rows.column("weight").to_numpy(), s.ngrams, s.tokenizer, s.hash_fn)


def bucket_weights(features: DataFrame, buckets: int) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the bucket)) + 1 per bucket; one partially aggregated count."""
    n = features.count()
    seen = features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()  # one row per bucket at most
    have = np.zeros(buckets)
    have[seen.column("bucket").to_numpy()] = seen.column("n").to_numpy()
    return np.log((1 + n) / (1 + have)) + 1


def _rows(b: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the batch's sparse rows of length one: (1 + ln count) times the bucket's weight."""
    lists = b.column("buckets")
    row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    bucket = pc.list_flatten(lists).to_numpy()
    value = (1 + np.log(pc.list_flatten(b.column("counts")).to_numpy())) * weights[bucket]
    length = np.sqrt(np.bincount(row, value * value, b.num_rows))
    return row, bucket, value / length[row]


def _parts(big: pa.RecordBatch, width: int):
    """Parts of a batch of features that are small in documents and in entries x directions."""
    for at in range(0, big.num_rows, ROWS):
        yield from entry_slices(big.slice(at, ROWS), max(1, width))


def _product(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """X Q for ``n`` sparse rows; rows come in order."""
    out = np.zeros((n, q.shape[1]))
    if len(row):
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[start]] = np.add.reduceat(q[bucket] * value[:, None], start, axis=0)
    return out


def _back(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
    """Add X^T Y to ``z``."""
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    if len(start):
        z[own[start]] += np.add.reduceat(y[row[order]] * value[order, None], start, axis=0)


def _pass(shipped):
    def fn(batches):
        from pyspark import TaskContext

        q, weights = shipped.value
        z, rows = np.zeros_like(q), 0
        for big in batches:
            for b in _parts(big, q.shape[1]):
                x = _rows(b, weights)
                _back(*x, _product(*x, b.num_rows, q), z)
                rows += b.num_rows
        if rows:
            flat = z.ravel()
            chunks = [flat[a:a + CHUNK] for a in range(0, len(flat), CHUNK)]
            k = len(chunks)
            yield _stats_batch(range(k), [TaskContext.get().partitionId()] * k, [0.0] * k, chunks, [np.zeros(0)] * k, [0.0] * k, [rows] + [0] * (k - 1))
    return fn


def power_pass(features: DataFrame, q: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """X^T (X Q) over all stored features."""
    spark = features.sparkSession
    ship_package(spark)
    shipped = spark.sparkContext.broadcast((q, weights))
    try:
        rows = features.select("buckets", "counts")
        sums = _tree_sum(rows.mapInArrow(_pass(shipped), STATS_SCHEMA), rows.rdd.getNumPartitions()).toArrow().to_pylist()
    finally:
        shipped.unpersist()
    out = np.zeros(q.size)
    for r in sorted(sums, key=lambda r: (r["component"], r["part"])):
        own = np.frombuffer(r["s1"])
        out[r["component"] * CHUNK:r["component"] * CHUNK + len(own)] += own
    return out.reshape(q.shape)


def fit_latent(features: DataFrame, buckets: int, dim: int = 32, passes: int = 4, extra: int = 8, seed: int = 0, **settings) -> LatentModel:
    """Leading ``dim`` right singular vectors of the weighted rows of ``features`` (stored: each pass reads them).

    ``extra`` directions and ``passes`` power passes make them accurate. Fewer documents or buckets than
    directions give as many as there are; signs make each vector's largest entry positive.
    """
    width = min(dim + extra, buckets)
    if buckets * width > MAX_NUMBERS:
        raise ValueError(f"{buckets} buckets of {width} directions are more than {MAX_NUMBERS}")
    weights = bucket_weights(features, buckets)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, width)))[0]
    for _ in range(passes):
        q = np.linalg.qr(power_pass(features, q, weights))[0]
    small = q.T @ power_pass(features, q, weights)
    squares, turn = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-squares)[:dim]
    values = np.sqrt(np.maximum(squares[top], 0))
    kept = values > 1e-9 * max(values.max(initial=0), 1e-300)
    directions = (q @ turn[:, top])[:, kept]
    if directions.shape[1]:
        directions *= np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    return LatentModel(directions, values[kept], weights, **settings)


def train_latent(df: DataFrame, path: str, buckets: int = 1 << 15, dim: int = 32, id_col: str = "doc_id", text_col: str = "text", ngrams: int = 2,
                 tokenizer: str = "wordpunct", hash_fn: str = "xxh64", **fit) -> LatentModel:
    """Featurise the texts of ``df`` once into the shared folder ``path`` and fit."""
    from ..sources.io import materialize

    features = materialize(ngram_features(df, id_col, text_col, ngrams, buckets, tokenizer, hash_fn), path)
    return fit_latent(features, buckets, dim, ngrams=ngrams, tokenizer=tokenizer, hash_fn=hash_fn, **fit)


def embed_features(model: LatentModel, features: DataFrame) -> DataFrame:
    """(doc_id, embedding ARRAY<FLOAT>) of length one from stored features; rows without n-grams have zeros. A narrow map."""
    spark = features.sparkSession
    ship_package(spark)
    shipped = spark.sparkContext.broadcast((model.directions, model.weights))

    def fn(batches):
        directions, weights = shipped.value
        for big in batches:
            for b in _parts(big, directions.shape[1]):
                y = _product(*_rows(b, weights), b.num_rows, directions)
                length = np.linalg.norm(y, axis=1, keepdims=True)
                y = (y / np.where(length > 0, length, 1.0)).astype(np.float32)
                ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * y.shape[1])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=["doc_id", "embedding"])
    return features.select("doc_id", "buckets", "counts").mapInArrow(fn, "doc_id long, embedding array<float>")


def embed_svd(model: LatentModel, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, embedding ARRAY<FLOAT>) of every row with a text (E7); what the mixture operators read."""
    features = ngram_features(df, id_col, text_col, model.ngrams, len(model.weights), model.tokenizer, model.hash_fn)
    return embed_features(model, features).withColumnRenamed("doc_id", id_col)
