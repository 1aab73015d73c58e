"""Text classifier on learned word and n-gram vectors.

A text is the mean of the vectors of its hashed words and word n-grams; its logit is that mean
times an output vector, plus a bias. Vectors, output and bias are learned together by
AdaGrad on mini-batches.

With z = sum_b (c_b / n) v_b . w + bias only the products s_b = v_b . w enter a forward pass, and
the gradient of v_b is g_b w with one number g_b per bucket; the output's gradient is
sum_b g_b v_b. So a step ships one number per bucket to the tasks and adds one number per bucket up
over them (packed, in a tree), whatever the dimension; documents and features never move.
Batches are drawn by a hash of the id, so a fit does not depend on the partitioning beyond
the rounding of sums.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package
from .embedding import STATS_SCHEMA, _stats_batch, _tree_sum
from .features import HASHERS, entry_slices, ngram_features

# Numbers of a model that the driver holds; more is refused rather than tried.
MAX_NUMBERS = 1 << 28
CHUNK = 1 << 16  # buckets whose sums travel together
EPS = 1e-8


def start_numbers(index: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (-1, 1) that depend on index and seed alone: two rounds of a 32-bit mix."""
    low = np.uint64(0xFFFFFFFF)
    x = (index.astype(np.uint64) * np.uint64(2654435761) + np.uint64(seed * 97)) & low
    x = ((x ^ x >> np.uint64(15)) * np.uint64(2246822519)) & low
    x ^= x >> np.uint64(13)
    return (x.astype(np.float64) + 0.5) / 2.0 ** 31 - 1.0


@dataclass
class VectorModel:
    """Vectors (buckets, dim), output (dim), bias and AdaGrad's sums, with the featurizer's settings."""
    vectors: np.ndarray
    output: np.ndarray
    bias: float = 0.0
    ngrams: int = 2
    tokenizer: str = "word_tokenize"
    hash_fn: str = "xxh64"
    seen: np.ndarray = field(default=None)  # type: ignore[assignment]
    seen_output: float = 0.0
    seen_bias: float = 0.0

    def __post_init__(self):
        if self.seen is None:
            self.seen = np.zeros(len(self.vectors))

    @classmethod
    def start(cls, buckets: int = 1 << 18, dim: int = 64, seed: int = 0, vectors: np.ndarray | None = None, **settings) -> "VectorModel":
        """Seeded small vectors, or given ones (rows that are all zero are seeded), and a seeded output."""
        if buckets * dim > MAX_NUMBERS:
            raise ValueError(f"{buckets} buckets of {dim} numbers are more than {MAX_NUMBERS}")
        own = start_numbers(np.arange(1, buckets * dim + 1), seed).reshape(buckets, dim) / dim
        if vectors is not None:
            given = np.abs(vectors).sum(axis=1) > 0
            own[given] = vectors[given]
        return cls(own, start_numbers(np.arange(buckets * dim + 1, buckets * dim + dim + 1), seed) / np.sqrt(dim), **settings)

    def products(self) -> np.ndarray:
        return self.vectors @ self.output

    def updated(self, g: np.ndarray, g_bias: float, rate: float) -> "VectorModel":
        """The model after one AdaGrad step; all gradients are taken at the old parameters."""
        g_output = g @ self.vectors
        seen, seen_output, seen_bias = self.seen + g * g, self.seen_output + float(g_output @ g_output), self.seen_bias + g_bias * g_bias
        return VectorModel(self.vectors - np.outer(rate * g / (np.sqrt(seen) + EPS), self.output), self.output - rate * g_output / (np.sqrt(seen_output) + EPS),
                           self.bias - rate * g_bias / (np.sqrt(seen_bias) + EPS), self.ngrams, self.tokenizer, self.hash_fn, seen, seen_output, seen_bias)

    def save(self, spark: SparkSession, path: str) -> None:
        """Vectors as rows (bucket, vector, seen), settings as one JSON row."""
        rows = pa.table({"bucket": pa.array(np.arange(len(self.vectors)), pa.int64()), "vector": pa.array(list(self.vectors)), "seen": pa.array(self.seen)})
        spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{path}/vectors")
        one = [(self.output.tolist(), float(self.bias), self.ngrams, self.tokenizer, self.hash_fn, float(self.seen_output), float(self.seen_bias))]
        spark.createDataFrame(one, "output array<double>, bias double, ngrams int, tokenizer string, hash_fn string, seen_output double, seen_bias double").coalesce(1).write.mode("overwrite").json(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "VectorModel":
        rows = spark.read.parquet(f"{path}/vectors").toArrow().sort_by("bucket")
        s = spark.read.schema("output array<double>, bias double, ngrams int, tokenizer string, hash_fn string, seen_output double, seen_bias double").json(f"{path}/settings").first()
        vectors = np.array(rows.column("vector").to_pylist(), np.float64)
        return cls(vectors, np.array(s.output), s.bias, s.ngrams, s.tokenizer, s.hash_fn, rows.column("seen").to_numpy(), s.seen_output, s.seen_bias)


def featurize(df: DataFrame, model: VectorModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, buckets, counts) as the model reads them."""
    return ngram_features(df, id_col, text_col, model.ngrams, len(model.vectors), model.tokenizer, model.hash_fn)


def _logits(b: pa.RecordBatch, products: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(logit per row, row per feature, bucket per feature, share per feature)."""
    lists = b.column("buckets")
    row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    bucket = pc.list_flatten(lists).to_numpy()
    count = pc.list_flatten(b.column("counts")).to_numpy().astype(np.float64)
    n = np.bincount(row, count, b.num_rows)
    share = count / n[row]
    return np.bincount(row, share * products[bucket], b.num_rows) + bias, row, bucket, share


def _probability(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _gradient(shipped):
    def fn(batches):
        from pyspark import TaskContext

        products, bias = shipped.value
        g, g_bias, loss, rows = np.zeros(len(products)), 0.0, 0.0, 0
        for b in (part for big in batches for part in entry_slices(big)):
            y = b.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            z, row, bucket, share = _logits(b, products, bias)
            error = _probability(z) - y
            g += np.bincount(bucket, share * error[row], len(g))
            g_bias += float(error.sum())
            loss += float((np.logaddexp(0.0, z) - y * z).sum())
            rows += b.num_rows
        if rows:
            chunks = [g[a:a + CHUNK] for a in range(0, len(g), CHUNK)]
            k = len(chunks)
            first = [0.0] * (k - 1)
            yield _stats_batch(range(k), [TaskContext.get().partitionId()] * k, [g_bias, *first], chunks, [np.zeros(0)] * k, [loss, *first], [rows] + [0] * (k - 1))
    return fn


def gradient(rows: DataFrame, model: VectorModel) -> tuple[np.ndarray, float, float, int]:
    """(mean gradient per bucket, of the bias, mean loss, rows) over ``rows`` (buckets, counts, label)."""
    spark = rows.sparkSession
    ship_package(spark)
    shipped = spark.sparkContext.broadcast((model.products(), model.bias))  # one number per bucket
    try:
        parts = rows.select("buckets", "counts", "label")
        sums = _tree_sum(parts.mapInArrow(_gradient(shipped), STATS_SCHEMA), parts.rdd.getNumPartitions()).toArrow().to_pylist()
    finally:
        shipped.unpersist()
    g, g_bias, loss, n = np.zeros(len(model.vectors)), 0.0, 0.0, 0
    for r in sorted(sums, key=lambda r: (r["component"], r["part"])):
        own = np.frombuffer(r["s1"])
        g[r["component"] * CHUNK:r["component"] * CHUNK + len(own)] += own
        g_bias, loss, n = g_bias + r["n"], loss + r["ll"], n + r["rows"]
    return (g / n, g_bias / n, loss / n, n) if n else (g, 0.0, 0.0, 0)


def sgd_step(rows: DataFrame, model: VectorModel, rate: float) -> tuple[VectorModel, float]:
    """One step over all of ``rows``; (new model, mean loss under the old one). No rows change nothing."""
    g, g_bias, loss, n = gradient(rows, model)
    return (model.updated(g, g_bias, rate) if n else model), loss


def vectors_by_bucket(word_vectors: DataFrame, buckets: int, hash_fn: str = "xxh64") -> np.ndarray:
    """Mean of the pretrained vectors (word, vec) whose words share a bucket; zero rows where there is none."""
    ship_package(word_vectors.sparkSession)
    factory = HASHERS[hash_fn]

    def fn(batches):
        bucket_of = factory(buckets)
        for b in batches:
            words = b.column("word").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([bucket_of(w) for w in words], pa.int32()), b.column("vec")], names=["bucket", "vec"])
    dim = len(word_vectors.first()["vec"])
    hashed = word_vectors.where("word is not null").select("word", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(fn, "bucket int, vec array<double>")
    means = hashed.groupBy("bucket").agg(F.array(*[F.avg(F.col("vec")[i]) for i in range(dim)]).alias("vec")).toArrow()  # one row per bucket at most
    out = np.zeros((buckets, dim))
    out[means.column("bucket").to_numpy()] = np.array(means.column("vec").to_pylist(), np.float64).reshape(-1, dim)
    return out


def train_vectors(train: DataFrame, val: DataFrame | None = None, model: VectorModel | None = None, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id",
                  epochs: int = 5, batches: int = 8, rates: tuple[float, ...] = (0.5, 0.1), patience: int = 2, history: list | None = None) -> VectorModel:
    """Learn vectors and output from ``train`` (E8); with ``val`` the rate and the number of epochs are tuned on its loss.

    Each epoch visits ``batches`` parts of the rows, dealt by a hash of the id. The rate falls
    linearly to a tenth. Rows without text or label are left out. Features are written once to the
    shared checkpoint folder, so a lost executor costs a re-read.
    """
    import os
    import uuid

    first = model or VectorModel.start()
    spark = train.sparkSession

    def prepared(df: DataFrame, name: str) -> DataFrame:
        labels = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("label is not null")
        both = featurize(df, first, id_col, text_col).where(F.size("buckets") > 0).join(labels, "doc_id")
        both = both.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
        path = os.path.join(checkpoint_dir(spark), f"vector-{name}-{uuid.uuid4().hex}")
        both.select("batch", "buckets", "counts", "label").write.partitionBy("batch").parquet(path)
        return spark.read.schema("buckets array<int>, counts array<int>, label double, batch int").parquet(path)

    rows = prepared(train, "train")
    held = prepared(val, "val") if val is not None else None
    best, best_loss = first, np.inf
    for rate in rates if held is not None else rates[:1]:
        m, bad, own_best = first, 0, np.inf
        for epoch in range(epochs):
            losses = []
            for k in range(batches):
                now = rate * (1 - 0.9 * (epoch * batches + k) / (epochs * batches))
                m, loss = sgd_step(rows.where(F.col("batch") == k), m, now)
                losses.append(loss)
            loss = gradient(held, m)[2] if held is not None else float(np.mean(losses))
            if history is not None:
                history.append((rate, epoch, float(np.mean(losses)), loss))
            if held is None:
                best = m
                continue
            if loss < best_loss:
                best, best_loss = m, loss
            own_best, bad = (loss, 0) if loss < own_best else (own_best, bad + 1)
            if bad >= patience:
                break
    return best


def predict_vectors(model: VectorModel, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, prob) of every row with a text (E9); a text without words has the bias alone."""
    return score_features(model, featurize(df, model, id_col, text_col)).withColumnRenamed("doc_id", id_col)


def score_features(model: VectorModel, features: DataFrame) -> DataFrame:
    """(doc_id, prob) from stored features; a narrow map that ships one number per bucket."""
    spark = features.sparkSession
    ship_package(spark)
    shipped = spark.sparkContext.broadcast((model.products(), model.bias))

    def fn(batches):
        products, bias = shipped.value
        for b in (part for big in batches for part in entry_slices(big)):
            z = _logits(b, products, bias)[0]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_probability(z))], names=["doc_id", "prob"])
    return features.select("doc_id", "buckets", "counts").mapInArrow(fn, "doc_id long, prob double")
