"""Embedding scores: diagonal Gaussian mixtures fitted by distributed EM,
mixture log-densities, embedding and hybrid log importance weights.

A mixture is a small table ``(component, weight, mean ARRAY<DOUBLE>,
var ARRAY<DOUBLE>)`` - K·(2d+1) numbers, K a parameter - so it is shipped to
tasks as a broadcast. EM passes never move embeddings: each task computes
responsibilities for its rows in NumPy and emits one packed row of sufficient
statistics per component; the rows are added up in a tree (``_tree_sum``), so only
K rows of 2d numbers reach the driver for the M-step.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import seeded_order_key

VAR_FLOOR = 1e-6
LOG2PI = math.log(2.0 * math.pi)


@dataclass
class Mixture:
    """Diagonal Gaussian mixture parameters (driver-side, K·(2d+1) numbers)."""
    weights: np.ndarray  # (K,)
    means: np.ndarray    # (K, d)
    vars: np.ndarray     # (K, d)

    @property
    def k(self) -> int:
        return len(self.weights)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(self.weights[i]), [float(x) for x in self.means[i]], [float(x) for x in self.vars[i]])
                for i in range(self.k)]
        return spark.createDataFrame(rows, "component int, weight double, mean array<double>, var array<double>")

    @classmethod
    def from_df(cls, df: DataFrame) -> "Mixture":
        rows = sorted(df.collect(), key=lambda r: r["component"])
        return cls(np.array([r["weight"] for r in rows], dtype=np.float64),
                   np.array([r["mean"] for r in rows], dtype=np.float64),
                   np.array([r["var"] for r in rows], dtype=np.float64))

    def save(self, spark: SparkSession, path: str) -> None:
        """Model checkpoint as parquet."""
        self.to_df(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Mixture":
        return cls.from_df(spark.read.parquet(path))


def log_density(x: np.ndarray, m: Mixture) -> np.ndarray:
    """Per-component log w_k + log N(x | mu_k, diag var_k), shape (n, K)."""
    prec = 1.0 / m.vars                                   # (K, d)
    # sum_j (x_j - mu_kj)^2 / var_kj, expanded to use matrix products
    quad = (x * x) @ prec.T - 2.0 * x @ (m.means * prec).T + np.sum(m.means * m.means * prec, axis=1)
    logdet = np.sum(np.log(m.vars), axis=1)
    d = x.shape[1]
    with np.errstate(divide="ignore"):
        lw = np.log(m.weights)
    return lw - 0.5 * (d * LOG2PI + logdet + quad)


def _logsumexp(a: np.ndarray) -> np.ndarray:
    mx = np.max(a, axis=1, keepdims=True)
    mx = np.where(np.isfinite(mx), mx, 0.0)
    return (mx + np.log(np.sum(np.exp(a - mx), axis=1, keepdims=True)))[:, 0]


def _matrix(col: pa.Array) -> np.ndarray:
    flat = pc_flatten(col)
    n = len(col)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def pc_flatten(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc
    return pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64)


STATS_SCHEMA = "component int, part int, n double, s1 binary, s2 binary, ll double, rows long"
# Partial sums that meet in one task of the tree.
FAN_IN = 64


def _stats_fn(bparams, emb_col: str):
    def fn(batches):
        from pyspark import TaskContext

        m: Mixture = bparams.value
        k, d = m.means.shape
        n = np.zeros(k)
        s1 = np.zeros((k, d))
        s2 = np.zeros((k, d))
        ll = 0.0
        rows = 0
        for rb in batches:
            x = _matrix(rb.column(rb.schema.get_field_index(emb_col)))
            if len(x) == 0:
                continue
            lp = log_density(x, m)
            lse = _logsumexp(lp)
            r = np.exp(lp - lse[:, None])
            n += r.sum(axis=0)
            s1 += r.T @ x
            s2 += r.T @ (x * x)
            ll += float(lse.sum())
            rows += len(x)
        if rows:
            part = TaskContext.get().partitionId() if TaskContext.get() else 0
            yield _stats_batch(range(k), [part] * k, n, s1, s2, [ll] + [0.0] * (k - 1), [rows] + [0] * (k - 1))
    return fn


def _stats_batch(component, part, n, s1, s2, ll, rows):
    return pa.RecordBatch.from_arrays(
        [pa.array(component, pa.int32()), pa.array(part, pa.int32()), pa.array(n, pa.float64()), pa.array([a.tobytes() for a in s1], pa.binary()),
         pa.array([a.tobytes() for a in s2], pa.binary()), pa.array(ll, pa.float64()), pa.array(rows, pa.int64())],
        names=["component", "part", "n", "s1", "s2", "ll", "rows"])


def _add_up(batches):
    """One row per component of the rows of a task."""
    sums: dict[int, list] = {}
    part = 0
    for rb in batches:
        for r in rb.to_pylist():
            one, two = np.frombuffer(r["s1"]), np.frombuffer(r["s2"])
            part = r["part"] // FAN_IN
            s = sums.get(r["component"])
            if s is None:
                sums[r["component"]] = [r["n"], one.copy(), two.copy(), r["ll"], r["rows"]]
            else:
                s[0] += r["n"]
                s[1] += one
                s[2] += two
                s[3] += r["ll"]
                s[4] += r["rows"]
    if sums:
        yield _stats_batch(list(sums), [part] * len(sums), *zip(*sums.values()))


def _tree_sum(stats: DataFrame, tasks: int) -> DataFrame:
    """Add packed statistics up, FAN_IN tasks at a time, until one row per component is left."""
    while tasks > 1:
        groups = -(-tasks // FAN_IN)
        stats = (stats.withColumn("_g", F.floor(F.col("part") / FAN_IN).cast("int")).repartition(min(groups * 8, 4096), "_g", "component").drop("_g")
                 .sortWithinPartitions("component", "part").mapInArrow(_grouped_sum, STATS_SCHEMA))
        tasks = groups
    return stats


def _grouped_sum(batches):
    """``_add_up`` for each (component, group of parts) of rows sorted by both."""
    held: list[dict] = []
    for rb in batches:
        for r in rb.to_pylist():
            if held and (held[0]["component"], held[0]["part"] // FAN_IN) != (r["component"], r["part"] // FAN_IN):
                yield from _add_up([pa.RecordBatch.from_pylist(held)])
                held = []
            held.append(r)
    if held:
        yield from _add_up([pa.RecordBatch.from_pylist(held)])


def em_sums(emb: DataFrame, m: Mixture, emb_col: str = "embedding") -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """(responsibilities, weighted sums, weighted sums of squares, log-likelihood, rows) under ``m``, as a Spark job."""
    from ..session import ship_package
    ship_package(emb.sparkSession)
    spark = emb.sparkSession
    b = spark.sparkContext.broadcast(m)
    try:
        tasks = emb.rdd.getNumPartitions()
        stats = _tree_sum(emb.select(emb_col).mapInArrow(_stats_fn(b, emb_col), STATS_SCHEMA), tasks).toArrow().to_pylist()
    finally:
        b.unpersist()
    k, d = m.means.shape
    n = np.zeros(k)
    s1 = np.zeros((k, d))
    s2 = np.zeros((k, d))
    ll, rows = 0.0, 0
    for r in sorted(stats, key=lambda r: (r["component"], r["part"])):
        c = r["component"]
        n[c] += r["n"]
        s1[c] += np.frombuffer(r["s1"])
        s2[c] += np.frombuffer(r["s2"])
        ll += r["ll"]
        rows += r["rows"]
    return n, s1, s2, ll, rows


def em_step(emb: DataFrame, m: Mixture, emb_col: str = "embedding", var_floor: float = VAR_FLOOR):
    """One EM iteration as a Spark job; returns (new mixture, mean log-likelihood under ``m``)."""
    n, s1, s2, ll, rows = em_sums(emb, m, emb_col)
    return m_step(n, s1, s2, rows, var_floor, m), (ll / rows if rows else float("nan"))


def m_step(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, rows: int, var_floor: float,
           prev: Mixture | None = None) -> Mixture:
    """Weights, means and diagonal variances from sufficient statistics (empty components keep ``prev``)."""
    safe = np.maximum(n, 1e-300)[:, None]
    means = s1 / safe
    var = s2 / safe - means * means
    var = np.maximum(var, 0.0) + var_floor
    if prev is not None:
        empty = n <= 0
        means[empty] = prev.means[empty]
        var[empty] = prev.vars[empty]
    w = n / max(rows, 1)
    return Mixture(w, means, var)


def init_mixture(emb: DataFrame, k: int, seed: int = 42, emb_col: str = "embedding",
                 id_col: str = "doc_id", var_floor: float = VAR_FLOOR, sample: int | None = None, rounds: int = 10) -> Mixture:
    """k-means++ start on a seeded sample of ``sample`` rows (default: 20 per component, 2,000 at least).

    Centres are drawn by squared distance and refined by a few Lloyd rounds; the
    clusters' shares, means and variances open EM. Moves the sample, whose size is a
    parameter, to the driver; EM itself reads every row.
    """
    size = sample or max(2000, 20 * k)
    picks = emb.withColumn("_k", seeded_order_key(seed, "gmm-init", id_col)) \
        .orderBy(F.col("_k").desc(), F.col(id_col)).limit(size).select(emb_col).toArrow()
    x = _matrix(picks.column(0).combine_chunks())
    rng = np.random.default_rng(seed)
    centres = [x[0]]
    gap = ((x - x[0]) ** 2).sum(1)
    while len(centres) < k and gap.max() > 0:
        centres.append(x[rng.choice(len(x), p=gap / gap.sum())])
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(1))
    means = np.array(centres)
    for _ in range(rounds):
        own = ((means ** 2).sum(1) - 2 * (x @ means.T)).argmin(1)
        n = np.bincount(own, minlength=len(means))
        total = np.zeros_like(means)
        np.add.at(total, own, x)
        means[n > 0] = total[n > 0] / n[n > 0][:, None]
    square = np.zeros_like(means)
    np.add.at(square, own, (x - means[own]) ** 2)
    # small clusters lean on the pooled variance
    var = (square + x.var(0) * 2) / (n + 2)[:, None] + var_floor
    return Mixture((n + 1) / (n + 1).sum(), means, var)


def fit_gmm(emb: DataFrame, k: int = 8, max_iter: int = 10, tol: float = 1e-3, seed: int = 42,
            emb_col: str = "embedding", id_col: str = "doc_id", init: Mixture | None = None,
            var_floor: float = VAR_FLOOR, checkpoint_dir: str | None = None, checkpoint_every: int = 10,
            history: list | None = None) -> Mixture:
    """Fit a diagonal mixture on all rows by distributed EM.

    ``init`` warm-starts from earlier weights/means/variances. Stops when the
    mean log-likelihood changes by less than ``tol`` or after ``max_iter``.
    The embedding table is persisted for the iterations (recomputable from
    its source if an executor is lost).
    """
    data = emb.select(id_col, emb_col).persist()
    try:
        m = init or init_mixture(data, k, seed, emb_col, id_col, var_floor)
        prev_ll = None
        for it in range(max_iter):
            m, ll = em_step(data, m, emb_col, var_floor)
            if history is not None:
                history.append(ll)
            if checkpoint_dir and (it + 1) % checkpoint_every == 0:
                m.save(emb.sparkSession, os.path.join(checkpoint_dir, f"iter_{it + 1}"))
            if prev_ll is not None and abs(ll - prev_ll) < tol:
                break
            prev_ll = ll
        if checkpoint_dir:
            m.save(emb.sparkSession, os.path.join(checkpoint_dir, "final"))
        return m
    finally:
        data.unpersist()


@dataclass
class EmState:
    """Where a stepwise fit stands: steps done, the mixture, and its blended statistics per row."""
    step: int
    mixture: Mixture
    n: np.ndarray
    s1: np.ndarray
    s2: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.step, i, float(self.mixture.weights[i]), self.mixture.means[i].tolist(), self.mixture.vars[i].tolist(), float(self.n[i]), self.s1[i].tolist(), self.s2[i].tolist())
                for i in range(self.mixture.k)]
        kinds = "step int, component int, weight double, mean array<double>, var array<double>, n double, s1 array<double>, s2 array<double>"
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "EmState":
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.component)  # one row per component
        def column(c):
            return np.array([r[c] for r in rows], np.float64)
        return cls(rows[0].step, Mixture(column("weight"), column("mean"), column("var")), column("n"), column("s1"), column("s2"))


def stepwise_em(emb: DataFrame, state: EmState, decay: float, emb_col: str = "embedding", var_floor: float = VAR_FLOOR) -> EmState:
    """One chunk: its statistics per row are blended in with the share (steps + 1) ^ -decay. An empty chunk changes the count alone."""
    n, s1, s2, _, rows = em_sums(emb, state.mixture, emb_col)
    if not rows:
        return EmState(state.step + 1, state.mixture, state.n, state.s1, state.s2)
    share = (state.step + 1) ** -decay
    n, s1, s2 = ((1 - share) * old + share * new / rows for old, new in ((state.n, n), (state.s1, s1), (state.s2, s2)))
    return EmState(state.step + 1, m_step(n, s1, s2, 1, var_floor, state.mixture), n, s1, s2)


def fit_gmm_stepwise(emb: DataFrame, k: int = 8, chunks: int = 10, epochs: int = 1, decay: float = 0.7, seed: int = 42, emb_col: str = "embedding",
                     id_col: str = "doc_id", init: Mixture | None = None, var_floor: float = VAR_FLOOR, state_dir: str | None = None, stop_after: int | None = None) -> Mixture:
    """Fit by stepwise EM over chunks of ids, warm from chunk to chunk, resumable.

    Chunk c has the rows whose id leaves c on division by ``chunks``; each of the
    ``epochs * chunks`` steps reads one chunk. With ``state_dir`` (shared) every step's state is stored, and a run
    goes on after the last one that was stored whole, whatever ``init`` it is given; a mixture
    fitted in several runs equals one fitted at once. ``stop_after`` ends a run after so many steps of its own.
    """
    from ..sources.io import _exists

    spark = emb.sparkSession

    def place(step: int) -> str:
        return os.path.join(state_dir, f"step_{step}")

    steps, state = epochs * chunks, None
    if state_dir:
        done = [t for t in range(1, steps + 1) if _exists(spark, place(t))]
        state = EmState.load(spark, place(max(done))) if done else None
    if state is None:
        m = init or init_mixture(emb, k, seed, emb_col, id_col, var_floor)
        state = EmState(0, m, np.zeros(m.k), np.zeros(m.means.shape), np.zeros(m.means.shape))
    last = steps if stop_after is None else min(steps, state.step + stop_after)
    while state.step < last:
        chunk = emb.where(F.pmod(F.col(id_col), F.lit(chunks)) == F.lit(state.step % chunks))
        state = stepwise_em(chunk, state, decay, emb_col, var_floor)
        if state_dir:
            state.save(spark, place(state.step))
    return state.mixture


def fit_by_label(emb: DataFrame, label_col: str = "label", emb_col: str = "embedding",
                 var_floor: float = VAR_FLOOR, decimals: int | None = 8) -> DataFrame:
    """One M-step from hard assignments (``label`` = component): a mixture table.

    Per-dimension mean and population variance + floor, weight = share of
    rows. Pure DataFrame aggregation (posexplode + groupBy), partial-aggregated.
    """
    x = emb.select(F.col(label_col).cast("int").alias("component"),
                   F.posexplode(emb_col).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    per = x.groupBy("component", "dim").agg(F.avg("v").alias("mu"), F.var_pop("v").alias("var"))
    rnd = (lambda c: F.round(c, decimals)) if decimals is not None else (lambda c: c)
    per = per.select("component", "dim", rnd(F.col("mu")).alias("mu"), rnd(F.col("var") + F.lit(var_floor)).alias("var"))
    counts = emb.groupBy(F.col(label_col).cast("int").alias("component")).agg(F.count(F.lit(1)).alias("n"))
    w = counts.select("component", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("weight"))
    arr = per.groupBy("component").agg(
        F.array_sort(F.collect_list(F.struct("dim", "mu", "var"))).alias("s"))
    arr = arr.select("component", F.transform("s", lambda e: e["mu"]).alias("mean"),
                     F.transform("s", lambda e: e["var"]).alias("var"))
    return w.join(arr, "component").select("component", "weight", "mean", "var")


def score_samples(emb: DataFrame, mixture: Mixture | DataFrame, id_col: str = "doc_id",
                  emb_col: str = "embedding", out_col: str = "logpdf") -> DataFrame:
    """Log-density of every row under a mixture (E4): a narrow ``mapInArrow``."""
    from ..session import ship_package
    ship_package(emb.sparkSession)
    m = mixture if isinstance(mixture, Mixture) else Mixture.from_df(mixture)
    b = emb.sparkSession.sparkContext.broadcast(m)

    def fn(batches):
        mm: Mixture = b.value
        for rb in batches:
            ids = rb.column(rb.schema.get_field_index(id_col))
            x = _matrix(rb.column(rb.schema.get_field_index(emb_col)))
            out = _logsumexp(log_density(x, mm)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(out, type=pa.float64())],
                                             names=[id_col, out_col])
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField(out_col, T.DoubleType())])
    return emb.select(id_col, emb_col).mapInArrow(fn, schema)


def score_samples_sql(emb: DataFrame, mixture: Mixture | DataFrame, id_col: str = "doc_id",
                      emb_col: str = "embedding", out_col: str = "logpdf") -> DataFrame:
    """Same density as pure DataFrame code: per-(row, component) sums, then log-sum-exp.

    Each row fans out over the K components (a generator over the small
    parameter set, K·d numbers, guarded); per-dimension terms are summed with
    ``aggregate`` over ``zip_with`` of the arrays, and the K values of a row
    are combined in the same pass. :func:`score_samples` is the vectorised
    path for large mixtures.
    """
    m = mixture if isinstance(mixture, Mixture) else Mixture.from_df(mixture)
    if m.k * m.means.shape[1] > 200_000:  # too many literals for a plan: the vectorised form gives the same densities
        return score_samples(emb, m, id_col, emb_col, out_col)
    comps = F.array(*[F.struct(F.lit(float(m.weights[i])).alias("weight"),
                               F.array(*[F.lit(float(v)) for v in m.means[i]]).alias("mean"),
                               F.array(*[F.lit(float(v)) for v in m.vars[i]]).alias("var"))
                      for i in range(m.k)])
    x = F.transform(F.col(emb_col), lambda v: v.cast("double"))

    def comp_logpdf(c):
        terms = F.zip_with(x, F.arrays_zip(c["mean"], c["var"]),
                           lambda xv, mv: F.log(mv["var"]) + (xv - mv["mean"]) * (xv - mv["mean"]) / mv["var"])
        s = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
        return F.log(c["weight"]) - F.lit(0.5) * (F.size(x) * F.lit(LOG2PI) + s)
    a = F.transform(comps, comp_logpdf)
    out = emb.select(id_col, a.alias("_a")).select(id_col, "_a", F.array_max("_a").alias("_m"))
    lse = F.col("_m") + F.log(F.aggregate("_a", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("_m"))))
    return out.select(id_col, lse.alias(out_col))


def embedding_log_weight(emb: DataFrame, raw_mixture, target_mixture, id_col: str = "doc_id",
                         emb_col: str = "embedding") -> DataFrame:
    """log p_target(x) - log p_raw(x) for the raw rows (E5): both mixtures in one narrow pass."""
    from ..session import ship_package
    ship_package(emb.sparkSession)
    both = tuple(m if isinstance(m, Mixture) else Mixture.from_df(m) for m in (raw_mixture, target_mixture))
    b = emb.sparkSession.sparkContext.broadcast(both)

    def fn(batches):
        for rb in batches:
            x = _matrix(rb.column(rb.schema.get_field_index(emb_col)))
            raw, target = (_logsumexp(log_density(x, m)) if len(x) else np.zeros(0) for m in b.value)
            yield pa.RecordBatch.from_arrays([rb.column(rb.schema.get_field_index(id_col)).cast(pa.int64()), pa.array(raw), pa.array(target), pa.array(target - raw)],
                                             names=[id_col, "raw_logpdf", "target_logpdf", "gmm_weight"])
    return emb.select(id_col, emb_col).mapInArrow(fn, f"{id_col} long, raw_logpdf double, target_logpdf double, gmm_weight double")


def _both_weights(ngram: DataFrame, gmm: DataFrame, id_col: str, ng_col: str, gmm_col: str, strict: bool) -> DataFrame:
    """Both weights by id. ``strict``: an id with only one of them is an error, found while the join runs."""
    a, b = ngram.select(id_col, F.col(ng_col).alias("_ng")), gmm.select(id_col, F.col(gmm_col).alias("_gm"))
    if not strict:
        return a.join(b, id_col)
    j = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), id_col, "full_outer")
    lack = F.raise_error(F.concat(F.lit("no n-gram or no mixture weight for id "), F.col(id_col).cast("string"))).cast("double")
    return j.select(id_col, F.when(F.col("_a") & F.col("_b"), F.col("_ng")).otherwise(lack).alias("_ng"), "_gm")


def hybrid_weight(ngram: DataFrame, gmm: DataFrame, alpha: float = 0.5, id_col: str = "doc_id",
                  ng_col: str = "log_weight", gmm_col: str = "gmm_weight", strict: bool = False) -> DataFrame:
    """alpha*(ng + 1e-8) + (1-alpha)*(gmm + 1e-8), joined on the id.

    Without ``strict`` the result has the ids that have both weights.
    """
    j = _both_weights(ngram, gmm, id_col, ng_col, gmm_col, strict)
    return j.select(id_col, (F.lit(alpha) * (F.col("_ng") + F.lit(1e-8)) +
                             F.lit(1.0 - alpha) * (F.col("_gm") + F.lit(1e-8))).alias("hybrid_weight"))


def hybrid_sweep(ngram: DataFrame, gmm: DataFrame, alphas=(0.0, 0.25, 0.5, 0.75), id_col: str = "doc_id",
                 ng_col: str = "log_weight", gmm_col: str = "gmm_weight", strict: bool = False) -> DataFrame:
    """All alphas at once: each joined row fans out over the literal alpha list (E6 sweep)."""
    j = _both_weights(ngram, gmm, id_col, ng_col, gmm_col, strict)
    j = j.select("*", F.explode(F.array(*[F.lit(float(x)) for x in alphas])).alias("alpha"))
    return j.select("alpha", id_col, (F.col("alpha") * (F.col("_ng") + F.lit(1e-8)) +
                                                   (F.lit(1.0) - F.col("alpha")) * (F.col("_gm") + F.lit(1e-8)))
                                 .alias("hybrid_weight"))


def cap_samples(emb: DataFrame, max_samples, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """``'all'`` or the first ``max_samples`` rows in a seeded order."""
    if max_samples in ("all", None):
        return emb
    from .select import top_k
    keyed = emb.withColumn("_cap", seeded_order_key(seed, "cap", id_col))
    return top_k(keyed, int(max_samples), "_cap", id_col).drop("_cap")


def hashed_embedding(dim: int = 64, n: int = 2) -> Callable:
    """Default text encoder: signed hashed n-gram projection, L2-normalised.

    Deterministic and dependency-free; a stand-in for a sentence encoder
    (none is available offline). Any ``fn(list[str]) -> np.ndarray`` works.
    """
    def encode(texts):
        import pyarrow.compute as pc
        import xxhash

        low = pc.utf8_lower(pc.fill_null(pa.array(texts, pa.large_string()), ""))
        spaced = pc.replace_substring_regex(low, r"([^\p{L}\p{N}_\s]+)", r" \1 ")
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(spaced))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(texts)), counts)
        flat = lists.flatten()
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for size in range(1, n + 1):
            inside = np.arange(max(len(row) - size + 1, 0))
            inside = inside[row[inside] == row[inside + size - 1]] if len(inside) else inside
            parts = [flat.take(pa.array(inside + i)) for i in range(size)]
            grams = pc.dictionary_encode(parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())))
            # each distinct n-gram of the batch is hashed once
            h = np.array([xxhash.xxh64_intdigest(g) if g else 0 for g in grams.dictionary.to_pylist()], dtype=np.uint64)[grams.indices.to_numpy(zero_copy_only=False)]
            named = pc.greater(pc.binary_length(parts[0]), 0).to_numpy(zero_copy_only=False) if len(inside) else np.zeros(0, bool)
            sign = np.where(h >> np.uint64(63), 1.0, -1.0) * named
            np.add.at(out, (row[inside], (h % np.uint64(dim)).astype(np.int64)), sign)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1.0)).astype(np.float32)
    return encode


def embed(df: DataFrame, encoder: Callable | None = None, id_col: str = "doc_id", text_col: str = "text",
          batch_size: int = 256) -> DataFrame:
    """Text -> ``(doc_id, embedding ARRAY<FLOAT>)`` with an encoder loaded once per task."""
    from ..session import ship_package
    ship_package(df.sparkSession)
    enc_factory = (lambda: encoder) if encoder is not None else (lambda: hashed_embedding())

    def fn(batches):
        enc = enc_factory()
        for rb in batches:
            ids = rb.column(rb.schema.get_field_index(id_col))
            texts = rb.column(rb.schema.get_field_index(text_col)).to_pylist()
            parts = []
            for s in range(0, len(texts), batch_size):
                parts.append(np.asarray(enc(texts[s:s + batch_size]), dtype=np.float32))
            mat = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            d = mat.shape[1] if mat.ndim == 2 else 0
            offs = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * d)
            arr = pa.ListArray.from_arrays(offs, pa.array(mat.ravel(), type=pa.float32()))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), arr], names=[id_col, "embedding"])
    schema = T.StructType([T.StructField(id_col, T.LongType()),
                           T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return df.select(id_col, text_col).mapInArrow(fn, schema)
