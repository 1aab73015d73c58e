"""Hashed n-gram importance model: fit bucket distributions, score documents.

Fitted state is a B-row table ``(target, bucket, raw_p, target_p, log_diff,
ld_e10)``. B is a parameter (default 10,000 buckets, at most 2^28), never a
data size, so the table is safe to broadcast: scoring is
``features`` gathered from a broadcast ``log_diff`` vector, row by row.

Exactness: ``log_diff`` is rounded to 10 decimals and carried as a scaled
integer ``ld_e10``; document weights are exact integer sums
(``weight_e10``), so scores and rankings do not depend on summation order or
partitioning.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .features import entry_slices, features_long, ngram_features, total_ngrams
from ..functions.text import example_length

VERSION = "1"
E10 = 10_000_000_000
AUTO_TOKENS_PER_BUCKET = 100_000
# Parameter-sized tables up to this many rows are broadcast (B x T log-ratio table).
BROADCAST_MAX_ROWS = 1 << 22


def resolve_budget(num_tokens_to_fit, num_buckets: int):
    """``'auto'`` -> 100000 * B, ``'all'``/None -> no budget, int -> int."""
    if num_tokens_to_fit == "auto":
        return AUTO_TOKENS_PER_BUCKET * num_buckets
    if num_tokens_to_fit in ("all", None):
        return None
    return int(num_tokens_to_fit)


def budgeted(features: DataFrame, budget: int | None, n: int, num_shards: int = 1,
             id_col: str = "doc_id") -> DataFrame:
    """Token-budgeted prefix.

    Virtual shard = ``pmod(doc_id, num_shards)``; inside a shard, documents in
    ``doc_id`` order are kept while the n-gram total of the documents *before*
    them is at most ``budget // num_shards`` (the reference stops after the
    document that crosses the budget).

    The running sum is a distributed prefix sum over (id, n-gram total) pairs:
    no window spans a shard, whatever the ids look like.
    """
    if budget is None:
        return features
    from .select import prefix_sum

    per_shard = budget // num_shards
    totals = features.select(id_col, total_ngrams("n_tokens", n).alias("_g"), F.pmod(F.col(id_col), F.lit(num_shards)).alias("_shard"))
    # one row per shard (a parameter) to the driver: if no shard reaches its budget, nothing is cut
    shards = {r["_shard"]: r["t"] for r in totals.groupBy("_shard").agg(F.sum("_g").alias("t")).collect()}
    if max(shards.values(), default=0) <= per_shard:
        return features
    before, start = 0, []
    for shard in sorted(shards):
        start.append((shard, before))
        before += shards[shard]
    ran = prefix_sum(totals, ["_shard", id_col], "_g", "_before")
    offsets = features.sparkSession.createDataFrame(start, "_shard long, _start long")
    kept = ran.withColumn("_shard", F.col("_shard").cast("long")).join(F.broadcast(offsets), "_shard").where(F.col("_before") - F.col("_start") <= F.lit(per_shard))
    return features.join(kept.select(id_col), id_col, "left_semi")


def budgeted_features(df: DataFrame, budget: int, n: int = 2, num_buckets: int = 10000, tokenizer: str | Callable = "wordpunct",
                      hash_fn: str = "sha256", num_shards: int = 1, id_col: str = "doc_id", text_col: str = "text", rounds: int = 10) -> DataFrame:
    """The features that :func:`budgeted` keeps, without featurising what comes after them.

    One pass over the id column alone finds the ids below which 1/2^``rounds``, ..., 1/4, 1/2 of the
    rows lie. Ranges between them are featurised and stored one after the other, each as large as all
    before, until every shard holds more n-grams than its budget. The ids are pushed down to the
    scan, so texts of later row groups are never read; at most about twice the kept prefix
    (or the first range) is.
    """
    from .select import _stored

    shares = [2.0 ** -k for k in range(rounds, 0, -1)]
    ids = F.col(id_col).cast("long")
    cuts = df.select(F.percentile_approx(ids, shares, 100_000).alias("c")).first()["c"] or []
    cuts = [*sorted(set(cuts)), None]
    per_shard = budget // num_shards
    own = [r[0] for r in df.select(F.pmod(ids, F.lit(num_shards)).alias("s")).distinct().collect() if r[0] is not None] if num_shards > 1 else [0]
    seen: dict[int, int] = dict.fromkeys(own, 0)
    parts, low = None, None
    for cut in cuts:
        part = df if low is None else df.where(ids > F.lit(low))
        part = part if cut is None else part.where(ids <= F.lit(cut))
        part = _stored(ngram_features(part, id_col, text_col, n, num_buckets, tokenizer, hash_fn))
        parts = part if parts is None else parts.unionByName(part)
        for r in part.groupBy(F.pmod("doc_id", F.lit(num_shards)).alias("s")).agg(F.sum(total_ngrams("n_tokens", n)).alias("t")).collect():  # one row per shard
            if r["s"] is not None:
                seen[r["s"]] = seen.get(r["s"], 0) + r["t"]
        if seen and min(seen.values()) > per_shard:
            break
        low = cut
    return budgeted(parts, budget, n, num_shards)


def bucket_counts(features: DataFrame, num_buckets: int, by: Sequence[str] = ()) -> DataFrame:
    """Corpus bag of n-grams (A1): ``(*by, bucket, cnt)``, partial-aggregated map-side."""
    long = features_long(features)
    cols = list(by)
    if cols:
        long = features.select("doc_id", *cols, F.explode(F.arrays_zip("buckets", "counts")).alias("z")) \
            .select(*cols, F.col("z.buckets").alias("bucket"), F.col("z.counts").cast("long").alias("cnt"))
    return long.groupBy(*cols, "bucket").agg(F.sum("cnt").alias("cnt"))


def dense_buckets(spark: SparkSession, counts: DataFrame, num_buckets: int, smoothing: float = 0.0) -> DataFrame:
    """All B buckets with (smoothed) counts and probabilities (A3, A4).

    ``p = (cnt + s) / (total + s*B)``. The bucket range is generated with
    ``spark.range`` and left-joined, so empty buckets get zero counts.
    """
    full = spark.range(num_buckets).select(F.col("id").cast("int").alias("bucket"))
    c = full.join(counts.select("bucket", "cnt"), "bucket", "left") \
        .select("bucket", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))
    c = _with_totals(c, ["cnt"], num_buckets).withColumnRenamed("_total_cnt", "total")
    den = F.col("total") + F.lit(smoothing * num_buckets)
    p = F.when(den > 0, (F.col("cnt") + F.lit(smoothing)) / den).otherwise(
        F.raise_error(F.lit("empty corpus: no n-grams to fit a distribution on")).cast("double"))
    return c.select("bucket", "cnt", F.col("total"), p.alias("p"))


def _with_totals(dense: DataFrame, cols: Sequence[str], num_buckets: int) -> DataFrame:
    """The bucket table with ``_total_<col>`` columns.

    A table of parameter size takes a window over its rows; a larger one is
    stored once and its totals come from partial sums.
    """
    if num_buckets <= BROADCAST_MAX_ROWS:
        w = Window.partitionBy()
        return dense.select("*", *[F.sum(c).over(w).alias(f"_total_{c}") for c in cols])
    from .select import _stored
    dense = _stored(dense)
    totals = dense.agg(*[F.sum(c).alias(c) for c in cols]).first()
    return dense.select("*", *[F.lit(totals[c]).alias(f"_total_{c}") for c in cols])


def log_diff_col(target_p: Column, raw_p: Column) -> Column:
    """Smoothed log ratio ln(p_t + 1e-8) - ln(p_r + 1e-8)."""
    return F.log(target_p + F.lit(1e-8)) - F.log(raw_p + F.lit(1e-8))


def scaled(ld: Column) -> Column:
    """log_diff rounded to 10 decimals, as an exact integer multiple of 1e-10."""
    return F.round(ld * F.lit(float(E10)), 0).cast("long")


@dataclass
class NgramModel:
    """Fitted hashed n-gram importance estimator."""
    params: dict
    table: DataFrame  # target, bucket, raw_cnt, raw_p, target_cnt, target_p, log_diff, ld_e10
    proportions: DataFrame | None = None  # target, proportion
    targets: list[str] = field(default_factory=list)

    # -- persistence (S12) --
    def save(self, path: str) -> None:
        spark = self.table.sparkSession
        self.table.write.mode("overwrite").parquet(os.path.join(path, "buckets"))
        if self.proportions is not None:
            self.proportions.write.mode("overwrite").parquet(os.path.join(path, "proportions"))
        settings = dict(self.params, version=VERSION, targets=self.targets, has_proportions=self.proportions is not None)
        spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "settings string") \
            .coalesce(1).write.mode("overwrite").text(os.path.join(path, "settings"))

    @classmethod
    def load(cls, spark: SparkSession, path: str, exclude_keys: Sequence[str] | None = None,
             defaults: dict | None = None) -> "NgramModel":
        import warnings
        settings = json.loads(spark.read.text(os.path.join(path, "settings")).first()[0])
        if settings.get("version") != VERSION:
            warnings.warn(f"Version mismatch: saved {settings.get('version')} != current {VERSION}")
        targets = settings.pop("targets", [])
        settings.pop("version", None)
        has_proportions = settings.pop("has_proportions", False)
        params = dict(defaults or {})
        for k, v in settings.items():
            if exclude_keys and k in exclude_keys:
                continue
            params[k] = v
        table = spark.read.parquet(os.path.join(path, "buckets"))
        proportions = spark.read.parquet(os.path.join(path, "proportions")) if has_proportions else None
        return cls(params=params, table=table, proportions=proportions, targets=targets)


def fit(raw: DataFrame, targets: DataFrame | dict[str, DataFrame], *, n: int = 2, num_buckets: int = 10000,
        tokenizer: str | Callable = "wordpunct", hash_fn: str = "sha256", num_tokens_to_fit="all",
        target_laplace_smoothing: float = 0.0, separate_targets: bool = False,
        target_proportions: Sequence[float] | None = None, num_shards: int = 1,
        raw_features: DataFrame | None = None, target_budget=None) -> NgramModel:
    """Fit raw and target bucket distributions from texts.

    ``raw``/targets: DataFrames with ``doc_id, text``. ``targets`` may be a
    dict name -> DataFrame (several targets); with ``separate_targets=False``
    they are pooled into one target named ``target``.
    ``num_tokens_to_fit`` bounds the raw fit (A2); targets use all tokens
    unless separate (the reference then applies the same budget per target).
    """
    def feats(df):
        return ngram_features(df, n=n, num_buckets=num_buckets, tokenizer=tokenizer, hash_fn=hash_fn)

    if isinstance(targets, DataFrame):
        targets = {"target": targets}
    if not separate_targets and len(targets) > 1:
        pooled = None
        for df in targets.values():
            d = df.select("doc_id", "text")
            pooled = d if pooled is None else pooled.unionAll(d)
        targets = {"target": pooled}
    budget = resolve_budget(num_tokens_to_fit, num_buckets)
    if raw_features is not None:
        rf = raw_features
    elif budget is not None:
        rf = budgeted_features(raw, budget, n, num_buckets, tokenizer, hash_fn, num_shards)
    else:
        rf = feats(raw)
    return fit_from_features(rf, {k: feats(v) for k, v in targets.items()}, n=n, num_buckets=num_buckets,
                             tokenizer=tokenizer, hash_fn=hash_fn, num_tokens_to_fit=num_tokens_to_fit,
                             target_laplace_smoothing=target_laplace_smoothing,
                             separate_targets=separate_targets, target_proportions=target_proportions,
                             num_shards=num_shards, target_budget=target_budget)


def fit_from_features(raw_features: DataFrame, target_features: dict[str, DataFrame], *, n: int = 2,
                      num_buckets: int = 10000, tokenizer: str | Callable = "wordpunct", hash_fn: str = "sha256",
                      num_tokens_to_fit="all", target_laplace_smoothing: float = 0.0,
                      separate_targets: bool = False, target_proportions: Sequence[float] | None = None,
                      num_shards: int = 1, target_budget=None) -> NgramModel:
    """Fit from feature tables already built (e.g. stored once and reused for scoring).

    A target that is a subset of the raw pool can pass
    ``raw_features.join(target_ids, "doc_id", "left_semi")`` - no second
    featurisation of its texts.
    """
    spark = raw_features.sparkSession
    budget = resolve_budget(num_tokens_to_fit, num_buckets)
    rcounts = bucket_counts(budgeted(raw_features, budget, n, num_shards), num_buckets)
    raw_dense = dense_buckets(spark, rcounts, num_buckets).select(
        "bucket", F.col("cnt").alias("raw_cnt"), F.col("p").alias("raw_p"))

    names = list(target_features)
    parts = []
    totals = []
    for name, tf in target_features.items():
        if separate_targets:
            tb = resolve_budget(target_budget, num_buckets) if target_budget is not None else budget
        else:
            tb = resolve_budget(target_budget, num_buckets) if target_budget is not None else None
        tc = bucket_counts(budgeted(tf, tb, n, num_shards), num_buckets)
        td = dense_buckets(spark, tc, num_buckets, target_laplace_smoothing)
        parts.append(td.select(F.lit(name).alias("target"), "bucket", F.col("cnt").alias("target_cnt"),
                               F.col("p").alias("target_p")))
        totals.append(tc.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total")).select(
            F.lit(name).alias("target"), "total"))
    tgt = parts[0]
    for p in parts[1:]:
        tgt = tgt.unionAll(p)
    table = tgt.join(raw_dense, "bucket").withColumn(
        "log_diff", log_diff_col(F.col("target_p"), F.col("raw_p"))).withColumn("ld_e10", scaled(F.col("log_diff")))
    table = table.select("target", "bucket", "raw_cnt", "raw_p", "target_cnt", "target_p", "log_diff", "ld_e10")

    tot = totals[0]
    for t in totals[1:]:
        tot = tot.unionAll(t)
    if target_proportions is not None:
        s = float(sum(target_proportions))
        rows = [(nm, float(p) / s) for nm, p in zip(names, target_proportions)]
        proportions = spark.createDataFrame(rows, "target string, proportion double")
    else:
        w = Window.partitionBy()
        proportions = tot.select("target", (F.col("total") / F.sum("total").over(w)).alias("proportion"))
    params = dict(n=n, num_buckets=num_buckets, tokenizer=tokenizer if isinstance(tokenizer, str) else "custom",
                  hash_fn=hash_fn, num_tokens_to_fit=num_tokens_to_fit,
                  target_laplace_smoothing=target_laplace_smoothing, separate_targets=separate_targets,
                  num_shards=num_shards)
    return NgramModel(params=params, table=table, proportions=proportions, targets=names)


def log_weights(features: DataFrame, model: NgramModel | DataFrame, min_example_length: int | None = 100,
                n: int | None = None) -> DataFrame:
    """Per-document log importance weight for every target.

    Output: ``doc_id, target, n_tokens, length, weight_e10, log_weight``
    where ``log_weight = round(weight_e10 / 1e10, 6)``. Documents shorter than
    ``min_example_length`` (reference length formula) are dropped first.
    A table of at most ``BROADCAST_MAX_ROWS`` entries is shipped to the tasks and
    scoring moves no row; a larger one is joined on the bucket.
    """
    if n is None:
        n = model.params["n"] if isinstance(model, NgramModel) else 2
    f = features.withColumn("length", example_length("n_tokens", n))
    if min_example_length is not None:
        f = f.where(F.col("length") >= F.lit(min_example_length))
    if isinstance(model, NgramModel) and int(model.params["num_buckets"]) * max(1, len(model.targets)) <= BROADCAST_MAX_ROWS:
        return score_features_arrow(f.drop("length"), model, n=n).select("doc_id", "target", "n_tokens", "length", "weight_e10", "log_weight")
    return _log_weights_joined(f, model)


def _log_weights_joined(f: DataFrame, model: NgramModel | DataFrame) -> DataFrame:
    """Scores by a join on the bucket, for tables too large to ship."""
    table = model.table if isinstance(model, NgramModel) else model
    long = f.select("doc_id", "n_tokens", "length", F.explode(F.arrays_zip("buckets", "counts")).alias("z")) \
        .select("doc_id", "n_tokens", "length", F.col("z.buckets").alias("bucket"),
                F.col("z.counts").cast("long").alias("cnt"))
    scored = long.join(table.select("target", "bucket", "ld_e10"), "bucket").groupBy("doc_id", "target", "n_tokens", "length").agg(
        F.sum(F.col("cnt") * F.col("ld_e10")).alias("weight_e10"))
    # documents without n-grams that pass the length filter weigh zero
    names = model.targets if isinstance(model, NgramModel) and model.targets else \
        [r[0] for r in table.select("target").distinct().collect()]
    empty = f.where(F.size("buckets") == 0).select(
        "doc_id", F.explode(F.array(*[F.lit(t) for t in names])).alias("target"), "n_tokens", "length") \
        .withColumn("weight_e10", F.lit(0).cast("long"))
    scored = scored.unionByName(empty)
    return scored.withColumn("log_weight", F.round(F.col("weight_e10").cast("double") / F.lit(float(E10)), 6))


def score_features_arrow(features: DataFrame, model: NgramModel, target: str | None = None,
                         n: int | None = None) -> DataFrame:
    """Row-local scoring: ``weight_e10 = sum(count * ld_e10[bucket])`` per document and target.

    The ``ld_e10`` vectors (targets x buckets numbers) travel as a broadcast
    variable; each task scores its own rows with one NumPy gather per batch. No
    join, no aggregation and no state, so it also runs unchanged on a stream.
    Output: ``doc_id, target, n_tokens, length, weight_e10, log_weight``, for
    ``target`` or for all targets; a document without n-grams weighs zero.
    """
    from ..session import ship_package
    ship_package(features.sparkSession)
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    nb = int(model.params["num_buckets"])
    names = [target] if target else list(model.targets)
    if nb * len(names) > BROADCAST_MAX_ROWS:
        raise ValueError(f"{nb} buckets for {len(names)} targets are too many to ship to every task; score with log_weights (join)")
    n = n or int(model.params["n"])
    ld = np.zeros((len(names), nb), dtype=np.int64)
    rows = model.table.where(F.col("target").isin(names)).select("target", "bucket", "ld_e10").toArrow()
    which = np.array([names.index(t) for t in rows.column("target").to_pylist()], dtype=np.int64)
    ld[which, np.asarray(rows.column("bucket"))] = np.asarray(rows.column("ld_e10"))
    bld = features.sparkSession.sparkContext.broadcast(ld)

    def fn(batches):
        vectors = bld.value
        for rb in (part for big in batches for part in entry_slices(big)):
            bk = rb.column(rb.schema.get_field_index("buckets"))
            lens = pc.fill_null(pc.list_value_length(bk), 0).to_numpy(zero_copy_only=False)
            b = pc.list_flatten(bk).to_numpy(zero_copy_only=False).astype(np.int64)
            c = pc.list_flatten(rb.column(rb.schema.get_field_index("counts"))).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
            for name, vec in zip(names, vectors):
                run = np.concatenate([[0], np.cumsum(c * vec[b])])  # differences of running sums: empty rows are zero
                yield pa.RecordBatch.from_arrays(
                    [rb.column(rb.schema.get_field_index("doc_id")), pa.array([name] * len(lens), pa.string()),
                     rb.column(rb.schema.get_field_index("n_tokens")), pa.array(run[ends[1:]] - run[ends[:-1]], pa.int64())],
                    names=["doc_id", "target", "n_tokens", "weight_e10"])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("target", T.StringType()), T.StructField("n_tokens", T.IntegerType()),
                           T.StructField("weight_e10", T.LongType())])
    out = features.select("doc_id", "n_tokens", "buckets", "counts").mapInArrow(fn, schema)
    return out.withColumn("length", example_length("n_tokens", n)) \
        .withColumn("log_weight", F.round(F.col("weight_e10").cast("double") / F.lit(float(E10)), 6))


def fit_subset_targets(raw_features: DataFrame, target_ids: dict[str, DataFrame], *, n: int = 2,
                       num_buckets: int = 10000, tokenizer: str = "wordpunct", hash_fn: str = "sha256",
                       num_tokens_to_fit="all", target_laplace_smoothing: float = 0.0,
                       separate_targets: bool = False, target_proportions: Sequence[float] | None = None,
                       num_shards: int = 1) -> NgramModel:
    """Fit when every target is a set of raw documents: one scan of the features.

    Each feature row is tagged with the targets its document belongs to (one
    join on ``doc_id``), then raw and per-target bucket counts come out of the
    same partial aggregation. A document listed twice counts twice, as it does in
    :func:`fit`. When the raw token budget cuts the raw pool, the same targets
    are fitted by :func:`fit_from_features`.
    """
    names = list(target_ids)
    if not separate_targets and len(names) > 1:
        pooled = None
        for v in target_ids.values():
            pooled = v.select("doc_id") if pooled is None else pooled.unionByName(v.select("doc_id"))
        target_ids = {"target": pooled}
        names = ["target"]
    budget = resolve_budget(num_tokens_to_fit, num_buckets)
    if budget is not None and budgeted(raw_features, budget, n, num_shards) is not raw_features:
        return fit_from_features(
            raw_features, {k: raw_features.join(v.select("doc_id"), "doc_id") for k, v in target_ids.items()},
            n=n, num_buckets=num_buckets, tokenizer=tokenizer, hash_fn=hash_fn, num_tokens_to_fit=num_tokens_to_fit,
            target_laplace_smoothing=target_laplace_smoothing, separate_targets=separate_targets,
            target_proportions=target_proportions, num_shards=num_shards)
    spark = raw_features.sparkSession
    tags = None
    for i, name in enumerate(names):
        t = target_ids[name].select("doc_id").withColumn("_t", F.lit(i))
        tags = t if tags is None else tags.unionByName(t)
    times = [F.sum((F.col("_t") == i).cast("long")).alias(f"_m{i}") for i in range(len(names))]
    tagged = raw_features.join(tags.groupBy("doc_id").agg(*times), "doc_id", "left")
    marks = [F.coalesce(f"_m{i}", F.lit(0)).alias(f"_m{i}") for i in range(len(names))]
    long = tagged.select(*marks, F.explode(F.arrays_zip("buckets", "counts")).alias("z")) \
        .select(*[f"_m{i}" for i in range(len(names))], F.col("z.buckets").alias("bucket"), F.col("z.counts").cast("long").alias("cnt"))
    counts = long.groupBy("bucket").agg(F.sum("cnt").alias("raw"), *[F.sum(F.col("cnt") * F.col(f"_m{i}")).alias(f"_c{i}") for i in range(len(names))])
    full = spark.range(num_buckets).select(F.col("id").cast("int").alias("bucket"))
    dense = full.join(counts, "bucket", "left").na.fill(0)
    dense = _with_totals(dense, ["raw", *[f"_c{i}" for i in range(len(names))]], num_buckets)

    def _share(num, den, what):
        return F.when(den > 0, num / den).otherwise(
            F.raise_error(F.lit(f"empty {what}: no n-grams to fit a distribution on")).cast("double"))
    dense = dense.withColumn("raw_p", _share(F.col("raw"), F.col("_total_raw"), "raw corpus"))
    s = float(target_laplace_smoothing)
    parts = []
    for i, name in enumerate(names):
        c = F.col(f"_c{i}")
        tp = _share(c + F.lit(s), F.col(f"_total__c{i}") + F.lit(s * num_buckets), f"target '{name}'")
        parts.append(dense.select(F.lit(name).alias("target"), "bucket", F.col("raw").alias("raw_cnt"), "raw_p",
                                  c.alias("target_cnt"), tp.alias("target_p")))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    table = table.withColumn("log_diff", log_diff_col(F.col("target_p"), F.col("raw_p"))) \
        .withColumn("ld_e10", scaled(F.col("log_diff")))
    table = table.select("target", "bucket", "raw_cnt", "raw_p", "target_cnt", "target_p", "log_diff", "ld_e10")
    tot = table.groupBy("target").agg(F.sum("target_cnt").alias("total"))
    if target_proportions is not None:
        ssum = float(sum(target_proportions))
        proportions = spark.createDataFrame([(nm, float(p) / ssum) for nm, p in zip(names, target_proportions)],
                                            "target string, proportion double")
    else:
        proportions = tot.select("target", (F.col("total") / F.sum("total").over(Window.partitionBy())).alias("proportion"))
    params = dict(n=n, num_buckets=num_buckets, tokenizer=tokenizer, hash_fn=hash_fn,
                  num_tokens_to_fit=num_tokens_to_fit, target_laplace_smoothing=target_laplace_smoothing,
                  separate_targets=separate_targets, num_shards=num_shards)
    return NgramModel(params=params, table=table, proportions=proportions, targets=names)
