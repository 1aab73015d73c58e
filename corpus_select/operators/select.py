"""Selection: exact top-k, Gumbel top-k, quotas, multi-target selection,
Pareto sampling, domain include/exclude/top-up, seeded random picks, dense
positional index, and the joins that attach picks back to the corpus.

Ordering rule everywhere: key descending, then ``doc_id`` ascending, so the
result is a pure function of the data and the seed (never of partitioning).
Top-k only ever moves ``(id, key)`` pairs; texts are fetched by a semi join.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import gumbel, pareto, seeded_order_key, seeded_uniform
from .ngram_model import E10

# Above this k the exact bracket method replaces a single ordered limit.
SMALL_K = 100_000
_ACCURACY = 100_000
# Pareto rounds looked at in one aggregate.
ROUND_STEPS = 1 << 12


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def top_k(df: DataFrame, k: int, key: str = "weight_e10", id_col: str = "doc_id",
          small_k: int = SMALL_K) -> DataFrame:
    """The k rows with the largest ``key`` (ties: smaller id first) (K1, K6, K8).

    k >= pool size returns the whole pool. Small k: one ordered limit (each
    partition keeps its own top k, then a k-row merge). Large k: exact
    bracket method — approximate quantiles give a key interval that must
    contain the cut; rows above it are kept outright and only the rows inside
    the interval are ranked, recursively. When the interval is a single key
    value (massive ties), the ranking switches to the id, which is unique.
    """
    if k <= 0:
        return df.limit(0)
    if k <= small_k:
        return df.orderBy(F.col(key).desc(), F.col(id_col).asc()).limit(k)
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.count(key).alias("keys")).first()
    if k >= size["rows"]:
        return df
    known = df.where(F.col(key).isNotNull())
    if k < size["keys"]:
        return _bracket(known, k, F.col(key), id_col, size["keys"], small_k, by_id=False)
    if k == size["keys"]:
        return known
    # rows without a key rank last, among themselves by id
    unknown = df.where(F.col(key).isNull())
    return known.unionByName(_bracket(unknown, k - size["keys"], F.col(key), id_col, size["rows"] - size["keys"], small_k, by_id=True))


def _bracket(df: DataFrame, k: int, key: Column, id_col: str, total: int, small_k: int,
             by_id: bool) -> DataFrame:
    # `score` is "bigger is better"; for the id tie-break that is -id.
    score = (-F.col(id_col)) if by_id else key
    q = 1.0 - k / total
    found = None
    for width in (3.0, 30.0, 300.0):
        d = width / _ACCURACY
        lo_q, hi_q = max(q - d, 0.0), min(q + d, 1.0)
        lo, hi = df.select(F.percentile_approx(score, [lo_q, hi_q], _ACCURACY).alias("b")).first()["b"]
        stats = df.select(F.sum((score > F.lit(hi)).cast("long")).alias("above"),
                          F.sum(score.between(F.lit(lo), F.lit(hi)).cast("long")).alias("within")).first()
        above, within = stats["above"] or 0, stats["within"] or 0
        if above <= k <= above + within and (within < total or width == 300.0):
            found = (lo, hi, above, within)
            break
    if found is not None and found[3] >= total and found[0] == found[1] and not by_id:
        # every row carries the same key: the order is the id order
        return _bracket(df, k, key, id_col, total, small_k, by_id=True)
    if found is None or found[3] >= total:
        # the interval did not narrow the pool (not expected): positions in a range-partitioned order
        order = [F.col(id_col).asc()] if by_id else [key.desc(), F.col(id_col).asc()]
        return dense_index(df, order, "_rank").where(F.col("_rank") < F.lit(k)).drop("_rank")
    lo, hi, above, within = found
    kept = df.where(score > F.lit(hi))
    rest = k - above
    if rest == 0:
        return kept
    inside = df.where(score.between(F.lit(lo), F.lit(hi)))
    if rest <= small_k:
        if by_id:
            picks = inside.orderBy(F.col(id_col).asc()).limit(rest)
        else:
            picks = inside.orderBy(key.desc(), F.col(id_col).asc()).limit(rest)
    elif lo == hi and not by_id:
        # one tied key value: rank the tied rows by id, which is unique
        picks = _bracket(inside, rest, key, id_col, within, small_k, by_id=True)
    else:
        picks = _bracket(inside, rest, key, id_col, within, small_k, by_id=by_id)
    return kept.unionByName(picks)


def gumbel_key(key: str = "weight_e10", seed: int = 0, salt: str = "gumbel", id_col: str = "doc_id") -> Column:
    """Weight plus Gumbel(0,1) noise, on the same exact 1e-10 integer scale (K2)."""
    g = F.round(gumbel(seed, salt, id_col) * F.lit(float(E10)), 0).cast("long")
    return F.col(key) + g


def gumbel_top_k(df: DataFrame, k: int, key: str = "weight_e10", seed: int = 0, salt: str = "gumbel",
                 id_col: str = "doc_id") -> DataFrame:
    """Weighted sampling without replacement of k rows (Gumbel top-k, K2)."""
    noisy = df.withColumn("sample_key", gumbel_key(key, seed, salt, id_col))
    return top_k(noisy, k, "sample_key", id_col)


def quota_split(k: int, proportions: Sequence[float]) -> list[int]:
    """``int(k * p)`` per target, remainder to the last one (K3)."""
    s = float(sum(proportions))
    q = [int(k * (p / s)) for p in proportions]
    q[-1] += k - sum(q)
    return q


def select_multi_target(weights: DataFrame, k: int, targets: Sequence[str], proportions: Sequence[float],
                        top_k_mode: bool = True, seed: int = 0, key: str = "weight_e10",
                        id_col: str = "doc_id") -> DataFrame:
    """Sequential per-target selection.

    ``weights``: ``(doc_id, target, weight_e10)``. For each target in order,
    rank the rows not chosen yet by that target's weight and take its quota;
    zero quotas are skipped. Output ``(doc_id, target, weight_e10, rank_key)``.
    T (number of targets) is a parameter, so the loop is over a handful of
    distributed top-k jobs.
    """
    quotas = quota_split(k, proportions)
    if sum(q > 0 for q in quotas) > 1:
        # every target reads the weights, and the anti-joins of later ones read them again
        weights = _stored(weights)
    chosen = None
    for t, qk in zip(targets, quotas):
        if qk == 0:
            continue
        pool = weights.where(F.col("target") == F.lit(t))
        if chosen is not None:
            pool = pool.join(chosen.select(id_col), id_col, "left_anti")
        if top_k_mode:
            pool = pool.withColumn("rank_key", F.col(key))
        else:
            pool = pool.withColumn("rank_key", gumbel_key(key, seed, f"gumbel:{t}", id_col))
        pick = top_k(pool, qk, "rank_key", id_col).select(id_col, "target", key, "rank_key")
        if qk > SMALL_K:
            # later targets anti-join these picks: evaluate the multi-pass top-k once
            pick = _stored(pick)
        chosen = pick if chosen is None else chosen.unionByName(pick)
    if chosen is None:
        return weights.limit(0).select(id_col, "target", key, F.col(key).alias("rank_key"))
    return chosen


def pareto_rounds(df: DataFrame, prob: str = "prob", seed: int = 0, shape: float = 9.0,
                  id_col: str = "doc_id") -> DataFrame:
    """First accepting round per row for Pareto threshold sampling (K5).

    Each round accepts a row when ``Pareto(shape) > 1 - p``, i.e. with
    probability ``q = (2 - p)^-shape``; rounds are independent, so the first
    accepting round is geometric and drawn from one seeded uniform.
    """
    q = F.pow(F.lit(2.0) - F.col(prob), F.lit(-shape))
    u = seeded_uniform(seed, "pareto", id_col)
    first = F.when(q >= F.lit(1.0), F.lit(0)).otherwise(F.floor(F.log(u) / F.log(F.lit(1.0) - q)))
    return df.withColumn("first_round", first.cast("long"))


def pareto_select(df: DataFrame, k: int, prob: str = "prob", seed: int = 0, shape: float = 9.0,
                  id_col: str = "doc_id", max_rounds: int | None = None) -> DataFrame:
    """Pareto threshold sampling of k rows (K5).

    Rounds run until at least k rows are accepted (the round count comes from
    a small histogram of first-accepting rounds); the accepted rows are then
    shuffled by a seeded key and k are kept. ``max_rounds`` fixes the number
    of rounds instead.
    """
    r = pareto_rounds(df, prob, seed, shape, id_col)
    if max_rounds is None:
        # rounds are looked at by powers of two first, then inside the power that reaches k:
        # a few dozen rows, then at most ROUND_STEPS, whatever the shape
        lo, hi, acc = -1, None, 0
        octave = F.floor(F.log2(F.col("first_round").cast("double") + F.lit(1.0)))
        for o, c in sorted((row["o"], row["count"]) for row in r.groupBy(octave.alias("o")).count().collect()):
            if acc + c >= k:
                lo, hi = (1 << int(o)) - 1, (1 << (int(o) + 1)) - 1
                break
            acc += c
        if hi is None:
            return r.withColumn("shuffle_key", seeded_order_key(seed, "pareto-shuffle", id_col))
        while hi - lo > 1:
            step = max(1, -(-(hi - lo) // ROUND_STEPS))
            inside = r.where((F.col("first_round") >= F.lit(lo)) & (F.col("first_round") < F.lit(hi)))
            part = F.floor((F.col("first_round") - F.lit(lo)) / F.lit(step))
            for q, c in sorted((row["q"], row["count"]) for row in inside.groupBy(part.alias("q")).count().collect()):
                if acc + c >= k:
                    lo, hi = lo + int(q) * step, min(hi, lo + (int(q) + 1) * step)
                    break
                acc += c
        rounds = hi
    else:
        rounds = max_rounds
    accepted = r.where(F.col("first_round") < F.lit(rounds)).withColumn(
        "shuffle_key", seeded_order_key(seed, "pareto-shuffle", id_col))
    return top_k(accepted, k, "shuffle_key", id_col)


def pareto_accept_fixed(df: DataFrame, rounds: int, prob: str = "prob", seed: int = 0,
                        shape: float = 9.0, id_col: str = "doc_id") -> DataFrame:
    """Literal form: one seeded Pareto draw per round, OR-ed over ``rounds``."""
    acc = None
    for r in range(rounds):
        a = pareto(seed, f"pareto:{r}", id_col, shape) > (F.lit(1.0) - F.col(prob))
        acc = a if acc is None else (acc | a)
    return df.where(acc)


def random_select(df: DataFrame, k: int, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Uniform choice of k rows (random baseline, K9)."""
    keyed = df.withColumn("random_key", seeded_order_key(seed, "random", id_col))
    return top_k(keyed, k, "random_key", id_col)


def shuffle_rows(df: DataFrame, seed: int = 0, epoch: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Seeded reshuffle (K10): a global sort on ``hash(seed, epoch, id)``."""
    return df.withColumn("shuffle_key", seeded_order_key(seed, f"epoch:{epoch}", id_col)) \
        .orderBy("shuffle_key", id_col)


def sample_rows(df: DataFrame, n: int = 3, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """A few seeded random rows."""
    return random_select(df, n, seed, id_col)


def domain_include(df: DataFrame, domains: Sequence[str], domain_col: str = "domain") -> DataFrame:
    """Keep rows of the listed domains."""
    return df.where(F.col(domain_col).isin(list(domains)))


def domain_exclude(df: DataFrame, domains: Sequence[str], domain_col: str = "domain") -> DataFrame:
    """Drop rows of the listed domains."""
    return df.where(~F.col(domain_col).isin(list(domains)) | F.col(domain_col).isNull())


def domain_topup(df: DataFrame, quotas: dict[str, int], seed: int = 0, domain_col: str = "domain",
                 id_col: str = "doc_id") -> DataFrame:
    """Random rows from held-out domains, ``quotas[domain]`` each (K7).

    One distributed seeded top-k per listed domain (a parameter-sized loop),
    so a domain holding a third of the corpus is still ranked by many tasks.
    """
    out = None
    for dom, q in quotas.items():
        part = df.where(F.col(domain_col) == F.lit(dom)).withColumn(
            "random_key", seeded_order_key(seed, f"topup:{dom}", id_col))
        pick = top_k(part, q, "random_key", id_col)
        out = pick if out is None else out.unionByName(pick)
    return out


# Held-out domains of the two corpus flows and their random top-up sizes.
NGRAM_FLOW_TOPUP = {"Wikipedia (en)": 2_000_000, "Gutenberg (PG-19)": 2_000_000 // 3}
CLASSIFIER_FLOW_DOMAINS = ["Wikipedia (en)", "BookCorpus2", "Books3", "Gutenberg (PG-19)"]


def classifier_flow_topup(n: int = 4_000_000) -> dict[str, int]:
    """Top-up sizes of the classifier flow: n // 2 from Wikipedia, n // 6 from each other domain."""
    return {d: (n // 2 if d == "Wikipedia (en)" else n // 6) for d in CLASSIFIER_FLOW_DOMAINS}


def union_ids(*frames: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Set union of chosen ids (U3): duplicates collapse."""
    out = None
    for f in frames:
        s = f.select(id_col)
        out = s if out is None else out.unionByName(s)
    return out.distinct()


def _stored(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder (lineage cut)."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _range_partitions(spark) -> int:
    """Ranges to sort in: what the session's shuffles use; the cores at start-up say little under dynamic allocation."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dense_index(df: DataFrame, order_cols: Sequence[str | Column], name: str = "idx", start: int = 0,
                num_partitions: int | None = None) -> DataFrame:
    """Positional index 0.. in ``order_cols`` order (W4), without a one-task window.

    Range-partition and sort, take each row's position inside its partition,
    then add the partition's offset (partition sizes: one small aggregate).
    The tagged rows are checkpointed once so sizes and positions describe the
    same split. ``order_cols`` must define a total order (end with a unique id).
    """
    spark = df.sparkSession
    p = num_partitions or _range_partitions(spark)
    cols = [(_c(c)) for c in order_cols]
    r = df.repartitionByRange(p, *cols).sortWithinPartitions(*cols) \
        .withColumn("_mid", F.monotonically_increasing_id())
    r = r.withColumn("_pid", F.shiftright(F.col("_mid"), 33)) \
        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    # evaluate the range split once: range bounds are sampled from shuffle output,
    # so two evaluations could disagree; sizes and offsets must come from the same rows
    r = _stored(r)
    sizes = sorted((row["_pid"], row["n"]) for row in
                   r.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc = [], start
    for pid, n in sizes:
        offsets.append((int(pid), int(acc)))
        acc += n
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long")).limit(0)
    off = spark.createDataFrame(offsets, "_pid long, _off long")
    return r.join(F.broadcast(off), "_pid").withColumn(name, F.col("_off") + F.col("_local")) \
        .drop("_mid", "_pid", "_local", "_off")


def prefix_sum(df: DataFrame, order_cols: Sequence[str | Column], weight_col: str, name: str = "prefix",
               num_partitions: int | None = None) -> DataFrame:
    """Exclusive running sum of ``weight_col`` in ``order_cols`` order, distributed.

    Same shape as :func:`dense_index`: range partitions, a running sum inside
    each partition, plus the totals of the partitions before it.
    """
    spark = df.sparkSession
    p = num_partitions or _range_partitions(spark)
    cols = [(_c(c)) for c in order_cols]
    r = df.repartitionByRange(p, *cols).withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    r = _stored(r.withColumn("_run", F.coalesce(F.sum(weight_col).over(w), F.lit(0))))
    totals = sorted((row["_pid"], row["t"] or 0) for row in
                    r.groupBy("_pid").agg(F.sum(weight_col).alias("t")).collect())
    offsets, acc = [], 0
    for pid, t in totals:
        offsets.append((int(pid), acc))
        acc += t
    if not offsets:
        return df.withColumn(name, F.lit(0)).limit(0)
    off = spark.createDataFrame(offsets, "_pid int, _off long")
    return r.join(F.broadcast(off), "_pid").withColumn(name, F.col("_off") + F.col("_run")) \
        .drop("_pid", "_run", "_off")


def semi_join(corpus: DataFrame, chosen: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chosen rows of the corpus."""
    return corpus.join(chosen.select(id_col), id_col, "left_semi")


def attach_scores(corpus: DataFrame, scores: DataFrame, score_col: str, id_col: str = "doc_id",
                  alias: str = "score") -> DataFrame:
    """Chosen rows with their score attached."""
    return corpus.join(scores.select(id_col, F.col(score_col).alias(alias)), id_col, "inner")


def domain_counts(df: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Rows per domain (A12); ids stay rows, nothing is collected."""
    return df.groupBy(domain_col).agg(F.count(F.lit(1)).alias("n_rows"))


def reconcile(scores: DataFrame, corpus: DataFrame, id_col: str = "doc_id") -> dict:
    """Row-count reconciliation (A14): every corpus row has a score and vice versa."""
    missing = corpus.join(scores.select(id_col), id_col, "left_anti").count()
    extra = scores.join(corpus.select(id_col), id_col, "left_anti").count()
    if missing or extra:
        raise ValueError(f"scores and corpus disagree: {missing} rows without score, {extra} scores without row")
    return {"missing": missing, "extra": extra}
