"""Registered queries over the driver's tables and their DuckDB twins.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole tables. Mapping of the tables onto the selection problem:
raw = ``documents`` (domain = ``source``), target A = documents with
``labels.quality = 1``, target B = ``benchmark``, embeddings = ``embeddings``
(``vec_id`` = ``doc_id``), classifier labels = ``labels.quality``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqlsnippets as S
from ..functions import text as TX
from ..functions.hashing import sha256_bucket
from ..operators import features as FE
from ..operators import ngram_model as NG
from ..operators import select as SEL
from ..sources.io import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

B = 10000


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# -- shared inputs -------------------------------------------------------------

def docs(spark, sf):
    return read_table(spark, sf, "documents", "doc_id")


def target_a(spark, sf):
    lab = read_table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")
    return docs(spark, sf).join(lab, "doc_id", "left_semi")


def target_b(spark, sf):
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def feats(spark, sf, n=2, num_buckets=B):
    return FE.ngram_features(docs(spark, sf), n=n, num_buckets=num_buckets)


def target_a_ids(spark, sf):
    return read_table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")


def model_a(spark, sf, **kw):
    """Target A is a subset of the raw pool: one scan of the raw features fits both."""
    kw.setdefault("num_tokens_to_fit", "all")
    return NG.fit_subset_targets(feats(spark, sf), {"target": target_a_ids(spark, sf)}, **kw)


def weights_a(spark, sf, min_len=100):
    """Weights under target A; the documents are featurised once and stored for fitting and scoring."""
    f = SEL._stored(feats(spark, sf))
    return NG.log_weights(f, NG.fit_subset_targets(f, {"target": target_a_ids(spark, sf)}), min_example_length=min_len)


def two_target_weights(spark, sf):
    """Weights under targets a (labelled documents) and b (benchmark), from one stored featurisation."""
    f = SEL._stored(feats(spark, sf))
    m = NG.fit_from_features(f, {"a": f.join(target_a_ids(spark, sf), "doc_id", "left_semi"), "b": FE.ngram_features(target_b(spark, sf))}, separate_targets=True)
    return NG.log_weights(f, m, min_example_length=100)


TARGET_A_SQL = "(select * from documents where doc_id in (select doc_id from labels where quality = 1))"

# log_diff for raw = documents, target = quality-1 documents, as a CTE chain
LD_A_CTE = f"""{S.features_cte()},
raw as (select bucket, sum(cnt) cnt from f group by all),
tgt as (select bucket, sum(cnt) cnt from f where doc_id in (select doc_id from labels where quality = 1) group by all),
b as (select r.bucket, r.raw_p, t.target_p from {S.dense('raw', 'raw')} r join {S.dense('tgt', 'target')} t using (bucket)),
ld as (select bucket, round((ln(target_p + 1e-8) - ln(raw_p + 1e-8)) * 1e10)::BIGINT ld from b)"""

WEIGHTS_A_CTE = f"""{LD_A_CTE},
lw as (select f.doc_id, sum(f.cnt * ld.ld)::BIGINT weight_e10 from f join ld using (bucket) group by f.doc_id),
lens as (select doc_id, len(w)::INT n_tokens, {S.length_expr('len(w)', 2)} length from w),
sc as (select doc_id, n_tokens, length, coalesce(weight_e10, 0)::BIGINT weight_e10,
       round(coalesce(weight_e10, 0)::DOUBLE / 1e10, 6) log_weight from lens left join lw using (doc_id))"""


# -- 1. tokens, n-grams, hashing, features ----------------------------------

@query("tokenize_wordpunct", f"""
select doc_id, len(w)::INT n_tokens, array_to_string(w, ' ') tokens_joined
from (select doc_id, {S.tok('text')} w from documents)""")
def q_tokenize(spark, sf):
    w = docs(spark, sf).select("doc_id", TX.wordpunct_tokens("text").alias("w"))
    return w.select("doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens_joined"))


@query("ngrams_2", f"""
select doc_id, len(g)::INT n_grams, array_to_string(g, '|') grams_joined
from (select doc_id, {S.grams('w', 2)} g from (select doc_id, {S.tok('text')} w from documents))""")
def q_ngrams2(spark, sf):
    g = docs(spark, sf).select("doc_id", TX.ngrams(TX.wordpunct_tokens("text"), 2).alias("g"))
    return g.select("doc_id", F.size("g").alias("n_grams"), F.array_join("g", "|").alias("grams_joined"))


@query("ngrams_3", f"""
select doc_id, len(g)::INT n_grams, array_to_string(g, '|') grams_joined
from (select doc_id, {S.grams('w', 3)} g from (select doc_id, {S.tok('text')} w from documents))""")
def q_ngrams3(spark, sf):
    g = docs(spark, sf).select("doc_id", TX.ngrams(TX.wordpunct_tokens("text"), 3).alias("g"))
    return g.select("doc_id", F.size("g").alias("n_grams"), F.array_join("g", "|").alias("grams_joined"))


@query("hash_bucket", f"""
select g, {S.bucket('g')} bucket
from (select distinct unnest({S.grams('w', 2)}) g from (select {S.tok('text')} w from benchmark))""")
def q_hash_bucket(spark, sf):
    """JVM sha-256 bucket of every distinct benchmark n-gram (T5)."""
    b = read_table(spark, sf, "benchmark")
    g = b.select(F.explode(TX.ngrams(TX.wordpunct_tokens("text"), 2)).alias("g")).distinct()
    return g.select("g", sha256_bucket("g", B).alias("bucket"))


@query("feature_counts", f"""
with {S.features_cte()}
select doc_id, bucket, cnt from f""")
def q_feature_counts(spark, sf):
    return FE.features_long(feats(spark, sf))


@query("feature_counts_n3", f"""
with {S.features_cte(n=3, num_buckets=50000)}
select doc_id, bucket, cnt from f""")
def q_feature_counts_n3(spark, sf):
    return FE.features_long(feats(spark, sf, n=3, num_buckets=50000))


@query("example_length", f"""
select doc_id, len(w)::INT n_tokens, {S.length_expr('len(w)', 2)} length_n2, {S.length_expr('len(w)', 3)} length_n3
from (select doc_id, {S.tok('text')} w from documents)""")
def q_example_length(spark, sf):
    f = feats(spark, sf)
    return f.select("doc_id", "n_tokens", TX.example_length("n_tokens", 2).alias("length_n2"),
                    TX.example_length("n_tokens", 3).alias("length_n3"))


@query("min_length_filter", f"""
select doc_id, {S.length_expr('len(w)', 2)} length
from (select doc_id, {S.tok('text')} w from documents)
where {S.length_expr('len(w)', 2)} >= 100""")
def q_min_length(spark, sf):
    f = FE.with_length(feats(spark, sf), 2)
    return f.where(F.col("length") >= 100).select("doc_id", "length")


# -- 2. n-gram model -------------------------------------------------------------

@query("bow_raw", f"""
with {S.features_cte()}
select bucket, sum(cnt)::BIGINT cnt from f group by bucket""")
def q_bow_raw(spark, sf):
    return NG.bucket_counts(feats(spark, sf), B)


@query("bow_budgeted", f"""
with {S.features_cte()},
per_doc as (select doc_id, len(w) + greatest(len(w) - 1, 0) g_cnt, doc_id % 4 shard from w),
pre as (select doc_id, coalesce(sum(g_cnt) over (partition by shard order by doc_id
        rows between unbounded preceding and 1 preceding), 0) before from per_doc),
kept as (select doc_id from pre where before <= 200000 // 4)
select bucket, sum(cnt)::BIGINT cnt from f where doc_id in (select doc_id from kept) group by bucket""")
def q_bow_budgeted(spark, sf):
    """Token-budgeted raw fit: 200,000 n-grams over 4 virtual shards."""
    f = NG.budgeted(feats(spark, sf), 200000, 2, num_shards=4)
    return NG.bucket_counts(f, B)


@query("bow_budgeted_early", f"""
with {S.features_cte()},
per_doc as (select doc_id, len(w) + greatest(len(w) - 1, 0) g_cnt, doc_id % 4 shard from w),
pre as (select doc_id, coalesce(sum(g_cnt) over (partition by shard order by doc_id
        rows between unbounded preceding and 1 preceding), 0) before from per_doc),
kept as (select doc_id from pre where before <= 60000 // 4)
select bucket, sum(cnt)::BIGINT cnt from f where doc_id in (select doc_id from kept) group by bucket""")
def q_bow_budgeted_early(spark, sf):
    """Token-budgeted raw fit that stops reading once all 4 shards are past their part of 60,000 n-grams."""
    return NG.bucket_counts(NG.budgeted_features(docs(spark, sf), 60000, 2, B, num_shards=4), B)


@query("probs_raw", f"""
with {S.features_cte()},
raw as (select bucket, sum(cnt) cnt from f group by all)
select bucket, raw_cnt cnt, round(raw_p, 12) p from {S.dense('raw', 'raw')}""")
def q_probs_raw(spark, sf):
    d = NG.dense_buckets(spark, NG.bucket_counts(feats(spark, sf), B), B)
    return d.select("bucket", "cnt", F.round("p", 12).alias("p"))


@query("probs_target_smoothed", f"""
with {S.features_cte(source=TARGET_A_SQL)},
tgt as (select bucket, sum(cnt) cnt from f group by all)
select bucket, target_cnt cnt, round(target_p, 12) p from {S.dense('tgt', 'target', smoothing=1.0)}""")
def q_probs_target_smoothed(spark, sf):
    """Target distribution with Laplace pseudo-count 1: (c + 1) / (T + B) (A4)."""
    c = NG.bucket_counts(FE.ngram_features(target_a(spark, sf)), B)
    d = NG.dense_buckets(spark, c, B, smoothing=1.0)
    return d.select("bucket", "cnt", F.round("p", 12).alias("p"))


def per_target_cte(gname: str = "g", dname: str = "dd") -> str:
    """CTEs tc(target, bucket, cnt) and tot(target, total) for targets a and b."""
    return f"""wa as (select doc_id, {S.tok('text')} w from {TARGET_A_SQL}),
wb as (select item_id doc_id, {S.tok('text')} w from benchmark),
{gname} as (select 'a' target, doc_id, unnest({S.grams('w', 2)}) g from wa
      union all select 'b' target, doc_id, unnest({S.grams('w', 2)}) g from wb),
{dname} as (select g, {S.bucket('g')} bucket from (select distinct g from {gname})),
tc as (select target, bucket, count(*)::BIGINT cnt from {gname} join {dname} using (g) group by all),
tot as (select target, sum(cnt) total from tc group by all)"""


PER_TARGET_CTE = per_target_cte()


@query("probs_per_target", f"""
with {PER_TARGET_CTE}
select t.target, x.i::INT bucket, coalesce(tc.cnt, 0)::BIGINT cnt,
       round(coalesce(tc.cnt, 0) / t.total, 12) p
from tot t cross join range(0, {B}) x(i) left join tc on tc.target = t.target and tc.bucket = x.i""")
def q_probs_per_target(spark, sf):
    """One distribution per target (A5): target a = quality-1 docs, b = benchmark."""
    m = NG.fit(docs(spark, sf), {"a": target_a(spark, sf), "b": target_b(spark, sf)},
               separate_targets=True, num_tokens_to_fit="all")
    return m.table.select("target", "bucket", F.col("target_cnt").alias("cnt"), F.round("target_p", 12).alias("p"))


@query("target_proportions", f"""
with {PER_TARGET_CTE}
select target, round(total / sum(total) over (), 12) proportion from tot""")
def q_target_proportions(spark, sf):
    """Target weights from unsmoothed n-gram totals when none are given (A5)."""
    m = NG.fit(docs(spark, sf), {"a": target_a(spark, sf), "b": target_b(spark, sf)},
               separate_targets=True, num_tokens_to_fit="all")
    return m.proportions.select("target", F.round("proportion", 12).alias("proportion"))


@query("log_diff", f"""
with {LD_A_CTE}
select bucket, ld ld_e10, round(ld::DOUBLE / 1e10, 10) log_diff from ld""")
def q_log_diff(spark, sf):
    m = model_a(spark, sf)
    return m.table.select("bucket", "ld_e10", F.round(F.col("ld_e10") / F.lit(1e10), 10).alias("log_diff"))


@query("log_weight", f"""
with {WEIGHTS_A_CTE}
select doc_id, n_tokens, length, weight_e10, log_weight from sc""")
def q_log_weight(spark, sf):
    """Every document's log importance weight under target A (A7), no length filter."""
    lw = weights_a(spark, sf, None)
    return lw.select("doc_id", "n_tokens", "length", "weight_e10", "log_weight")


LD_MULTI_CTE = f"""{S.features_cte()},
raw as (select bucket, sum(cnt) cnt from f group by all),
r as {S.dense('raw', 'raw')},
{per_target_cte('tg', 'tdd')},
tp as (select t.target, x.i::INT bucket, coalesce(tc.cnt, 0) / t.total target_p
       from tot t cross join range(0, {B}) x(i) left join tc on tc.target = t.target and tc.bucket = x.i),
ld as (select tp.target, tp.bucket, round((ln(target_p + 1e-8) - ln(raw_p + 1e-8)) * 1e10)::BIGINT ld
       from tp join r using (bucket))"""


@query("log_weight_multi", f"""
with {LD_MULTI_CTE}
select f.doc_id, ld.target, sum(f.cnt * ld.ld)::BIGINT weight_e10,
       round(sum(f.cnt * ld.ld)::DOUBLE / 1e10, 6) log_weight
from f join ld using (bucket)
where f.doc_id in (select doc_id from w where {S.length_expr('len(w)', 2)} >= 100)
group by f.doc_id, ld.target""")
def q_log_weight_multi(spark, sf):
    """One weight per (document, target) for two separate targets, length >= 100 (A7 matrix form)."""
    return two_target_weights(spark, sf).select("doc_id", "target", "weight_e10", "log_weight")


# -- 3. selection ------------------------------------------------------------------

@query("topk_weight", f"""
with {WEIGHTS_A_CTE}
select doc_id, log_weight from sc where length >= 100
order by weight_e10 desc, doc_id limit 100""")
def q_topk(spark, sf):
    """The 100 documents most like the quality-1 documents (K1, P5)."""
    return SEL.top_k(weights_a(spark, sf), 100).select("doc_id", "log_weight")


@query("probs_domain_filtered", f"""
with {S.features_cte(where="source in ('src1', 'src2')")},
tgt as (select bucket, sum(cnt) cnt from f group by all)
select bucket, target_cnt cnt, round(target_p, 12) p from {S.dense('tgt', 'target')}""")
def q_probs_domain_filtered(spark, sf):
    """Target distribution from two domains only (A6 = P7 + A1 + A3)."""
    from ..operators.select import domain_include
    t = domain_include(docs(spark, sf), ["src1", "src2"], "source")
    d = NG.dense_buckets(spark, NG.bucket_counts(FE.ngram_features(t), B), B)
    return d.select("bucket", "cnt", F.round("p", 12).alias("p"))


@query("line_count", """
select count(*)::BIGINT n_rows from documents""")
def q_line_count(spark, sf):
    """Row count of the raw pool (A11), as a lazy one-row aggregate."""
    return docs(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"))
