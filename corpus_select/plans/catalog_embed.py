"""Registered embedding-score queries."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from . import sqlsnippets as S
from .catalog import WEIGHTS_A_CTE, docs, query, weights_a
from ..operators import embedding as EM
from ..operators import latent as LA
from ..operators.features import ngram_features
from ..operators.vector_classifier import start_numbers
from ..session import checkpoint_dir
from ..sources.io import materialize, read_table


def emb(spark, sf):
    e = read_table(spark, sf, "embeddings", "vec_id")
    return e.select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def emb_target(spark, sf):
    lab = read_table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")
    return emb(spark, sf).join(lab, "doc_id", "left_semi")


def mixtures(spark, sf):
    e = emb(spark, sf)
    return EM.fit_by_label(e), EM.fit_by_label(emb_target(spark, sf))


def gmm_weights(spark, sf):
    raw_m, tgt_m = mixtures(spark, sf)
    return EM.embedding_log_weight(emb(spark, sf), raw_m, tgt_m)


X_SQL = """x as (select vec_id, label, unnest(range(len(embedding))) i, unnest(embedding)::DOUBLE v from embeddings)"""


def mixture_sql(name: str, where: str = "") -> str:
    wh = f"where {where}" if where else ""
    return f"""{name}_per as (select label component, i dim, round(avg(v), 8) mu, round(var_pop(v) + 1e-6, 8) var
                 from x {wh} group by all),
{name}_w as (select label component, count(*) / (select count(*) from embeddings {wh}) weight
             from embeddings {wh} group by all),
{name}_a as (select x.vec_id, p.component,
               ln(w.weight) - 0.5 * (count(*) * ln(2 * pi()) + sum(ln(p.var) + (x.v - p.mu) * (x.v - p.mu) / p.var)) a
             from x join {name}_per p on p.dim = x.i join {name}_w w on w.component = p.component
             group by x.vec_id, p.component, w.weight),
{name}_m as (select vec_id, max(a) m from {name}_a group by all),
{name}_lp as (select a.vec_id, m.m + ln(sum(exp(a.a - m.m))) lp from {name}_a a join {name}_m m using (vec_id)
              group by a.vec_id, m.m)"""


TARGET_WHERE = "vec_id in (select doc_id from labels where quality = 1)"
GMM_CTE = f"""{X_SQL},
{mixture_sql('raw')},
{mixture_sql('tgt', TARGET_WHERE)},
gw as (select r.vec_id doc_id, r.lp raw_logpdf, t.lp target_logpdf, t.lp - r.lp gmm_weight
       from raw_lp r join tgt_lp t using (vec_id))"""


@query("embed_moments", """
select 0 component, (i - 1)::INT dim, round(avg(v), 8) mean, round(var_pop(v) + 1e-6, 8) var
from (select unnest(range(1, len(embedding) + 1)) i, unnest(embedding)::DOUBLE v from embeddings) group by i""")
def q_embed_moments(spark, sf):
    """EM with K = 1 equals the closed form: mean and population variance + 1e-6."""
    m = EM.fit_gmm(emb(spark, sf), k=1, max_iter=1)
    rows = [(0, j, round(float(m.means[0, j]), 8), round(float(m.vars[0, j]), 8)) for j in range(m.means.shape[1])]
    return spark.createDataFrame(rows, "component int, dim int, mean double, var double")


@query("gmm_label_fit", f"""
with {X_SQL}, {mixture_sql('raw')}
select component, dim::INT dim, mu mean, var from raw_per""")
def q_gmm_label_fit(spark, sf):
    """Mixture from hard assignments (label = component): means and variances (A13 M-step)."""
    m = EM.fit_by_label(emb(spark, sf))
    return m.select("component", F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "z")) \
        .select("component", "dim", F.col("z.mean").alias("mean"), F.col("z.var").alias("var"))


@query("gmm_logpdf", f"""
with {X_SQL}, {mixture_sql('raw')}
select vec_id doc_id, round(lp, 6) logpdf from raw_lp""")
def q_gmm_logpdf(spark, sf):
    """Log-density of every embedding under the raw mixture (E4, vectorised)."""
    raw_m, _ = mixtures(spark, sf)
    return EM.score_samples(emb(spark, sf), raw_m).select("doc_id", F.round("logpdf", 6).alias("logpdf"))


@query("gmm_logpdf_sql", f"""
with {X_SQL}, {mixture_sql('raw')}
select vec_id doc_id, round(lp, 6) logpdf from raw_lp""")
def q_gmm_logpdf_sql(spark, sf):
    """The same density as pure DataFrame code (broadcast components, log-sum-exp)."""
    raw_m, _ = mixtures(spark, sf)
    return EM.score_samples_sql(emb(spark, sf), raw_m).select("doc_id", F.round("logpdf", 6).alias("logpdf"))


@query("gmm_log_weight", f"""
with {GMM_CTE}
select doc_id, round(raw_logpdf, 6) raw_logpdf, round(target_logpdf, 6) target_logpdf,
       round(gmm_weight, 6) gmm_weight from gw""")
def q_gmm_log_weight(spark, sf):
    """log p_target - log p_raw for every embedded document (E5)."""
    w = gmm_weights(spark, sf)
    return w.select("doc_id", *[F.round(c, 6).alias(c) for c in ("raw_logpdf", "target_logpdf", "gmm_weight")])


HYB_CTE = f"""{WEIGHTS_A_CTE}, {GMM_CTE},
ng as (select doc_id, weight_e10::DOUBLE / 1e10 ng from sc where length >= 100)"""


def ng_weights(spark, sf):
    return weights_a(spark, sf).select("doc_id", (F.col("weight_e10") / F.lit(1e10)).alias("ng"))


@query("hybrid_weight", f"""
with {HYB_CTE}
select doc_id, round(0.5 * (ng + 1e-8) + 0.5 * (gmm_weight + 1e-8), 6) hybrid_weight
from ng join gw using (doc_id)""")
def q_hybrid(spark, sf):
    """alpha = 0.5 blend of n-gram and mixture weights, length >= 100 kept."""
    h = EM.hybrid_weight(ng_weights(spark, sf), gmm_weights(spark, sf), 0.5, ng_col="ng")
    return h.select("doc_id", F.round("hybrid_weight", 6).alias("hybrid_weight"))


@query("hybrid_sweep", f"""
with {HYB_CTE}
select a.alpha, doc_id, round(a.alpha * (ng + 1e-8) + (1 - a.alpha) * (gmm_weight + 1e-8), 6) hybrid_weight
from ng join gw using (doc_id) cross join (values (0.0), (0.25), (0.5), (0.75)) a(alpha)""")
def q_hybrid_sweep(spark, sf):
    """The alpha sweep 0, .25, .5, .75 in one job."""
    h = EM.hybrid_sweep(ng_weights(spark, sf), gmm_weights(spark, sf), ng_col="ng")
    return h.select("alpha", "doc_id", F.round("hybrid_weight", 6).alias("hybrid_weight"))


@query("embed_cap", f"""
select vec_id doc_id from embeddings order by {S.order_key(42, 'cap', 'vec_id')} desc, vec_id limit 100""")
def q_embed_cap(spark, sf):
    """Fitting sample cap: 100 rows in a seeded order."""
    return EM.cap_samples(emb(spark, sf), 100).select("doc_id")


@query("gmm_em_fit")
def q_gmm_em(spark, sf):
    """Distributed EM, K = 4, up to 5 iterations, seed 42 (E1; float sums -> rows-only check)."""
    m = EM.fit_gmm(emb(spark, sf), k=4, max_iter=5, seed=42)
    return m.to_df(spark)


@query("embed_text")
def q_embed_text(spark, sf):
    """Text -> 64-d hashed embedding for every document (E7 hook with the default encoder)."""
    return EM.embed(docs(spark, sf))


PASS = (256, 3)


def _pass_sql(buckets: int, dim: int) -> str:
    ys = ", ".join(f"sum(x * {S.start_number(f'bucket * {dim} + {j} + 1')}) y{j}" for j in range(dim))
    zs = ", ".join(f"round(coalesce(sum(x * y{j}), 0.0), 6) + 0.0 z{j}" for j in range(dim))
    return f"""
with {S.features_cte(n=2, num_buckets=buckets, where="text is not null")},
df as (select bucket, count(*) df from f group by bucket),
u as (select doc_id, bucket, (1 + ln(cnt)) * (ln((1 + (select count(*) from w)) / (1 + df)) + 1) u from f join df using (bucket)),
x as (select doc_id, bucket, u / sqrt(sum(u * u) over (partition by doc_id)) x from u),
y as (select doc_id, {ys} from x group by doc_id)
select b::INT bucket, {zs} from range(0, {buckets}) r(b) left join x on x.bucket = b left join y using (doc_id) group by b"""


@query("latent_power_pass", _pass_sql(*PASS))
def q_latent_pass(spark, sf):
    """One power pass X^T (X Q) of the latent factors over all documents, from fixed directions."""
    buckets, dim = PASS
    path = os.path.join(checkpoint_dir(spark), f"latent-{uuid.uuid4().hex}")
    features = materialize(ngram_features(docs(spark, sf), n=2, num_buckets=buckets), path)
    q = start_numbers(np.arange(1, buckets * dim + 1), 0).reshape(buckets, dim)
    z = LA.power_pass(features, q, LA.bucket_weights(features, buckets))
    made = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(z)], "bucket int, " + ", ".join(f"z{j} double" for j in range(dim)))
    return made.select("bucket", *[(F.round(f"z{j}", 6) + F.lit(0.0)).alias(f"z{j}") for j in range(dim)])


@query("embed_svd")
def q_embed_svd(spark, sf):
    """Latent semantic vectors of every document, learned from the documents (E7); float fit -> rows-only check."""
    path = os.path.join(checkpoint_dir(spark), f"latent-{uuid.uuid4().hex}")
    features = materialize(ngram_features(docs(spark, sf), n=2, num_buckets=1 << 12, hash_fn="xxh64"), path)
    return LA.embed_features(LA.fit_latent(features, 1 << 12, dim=16, passes=3, hash_fn="xxh64"), features)


@query("stream_score_filter", f"""
with {WEIGHTS_A_CTE}
select doc_id, log_weight from sc where length >= 100 and weight_e10 >= 0""")
def q_stream(spark, sf):
    """Streaming score-and-filter over the documents files: length >= 100 and weight >= 0."""
    from ..streaming.stream import run_score_filter
    from .catalog import model_a
    m = model_a(spark, sf)
    out = run_score_filter(spark, os.path.join(sf, "documents*.parquet"), m, threshold_e10=0)
    return out.select("doc_id", "log_weight")
