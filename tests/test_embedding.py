"""Mixture EM and scores."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001, text_df
from corpus_select.operators import embedding as EM
from corpus_select.sources.io import read_table


def _emb(spark):
    return read_table(spark, SF001, "embeddings", "vec_id").select(
        F.col("vec_id").alias("doc_id"), "embedding", "label")


def test_k1_is_closed_form(spark):
    e = _emb(spark)
    m = EM.fit_gmm(e, k=1, max_iter=2)
    x = np.array([r[0] for r in e.select("embedding").collect()], dtype=np.float64)
    assert np.allclose(m.means[0], x.mean(axis=0), atol=1e-10)
    assert np.allclose(m.vars[0], x.var(axis=0) + 1e-6, atol=1e-10)
    assert abs(m.weights[0] - 1.0) < 1e-12


def test_em_log_likelihood_never_falls(spark):
    hist = []
    EM.fit_gmm(_emb(spark), k=4, max_iter=6, tol=0.0, history=hist)
    assert all(b >= a - 1e-7 for a, b in zip(hist, hist[1:])), hist


def test_em_partition_independent_within_tolerance(spark):
    e = _emb(spark)
    a = EM.fit_gmm(e, k=3, max_iter=3, tol=0.0)
    b = EM.fit_gmm(e.repartition(7), k=3, max_iter=3, tol=0.0)
    assert np.allclose(a.means, b.means, atol=1e-8) and np.allclose(a.weights, b.weights, atol=1e-10)


def test_vectorised_and_sql_density_agree(spark):
    e = _emb(spark)
    mix = EM.fit_by_label(e)
    a = {r[0]: r[1] for r in EM.score_samples(e, mix).collect()}
    b = {r[0]: r[1] for r in EM.score_samples_sql(e, mix).collect()}
    assert a.keys() == b.keys()
    assert max(abs(a[k] - b[k]) for k in a) < 1e-8


def test_checkpoint_and_warm_start(spark, tmp_out):
    e = _emb(spark)
    m = EM.fit_gmm(e, k=2, max_iter=2, checkpoint_dir=tmp_out, checkpoint_every=1)
    m2 = EM.Mixture.load(spark, tmp_out + "/final")
    assert np.allclose(m.means, m2.means)
    m3 = EM.fit_gmm(e, k=2, max_iter=1, init=m2)
    assert m3.means.shape == m.means.shape


def test_hybrid_alpha_one_is_ngram(spark):
    ng = spark.createDataFrame([(1, 2.0), (2, -1.0)], "doc_id long, log_weight double")
    gm = spark.createDataFrame([(1, 5.0), (2, 7.0)], "doc_id long, gmm_weight double")
    h = {r[0]: r[1] for r in EM.hybrid_weight(ng, gm, alpha=1.0).collect()}
    assert abs(h[1] - (2.0 + 1e-8)) < 1e-12 and abs(h[2] - (-1.0 + 1e-8)) < 1e-12
    assert EM.hybrid_sweep(ng, gm).count() == 8


def test_embed_hook(spark):
    df = text_df(spark, ["hello world", "another text here"])
    out = EM.embed(df).collect()
    assert len(out) == 2 and len(out[0]["embedding"]) == 64
    custom = EM.embed(df, encoder=lambda texts: np.ones((len(texts), 3), dtype=np.float32)).collect()
    assert custom[0]["embedding"] == [1.0, 1.0, 1.0]


def test_stepwise_fit_resumes_where_it_stopped(spark, tmp_out):
    import numpy as np

    from corpus_select.operators import embedding as EM
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-3, 1, (150, 3)), rng.normal(3, 1, (250, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[rng.permutation(400)])], "doc_id long, embedding array<double>").persist()
    whole = EM.fit_gmm_stepwise(df, k=2, chunks=4, epochs=3)
    for _ in range(4):  # three runs of five steps at most, the last one with nothing left
        parts = EM.fit_gmm_stepwise(df.repartition(7), k=2, chunks=4, epochs=3, state_dir=f"{tmp_out}/em", stop_after=5)
    assert np.allclose(parts.means, whole.means, atol=1e-9) and np.allclose(parts.weights, whole.weights) and np.allclose(parts.vars, whole.vars)
    assert np.allclose(sorted(whole.weights), [0.375, 0.625], atol=0.05)
    # a step that was not stored whole is done again
    import os
    os.remove(f"{tmp_out}/em/step_12/_SUCCESS")
    again = EM.fit_gmm_stepwise(df, k=2, chunks=4, epochs=3, state_dir=f"{tmp_out}/em")
    assert np.allclose(again.means, whole.means, atol=1e-9)
    # more chunks than rows: empty ones change nothing but the count
    few = EM.fit_gmm_stepwise(df.where("doc_id < 3"), k=1, chunks=10)
    assert few.k == 1 and np.isfinite(few.means).all()
    # one chunk per epoch is plain EM at a share of one
    one = EM.fit_gmm_stepwise(df, k=2, chunks=1, epochs=1)
    plain = EM.fit_gmm(df, k=2, max_iter=1, tol=0.0)
    assert np.allclose(one.means, plain.means, atol=1e-9)
    df.unpersist()
