"""Latent directions against NumPy's SVD, one pass against dense products, storage and odd rows."""

import numpy as np
import pytest

from corpus_select.operators import embedding, latent
from corpus_select.operators.features import ngram_features
from conftest import SF01, text_df

BUCKETS = 512


@pytest.fixture(scope="module")
def features(spark):
    import tempfile
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/f"
    ngram_features(spark.read.parquet(f"{SF01}/documents.parquet").repartition(7), num_buckets=BUCKETS, hash_fn="xxh64").write.parquet(path)
    return spark.read.parquet(path)


def dense(features, buckets=BUCKETS):
    rows = features.orderBy("doc_id").collect()
    x = np.zeros((len(rows), buckets))
    for i, r in enumerate(rows):
        x[i, r.buckets] = 1 + np.log(r.counts)
    have = (x > 0).sum(axis=0)
    x *= np.log((1 + len(rows)) / (1 + have)) + 1
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return [r.doc_id for r in rows], x / np.where(length > 0, length, 1)


def test_pass_against_dense_products(features, monkeypatch):
    monkeypatch.setattr(latent, "CHUNK", 100)
    monkeypatch.setattr(latent, "ROWS", 37)
    _, x = dense(features)
    q = np.random.default_rng(1).standard_normal((BUCKETS, 5))
    weights = latent.bucket_weights(features, BUCKETS)
    assert np.allclose(latent.power_pass(features, q, weights), x.T @ (x @ q), atol=1e-9)


def test_directions_against_svd(features):
    ids, x = dense(features)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    model = latent.fit_latent(features, BUCKETS, dim=6, passes=10, extra=10)
    assert np.allclose(model.values, s[:6], rtol=1e-3)
    overlap = np.linalg.svd(vt[:4] @ model.directions)[1]  # cosines of the angles between the subspaces
    assert overlap.min() > 0.99
    assert np.allclose(model.directions.T @ model.directions, np.eye(6), atol=1e-8)
    found = {r.doc_id: r.embedding for r in latent.embed_features(model, features).collect()}
    y = x @ model.directions
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert np.allclose([found[i] for i in ids], y, atol=1e-5)


def test_partitions_do_not_matter(spark, features):
    one = latent.fit_latent(features.coalesce(1), BUCKETS, dim=3, passes=2)
    other = latent.fit_latent(features.repartition(13), BUCKETS, dim=3, passes=2)
    assert np.allclose(one.directions, other.directions, atol=1e-7) and np.allclose(one.values, other.values)


def test_similar_texts_are_near_and_feed_a_mixture(spark, tmp_out):
    texts = [f"river water boat fish {w} river" for w in "abcdefgh"] + [f"market price money trade {w} money" for w in "abcdefgh"] + ["", None, "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, body string")
    model = latent.train_latent(df, f"{tmp_out}/f", 1 << 10, 2, "k", "body", passes=6)
    found = {r.k: np.array(r.embedding) for r in latent.embed_svd(model, df, "k", "body").collect()}
    assert sorted(found) == [i for i in range(19) if i != 17] and not found[16].any()
    near, far = found[0] @ found[5], found[0] @ found[12]
    assert near > 0.9 > far
    emb = latent.embed_svd(model, df.where("k < 16"), "k", "body")
    mixture = embedding.fit_gmm(emb, k=2, max_iter=5, id_col="k")
    assert sorted(np.round(mixture.weights, 2)) == [0.5, 0.5]
    model.save(spark, f"{tmp_out}/m")
    again = latent.LatentModel.load(spark, f"{tmp_out}/m")
    assert np.array_equal(again.directions, model.directions) and again.tokenizer == model.tokenizer


def test_few_rows_and_limits(spark, tmp_out):
    model = latent.train_latent(text_df(spark, ["one text"]), f"{tmp_out}/f", 256, 8)
    assert model.directions.shape[1] == 1 and model.values[0] == pytest.approx(1.0)
    none = latent.train_latent(text_df(spark, ["x"]).limit(0), f"{tmp_out}/g", 256, 8)
    assert none.directions.shape[1] == 0
    with pytest.raises(ValueError):
        latent.fit_latent(text_df(spark, ["x"]), 1 << 26, 8)
