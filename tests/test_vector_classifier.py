"""Learned vectors: gradients, partitions, warm start, quality beside the logistic model, storage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_select.operators import classifier, vector_classifier as vc
from conftest import SF01


def loss_of(model, rows):
    total = 0.0
    for buckets, counts, y in rows:
        c = np.array(counts, float)
        z = (c / c.sum()) @ model.vectors[buckets] @ model.output + model.bias
        total += np.logaddexp(0, z) - y * z
    return total / len(rows)


def random_rows(seed, n=40, buckets=30):
    rng = np.random.default_rng(seed)
    return [(sorted(rng.choice(buckets, k, replace=False).tolist()), rng.integers(1, 5, k).tolist(), float(rng.integers(0, 2))) for k in rng.integers(1, 9, n)]


def test_gradient_against_finite_differences(spark, monkeypatch):
    monkeypatch.setattr(vc, "CHUNK", 7)  # sums travel in several chunks
    rows = random_rows(1)
    model = vc.VectorModel.start(30, 5, seed=3)
    model.bias = 0.3
    df = spark.createDataFrame(rows, "buckets array<int>, counts array<int>, label double").repartition(5)
    g, g_bias, loss, n = vc.gradient(df, model)
    assert n == 40 and loss == pytest.approx(loss_of(model, rows), abs=1e-12)
    full = np.outer(g, model.output)

    def slope(change, h=1e-6):
        return (change(h) - change(-h)) / (2 * h)

    def moved(name, at, h):
        m = vc.VectorModel(model.vectors.copy(), model.output.copy(), model.bias)
        if name == "bias":
            m.bias += h
        else:
            getattr(m, name)[at] += h
        return loss_of(m, rows)
    for at in [(0, 0), (7, 2), (13, 4), (29, 1)]:
        assert full[at] == pytest.approx(slope(lambda h: moved("vectors", at, h)), abs=1e-8)
    for at in range(5):
        assert (g @ model.vectors)[at] == pytest.approx(slope(lambda h: moved("output", at, h)), abs=1e-8)
    assert g_bias == pytest.approx(slope(lambda h: moved("bias", 0, h)), abs=1e-8)


def test_steps_lower_the_loss_and_ignore_no_rows(spark):
    rows = random_rows(2, 60)
    df = spark.createDataFrame(rows, "buckets array<int>, counts array<int>, label double")
    model = vc.VectorModel.start(30, 8)
    losses = []
    for _ in range(15):
        model, loss = vc.sgd_step(df, model, 0.3)
        losses.append(loss)
    assert losses[-1] < 0.8 * losses[0]
    same, loss = vc.sgd_step(df.limit(0), model, 0.3)
    assert same is model and loss == 0.0


def test_partitions_do_not_matter(spark):
    lab = spark.read.parquet(f"{SF01}/labels.parquet").join(spark.read.parquet(f"{SF01}/documents.parquet"), "doc_id").where("doc_id < 200")
    models = []
    for parts in (1, 4, 13):
        first = vc.VectorModel.start(1 << 12, 8)
        models.append(vc.train_vectors(lab.repartition(parts), None, first, label_col="quality", epochs=2, batches=3, rates=(0.5,)))
    for m in models[1:]:
        assert np.abs(m.vectors - models[0].vectors).max() < 1e-9 and np.abs(m.output - models[0].output).max() < 1e-9


def test_start_from_word_vectors(spark):
    words = spark.createDataFrame([("good", [1.0, 0.0]), ("bad", [0.0, 1.0]), (None, [5.0, 5.0])], "word string, vec array<float>")
    given = vc.vectors_by_bucket(words, 1 << 10)
    bucket = vc.HASHERS["xxh64"](1 << 10)
    assert given[bucket(b"good")].tolist() == [1.0, 0.0] and given[bucket(b"bad")].tolist() == [0.0, 1.0] and np.count_nonzero(given) == 2
    model = vc.VectorModel.start(1 << 10, 2, vectors=given)
    assert model.vectors[bucket(b"good")].tolist() == [1.0, 0.0] and (np.abs(model.vectors).sum(axis=1) > 0).all()
    with pytest.raises(ValueError):
        vc.VectorModel.start(1 << 20, 1 << 10)


def f1(rows):
    tp = sum(p >= 0.5 and y == 1 for p, y in rows)
    return 2 * tp / max(1, sum(p >= 0.5 for p, _ in rows) + sum(y == 1 for _, y in rows))


def test_held_out_f1_not_below_the_logistic_model(spark, tmp_out):
    lab = spark.read.parquet(f"{SF01}/labels.parquet").join(spark.read.parquet(f"{SF01}/documents.parquet"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"))
    split = classifier.ordered_split(lab, ["doc_id"], 0.7).persist()
    train, held = split.where("split = 'train'"), split.where("split = 'val'")
    tune = classifier.ordered_split(train.drop("split", "_pos"), ["doc_id"])
    history = []
    model = vc.train_vectors(tune.where("split = 'train'"), tune.where("split = 'val'"), vc.VectorModel.start(1 << 16, 32), epochs=6, batches=4, history=history)
    truth = {r.doc_id: r.label for r in held.collect()}
    found = {r.doc_id: r.prob for r in vc.predict_vectors(model, held).collect()}
    logistic = classifier.train_classifier(tune.where("split = 'train'"), tune.where("split = 'val'"), num_features=1 << 16, reg_params=(0.01, 0.1), max_iter=20)
    other = {r.doc_id: r.prob for r in classifier.predict_proba(logistic, held).collect()}
    split.unpersist()
    assert set(found) == set(truth) and all(0 <= p <= 1 for p in found.values())
    own, base = f1([(found[k], y) for k, y in truth.items()]), f1([(other[k], y) for k, y in truth.items()])
    print("held-out F1", own, base, history)
    assert own >= base - 0.005
    model.save(spark, f"{tmp_out}/model")
    again = vc.VectorModel.load(spark, f"{tmp_out}/model")
    assert {r.doc_id: r.prob for r in vc.predict_vectors(again, held).collect()} == found


def test_odd_rows_are_scored(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "..."), (4, "word " * 50_000)], "doc_id long, text string")
    model = vc.VectorModel.start(1 << 8, 4)
    model.bias = 1.0
    found = {r.doc_id: r.prob for r in vc.predict_vectors(model, df).collect()}
    assert sorted(found) == [1, 3, 4] and found[1] == pytest.approx(1 / (1 + np.exp(-1.0)))
