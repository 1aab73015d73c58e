"""Classifier path, MLM preparation, evaluation helpers, readers and writers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001, text_df
from corpus_select.operators import classifier as CL
from corpus_select.operators import mlm as ML
from corpus_select.operators import results as RS
from corpus_select.sources import io as IO


def test_classifier_line_and_relabel(spark):
    df = text_df(spark, ["Hello, World!"])
    line = df.select(CL.classifier_line(F.lit(1), F.col("text")).alias("l")).first()[0]
    assert line == "__label__1 , hello , world !"
    assert df.select(CL.relabel(F.lit(line), 0)).first()[0] == "__label__0 , hello , world !"


def test_zip_mix_stops_at_shorter(spark):
    pos = spark.createDataFrame([(i, f"__label__1 , p{i}") for i in range(5)], "doc_id long, line string")
    neg = spark.createDataFrame([(i, f"__label__0 , n{i}") for i in range(20)], "doc_id long, line string")
    m = CL.zip_mix(pos, neg, ["doc_id"], ["doc_id"]).collect()
    assert len(m) == 10
    assert sum(1 for r in m if r["split"] == "train") == 8  # int(0.9 * 5) = 4 pairs


def test_train_predict_and_metrics(spark):
    pos = ["markets rallied as stocks rose"] * 20
    neg = ["the cat slept on a warm mat"] * 20
    df = spark.createDataFrame([(i, t, 1 if i < 20 else 0) for i, t in enumerate(pos + neg)],
                               "doc_id long, text string, label int")
    model = CL.train_classifier(df, df, num_features=1 << 10, reg_params=(0.0, 0.1), max_iter=20)
    p = CL.predict_proba(model, df).join(df, "doc_id")
    m = CL.binary_metrics(p.withColumn("pred", (F.col("prob") > 0.5).cast("int")), "pred", "label").first()
    assert m["accuracy"] == 1.0 and m["f1"] == 1.0
    chosen = CL.retrieve(p.select("doc_id", "prob"), 10, mode="topk").collect()
    assert all(r["doc_id"] < 20 for r in chosen)
    with pytest.raises(ValueError):
        CL.retrieve(p, 10, mode="other")


def test_word_vectors_source(spark, tmp_out):
    path = os.path.join(tmp_out, "wv.vec")
    with open(path, "w") as f:
        f.write("3 2\nmarkets 1.0 0.0\ncat 0.0 1.0\nthe 0.5 0.5\n")
    wv = IO.read_word_vectors(spark, path)
    assert wv.count() == 3
    df = spark.createDataFrame([(0, "markets up", 1), (1, "the cat", 0)] * 5, "doc_id long, text string, label int")
    df = df.withColumn("doc_id", F.monotonically_increasing_id())
    model = CL.train_classifier(df, None, num_features=64, reg_params=(0.0,), word_vectors=wv)
    assert CL.predict_proba(model, df, word_vectors=wv).count() == 10


def test_mlm_encode_and_mask(spark):
    docs = IO.read_table(spark, SF001, "documents", "doc_id")
    vocab = ML.build_vocab(docs, max_size=500)
    assert vocab.count() == 500
    assert vocab.agg(F.min("id"), F.max("id")).first() == (5, 504)
    enc = ML.encode(docs, vocab, max_length=32)
    r = enc.first()
    assert len(r["input_ids"]) == 32 and r["input_ids"][0] == ML.CLS
    m = ML.mask_tokens(enc, vocab_size=505, seed=3).collect()
    total = sel = masked = 0
    for row, orig in zip(sorted(m), sorted(enc.collect())):
        for x, lab, s, o in zip(row["input_ids"], row["labels"], orig["special_tokens_mask"], orig["input_ids"]):
            if s == 1:
                assert lab == -100 and x == o
                continue
            total += 1
            if lab != -100:
                sel += 1
                assert lab == o
                masked += x == ML.MASK
    assert abs(sel / total - 0.15) < 0.02
    assert abs(masked / sel - 0.8) < 0.05
    assert ML.pick_text_column(spark.createDataFrame([("a", "b")], "x string, contents string")) == "contents"


def test_run_names_rollup_best_median(spark, tmp_out):
    runs = {"RTE_EPOCHS10_BS32_LR2e-05_seed1": {"eval_accuracy": 0.70},
            "RTE_EPOCHS10_BS32_LR2e-05_seed2": {"eval_accuracy": 0.72},
            "RTE_EPOCHS10_BS32_LR2e-05_seed3": {"eval_accuracy": 0.75},
            "STSB_EPOCHS10_BS32_LR2e-05_seed1": {"eval_spearmanr": 0.88},
            "COLA_EPOCHS10_BS32_LR1e-05_seed1": {"eval_matthews_correlation": 0.5}}
    for name, res in runs.items():
        os.makedirs(os.path.join(tmp_out, name))
        with open(os.path.join(tmp_out, name, "eval_results.json"), "w") as f:
            json.dump(res, f)
    os.makedirs(os.path.join(tmp_out, "MRPC_EPOCHS3_BS32_LR2e-05_seed1"))
    with open(os.path.join(tmp_out, "MRPC_EPOCHS3_BS32_LR2e-05_seed1", "eval_results.json"), "w") as f:
        f.write("{not json")
    raw = IO.read_trials(spark, tmp_out)
    trials = RS.trial_table(raw)
    rolled = RS.rollup(trials)
    got = {r["task_name"]: r for r in rolled.collect()}
    assert got["RTE"]["mean"] == 72.33 and got["RTE"]["median"] == 72.0 and got["RTE"]["std"] == 2.52
    assert got["STSB"]["mean"] == 88.0 and got["COLA"]["median"] == 50.0
    assert "MRPC" not in got
    assert RS.best_median(rolled).count() == 3
    two = rolled.unionByName(rolled.where("task_name = 'RTE'").withColumn("lr", F.lit(3e-5))
                             .withColumn("median", F.lit(10.0)))
    assert RS.best_median(two).count() == 4
    assert RS.best_median(two, ["task_name"]).count() == 3
    IO.write_tsv(rolled, os.path.join(tmp_out, "tsv"))


def test_misc_results_helpers(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],), ([2.0, 1.0, 0.0],)], "s array<double>")
    assert [r[0] for r in df.select(RS.argmax(F.col("s"))).collect()] == [1, 0]
    assert RS.eval_splits("MNLI") == ["validation_matched", "validation_mismatched"]
    assert RS.text_pair_columns(["sentence1", "sentence2", "label"]) == ("sentence1", "sentence2")
    assert RS.text_pair_columns(["a", "label", "b"]) == ("a", "b")
    assert RS.text_pair_columns(["q", "s"], "qnli") == ("question", "sentence")
    lab = spark.createDataFrame([("b",), ("a",), ("b",)], "label string")
    ll = RS.label_list(lab)
    assert [(r["label"], r["label_id"]) for r in ll.orderBy("label_id").collect()] == [("a", 0), ("b", 1)]
    reg = spark.createDataFrame([(0, 1.23456)], "i long, p double")
    assert RS.format_predictions(reg, "i", "p", regression=True).first()["prediction"] == "1.235"
    assert RS.is_regression(reg, "p")


def test_prediction_metrics_spearman(spark):
    rows = [(float(i % 2), float(i % 2), i / 10.0) for i in range(10)]
    df = spark.createDataFrame(rows, "pred double, y double, s double")
    m = RS.prediction_metrics(df, "pred", "y", "s").first()
    assert m["accuracy"] == 1.0 and m["matthews"] == 1.0
    import numpy as np
    s = np.array([r[2] for r in rows]); y = np.array([r[1] for r in rows])
    rs = s.argsort().argsort() + 1.0
    ry = np.array([np.mean(np.where(y == v)[0] * 0 + (np.argsort(np.argsort(y, kind="stable")) + 1)[y == v]) for v in y])
    assert abs(m["spearman"] - np.corrcoef(rs, ry)[0, 1]) < 1e-9


def test_jsonl_pool_and_zst(spark, tmp_out):
    import zstandard
    p1 = os.path.join(tmp_out, "a.jsonl")
    with open(p1, "w") as f:
        for i in range(3):
            f.write(json.dumps({"text": f"row {i}"}) + "\n")
    p2 = os.path.join(tmp_out, "b.jsonl.zst")
    with open(p2, "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(b'{"text": "z0"}\n{"text": "z1"}\n'))
    pool = IO.read_jsonl(spark, [p1, p1, p2], with_source=True)
    assert pool.count() == 8
    bad = os.path.join(tmp_out, "bad.jsonl")
    with open(bad, "w") as f:
        f.write('{"text": "ok"}\nnot json\n')
    with pytest.raises(Exception):
        IO.read_jsonl(spark, bad).collect()
    assert IO.read_by_extension(spark, p1).count() == 3


def test_materialize_and_sinks(spark, tmp_out):
    df = text_df(spark, ["a", "b", "c"])
    path = os.path.join(tmp_out, "m")
    a = IO.materialize(df, path)
    b = IO.materialize(df.limit(1), path)  # reused, not rewritten
    assert a.count() == b.count() == 3
    chosen = df.where("doc_id in (0, 2)")
    IO.write_selected(df, chosen, os.path.join(tmp_out, "sel"))
    assert spark.read.json(os.path.join(tmp_out, "sel")).count() == 2
    IO.write_indices(chosen, os.path.join(tmp_out, "idx"))
    assert sorted(r[0] for r in spark.read.parquet(os.path.join(tmp_out, "idx")).collect()) == [0, 2]
    assert IO.cache_key(n=2, b=10000, f=None) == "b10000_fnone_n2"


def test_pile_shape_registry_and_custom_tokenizer(spark, tmp_out):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf
    from corpus_select.operators.features import features_long, ngram_features
    p = os.path.join(tmp_out, "pile.jsonl")
    with open(p, "w") as f:
        for i, dom in enumerate(["Github", "Wikipedia (en)", "Github"]):
            f.write(json.dumps({"contents": f"text {i}", "metadata": {"pile_set_name": dom}, "id": i}) + "\n")
    df = IO.pile_chunks(IO.read_jsonl(spark, p, IO.PILE_CHUNK_SCHEMA))
    assert [r["domain"] for r in df.orderBy("doc_id").collect()] == ["Github", "Wikipedia (en)", "Github"]
    reg = IO.registry_for(SF001)
    conv = IO.load_dataset(spark, reg["conversations"])
    assert set(conv.columns) == {"doc_id", "text", "domain"} and conv.count() > 0

    @pandas_udf("array<string>")
    def chars(s: pd.Series) -> pd.Series:
        return s.map(lambda t: list(t.replace(" ", "")))
    f = features_long(ngram_features(df, tokenizer=chars, n=1)).groupBy("doc_id").agg(F.sum("cnt").alias("c"))
    assert {r["doc_id"]: r["c"] for r in f.collect()} == {0: 5, 1: 5, 2: 5}
    assert RS.drop_label(spark.createDataFrame([(1, 2)], "a int, label int")).columns == ["a"]


def test_row_ids_and_byte_exact_copy(spark, tmp_out):
    p = os.path.join(tmp_out, "raw.jsonl")
    lines = ['{"text": "a", "x": 1}', '{"text":"b"}', '{"text": "c",  "y": [1, 2]}']
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    raw = spark.read.text(p).withColumn("source_path", F.col("_metadata.file_path"))
    ided = IO.with_row_id(raw, order_cols=["source_path", "_row_in_file"])
    got = {r["doc_id"]: r["value"] for r in ided.collect()}
    assert got == {0: lines[0], 1: lines[1], 2: lines[2]}
    chosen = spark.createDataFrame([(0,), (2,)], "doc_id long")
    IO.write_selected_lines(ided.select("doc_id", "value"), chosen, os.path.join(tmp_out, "copy"))
    out = sorted(r[0] for r in spark.read.text(os.path.join(tmp_out, "copy")).collect())
    assert out == sorted([lines[0], lines[2]])


def test_mlm_pre_tokenized_equals_text_path(spark):
    from corpus_select.functions.text import wordpunct_tokens
    docs = IO.read_table(spark, SF001, "documents", "doc_id")
    toks = docs.select("doc_id", wordpunct_tokens("text").alias("tokens"))
    v1 = ML.build_vocab(docs, max_size=300)
    v2 = ML.build_vocab(toks, max_size=300, tokens_col="tokens")
    assert sorted(v1.collect()) == sorted(v2.collect())
    e1 = ML.encode(docs, v1, max_length=24)
    e2 = ML.encode(toks, v2, max_length=24, tokens_col="tokens")
    assert sorted(e1.collect()) == sorted(e2.collect())


def test_classifier_pre_tokenized_equals_text_path(spark):
    from corpus_select.functions.stats import treebank_tokens
    pos = ["markets rallied as stocks rose"] * 10 + ["bond yields fell"] * 10
    neg = ["the cat slept on a warm mat"] * 20
    df = spark.createDataFrame([(i, t, 1 if i < 20 else 0) for i, t in enumerate(pos + neg)],
                               "doc_id long, text string, label int").coalesce(1)
    toks = df.withColumn("tokens", treebank_tokens("text"))
    m1 = CL.train_classifier(df, None, num_features=256, reg_params=(0.1,), max_iter=20)
    m2 = CL.train_classifier(toks, None, num_features=256, reg_params=(0.1,), max_iter=20, tokens_col="tokens")
    p1 = {r[0]: r[1] for r in CL.predict_proba(m1, df).collect()}
    p2 = {r[0]: r[1] for r in CL.predict_proba(m2, toks, tokens_col="tokens").collect()}
    assert p1.keys() == p2.keys() and max(abs(p1[k] - p2[k]) for k in p1) < 1e-9
