"""Hashed n-gram estimator: exact values and invariants (the reference's unit tests, re-aimed)."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF001, text_df
from corpus_select.functions.hashing import sha256_bucket, sha256_bucket_py
from corpus_select.functions.text import example_length, ngrams, wordpunct_tokens
from corpus_select.operators import ngram_model as NG
from corpus_select.operators import select as SEL
from corpus_select.operators.features import features_long, ngram_features
from corpus_select.sources.io import read_table


def test_hash_values_python_and_jvm(spark):
    assert sha256_bucket_py("alice", 10000) == 6720
    assert sha256_bucket_py("alice went", 10000) == 114
    df = spark.createDataFrame([("alice",), ("alice went",)], "g string")
    got = [r[0] for r in df.select(sha256_bucket("g", 10000)).collect()]
    assert got == [6720, 114]


def test_arrow_features_match_python_hash(spark):
    df = text_df(spark, ["Alice went to the store"])
    long = features_long(ngram_features(df, n=2, num_buckets=10000)).collect()
    assert sum(r["cnt"] for r in long) == 9
    assert any(r["bucket"] == 6720 for r in long)
    assert any(r["bucket"] == 114 for r in long)


def test_length_equals_token_count(spark):
    df = text_df(spark, ["Alice walked into the store\n\n()()($#%@?)@(#(*"])
    f = ngram_features(df, n=2).withColumn("length", example_length("n_tokens", 2)).first()
    toks = df.select(wordpunct_tokens("text")).first()[0]
    assert f["length"] == len(toks) == f["n_tokens"]


@pytest.mark.parametrize("n,expected", [(2, 0), (3, 1)])
def test_empty_document_length(spark, n, expected):
    df = text_df(spark, [""])
    f = ngram_features(df, n=n).withColumn("length", example_length("n_tokens", n)).first()
    assert f["n_tokens"] == 0 and f["length"] == expected


def test_ngrams_general_n(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],)], "w array<string>")
    assert df.select(ngrams("w", 3)).first()[0] == ["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d"]
    short = spark.createDataFrame([(["a"],)], "w array<string>")
    assert short.select(ngrams("w", 3)).first()[0] == ["a"]


@pytest.mark.parametrize("budget", ["all", "auto", 100000])
def test_distributions_sum_to_one(spark, budget):
    docs = read_table(spark, SF001, "documents", "doc_id")
    tgt = read_table(spark, SF001, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    m = NG.fit(docs, tgt, num_tokens_to_fit=budget)
    rows = m.table.collect()
    assert len(rows) == 10000
    assert math.isclose(sum(r["raw_p"] for r in rows), 1.0, rel_tol=1e-9)
    assert math.isclose(sum(r["target_p"] for r in rows), 1.0, rel_tol=1e-9)
    for r in rows[:50]:
        ld = math.log(r["target_p"] + 1e-8) - math.log(r["raw_p"] + 1e-8)
        assert math.isclose(r["log_diff"], ld, rel_tol=1e-12, abs_tol=1e-12)
        assert r["ld_e10"] == round(ld * 1e10)


def test_budget_cuts_after_crossing_document(spark):
    docs = text_df(spark, ["a b c"] * 10)  # 5 n-grams each
    f = ngram_features(docs)
    kept = NG.budgeted(f, 12, 2, num_shards=1).select("doc_id").collect()
    # before-sums 0,5,10 <= 12 -> three docs kept, the third crosses the budget
    assert sorted(r[0] for r in kept) == [0, 1, 2]


def test_smoothing_formula(spark):
    docs = read_table(spark, SF001, "documents", "doc_id")
    tgt = read_table(spark, SF001, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    m = NG.fit(docs, tgt, num_tokens_to_fit="all", target_laplace_smoothing=1.0)
    rows = m.table.collect()
    total = sum(r["target_cnt"] for r in rows)
    for r in rows[:100]:
        assert math.isclose(r["target_p"], (r["target_cnt"] + 1) / (total + 10000), rel_tol=1e-12)


def _select(spark, n=2, num_buckets=10000, k=2, partitions=None):
    docs = read_table(spark, SF001, "documents")
    if partitions:
        docs = docs.repartition(partitions)
    tgt = read_table(spark, SF001, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    m = NG.fit(docs, tgt, n=n, num_buckets=num_buckets, num_tokens_to_fit="all")
    w = NG.log_weights(ngram_features(docs, n=n, num_buckets=num_buckets), m, min_example_length=100, n=n)
    return SEL.top_k(w, k).collect()


def test_selection_k_rows_min_length(spark):
    rows = _select(spark)
    assert len(rows) == 2 and all(r["length"] >= 100 for r in rows)


def test_selection_other_parameters(spark):
    rows = _select(spark, n=3, num_buckets=50000)
    assert len(rows) == 2 and all(r["length"] >= 100 for r in rows)


def test_partition_independence(spark):
    a = [(r["doc_id"], r["weight_e10"]) for r in _select(spark, k=20, partitions=2)]
    b = [(r["doc_id"], r["weight_e10"]) for r in _select(spark, k=20, partitions=15)]
    c = [(r["doc_id"], r["weight_e10"]) for r in _select(spark, k=20, partitions=1)]
    assert a == b == c


def test_two_targets_one_row_each(spark):
    t1 = text_df(spark, ["def foo(x): return x  # licensed under the apache license version 2.0"] * 3, 1000)
    t2 = text_df(spark, ["the novel follows a young woman who travels across the country"] * 3, 2000)
    raw = text_df(spark, [
        "def foo(x): return x  # licensed under the apache license version 2.0",
        "the novel follows a young woman who travels across the country",
        "zebra quartz lamp violin orbit maple canyon ribbon velvet harbor",
    ])
    m = NG.fit(raw, {"code": t1, "novel": t2}, separate_targets=True, num_tokens_to_fit="all",
               target_proportions=[0.5, 0.5])
    w = NG.log_weights(ngram_features(raw), m, min_example_length=None)
    chosen = SEL.select_multi_target(w, 2, ["code", "novel"], [0.5, 0.5]).collect()
    got = {r["target"]: r["doc_id"] for r in chosen}
    assert got == {"code": 0, "novel": 1}


def test_save_load(spark, tmp_out):
    docs = read_table(spark, SF001, "documents", "doc_id")
    tgt = read_table(spark, SF001, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    m = NG.fit(docs, tgt, num_tokens_to_fit="all", target_laplace_smoothing=0.5)
    m.save(tmp_out)
    m2 = NG.NgramModel.load(spark, tmp_out)
    assert m2.params == m.params and m2.targets == m.targets
    assert sorted(m2.table.collect()) == sorted(m.table.collect())
    m3 = NG.NgramModel.load(spark, tmp_out, exclude_keys=["target_laplace_smoothing"],
                            defaults={"target_laplace_smoothing": 0.0})
    assert m3.params["target_laplace_smoothing"] == 0.0


def test_unknown_tokenizer(spark):
    with pytest.raises(ValueError):
        ngram_features(text_df(spark, ["x"]), tokenizer="nope")


def test_toy_pair_target_words_score_higher(spark):
    raw = text_df(spark, ["the cat sat on the mat", "stock markets fell sharply today",
                          "cats and dogs are pets", "bond yields rose again"])
    tgt = text_df(spark, ["markets and stock prices", "bond yields and markets"], 100)
    m = NG.fit(raw, tgt, num_tokens_to_fit="all")
    w = {r["doc_id"]: r["weight_e10"] for r in NG.log_weights(ngram_features(raw), m, min_example_length=None).collect()}
    assert min(w[1], w[3]) > max(w[0], w[2])


def test_sparse_features_equal_sql_features(spark):
    docs = read_table(spark, SF001, "documents", "doc_id")
    from corpus_select.operators.features import ngram_features_sql
    a = sorted(tuple(r) for r in features_long(ngram_features(docs)).collect())
    b = sorted(tuple(r) for r in ngram_features_sql(docs).collect())
    assert a == b


def test_null_text_dropped(spark):
    df = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert [r["doc_id"] for r in ngram_features(df).collect()] == [2]


def test_single_scan_fit_equals_separate_fit(spark):
    docs = read_table(spark, SF001, "documents", "doc_id")
    tid = read_table(spark, SF001, "labels").where("quality = 1").select("doc_id")
    tid2 = docs.where("source in ('src1', 'src2')").select("doc_id")
    f = ngram_features(docs)
    for sep in (False, True):
        a = NG.fit_subset_targets(f, {"a": tid, "b": tid2}, separate_targets=sep, num_tokens_to_fit="all",
                                  target_laplace_smoothing=0.5)
        b = NG.fit_from_features(f, {"a": f.join(tid, "doc_id", "left_semi"), "b": f.join(tid2, "doc_id", "left_semi")}
                                 # pooled: a document of both targets counts twice, as repeated inputs do
                                 if sep else {"target": f.join(tid.unionByName(tid2), "doc_id")},
                                 separate_targets=sep, num_tokens_to_fit="all", target_laplace_smoothing=0.5)
        ka = sorted((r["target"], r["bucket"], r["ld_e10"], r["raw_cnt"], r["target_cnt"]) for r in a.table.collect())
        kb = sorted((r["target"], r["bucket"], r["ld_e10"], r["raw_cnt"], r["target_cnt"]) for r in b.table.collect())
        assert ka == kb
        pa = sorted((r["target"], round(r["proportion"], 12)) for r in a.proportions.collect())
        pb = sorted((r["target"], round(r["proportion"], 12)) for r in b.proportions.collect())
        assert pa == pb


def test_empty_target_raises(spark):
    docs = read_table(spark, SF001, "documents", "doc_id")
    empty = docs.limit(0)
    with pytest.raises(Exception, match="empty"):
        NG.fit(docs, empty, num_tokens_to_fit="all").table.collect()
    f = ngram_features(docs)
    with pytest.raises(Exception, match="empty"):
        NG.fit_subset_targets(f, {"t": docs.limit(0).select("doc_id")}, num_tokens_to_fit="all").table.collect()


def test_budgeted_features_read_little_more_than_they_keep(spark):
    df = spark.range(0, 4000, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id") % (7 + k)) for k in range(10)]).alias("text"))
    whole = NG.budgeted(ngram_features(df, n=2, num_buckets=100), 5000, 2, num_shards=3)
    read = []

    def counted(part, *a, **k):
        read.append(part.count())
        return ngram_features(part, *a, **k)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(NG, "ngram_features", counted)
        early = NG.budgeted_features(df, 5000, 2, 100, num_shards=3)
    kept = sorted(map(str, whole.collect()))
    assert sorted(map(str, early.collect())) == kept and 0 < len(kept) < 400
    assert sum(read) <= 2 * len(kept) + 8 and len(read) > 2
    # a budget beyond the corpus reads it all; an empty table gives nothing
    assert NG.budgeted_features(df, 10**9, 2, 100).count() == 4000
    assert NG.budgeted_features(df.limit(0), 10, 2, 100).count() == 0


def test_documents_without_ngrams_weigh_the_same_on_both_paths(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, ""), (3, "a b"), (4, "...")], "doc_id long, text string")
    model = NG.fit(df, df.where("doc_id = 1"), n=3, num_buckets=50)
    f = ngram_features(df, n=3, num_buckets=50)
    for least in (None, 0, 1, 2):
        arrow = sorted(map(str, NG.log_weights(f, model, least).collect()))
        with pytest.MonkeyPatch.context() as m:
            m.setattr(NG, "BROADCAST_MAX_ROWS", 10)
            joined = sorted(map(str, NG.log_weights(f, model, least).collect()))
        assert arrow == joined
