"""Answers that must not depend on sizes, ids, batches or budgets; and the flows' options."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, text_df
from corpus_select.operators import classifier as CL
from corpus_select.operators import embedding as EM
from corpus_select.operators import features as FE
from corpus_select.operators import ngram_model as NG
from corpus_select.operators import results as RE
from corpus_select.operators import select as SEL
from corpus_select.operators.features import ngram_features
from corpus_select.plans import flows

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def texts(n, seed=0, words=30):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, words)) for _ in range(n)]


@pytest.fixture(scope="module")
def small_model(spark):
    docs = text_df(spark, texts(40))
    return docs, NG.fit(docs, docs.where("doc_id < 10"))


@pytest.mark.parametrize("blank", [[0], [1], [3], [0, 1], [2, 3], [0, 1, 2, 3]])
def test_blank_documents_in_a_batch_weigh_zero(spark, small_model, blank):
    _, m = small_model
    rows = [(i, " " if i in blank else t) for i, t in enumerate(texts(4, 5))]
    f = ngram_features(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    got = {r.doc_id: r.weight_e10 for r in NG.score_features_arrow(f, m).collect()}
    want = {r.doc_id: r.weight_e10 for r in NG._log_weights_joined(f.withColumn("length", F.lit(1)), m).collect()}
    assert got == want and all(got[i] == 0 for i in blank)


def test_targets_are_the_same_with_and_without_a_budget(spark):
    docs = text_df(spark, texts(60))
    f = ngram_features(docs)
    ids = {"x": docs.where("doc_id < 20").select("doc_id"), "y": docs.where("doc_id between 10 and 40").select("doc_id")}
    whole = NG.fit_subset_targets(f, ids, separate_targets=False, num_tokens_to_fit="all")
    cut = NG.fit_subset_targets(f, ids, separate_targets=False, num_tokens_to_fit=500)
    texts_of = {k: docs.join(v, "doc_id", "left_semi") for k, v in ids.items()}
    plain = NG.fit(docs, texts_of)

    def counts(m):
        return {r["bucket"]: r["target_cnt"] for r in m.table.where("target_cnt > 0").collect()}
    assert whole.targets == cut.targets == plain.targets == ["target"]
    assert counts(whole) == counts(cut) == counts(plain)
    assert sum(counts(whole).values()) == 59 * (20 + 31)  # shared documents count twice


def test_budget_prefix_with_sparse_ids(spark):
    rng = np.random.default_rng(2)
    ids = sorted(int(i) for i in rng.choice(2**62, 80, replace=False))
    docs = spark.createDataFrame(list(zip(ids, texts(80, 3))), "doc_id long, text string").repartition(7)
    f = ngram_features(docs)
    for shards in (1, 3):
        kept = {r.doc_id for r in NG.budgeted(f, 900, 2, shards).collect()}
        want, before = set(), dict.fromkeys(range(shards), 0)
        for i in ids:
            if before[i % shards] <= 900 // shards:
                want.add(i)
            before[i % shards] += 59
        assert kept == want


def test_long_batches_are_cut_by_bytes(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(FE, "SLICE_BYTES", 100)
    for col in (pa.array(["a" * 60, None, "b" * 300, "", "c" * 50, "d" * 50]), pa.array([["a" * 60], None, ["b" * 200, "b" * 100], [], ["c" * 50], ["d" * 50]])):
        parts = list(FE._byte_slices(pa.RecordBatch.from_arrays([col], ["tokens"]), "tokens"))
        assert [p.num_rows for p in parts] == [2, 1, 3] or [p.num_rows for p in parts] == [2, 2, 2]
        assert sum(p.num_rows for p in parts) == 6


def test_feature_step_holds_little_for_large_batches(monkeypatch):
    import pyarrow as pa
    # 6 MB of distinct words in one batch: the memory of Arrow's arrays follows the slice, not the batch
    words = (f"w{i:x}" for i in range(10 ** 9))
    rb = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([" ".join(next(words) for _ in range(16_000)) for _ in range(60)])], ["doc_id", "tokens"])
    pool = pa.system_memory_pool()
    before, most, rows = pa.default_memory_pool(), 0, 0
    pa.set_memory_pool(pool)
    try:
        slices = list(FE._byte_slices(rb, "tokens"))
        assert max(p.column(1).nbytes for p in slices) <= 2 << 20
        for p in slices:
            rows += FE._batch_features(p, 2, 10_000, FE.hasher("xxh64")(10_000), "doc_id", "tokens", True).num_rows
        most = pool.max_memory()
    finally:
        pa.set_memory_pool(before)
    assert rows == 60 and most < 150 << 20


def test_feature_readers_are_cut_by_entries(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from corpus_select.operators import vector_classifier as VC
    lists = [[1, 2, 3], [], None, [4], list(range(9)), [5, 6]]
    rb = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(lists, pa.list_(pa.int32())), pa.array([x and [2] * len(x) for x in lists], pa.list_(pa.int32()))],
                                    ["doc_id", "buckets", "counts"])
    monkeypatch.setattr(FE, "SLICE_ENTRIES", 8)
    for width in (1, 2):
        parts = list(FE.entry_slices(rb, width))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(6))
        assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= 8 // width for p in parts) and len(parts) >= 3
        products = np.arange(10.0)
        assert np.allclose(np.concatenate([VC._logits(p, products, 0.5)[0] for p in parts]), VC._logits(rb, products, 0.5)[0])
    assert not list(FE.entry_slices(rb.slice(0, 0)))


def test_pareto_keeps_a_pool_that_k_covers(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0.0).alias("prob"))
    for k in (500, 900):
        assert SEL.pareto_select(df, k, shape=40.0).count() == 500
    for k in (1, 17, 499):
        r = SEL.pareto_rounds(df, shape=6.0)
        picked = {x.doc_id for x in SEL.pareto_select(df, k, shape=6.0).collect()}
        rounds = sorted(x.first_round for x in r.collect())[k - 1]
        accepted = {x.doc_id for x in r.where(F.col("first_round") <= rounds).collect()}
        assert len(picked) == k and picked <= accepted


def test_word_ngrams_above_two_count(spark):
    df = spark.createDataFrame([(1, "a b c", 1.0), (2, "c b a", 0.0)] * 3, "doc_id long, text string, label double")
    sizes = {}
    for n in (1, 2, 3):
        m = CL.train_classifier(df, ngrams=n, num_features=1 << 12, reg_params=(0.1,), max_iter=3)
        tokens = df.select("doc_id", F.split("text", " ").alias("_tok"))
        grams = tokens
        for stage in m.stages[:-1]:
            grams = stage.transform(grams)
        sizes[n] = len(grams.first()["_grams"])
    assert sizes == {1: 3, 2: 5, 3: 6}


def test_em_start_and_packed_sums(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [20, 0], [0, 20], [20, 20]], float)
    x = np.concatenate([c + rng.normal(size=(60, 2)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    start = EM.init_mixture(df, 4)
    assert all(np.abs(start.means - c).sum(1).min() < 1.0 for c in centres)
    monkeypatch.setattr(EM, "FAN_IN", 3)  # driver side: how often the sums are combined
    one, ll1 = EM.em_step(df.coalesce(1), start)
    many, ll2 = EM.em_step(df.repartition(11), start)
    assert np.allclose(one.means, many.means) and np.allclose(one.vars, many.vars) and np.isclose(ll1, ll2)


def test_hybrid_selection(spark, tmp_out):
    docs = text_df(spark, texts(50))
    e = docs.select("doc_id", F.array((F.col("doc_id") % 5).cast("double"), F.lit(1.0)).alias("embedding"))
    target = docs.where("doc_id % 5 = 2").select("doc_id")
    options = dict(target_ids=target, min_example_length=None, components=3, target_components=1, max_iter=3)
    by_text = flows.hybrid_selection(docs, None, e, e.join(target, "doc_id"), 10, alpha=1.0, top_k=True, **options)
    by_vector = flows.hybrid_selection(docs, None, e, e.join(target, "doc_id"), 10, alpha=0.0, top_k=True, **options)
    plain = flows.ngram_selection(docs, None, 10, target_ids=target, min_example_length=None, top_k=True)
    assert {r.doc_id for r in by_text.chosen.collect()} == {r.doc_id for r in plain.chosen.collect()}
    assert {r.doc_id for r in by_vector.chosen.collect()} == {r.doc_id for r in target.collect()}
    lacking = e.where("doc_id <> 7")
    with pytest.raises(Exception, match="id 7"):
        flows.hybrid_selection(docs, None, lacking, e.join(target, "doc_id"), 10, top_k=True, **options)
    some = flows.hybrid_selection(docs, None, lacking, e.join(target, "doc_id"), 60, top_k=True, require_all=False, **options)
    assert some.chosen.count() == 49


def test_metadata_filter_of_a_flow(spark):
    docs = text_df(spark, texts(40)).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    sel = flows.ngram_selection(docs, None, 100, target_ids=docs.where("doc_id < 9").select("doc_id"), min_example_length=None, where=F.col("lang") == "en")
    assert {r.doc_id for r in sel.chosen.collect()} == set(range(0, 40, 2))


def test_chunk_flow_ids_filters_and_reuse(spark, tmp_out):
    base = spark.read.parquet(f"{SF001}/documents.parquet").limit(60)
    raw = base.select((F.col("doc_id") * 2 + (1 << 44)).alias("doc_id"), "text", F.when(F.col("doc_id") % 3 == 0, "held").otherwise("open").alias("domain"))
    target = raw.where("doc_id % 4 = 0").select("doc_id")
    out = flows.chunked_selection(raw, target, 10_000, quality_filter=True, exclude_domains=["held"], work_dir=tmp_out)
    from corpus_select.operators import quality as QU
    chunks = QU.chunk_documents(raw, 128, keep=("domain",))
    want = QU.apply_quality_mask(QU.quality_stats(chunks.where("domain <> 'held'"), "contents"))
    assert sorted(r.contents for r in out.collect()) == sorted(r.contents for r in want.collect())
    assert out.select("chunk_id").distinct().count() == want.count() > 0
    short = flows.chunked_selection(raw, target, 10_000, chunk_length=50, quality_filter=False, work_dir=tmp_out)
    assert max(len(r.contents.split(" ")) for r in short.collect()) == 50


def test_classifier_flow_with_vectors_and_retrieval(spark, tmp_out):
    good = text_df(spark, ["alpha beta :: gamma"] * 30)
    bad = text_df(spark, ["omega sigma tau"] * 30, 1000)
    pool = text_df(spark, ["alpha beta gamma", "omega sigma", "alpha :: gamma", "tau omega"], 5000).withColumn("domain", F.when(F.col("doc_id") == 5002, "held").otherwise("open"))
    vectors = spark.createDataFrame([("alpha", [1.0, 0.0]), ("omega", [0.0, 1.0]), ("tau", [0.0, 2.0])], "word string, vec array<float>")
    model, probs, chosen = flows.classifier_selection(good, bad, pool.select("doc_id", "text"), 2, mode="topk", reg_params=(0.01,), num_features=1 << 10, word_vectors=vectors, work_dir=tmp_out)
    assert {r.doc_id for r in chosen.collect()} == {5000, 5002}
    rows = flows.classifier_retrieval(pool, probs, 1, mode="topk", exclude_domains=["held"], topup={"held": 1}).collect()
    assert {(r.doc_id, r.score is None, r.domain[0]) for r in rows} == {(5000, False, "open"), (5002, True, "held")}
    with pytest.raises(ValueError, match="nonsense"):
        CL.retrieve(probs, 1, mode="nonsense")


def test_stream_with_quality_mask(spark, small_model, tmp_out):
    from corpus_select.operators import quality as QU
    from corpus_select.streaming.stream import run_score_filter
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    m = NG.fit(docs, docs.where("doc_id % 3 = 0"))
    out = run_score_filter(spark, f"{SF001}/documents*.parquet", m, threshold_e10=0, sink_dir=tmp_out, quality_mask=True)
    kept = QU.apply_quality_mask(QU.quality_stats(docs.select("doc_id", "text"), "text")).select("doc_id")
    want = NG.log_weights(ngram_features(docs), m).where("weight_e10 >= 0").join(kept, "doc_id", "left_semi")
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in want.collect()}


def test_text_pair_columns():
    assert RE.text_pair_columns(["label", "sentence2", "sentence1"]) == ("sentence1", "sentence2")
    assert RE.text_pair_columns(["a", "label", "b", "c"]) == ("a", "b")
    assert RE.text_pair_columns(["only", "label"]) == ("only", None)


def test_default_encoder_ignores_batches():
    enc = EM.hashed_embedding(32)
    rows = ["Alpha, beta!", "", None, "beta alpha", "x " * 300]
    whole = enc(rows)
    assert np.allclose(whole, np.concatenate([enc([r]) for r in rows])) and np.allclose(np.linalg.norm(whole, axis=1), [1, 0, 0, 1, 1])


def test_rows_without_a_key_rank_last_by_id(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 7) for i in range(200)], "doc_id long, weight_e10 long")
    order = sorted(range(200), key=lambda i: (i % 4 == 0, -(i % 7) if i % 4 else 0, i))
    for k in (5, 149, 150, 151, 170, 199, 200, 999):
        assert {r.doc_id for r in SEL.top_k(df, k, small_k=3).collect()} == set(order[:k])
