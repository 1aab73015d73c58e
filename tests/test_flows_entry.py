"""End-to-end flows, streaming vs batch, and the driver contract."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from corpus_select.operators import ngram_model as NG
from corpus_select.operators.features import ngram_features
from corpus_select.plans import flows
from corpus_select.sources.io import read_table
from corpus_select.streaming.stream import run_score_filter


def test_ngram_selection_flow(spark, tmp_out):
    docs = read_table(spark, SF001, "documents", "doc_id")
    tid = read_table(spark, SF001, "labels").where("quality = 1").select("doc_id")
    sel = flows.ngram_selection(docs, None, 20, target_ids=tid, top_k=True, work_dir=tmp_out,
                                num_tokens_to_fit="all")
    rows = sel.chosen.collect()
    assert len(rows) == 20
    m2 = NG.fit(docs, docs.join(tid, "doc_id", "left_semi"), num_tokens_to_fit="all")
    w2 = NG.log_weights(ngram_features(docs), m2)
    exp = [r["doc_id"] for r in w2.orderBy(F.col("weight_e10").desc(), "doc_id").limit(20).collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(exp)


def test_chunked_selection_flow(spark, tmp_out):
    docs = read_table(spark, SF001, "documents", "doc_id").withColumnRenamed("source", "domain")
    tid = read_table(spark, SF001, "labels").where("quality = 1").select("doc_id")
    out = flows.chunked_selection(docs, tid, 40, exclude_domains=["src1"], topup={"src1": 4}, pack=True,
                                  quality_filter=False, work_dir=tmp_out)
    rows = out.collect()
    assert 18 <= len(rows) <= 22
    assert all(len(r["domain"]) == 2 for r in rows)


def test_classifier_flow(spark):
    docs = read_table(spark, SF001, "documents", "doc_id").select("doc_id", "text")
    tgt = read_table(spark, SF001, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    _, probs, chosen = flows.classifier_selection(tgt, docs, docs, 15, mode="pareto", num_features=1 << 12,
                                                  reg_params=(0.1,))
    assert probs.count() == docs.count() and chosen.count() == 15


def test_stream_equals_batch(spark):
    docs = read_table(spark, SF001, "documents", "doc_id")
    tid = read_table(spark, SF001, "labels").where("quality = 1").select("doc_id")
    m = NG.fit(docs, docs.join(tid, "doc_id", "left_semi"), num_tokens_to_fit="all")
    s = run_score_filter(spark, os.path.join(SF001, "documents*.parquet"), m, threshold_e10=0)
    b = NG.log_weights(ngram_features(docs), m).where("weight_e10 >= 0")
    assert sorted(r["doc_id"] for r in s.collect()) == sorted(r["doc_id"] for r in b.collect())


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["doc_id", "log_weight"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_ngram_selection_flow_two_targets(spark, tmp_out):
    docs = read_table(spark, SF001, "documents", "doc_id")
    labels = read_table(spark, SF001, "labels")
    ids = {"good": labels.where("quality = 1").select("doc_id"),
           "src1": docs.where("source = 'src1'").select("doc_id")}
    sel = flows.ngram_selection(docs, None, 30, target_ids=ids, separate_targets=True,
                                target_proportions=[2, 1], top_k=True, work_dir=tmp_out, num_tokens_to_fit="all")
    rows = sel.chosen.collect()
    assert len(rows) == 30 and len({r["doc_id"] for r in rows}) == 30
    counts = {}
    for r in rows:
        counts[r["target"]] = counts.get(r["target"], 0) + 1
    assert counts == {"good": 20, "src1": 10}
