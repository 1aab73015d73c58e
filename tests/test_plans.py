"""Physical-plan checks for the hot path: the shapes that make it scale."""

from pyspark.sql import functions as F

from conftest import SF001
from corpus_select.operators import ngram_model as NG
from corpus_select.operators import quality as QU
from corpus_select.operators.features import ngram_features
from corpus_select.sources.io import read_table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_a_narrow_map(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")  # no balancing: plain scan
    p = _plan(ngram_features(docs))
    assert "MapInArrow" in p or "PythonMapInArrow" in p
    assert "Exchange" not in p
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "text" in scan and "doc_id" in scan
    assert "lang" not in scan and "source" not in scan and "n_chars" not in scan  # pruned


def test_scoring_moves_no_row(spark, tmp_out):
    docs = read_table(spark, SF001, "documents", "doc_id")
    feats = ngram_features(docs)
    feats.write.parquet(tmp_out + "/f")
    feats = spark.read.parquet(tmp_out + "/f")
    tid = read_table(spark, SF001, "labels").where("quality = 1").select("doc_id")
    m = NG.fit_subset_targets(feats, {"target": tid}, num_tokens_to_fit="all")
    w = NG.log_weights(feats, m)
    plan = w._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "MapInArrow" in plan
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "buckets" in line]
    assert scan and "text" not in scan[0]
    # a table too large to ship is joined, with partial sums around the exchange; the weights are the same
    joined = NG._log_weights_joined(feats.withColumn("length", NG.example_length("n_tokens", 2)).where("length >= 100"), m)
    assert joined._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") >= 2
    assert sorted(map(tuple, joined.select("doc_id", "weight_e10").collect())) == sorted(map(tuple, w.select("doc_id", "weight_e10").collect()))


def test_quality_mask_keeps_tokenizer_once(spark):
    df = read_table(spark, SF001, "documents", "doc_id")
    q = QU.apply_quality_mask(QU.quality_stats(QU.chunk_documents(df), "contents"))
    assert q._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(lower") == 1
