"""Chunking, quality statistics and tokenizer rules."""

from pyspark.sql import functions as F

from conftest import text_df
from corpus_select.functions import stats as ST
from corpus_select.functions.text import chunk_words, is_blank, treebank_tokens, whitespace_tokens
from corpus_select.operators import quality as QU


def test_numeric_ratio_and_friends(spark):
    df = spark.createDataFrame([(["12", "3", "x"],), ([],)], "t array<string>")
    r = df.select(ST.numeric_ratio(F.col("t")).alias("n"), ST.repeating_ratio(F.col("t")).alias("r"),
                  ST.informative_ratio(F.col("t")).alias("i")).collect()
    assert abs(r[0]["n"] - 2 / 3) < 1e-12
    assert abs(r[0]["r"] - 1 / 3) < 1e-12
    assert r[1]["n"] == 0.0 and r[1]["r"] == 0.0 and r[1]["i"] == 0.0


def test_repeating_ratio_counts_commonest(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "a", "b"],)], "t array<string>")
    assert abs(df.select(ST.repeating_ratio(F.col("t"))).first()[0] - 0.5) < 1e-12


def test_treebank_style_tokens(spark):
    df = text_df(spark, ['He said, "don\'t stop." (Really?)'])
    toks = df.select(treebank_tokens("text")).first()[0]
    assert toks == ["he", "said", ",", "``", "do", "n't", "stop", ".", "''", "(", "really", "?", ")"]


def test_chunking_like_python(spark):
    words = " ".join(f"w{i}" for i in range(300))
    df = text_df(spark, [words, "", "a  b"])
    got = df.select("doc_id", F.posexplode(chunk_words("text", 128))).collect()
    for doc_id, text in enumerate([words, "", "a  b"]):
        parts = text.split(" ")
        exp = [" ".join(parts[i:i + 128]) for i in range(0, len(parts), 128)]
        assert [r["col"] for r in sorted(got) if r["doc_id"] == doc_id] == exp


def test_quality_stats_computed_once_and_mask(spark):
    df = text_df(spark, ["the cat " * 30 + "numbers 1 2 3", "alpha beta gamma delta " * 20])
    q = QU.apply_quality_mask(QU.quality_stats(df, "text"))
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(lower") == 1
    q.collect()


def test_blank_and_whitespace(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \t  "), (4, " x ")], "doc_id long, text string")
    assert [r["doc_id"] for r in df.where(~is_blank("text")).collect()] == [4]
    assert df.where("doc_id = 4").select(whitespace_tokens("text")).first()[0] == ["x"]
