"""Selection operators: exact top-k (incl. the large-k bracket path), ties, k >= pool,
Gumbel inclusion frequencies, Pareto, quotas, dense index, packing."""

import math

from pyspark.sql import functions as F

from conftest import text_df
from corpus_select.functions.hashing import seeded_uniform
from corpus_select.operators import pack as PK
from corpus_select.operators import select as SEL


def _weights(spark, n=5000, dup_every=7):
    rows = [(i, (i * 7919) % 1000 if i % dup_every else 500) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, weight_e10 long")


def _brute(rows, k):
    return [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]]


def test_top_k_small_and_ties(spark):
    w = _weights(spark)
    rows = [(r[0], r[1]) for r in w.collect()]
    got = sorted(r["doc_id"] for r in SEL.top_k(w, 300).collect())
    assert got == sorted(_brute(rows, 300))


def test_top_k_bracket_path_equals_brute_force(spark):
    w = _weights(spark, n=20000, dup_every=3)  # a third of all rows share one weight
    rows = [(r[0], r[1]) for r in w.collect()]
    for k in (1000, 7000, 15000):
        got = sorted(r["doc_id"] for r in SEL.top_k(w, k, small_k=50).collect())
        assert got == sorted(_brute(rows, k)), k


def test_k_at_least_pool_returns_pool(spark):
    w = _weights(spark, n=1000)
    assert SEL.top_k(w, 10000).count() == 1000
    assert SEL.top_k(w, 10000, small_k=10).count() == 1000


def test_duplicate_text_tie_keeps_smaller_id(spark):
    w = spark.createDataFrame([(5, 10), (3, 10), (9, 10), (1, 1)], "doc_id long, weight_e10 long")
    assert [r["doc_id"] for r in SEL.top_k(w, 2).collect()] == [3, 5]


def test_gumbel_inclusion_frequency(spark):
    # 3 items, weights log(1), log(2), log(7): P(first pick) = w / sum(w)
    rows = []
    ws = [1.0, 2.0, 7.0]
    for seed in range(400):
        for i, wt in enumerate(ws):
            rows.append((seed, seed * 10 + i, i, int(round(math.log(wt) * 1e10))))
    df = spark.createDataFrame(rows, "seed int, doc_id long, item int, weight_e10 long")
    g = -F.log(-F.log(seeded_uniform(0, "gumbel", "doc_id")))
    df = df.withColumn("k", F.col("weight_e10") + F.round(g * F.lit(1e10), 0).cast("long"))
    from pyspark.sql import Window
    top = df.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy(F.col("k").desc()))) \
        .where("r = 1").groupBy("item").count().collect()
    freq = {r["item"]: r["count"] / 400 for r in top}
    for i, wt in enumerate(ws):
        assert abs(freq.get(i, 0) - wt / 10) < 0.07


def test_gumbel_top_k_is_seeded_and_partition_free(spark):
    w = _weights(spark, n=3000)
    a = sorted(r["doc_id"] for r in SEL.gumbel_top_k(w, 100, seed=4).collect())
    b = sorted(r["doc_id"] for r in SEL.gumbel_top_k(w.repartition(13), 100, seed=4).collect())
    c = sorted(r["doc_id"] for r in SEL.gumbel_top_k(w, 100, seed=5).collect())
    assert a == b and a != c


def test_quota_split():
    assert SEL.quota_split(10, [0.5, 0.5]) == [5, 5]
    assert SEL.quota_split(10, [1, 1, 1]) == [3, 3, 4]
    assert SEL.quota_split(3, [0.0, 1.0]) == [0, 3]


def test_pareto_acceptance_rate(spark):
    n = 20000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0.6).alias("prob"))
    r = SEL.pareto_rounds(df, "prob", seed=3).where("first_round = 0").count()
    q = (2 - 0.6) ** -9
    assert abs(r / n - q) < 0.01
    chosen = SEL.pareto_select(df, 500, "prob", seed=3)
    assert chosen.count() == 500


def test_dense_index_is_positional(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(500)], "doc_id long, source string")
    got = SEL.dense_index(df, ["source", "doc_id"], "idx", num_partitions=7).collect()
    exp = sorted([(r["source"], r["doc_id"]) for r in got])
    assert sorted(r["idx"] for r in got) == list(range(500))
    pos = {(r["source"], r["doc_id"]): r["idx"] for r in got}
    assert [pos[e] for e in exp] == list(range(500))


def test_prefix_sum(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(300)], "k long, w long")
    got = {r["k"]: r["prefix"] for r in SEL.prefix_sum(df, ["k"], "w", "prefix", num_partitions=5).collect()}
    acc = 0
    for i in range(300):
        assert got[i] == acc
        acc += i % 4


def test_pack_odd_selection_drops_last(spark):
    df = spark.createDataFrame([(i, f"t{i}", f"d{i}") for i in (2, 4, 6, 8, 10)],
                               "doc_id long, contents string, domain string")
    rows = sorted(PK.pack_pairs(df, "doc_id", "contents", "domain").collect())
    assert len(rows) == 2
    assert rows[0]["contents"] == "t2t4" and rows[0]["domain"] == ["d2", "d4"]
    assert rows[1]["doc_id"] == 6


def test_group_of_n_modes(spark):
    import pytest
    df = spark.createDataFrame([(i,) for i in range(7)], "v long")
    fill = sorted(PK.group_of_n(df, 3, "v", ["v"], "fill", -1).collect())
    assert fill[-1]["items"] == [6, -1, -1]
    assert len(PK.group_of_n(df, 3, "v", ["v"], "ignore").collect()) == 2
    with pytest.raises(ValueError):
        PK.group_of_n(df, 3, "v", ["v"], "strict")


def test_domain_topup_and_union(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(300)], "doc_id long, domain string")
    up = SEL.domain_topup(df, {"a": 10, "b": 5}, seed=1)
    got = up.groupBy("domain").count().collect()
    assert {r["domain"]: r["count"] for r in got} == {"a": 10, "b": 5}
    u = SEL.union_ids(up, up.limit(3))
    assert u.count() == 15


def test_reconcile(spark):
    import pytest
    a = text_df(spark, ["x", "y"])
    SEL.reconcile(a.select("doc_id"), a)
    with pytest.raises(ValueError):
        SEL.reconcile(a.select("doc_id").limit(1), a)


def test_top_k_all_tied_pool(spark):
    w = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(7).cast("long").alias("weight_e10"))
    got = sorted(r["doc_id"] for r in SEL.top_k(w, 2500, small_k=100).collect())
    assert got == list(range(2500))


def test_flow_topup_quotas():
    assert SEL.NGRAM_FLOW_TOPUP == {"Wikipedia (en)": 2000000, "Gutenberg (PG-19)": 666666}
    q = SEL.classifier_flow_topup(6000)
    assert q["Wikipedia (en)"] == 3000 and q["Books3"] == 1000 and len(q) == 4
