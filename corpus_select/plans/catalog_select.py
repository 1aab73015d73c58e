"""Registered selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sqlsnippets as S
from .catalog import LD_MULTI_CTE, WEIGHTS_A_CTE, docs, feats, query, two_target_weights, weights_a
from ..operators import select as SEL
from ..sources.io import read_table

GUMBEL_SQL = S.gumbel_e10(7, "gumbel", "doc_id")


@query("gumbel_topk", f"""
with {WEIGHTS_A_CTE}
select doc_id, log_weight from sc where length >= 100
order by weight_e10 + {GUMBEL_SQL} desc, doc_id limit 100""")
def q_gumbel(spark, sf):
    """Weighted sampling without replacement of 100 documents, seed 7 (K2)."""
    return SEL.gumbel_top_k(weights_a(spark, sf), 100, seed=7).select("doc_id", "log_weight")


MULTI_W = f"""{LD_MULTI_CTE},
lw as (select f.doc_id, ld.target, sum(f.cnt * ld.ld)::BIGINT weight_e10 from f join ld using (bucket)
       where f.doc_id in (select doc_id from w where {S.length_expr('len(w)', 2)} >= 100)
       group by f.doc_id, ld.target)"""


@query("multi_target_select", f"""
with {MULTI_W},
pa as (select doc_id, target from lw where target = 'a' order by weight_e10 desc, doc_id limit 50),
pb as (select doc_id, target from lw where target = 'b' and doc_id not in (select doc_id from pa)
       order by weight_e10 desc, doc_id limit 50)
select * from pa union all select * from pb""")
def q_multi_target(spark, sf):
    """Two targets at 0.5 / 0.5, k = 100: target a first, then b among the rest."""
    lw = two_target_weights(spark, sf)
    return SEL.select_multi_target(lw, 100, ["a", "b"], [0.5, 0.5]).select("doc_id", "target")


@query("multi_target_gumbel", f"""
with {MULTI_W},
pa as (select doc_id, target from lw where target = 'a'
       order by weight_e10 + {S.gumbel_e10(3, 'gumbel:a', 'doc_id')} desc, doc_id limit 60),
pb as (select doc_id, target from lw where target = 'b' and doc_id not in (select doc_id from pa)
       order by weight_e10 + {S.gumbel_e10(3, 'gumbel:b', 'doc_id')} desc, doc_id limit 40)
select * from pa union all select * from pb""")
def q_multi_target_gumbel(spark, sf):
    """Two targets at 0.6 / 0.4 with Gumbel sampling, seed 3 (K2 + K4)."""
    lw = two_target_weights(spark, sf)
    return SEL.select_multi_target(lw, 100, ["a", "b"], [0.6, 0.4], top_k_mode=False, seed=3) \
        .select("doc_id", "target")


@query("random_select", f"""
select doc_id from documents order by {S.order_key(1, 'random', 'doc_id')} desc, doc_id limit 100""")
def q_random(spark, sf):
    """Uniform random baseline of 100 documents, seed 1 (K9)."""
    return SEL.random_select(docs(spark, sf).select("doc_id"), 100, seed=1).select("doc_id")


@query("sample_rows", f"""
select doc_id, source from documents order by {S.order_key(5, 'random', 'doc_id')} desc, doc_id limit 3""")
def q_sample_rows(spark, sf):
    """Three seeded random rows for a log."""
    return SEL.sample_rows(docs(spark, sf).select("doc_id", "source"), 3, seed=5).select("doc_id", "source")


@query("shuffle_order", f"""
select doc_id, (row_number() over (order by {S.order_key(11, 'epoch:2', 'doc_id')}, doc_id) - 1)::BIGINT pos
from documents""")
def q_shuffle(spark, sf):
    """Seeded epoch shuffle (K10): position of every document in epoch 2, seed 11."""
    sh = SEL.shuffle_rows(docs(spark, sf).select("doc_id"), seed=11, epoch=2)
    return SEL.dense_index(sh, ["shuffle_key", "doc_id"], "pos").select("doc_id", "pos")


@query("domain_include", """
select doc_id, source from documents where source in ('src1', 'src2')""")
def q_domain_include(spark, sf):
    return SEL.domain_include(docs(spark, sf), ["src1", "src2"], "source").select("doc_id", "source")


@query("domain_exclude", """
select doc_id, source from documents where source not in ('src1', 'src2') or source is null""")
def q_domain_exclude(spark, sf):
    return SEL.domain_exclude(docs(spark, sf), ["src1", "src2"], "source").select("doc_id", "source")


@query("domain_topup", f"""
(select doc_id, source from documents where source = 'src3'
 order by {S.order_key(3, 'topup:src3', 'doc_id')} desc, doc_id limit 10)
union all
(select doc_id, source from documents where source = 'src4'
 order by {S.order_key(3, 'topup:src4', 'doc_id')} desc, doc_id limit 5)""")
def q_domain_topup(spark, sf):
    """Random top-up from held-out domains: 10 from src3, 5 from src4, seed 3 (K7)."""
    return SEL.domain_topup(docs(spark, sf).select("doc_id", "source"), {"src3": 10, "src4": 5}, seed=3,
                            domain_col="source").select("doc_id", "source")


@query("domain_counts", """
select source, count(*)::BIGINT n_rows from documents group by source""")
def q_domain_counts(spark, sf):
    return SEL.domain_counts(docs(spark, sf), "source")


TOP100 = f"""{WEIGHTS_A_CTE},
top as (select doc_id, weight_e10, log_weight from sc where length >= 100 order by weight_e10 desc, doc_id limit 100)"""


def top100(spark, sf):
    return SEL.top_k(weights_a(spark, sf), 100)


@query("selected_semi_join", f"""
with {TOP100}
select doc_id, source, text from documents where doc_id in (select doc_id from top)""")
def q_semi(spark, sf):
    """The chosen documents' rows, fetched by semi join."""
    return SEL.semi_join(docs(spark, sf), top100(spark, sf)).select("doc_id", "source", "text")


@query("score_attach", f"""
with {TOP100}
select d.doc_id, d.source, t.log_weight score from documents d join top t using (doc_id)""")
def q_score_attach(spark, sf):
    """Chosen rows with their score attached."""
    return SEL.attach_scores(docs(spark, sf).select("doc_id", "source"), top100(spark, sf), "log_weight")


@query("union_topup", f"""
with {TOP100},
t3 as (select doc_id from documents where source = 'src3'
       order by {S.order_key(3, 'topup:src3', 'doc_id')} desc, doc_id limit 30)
select distinct doc_id from (select doc_id from top union all select doc_id from t3)""")
def q_union_topup(spark, sf):
    """Chosen ∪ top-up ids; duplicates collapse."""
    t = top100(spark, sf)
    up = SEL.domain_topup(docs(spark, sf).select("doc_id", "source"), {"src3": 30}, seed=3, domain_col="source")
    return SEL.union_ids(t, up)


@query("row_count_check", f"""
with {WEIGHTS_A_CTE}
select (select count(*) from documents)::BIGINT n_rows, (select count(*) from sc)::BIGINT n_scores,
       (select count(*) from documents where doc_id not in (select doc_id from sc))::BIGINT missing,
       (select count(*) from sc where doc_id not in (select doc_id from documents))::BIGINT extra""")
def q_row_count(spark, sf):
    """Scores must cover every row before selecting (A14), as one lazy row of counts."""
    d = docs(spark, sf).select("doc_id", F.lit(1).alias("in_docs"))
    s = weights_a(spark, sf, None) \
        .select("doc_id", F.lit(1).alias("in_scores"))
    j = d.join(s, "doc_id", "full")
    return j.agg(F.sum(F.coalesce("in_docs", F.lit(0))).cast("long").alias("n_rows"),
                 F.sum(F.coalesce("in_scores", F.lit(0))).cast("long").alias("n_scores"),
                 F.sum(F.when(F.col("in_scores").isNull(), 1).otherwise(0)).cast("long").alias("missing"),
                 F.sum(F.when(F.col("in_docs").isNull(), 1).otherwise(0)).cast("long").alias("extra"))


@query("pool_union", """
select 'documents' pool, doc_id id, text from documents
union all select 'benchmark' pool, item_id id, text from benchmark
union all select 'conversations' pool, conv_id * 1000 + turn id, text from conversations""")
def q_pool_union(spark, sf):
    """Several inputs form one pool."""
    d = docs(spark, sf).select(F.lit("documents").alias("pool"), F.col("doc_id").alias("id"), "text")
    b = read_table(spark, sf, "benchmark").select(F.lit("benchmark").alias("pool"), F.col("item_id").alias("id"), "text")
    c = read_table(spark, sf, "conversations").select(
        F.lit("conversations").alias("pool"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return d.unionByName(b).unionByName(c)


@query("virtual_shards", f"""
select (doc_id % 4)::INT shard, count(*)::BIGINT n_rows,
       sum(len(w) + greatest(len(w) - 1, 0))::BIGINT n_grams
from (select doc_id, {S.tok('text')} w from documents) group by all""")
def q_virtual_shards(spark, sf):
    """Virtual shard = doc_id mod 4, with rows and n-grams per shard."""
    f = feats(spark, sf)
    return f.groupBy(F.pmod("doc_id", F.lit(4)).cast("int").alias("shard")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("n_tokens") + F.greatest(F.col("n_tokens") - 1, F.lit(0))).cast("long").alias("n_grams"))


@query("dense_index", """
select doc_id, (row_number() over (order by source, doc_id) - 1)::BIGINT idx from documents""")
def q_dense_index(spark, sf):
    """Positional index in (source, doc_id) order without a one-task window."""
    return SEL.dense_index(docs(spark, sf).select("doc_id", "source"), ["source", "doc_id"], "idx") \
        .select("doc_id", "idx")


PARETO_CTE = f"""{WEIGHTS_A_CTE},
pp as (select doc_id, 1.0 / (1.0 + exp(-log_weight / 100.0)) prob from sc where length >= 100),
fr as (select doc_id, prob, case when pow(2.0 - prob, -9.0) >= 1.0 then 0
         else floor(ln({S.uniform(13, 'pareto', 'doc_id')}) / ln(1.0 - pow(2.0 - prob, -9.0))) end::BIGINT first_round
       from pp),
hist as (select first_round, sum(count(*)) over (order by first_round) cum from fr group by first_round),
r as (select min(first_round) + 1 rounds from hist where cum >= 100)"""


@query("pareto_select", f"""
with {PARETO_CTE}
select doc_id from fr where first_round < (select rounds from r)
order by {S.order_key(13, 'pareto-shuffle', 'doc_id')} desc, doc_id limit 100""")
def q_pareto(spark, sf):
    """Pareto(9) threshold sampling of 100 documents, prob = sigmoid(log_weight / 100), seed 13 (K5)."""
    w = weights_a(spark, sf).withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("log_weight") / F.lit(100.0))))
    return SEL.pareto_select(w, 100, "prob", seed=13).select("doc_id")


@query("selected_sink_roundtrip", f"""
with {TOP100}
select doc_id, source, text from documents where doc_id in (select doc_id from top)""")
def q_sink_roundtrip(spark, sf):
    """Chosen rows written as JSON lines (S8, S10) and read back with an explicit schema."""
    import os
    import uuid
    from pyspark.sql import types as T
    from ..session import checkpoint_dir
    from ..sources.io import read_jsonl, write_selected
    out = os.path.join(checkpoint_dir(spark), f"selected_{uuid.uuid4().hex}")
    write_selected(docs(spark, sf).select("doc_id", "source", "text"), top100(spark, sf), out)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()),
                           T.StructField("text", T.StringType())])
    return read_jsonl(spark, os.path.join(out, "*.json"), schema)
