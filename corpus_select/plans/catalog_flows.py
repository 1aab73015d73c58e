"""Registered queries of the end-to-end flows, and round trips of their stored parts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flows
from . import sqlsnippets as S
from .catalog import WEIGHTS_A_CTE, docs, feats, query, target_a_ids
from .catalog_embed import HYB_CTE, X_SQL, emb, mixture_sql, mixtures
from .catalog_model import SIG_CTE, probs
from .catalog_prep import STATS_SQL, chunk_stats
from ..functions import stats as ST
from ..operators import embedding as EM
from ..operators import ngram_model as NG
from ..operators import quality as QU
from ..operators import select as SEL
from ..operators.features import ngram_features
from ..session import checkpoint_dir
from ..operators import results as RS
from ..operators.mlm import pick_text_column
from ..sources.io import materialize, read_by_extension, read_jsonl, read_table, read_trials, write_indices, write_tsv
from ..sources.npy import read_npy, write_npy
from ..sources.shards import read_shards, write_shards
from ..sources.staged import write_files


def scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}_{uuid.uuid4().hex[:12]}")


# -- hybrid selection (n-gram and mixture weights blended) ----------------------

HYBRID_SQL = f"""{HYB_CTE},
hy as (select doc_id, round((0.5 * (ng + 1e-8) + 0.5 * (gmm_weight + 1e-8)) * 1e10)::BIGINT h from ng join gw using (doc_id))"""


def hybrid(spark, sf, **options):
    """Raw pool: the documents that have an embedding; mixtures from the embeddings' labels."""
    e = emb(spark, sf).select("doc_id", "embedding")
    return flows.hybrid_selection(docs(spark, sf), None, e, e, target_ids=target_a_ids(spark, sf), mixtures=mixtures(spark, sf),
                                  require_all=False, min_example_length=100, **options).chosen


@query("hybrid_topk", f"""
with {HYBRID_SQL}
select doc_id, round(h / 1e10, 6) hybrid_weight from hy order by h desc, doc_id limit 100""")
def q_hybrid_topk(spark, sf):
    """Hybrid flow, 100 documents by blended weight."""
    return hybrid(spark, sf, k=100, top_k=True).select("doc_id", F.round(F.col("weight_e10") / 1e10, 6).alias("hybrid_weight"))


@query("hybrid_gumbel", f"""
with {HYBRID_SQL}
select doc_id from hy order by h + {S.gumbel_e10(7, 'gumbel', 'doc_id')} desc, doc_id limit 100""")
def q_hybrid_gumbel(spark, sf):
    """Hybrid flow, Gumbel sample of 100, seed 7."""
    return hybrid(spark, sf, k=100, seed=7).select("doc_id")


def em_sql(name: str, before: str) -> str:
    """One EM step from ``{before}_per`` and ``{before}_w`` to ``{name}_per`` and ``{name}_w``."""
    return f"""{name}_a as (select x.vec_id, p.component,
    ln(w.weight) - 0.5 * (count(*) * ln(2 * pi()) + sum(ln(p.var) + (x.v - p.mu) * (x.v - p.mu) / p.var)) a
  from x join {before}_per p on p.dim = x.i join {before}_w w on w.component = p.component group by x.vec_id, p.component, w.weight),
{name}_e as (select vec_id, component, exp(a - max(a) over (partition by vec_id)) e from {name}_a),
{name}_r as (select vec_id, component, e / sum(e) over (partition by vec_id) r from {name}_e),
{name}_per as (select r.component, x.i dim, sum(r.r * x.v) / sum(r.r) mu,
    greatest(sum(r.r * x.v * x.v) / sum(r.r) - pow(sum(r.r * x.v) / sum(r.r), 2), 0) + 1e-6 var
  from {name}_r r join x using (vec_id) group by r.component, x.i),
{name}_w as (select component, sum(r) / (select count(*) from embeddings) weight from {name}_r group by component)"""


@query("em_two_steps", f"""
with {X_SQL}, {mixture_sql('raw')}, {em_sql('one', 'raw')}, {em_sql('two', 'one')}
select component, dim::INT dim, round(weight, 6) weight, round(mu, 6) mean, round(var, 6) var from two_per join two_w using (component)""")
def q_em_two_steps(spark, sf):
    """Two EM steps over all rows from the labels' mixture, ten components."""
    e = emb(spark, sf)
    m = EM.fit_gmm(e, init=EM.Mixture.from_df(EM.fit_by_label(e)), max_iter=2, tol=0.0)
    rows = m.to_df(spark).select("component", "weight", F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "z"))
    return rows.select("component", "dim", F.round("weight", 6).alias("weight"), F.round("z.mean", 6).alias("mean"), F.round("z.var", 6).alias("var"))


def stepwise_sql(name: str, before: str, chunk: str, share: float, blend: str | None) -> str:
    """One chunk of stepwise EM from ``{before}_per``, ``{before}_w`` and the blended sums of ``blend``."""
    old = f"left join {blend}_s o on o.component = c.component and o.dim = c.dim" if blend else ""
    mix = (lambda c: f"{1 - share!r} * o.{c} + {share!r} * c.{c}") if blend else (lambda c: f"c.{c}")
    return f"""{name}_x as (select * from x where {chunk}),
{name}_a as (select x.vec_id, p.component,
    ln(w.weight) - 0.5 * (count(*) * ln(2 * pi()) + sum(ln(p.var) + (x.v - p.mu) * (x.v - p.mu) / p.var)) a
  from {name}_x x join {before}_per p on p.dim = x.i join {before}_w w on w.component = p.component group by x.vec_id, p.component, w.weight),
{name}_e as (select vec_id, component, exp(a - max(a) over (partition by vec_id)) e from {name}_a),
{name}_r as (select vec_id, component, e / sum(e) over (partition by vec_id) r from {name}_e),
{name}_c as (select r.component, x.i dim, sum(r.r) / (select count(distinct vec_id) from {name}_x) n, sum(r.r * x.v) / (select count(distinct vec_id) from {name}_x) s1,
    sum(r.r * x.v * x.v) / (select count(distinct vec_id) from {name}_x) s2 from {name}_r r join {name}_x x using (vec_id) group by r.component, x.i),
{name}_s as (select c.component, c.dim, {mix("n")} n, {mix("s1")} s1, {mix("s2")} s2 from {name}_c c {old}),
{name}_per as (select component, dim, s1 / n mu, greatest(s2 / n - (s1 / n) * (s1 / n), 0) + 1e-6 var from {name}_s),
{name}_w as (select component, max(n) weight from {name}_s group by component)"""


@query("em_two_chunks", f"""
with {X_SQL}, {mixture_sql('raw')}, {stepwise_sql('one', 'raw', 'vec_id % 2 = 0', 1.0, None)}, {stepwise_sql('two', 'one', 'vec_id % 2 = 1', 2.0 ** -0.7, 'one')}
select component, dim::INT dim, round(weight, 6) weight, round(mu, 6) mean, round(var, 6) var from two_per join two_w using (component)""")
def q_em_two_chunks(spark, sf):
    """Stepwise EM over two chunks of ids, stopped after the first and resumed from its stored state."""
    e = emb(spark, sf)
    first, at = EM.Mixture.from_df(EM.fit_by_label(e)), scratch(spark, "em")
    EM.fit_gmm_stepwise(e, init=first, chunks=2, state_dir=at, stop_after=1)
    m = EM.fit_gmm_stepwise(e, init=first, chunks=2, state_dir=at)
    rows = m.to_df(spark).select("component", "weight", F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "z"))
    return rows.select("component", "dim", F.round("weight", 6).alias("weight"), F.round("z.mean", 6).alias("mean"), F.round("z.var", 6).alias("var"))


# -- classifier retrieval and corpus filters ------------------------------------

@query("classifier_flow_retrieve", f"""
with {SIG_CTE},
dt as (select doc_id, {ST.treebank_sql("text")} t from documents where source not in ('src3', 'src4') or source is null),
st as (select doc_id, len(t)::BIGINT length,
  case when len(t) = 0 then 0.0 else len(list_filter(t, lambda x: x = list_aggregate(t, 'mode'))) / len(t) end repeating_ratio,
  case when len(t) = 0 then 0.0 else len(list_filter(t, lambda x: not list_contains({ST.sql_list(ST.UNINFORMATIVE)}, x))) / len(t) end informative_ratio,
  case when len(t) = 0 then 0.0 else len(list_filter(t, lambda x: not list_contains({ST.sql_list(ST.DIGITS)}, x))) / len(t) end numeric_ratio from dt),
top as (select doc_id, prob from pr where doc_id in (select doc_id from st where {ST.quality_mask_sql()}) order by prob desc, doc_id limit 100),
up as ((select doc_id from documents where source = 'src3' order by {S.order_key(0, 'topup:src3', 'doc_id')} desc, doc_id limit 20)
  union all (select doc_id from documents where source = 'src4' order by {S.order_key(0, 'topup:src4', 'doc_id')} desc, doc_id limit 10))
select doc_id, round(prob, 6) score from top union all select doc_id, null from up""")
def q_classifier_retrieve(spark, sf):
    """Retrieval of the classifier flow on given probabilities: exclusion, quality mask, top 100, top-up, score."""
    pool = docs(spark, sf).select("doc_id", "text", F.col("source").alias("domain"))
    rows = flows.classifier_retrieval(pool, SEL._stored(probs(spark, sf)), 100, mode="topk", quality_filter=True,
                                      exclude_domains=["src3", "src4"], topup={"src3": 20, "src4": 10})
    return rows.select("doc_id", F.round("score", 6).alias("score"))


@query("chunk_filters", f"""
with {STATS_SQL}
select st.doc_id, chunk_no from st join documents d using (doc_id) where {ST.quality_mask_sql()} and (d.source not in ('src1', 'src2') or d.source is null)""")
def q_chunk_filters(spark, sf):
    """Chunks that pass the quality mask and the domain exclusion together (U4)."""
    good = QU.apply_quality_mask(chunk_stats(spark, sf)).select("doc_id", "chunk_no")
    return SEL.domain_exclude(good.join(docs(spark, sf).select("doc_id", "source"), "doc_id"), ["src1", "src2"], "source").select("doc_id", "chunk_no")


# -- stored parts, read back ------------------------------------------------------

@query("model_roundtrip", f"""
with {WEIGHTS_A_CTE}
select doc_id, log_weight from sc where length >= 100""")
def q_model_roundtrip(spark, sf):
    """A saved and reloaded model scores as the fitted one does."""
    path = scratch(spark, "model")
    f = SEL._stored(feats(spark, sf))
    NG.fit_subset_targets(f, {"target": target_a_ids(spark, sf)}).save(path)
    return NG.log_weights(f, NG.NgramModel.load(spark, path), min_example_length=100).select("doc_id", "log_weight")


@query("index_roundtrip", f"""
with {WEIGHTS_A_CTE}
select doc_id from sc where length >= 100 order by weight_e10 desc, doc_id limit 100""")
def q_index_roundtrip(spark, sf):
    """Selected ids written and read back."""
    path = scratch(spark, "indices")
    f = SEL._stored(feats(spark, sf))
    write_indices(SEL.top_k(NG.log_weights(f, model_a_of(spark, sf, f)), 100), path)
    return spark.read.parquet(path)


def model_a_of(spark, sf, f):
    return NG.fit_subset_targets(f, {"target": target_a_ids(spark, sf)})


@query("xxhash_ngram_totals", f"""
with {S.features_cte()}
select w.doc_id, len({S.grams('w', 2)})::BIGINT n_grams from w""")
def q_xxhash_totals(spark, sf):
    """n-grams per document from the xxhash features: the sum does not depend on the hash."""
    f = ngram_features(docs(spark, sf), n=2, hash_fn="xxh64")
    return f.select("doc_id", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("n_grams"))


@query("fit_pooled_budgeted", f"""
with {S.features_cte()},
tot as (select doc_id, sum(cnt) g from f group by doc_id),
run as (select w.doc_id, coalesce(sum(coalesce(g, 0)) over (order by w.doc_id rows between unbounded preceding and 1 preceding), 0) before
        from w left join tot using (doc_id)),
rawc as (select bucket, sum(cnt)::BIGINT cnt from f where doc_id in (select doc_id from run where before <= 50000) group by bucket),
tgtc as (select bucket, sum(cnt)::BIGINT cnt from (
           select bucket, cnt from f where doc_id in (select doc_id from labels where quality = 1)
           union all select bucket, cnt from f where doc_id in (select doc_id from documents where source = 'src1')) group by bucket),
rd as {S.dense('rawc', 'raw')}, td as {S.dense('tgtc', 'target')}
select 'target' target, bucket, raw_cnt, target_cnt from rd join td using (bucket)""")
def q_fit_pooled_budgeted(spark, sf):
    """Two overlapping targets pooled, raw fit cut at 50,000 n-grams: a shared document counts twice (A2, A4, A5)."""
    ids = {"a": target_a_ids(spark, sf), "b": read_table(spark, sf, "documents").where("source = 'src1'").select("doc_id")}
    m = NG.fit_subset_targets(SEL._stored(feats(spark, sf)), ids, num_tokens_to_fit=50_000)
    return m.table.select("target", "bucket", "raw_cnt", "target_cnt")


@query("json_readback", """
select doc_id, text, source from documents""")
def q_json_readback(spark, sf):
    """Documents written as compressed JSON lines and read by suffix."""
    path = scratch(spark, "documents") + ".json"
    docs(spark, sf).select("doc_id", "text", "source").write.option("compression", "gzip").json(path)
    return read_by_extension(spark, path).select("doc_id", "text", "source")


@query("nested_domain", """
select doc_id, source as domain from documents where source in ('src1', 'src2')""")
def q_nested_domain(spark, sf):
    """Filter and projection on a field of a struct."""
    nested = docs(spark, sf).select("doc_id", F.struct(F.col("source").alias("pile_set_name")).alias("metadata"))
    return nested.where(F.col("metadata.pile_set_name").isin("src1", "src2")).select("doc_id", F.col("metadata.pile_set_name").alias("domain"))


@query("k_above_pool", f"""
with {WEIGHTS_A_CTE}
select doc_id from sc where length >= 100""")
def q_k_above_pool(spark, sf):
    """k beyond the pool keeps the whole pool, by the bracket path too (K8)."""
    f = SEL._stored(feats(spark, sf))
    return SEL.top_k(NG.log_weights(f, model_a_of(spark, sf, f)), 10_000_000, small_k=10).select("doc_id")


@query("bracket_topk", f"""
with {WEIGHTS_A_CTE}
select doc_id from sc where length >= 100 order by weight_e10 desc, doc_id limit 300""")
def q_bracket_topk(spark, sf):
    """Exact top 300 by the bracket path for large k (K1)."""
    f = SEL._stored(feats(spark, sf))
    return SEL.top_k(SEL._stored(NG.log_weights(f, model_a_of(spark, sf, f))), 300, small_k=10).select("doc_id")


@query("trial_rollup", """
with t as (select source task_name, (doc_id % 3)::INT epochs, round((n_chars % 997) / 1000.0 * 100, 2) dev from documents where n_chars is not null)
select task_name, epochs, round(quantile_cont(dev, 0.5), 1) median from t group by all""")
def q_trial_rollup(spark, sf):
    """Roll-up of a metric by setting: median per (task, epochs) (A10)."""
    t = docs(spark, sf).where("n_chars is not null").select(F.col("source").alias("task_name"), (F.col("doc_id") % 3).cast("int").alias("epochs"), ((F.col("n_chars") % 997) / 1000.0).alias("dev"))
    return RS.rollup(t, ("task_name", "epochs")).select("task_name", "epochs", F.round("median", 1).alias("median"))


@query("best_setting", """
with t as (select source task_name, (doc_id % 3)::INT epochs, round((n_chars % 997) / 1000.0 * 100, 2) dev from documents where n_chars is not null),
r as (select task_name, epochs, round(quantile_cont(dev, 0.5), 2) median from t group by all)
select task_name, epochs from r where median = (select max(median) from r q where q.task_name = r.task_name)""")
def q_best_setting(spark, sf):
    """Settings with the best median of their task."""
    t = docs(spark, sf).where("n_chars is not null").select(F.col("source").alias("task_name"), (F.col("doc_id") % 3).cast("int").alias("epochs"), ((F.col("n_chars") % 997) / 1000.0).alias("dev"))
    return RS.best_median(RS.rollup(t, ("task_name", "epochs")), ("task_name",)).select("task_name", "epochs")


@query("predictions_file", f"""
with {SIG_CTE}
select pr.doc_id "index", (pr.prob >= 0.5)::INT::VARCHAR prediction from pr""")
def q_predictions_file(spark, sf):
    """Predictions written as a tab-separated file and read back, labels dropped before."""
    path = scratch(spark, "predictions")
    p = RS.drop_label(probs(spark, sf).withColumn("label", F.lit(1))).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    write_tsv(RS.format_predictions(p, "doc_id", "pred", regression=False), path)
    return spark.read.option("sep", "\t").option("header", True).schema("index long, prediction string").csv(path)


@query("stored_features", f"""
with {S.features_cte()}
select doc_id, count(*)::BIGINT n_buckets from f group by doc_id""")
def q_stored_features(spark, sf):
    """Features stored once and reused by a second call, which reads the stored files."""
    path = scratch(spark, "features")
    materialize(feats(spark, sf), path)
    again = materialize(feats(spark, sf).limit(0), path)
    return again.where(F.size("buckets") > 0).select("doc_id", F.size("buckets").cast("long").alias("n_buckets"))


# -- chunk files and shard files ---------------------------------------------------

@query("npy_roundtrip", """
with n as (select row_number() over (order by vec_id) - 1 "row", embedding from embeddings)
select "row", len(embedding)::INT dim, round(embedding[1]::DOUBLE, 6) first_value, round(embedding[-1]::DOUBLE, 6) last_value from n""")
def q_npy_roundtrip(spark, sf):
    """Embeddings written as .npy chunks in id order and read back by ranges of 50 rows, which split the files."""
    at = scratch(spark, "npy")
    write_npy(read_table(spark, sf, "embeddings", "vec_id"), at, "vec_id", files=4)
    e = F.col("embedding")
    return read_npy(spark, at, rows=50).select("row", F.size(e).alias("dim"), F.round(F.get(e, 0).cast("double"), 6).alias("first_value"),
                                               F.round(F.element_at(e, -1).cast("double"), 6).alias("last_value"))


@query("shard_files", """
select doc_id, (doc_id % 4)::INT shard, sha256(text) text_sha256 from documents where text is not null""")
def q_shard_files(spark, sf):
    """Documents as JSON lines in one file per virtual shard, read back with the shard from the file's name."""
    at = scratch(spark, "shards")
    lines = docs(spark, sf).where("text is not null").select("doc_id", F.to_json(F.struct("text", "doc_id")).alias("value"))
    write_shards(lines, at, F.pmod("doc_id", F.lit(4)), ["doc_id"], 4)
    parsed = read_shards(spark, at).select("shard", F.from_json("value", "text string, doc_id long").alias("d"))
    return parsed.select("d.doc_id", "shard", F.sha2("d.text", 256).alias("text_sha256"))


@query("zst_readback", """
select doc_id, text, source from documents""")
def q_zst_readback(spark, sf):
    """Documents written as .zst JSON lines and read back with a schema."""
    import pyarrow as pa

    path = scratch(spark, "zst")

    def packed(batches):
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            lines = "".join(x + "\n" for x in b.column(0).to_pylist()).encode()
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{k:05d}.jsonl.zst"]), pa.array([zstandard.ZstdCompressor().compress(lines)], pa.binary())], names=["name", "content"])
    lines = docs(spark, sf).select(F.to_json(F.struct("doc_id", "text", "source")).alias("line"))
    write_files(lines.mapInArrow(packed, "name string, content binary"), path)
    return read_jsonl(spark, f"{path}/*.zst", T.StructType.fromDDL("doc_id long, text string, source string"))


TASKS = ["COLA", "MNLI", "MRPC", "QNLI", "QQP", "RTE", "SST2", "STSB"]


@query("trial_files", f"""
with g as (select doc_id % 8 t, doc_id % 5 s, round(avg(n_chars % 997) / 1000, 4) v from documents where n_chars is not null group by all)
select ['{"', '".join(TASKS)}'][t + 1] task_name, (3 + s % 2)::INT epochs, 16 bs, 1e-5::DOUBLE lr, s::INT seed,
  case when t = 0 then v when t = 7 then round(v / 2, 4) else 1 - v end dev from g""")
def q_trial_files(spark, sf):
    """One run directory with its eval_results.json per task and seed, written, listed, parsed."""
    at = scratch(spark, "trials")
    d = docs(spark, sf).where("n_chars is not null").groupBy((F.col("doc_id") % 8).alias("t"), (F.col("doc_id") % 5).alias("s")).agg(F.round(F.avg(F.col("n_chars") % 997) / 1000, 4).alias("v"))
    name = F.format_string("%s_EPOCHS%d_BS16_LR1e-05_seed%d/eval_results.json", F.get(F.array(*map(F.lit, TASKS)), F.col("t").cast("int")), 3 + F.col("s") % 2, F.col("s"))
    keys = {key: 1 - F.col("v") for key in RS.TASK_METRIC.values()} | {RS.TASK_METRIC["COLA"]: F.col("v"), RS.TASK_METRIC["STSB"]: F.round(F.col("v") / 2, 4)}
    write_files(d.select(name.alias("name"), F.to_json(F.struct(*[v.alias(k) for k, v in keys.items()])).alias("content")), at)
    return RS.trial_table(read_trials(spark, at)).select("task_name", "epochs", "bs", "lr", "seed", "dev")


@query("task_columns", """
select 'mnli' task, 'validation_matched,validation_mismatched' splits, 'premise,hypothesis' columns, (select count(*) from documents where text is not null) n
union all select 'documents', 'validation', 'text,lang', (select count(*) from documents where text is not null)
union all select 'contents', 'validation', 'contents', (select count(*) from documents where text is not null)""")
def q_task_columns(spark, sf):
    """Which splits and text columns a task or a table takes, with the rows that have that text."""
    d = docs(spark, sf)
    n = d.where(F.col("text").isNotNull())
    tables = {"documents": d.select("text", "lang"), "contents": d.select(F.col("lang"), F.col("text").alias("contents"))}
    rows = [n.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("mnli").alias("task"), F.lit(",".join(RS.eval_splits("mnli"))).alias("splits"),
                                                                 F.lit(",".join(RS.text_pair_columns([], "mnli"))).alias("columns"), "n")]
    for name, table in tables.items():
        column = pick_text_column(table)
        shown = ",".join(RS.text_pair_columns(table.columns)) if name == "documents" else column
        rows.append(table.where(F.col(column).isNotNull()).groupBy().agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("task"), F.lit(",".join(RS.eval_splits(name))).alias("splits"), F.lit(shown).alias("columns"), "n"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
