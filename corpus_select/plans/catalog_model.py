"""Registered classifier, MLM-preparation and evaluation queries
(T16-T18, T21-T23, J5, U5, W5, A8, A9, E8-E10, K6, P11, P12, P14, S15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sqlsnippets as S
from .catalog import WEIGHTS_A_CTE, docs, query, two_target_weights, weights_a
from .catalog_select import MULTI_W
from ..functions import stats as ST
from ..functions.text import WHITESPACE_CLASS
from ..operators import classifier as CL
from ..operators import mlm as ML
from ..operators import results as RS
from ..operators import vector_classifier as VC
from ..operators import wordpiece as WP
from ..sources.io import read_table


def labelled(spark, sf):
    lab = read_table(spark, sf, "labels")
    return docs(spark, sf).join(lab, "doc_id")


@query("classifier_lines", f"""
select d.doc_id, '__label__' || l.quality || ' , ' || array_to_string({ST.treebank_sql('d.text')}, ' ') line
from documents d join labels l using (doc_id)""")
def q_classifier_lines(spark, sf):
    """fastText-style training lines for every labelled document."""
    d = labelled(spark, sf)
    return d.select("doc_id", CL.classifier_line(F.col("quality"), F.col("text")).alias("line"))


LINES_SQL = f"""lines as (select d.doc_id, l.toxic, '__label__' || l.quality || ' , ' || array_to_string({ST.treebank_sql('d.text')}, ' ') line
  from documents d join labels l using (doc_id))"""


@query("relabel_lines", f"""
with {LINES_SQL}
select doc_id, '__label__' || toxic || ' , ' ||
  array_to_string(list_filter(regexp_split_to_array(line, '{WHITESPACE_CLASS}+'), lambda x: x <> '')[3:], ' ') line
from lines""")
def q_relabel(spark, sf):
    """Swap every line's label for the toxicity label, text kept."""
    d = labelled(spark, sf)
    lines = d.select("doc_id", "toxic", CL.classifier_line(F.col("quality"), F.col("text")).alias("line"))
    return lines.select("doc_id", CL.relabel(F.col("line"), F.col("toxic")).alias("line"))


@query("ordered_split", f"""
select doc_id, case when row_number() over (order by doc_id) - 1 < floor(0.9 * (select count(*) from labels))
  then 'train' else 'val' end split
from labels""")
def q_ordered_split(spark, sf):
    """First 90% of the labelled lines in id order train, the rest validation."""
    lab = read_table(spark, sf, "labels").select("doc_id")
    return CL.ordered_split(lab, ["doc_id"]).select("doc_id", "split")


@query("zip_label_mix", f"""
with p as (select row_number() over (order by item_id) - 1 pair,
             '__label__0 , ' || array_to_string({ST.treebank_sql('text')}, ' ') line from benchmark),
q as (select row_number() over (order by doc_id) - 1 pair,
             '__label__0 , ' || array_to_string({ST.treebank_sql('text')}, ' ') line from documents),
n as (select least((select count(*) from benchmark), (select count(*) from documents)) n),
j as (select p.pair, p.line pl, q.line ql from p join q using (pair) where p.pair < (select n from n))
select case when pair < floor(0.9 * (select n from n)) then 'train' else 'val' end split, pair::BIGINT pair,
       1 label, '__label__1 , ' || array_to_string(list_filter(regexp_split_to_array(pl, '{WHITESPACE_CLASS}+'), lambda x: x <> '')[3:], ' ') line from j
union all
select case when pair < floor(0.9 * (select n from n)) then 'train' else 'val' end split, pair::BIGINT pair,
       0 label, '__label__0 , ' || array_to_string(list_filter(regexp_split_to_array(ql, '{WHITESPACE_CLASS}+'), lambda x: x <> '')[3:], ' ') line from j""")
def q_zip_mix(spark, sf):
    """Benchmark lines (label 1) zipped with raw lines (label 0) by position, 90/10 split."""
    b = read_table(spark, sf, "benchmark").select(
        "item_id", CL.classifier_line(F.lit(0), F.col("text")).alias("line"))
    d = docs(spark, sf).select("doc_id", CL.classifier_line(F.lit(0), F.col("text")).alias("line"))
    return CL.zip_mix(b, d, ["item_id"], ["doc_id"])


SIG_CTE = f"""{WEIGHTS_A_CTE},
pr as (select doc_id, 1.0 / (1.0 + exp(-log_weight / 100.0)) prob from sc)"""


def probs(spark, sf):
    w = weights_a(spark, sf, None)
    return w.select("doc_id", "log_weight",
                    (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("log_weight") / F.lit(100.0)))).alias("prob"))


@query("binary_metrics", f"""
with {WEIGHTS_A_CTE},
x as (select (s.log_weight > 0)::INT p, l.quality y from sc s join labels l using (doc_id)),
c as (select sum((p = 1 and y = 1)::INT)::BIGINT tp, sum((p = 1 and y = 0)::INT)::BIGINT fp,
             sum((p = 0 and y = 1)::INT)::BIGINT fn, sum((p = 0 and y = 0)::INT)::BIGINT tn from x),
m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end prec,
             case when tp + fn > 0 then tp / (tp + fn) else 0.0 end rec from c)
select tp, fp, fn, tn, round(prec, 6) "precision", round(rec, 6) recall,
       round(case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0.0 end, 6) f1,
       round((tp + tn) / (tp + fp + fn + tn), 6) accuracy from m""")
def q_binary_metrics(spark, sf):
    """Precision / recall / F1 of 'log weight > 0' against the quality label."""
    w = weights_a(spark, sf, None)
    x = w.join(read_table(spark, sf, "labels"), "doc_id").select(
        (F.col("log_weight") > 0).cast("int").alias("pred"), F.col("quality").alias("label"))
    m = CL.binary_metrics(x, "pred", "label")
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("prob_flip", f"""
with {SIG_CTE}
select doc_id, round(case when (case when prob >= 0.5 then 1 else 0 end) = 0
       then 1.0 - greatest(prob, 1.0 - prob) else greatest(prob, 1.0 - prob) end, 6) prob from pr""")
def q_prob_flip(spark, sf):
    """Positive-class probability from a (top label, top probability) pair."""
    p = probs(spark, sf)
    top_label = F.when(F.col("prob") >= 0.5, F.lit(1)).otherwise(F.lit(0))
    top_p = F.greatest(F.col("prob"), F.lit(1.0) - F.col("prob"))
    return p.select("doc_id", F.round(CL.positive_prob(top_label, top_p), 6).alias("prob"))


@query("topk_prob", f"""
with {SIG_CTE}
select doc_id, round(prob, 6) prob from pr order by prob desc, doc_id limit 100""")
def q_topk_prob(spark, sf):
    """Top 100 by probability (K6) through the retrieval switch (E10, mode topk)."""
    return CL.retrieve(probs(spark, sf), 100, mode="topk").select("doc_id", F.round("prob", 6).alias("prob"))


@query("classifier_predict")
def q_classifier_predict(spark, sf):
    """Train the hashed n-gram logistic classifier on the 90% split of labelled docs (quality),
    tune on the 10%, predict every document (E8, E9); float fit -> rows-only check."""
    lab = labelled(spark, sf)
    sp = CL.ordered_split(lab.select("doc_id", "text", F.col("quality").alias("label")), ["doc_id"])
    model = CL.train_classifier(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "val"),
                                num_features=1 << 16, reg_params=(0.01, 0.1), max_iter=20)
    return CL.predict_proba(model, docs(spark, sf))


@query("classifier_retrieve")
def q_classifier_retrieve(spark, sf):
    """Pareto retrieval of 100 documents from classifier probabilities (E10, K5); rows-only.

    Retrieval reads the probabilities several times, so they are checkpointed once.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    probs = q_classifier_predict(spark, sf).checkpoint()
    return CL.retrieve(probs, 100, mode="pareto", seed=1)


@query("classifier_metrics_per_task", f"""
with {SIG_CTE},
x as (select (pr.prob >= 0.5)::DOUBLE p, l.quality::DOUBLE y, pr.prob s from pr join labels l using (doc_id)),
r as (select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 rank_s,
             rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 rank_y from x)
select 'stsb' task, round(corr(s, y), 6) first_metric, round(corr(rank_s, rank_y), 6) second_metric, round((corr(s, y) + corr(rank_s, rank_y)) / 2, 6) combined_score from r
union all select 'sst2', round(avg((p = y)::DOUBLE), 6), null, round(avg((p = y)::DOUBLE), 6) from x""")
def q_metrics_per_task(spark, sf):
    """Each task's own metrics and their mean (A9): a similarity task and an accuracy task over the same predictions."""
    x = probs(spark, sf).join(read_table(spark, sf, "labels"), "doc_id").select(
        (F.col("prob") >= 0.5).cast("double").alias("pred"), F.col("quality").alias("y"), "prob")
    out = RS.task_metrics(x, "stsb", "pred", "y", "prob").unionByName(RS.task_metrics(x, "sst2", "pred", "y", "prob"))
    return out.select("task", *[F.round(c, 6).alias(c) for c in ("first_metric", "second_metric", "combined_score")])


# -- learned vectors ------------------------------------------------------------------

def _vector_step_sql(buckets: int, dim: int, rate: float) -> str:
    out = [f"({S.start_number(f'{buckets * dim + 1 + j}')} / sqrt({dim}.0))" for j in range(dim)]
    s = " + ".join(f"v{j} * {out[j]}" for j in range(dim))
    moved = ", ".join(f"round(v{j} - {rate} * gb / (sqrt(gb * gb) + 1e-8) * {out[j]}, 7) v{j}" for j in range(dim))
    return f"""
with {S.features_cte(n=2, num_buckets=buckets)},
lf as (select f.doc_id, bucket, cnt, quality y from f join labels l on l.doc_id = f.doc_id where quality is not null),
v as (select i bucket, {", ".join(f"{S.start_number(f'i * {dim} + {j} + 1')} / {dim}.0 v{j}" for j in range(dim))} from range(0, {buckets}) x(i)),
s as (select bucket, {s} s from v),
z as (select doc_id, max(y) y, sum(cnt * s) / sum(cnt) z, sum(cnt) n from lf join s using (bucket) group by doc_id),
e as (select doc_id, n, 1.0 / (1.0 + exp(-z)) - y err from z),
gr as (select bucket, sum(cnt / n * err) / (select count(*) from e) gb from lf join e using (doc_id) group by bucket),
j as (select v.*, coalesce(gb, 0.0) gb from v left join gr using (bucket))
select bucket::INT bucket, round(gb, 9) grad, {moved} from j"""


STEP = {"buckets": 512, "dim": 4, "rate": 0.5}


@query("vector_classifier_step", _vector_step_sql(**STEP))
def q_vector_step(spark, sf):
    """One full step of the learned-vector classifier over all labelled documents: gradients and moved vectors."""
    model = VC.VectorModel.start(STEP["buckets"], STEP["dim"], ngrams=2, tokenizer="wordpunct", hash_fn="sha256")
    lab = labelled(spark, sf).where("quality is not null")
    rows = VC.featurize(lab, model).where(F.size("buckets") > 0).join(lab.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    g, g_bias, _, _ = VC.gradient(rows, model)
    moved = model.updated(g, g_bias, STEP["rate"])
    table = [(i, float(g[i]), *map(float, v)) for i, v in enumerate(moved.vectors)]
    made = spark.createDataFrame(table, "bucket int, grad double, " + ", ".join(f"v{j} double" for j in range(STEP["dim"])))
    return made.select("bucket", F.round("grad", 9).alias("grad"), *[F.round(f"v{j}", 7).alias(f"v{j}") for j in range(STEP["dim"])])


@query("vector_classifier_predict")
def q_vector_predict(spark, sf):
    """Learned word and bigram vectors: fitted on the 90% split of labelled documents, tuned on the 10%, every
    document scored (E8, E9); float fit -> rows-only check."""
    sp = CL.ordered_split(labelled(spark, sf).select("doc_id", "text", F.col("quality").alias("label")), ["doc_id"])
    first = VC.VectorModel.start(1 << 16, 32)
    model = VC.train_vectors(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "val"), first, epochs=4, batches=4)
    return VC.predict_vectors(model, docs(spark, sf))


# -- MLM data preparation ---------------------------------------------------------

VOCAB_SQL = f"""tk as (select doc_id, {S.tok('text')} w from documents
        where text is not null and regexp_replace(text, '{WHITESPACE_CLASS}', '', 'g') <> ''),
vc as (select token, count(*) freq from (select unnest(w) token from tk) group by token),
vocab as (select token, (row_number() over (order by freq desc, token) - 1 + 5)::INT id from vc),
vk as (select * from vocab where id < 5005),
ex as (select doc_id, unnest(w[1:62]) token, unnest(range(1, len(w[1:62]) + 1)) pos from tk),
ids as (select ex.doc_id, list(coalesce(v.id, 1) order by pos) ids from ex left join vk v using (token) group by ex.doc_id),
enc as (select tk.doc_id, coalesce(ids.ids, []::INT[]) ids from tk left join ids using (doc_id)),
pad as (select doc_id, list_resize([2] || ids || [3], 64, 0) input_ids,
               list_resize(list_transform(range(len(ids) + 2), lambda i: 1), 64, 0) attention_mask,
               list_resize([1] || list_transform(ids, lambda i: 0) || [1], 64, 1) special_tokens_mask from enc)"""


def encoded(spark, sf):
    d = docs(spark, sf)
    vocab = ML.build_vocab(d, max_size=5000)
    return ML.encode(d, vocab, max_length=64)


def _join_ints(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("tokenize_pad", f"""
with {VOCAB_SQL}
select doc_id, array_to_string(input_ids, ',') input_ids, array_to_string(attention_mask, ',') attention_mask,
       array_to_string(special_tokens_mask, ',') special_tokens_mask from pad""")
def q_tokenize_pad(spark, sf):
    """Word-level vocabulary (5,000 most frequent), ids truncated and padded to 64."""
    e = encoded(spark, sf)
    return e.select("doc_id", *[_join_ints(F.col(c)).alias(c) for c in
                                ("input_ids", "attention_mask", "special_tokens_mask")])


@query("tokenize_pad_pair", f"""
with {VOCAB_SQL},
pr as (select tk.doc_id, w a, {S.tok("coalesce(d.source, '') || ' ' || d.text")} b from tk join documents d using (doc_id)),
ln as (select doc_id, a, b, case when len(a) + len(b) <= 61 then len(a) when len(a) <= 31 then len(a)
         when len(b) <= 30 then 61 - len(b) else 31 end ka from pr),
ct as (select doc_id, a[1:ka] a, b[1:61 - ka] b from ln),
pa as (select doc_id, list(coalesce(v.id, 1) order by pos) ids from (select doc_id, unnest(a) token, unnest(range(1, len(a) + 1)) pos from ct)
       left join vk v using (token) group by doc_id),
pb as (select doc_id, list(coalesce(v.id, 1) order by pos) ids from (select doc_id, unnest(b) token, unnest(range(1, len(b) + 1)) pos from ct)
       left join vk v using (token) group by doc_id),
jn as (select ct.doc_id, coalesce(pa.ids, []::INT[]) x, coalesce(pb.ids, []::INT[]) y from ct left join pa using (doc_id) left join pb using (doc_id))
select doc_id, array_to_string(list_resize([2] || x || [3] || y || [3], 64, 0), ',') input_ids,
  array_to_string(list_resize(list_transform(range(len(x) + 2), lambda i: 0) || list_transform(range(len(y) + 1), lambda i: 1), 64, 0), ',') token_type_ids
from jn""")
def q_tokenize_pad_pair(spark, sf):
    """Pairs (text; source and the same text), truncated longest first to 64."""
    d = docs(spark, sf).withColumn("second", F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.col("text")))
    e = ML.encode(d, ML.build_vocab(d, max_size=5000), max_length=64, pair_col="second")
    return e.select("doc_id", *[_join_ints(F.col(c)).alias(c) for c in ("input_ids", "token_type_ids")])


def _mlm_sql(seed: int, vocab_size: int, encoded: str = VOCAB_SQL) -> str:
    h = f"sha256('{seed}:mlm:' || doc_id::VARCHAR || ':' || (i - 1)::VARCHAR)"

    def u(k):
        return f"((('0x' || substr(h, {13 * k + 1}, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"
    return f"""with {encoded},
z as (select doc_id, list_transform(range(1, len(input_ids) + 1),
        lambda i: {{'x': input_ids[i], 's': special_tokens_mask[i], 'h': {h}}}) info from pad)
select doc_id,
  array_to_string(list_transform(info, lambda e: case when not (e.s = 0 and {u(0).replace('h,', 'e.h,')} < 0.15) then e.x
      when {u(1).replace('h,', 'e.h,')} < 0.8 then 4
      when {u(2).replace('h,', 'e.h,')} < 0.5 then floor({u(3).replace('h,', 'e.h,')} * {vocab_size})::INT
      else e.x end), ',') input_ids,
  array_to_string(list_transform(info, lambda e: case when e.s = 0 and {u(0).replace('h,', 'e.h,')} < 0.15 then e.x
      else -100 end), ',') labels
from z"""


@query("mlm_mask", _mlm_sql(17, 5005))
def q_mlm_mask(spark, sf):
    """Seeded 15% masking with 80/10/10 replacement on the encoded documents, seed 17."""
    m = ML.mask_tokens(encoded(spark, sf), vocab_size=5005, seed=17)
    return m.select("doc_id", _join_ints(F.col("input_ids")).alias("input_ids"), _join_ints(F.col("labels")).alias("labels"))


# -- subword ids --------------------------------------------------------------------

def public_vocabulary() -> str:
    """The public byte-pair file that the registered queries take their pieces from."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _vocab_file() -> str:
    try:
        return public_vocabulary()
    except ImportError:  # the queries then fail when they are run, not when they are listed
        return "word_bpe_49k.json"


def _words_sql(text: str) -> str:
    t = f"regexp_replace(strip_accents(lower(regexp_replace({text}, '{WP.DROPPED}', '', 'g'))), '([{WP.MARK}{WP.IDEOGRAPH}])', ' \\1 ', 'g')"
    return f"list_filter(string_split(regexp_replace({t}, '{WP.SPACE}', ' ', 'g'), ' '), lambda x: x <> '')"


def wordpiece_sql(words: str, columns: tuple[str, ...] = ("text",)) -> str:
    """CTEs ``t`` (doc_id, word lists) and ``e0``, ``e1`` (doc_id, ids) by greedy longest match; ``words`` selects (doc_id, texts...)."""
    lists = ", ".join(f"{_words_sql(c)} w{k}" for k, c in enumerate(columns))
    union = " union all ".join(f"select unnest(w{k}) w from t" for k in range(len(columns)))
    encoded = ",\n".join(f"""x{k} as (select doc_id, unnest(w{k}) w, unnest(range(1, len(w{k}) + 1)) pos from t),
e{k} as (select doc_id, coalesce(flatten(list(p.ids order by pos)), []::INT[]) ids from t left join x{k} using (doc_id) left join pieces p using (w) group by doc_id)""" for k in range(len(columns)))
    return f"""recursive src as ({words}), t as (select doc_id, {lists} from src),
raw as (select unnest(map_entries(model.vocab)) e from read_json('{_vocab_file()}', columns = {{'model': 'STRUCT(vocab MAP(VARCHAR, INTEGER))'}}, maximum_object_size = 100000000)),
core as (select core, min(e.value) nr from (select e, regexp_replace(e.key, '</w>$', '') core from raw) where core <> '' and regexp_matches(core, '^[!-~]+$') group by core),
vocab as (select core piece, false more, (row_number() over (order by nr) + 4)::INT id from core
  union all select core, true, (row_number() over (order by nr) + 4 + (select count(*) from core))::INT from core),
word as (select distinct w from ({union})),
at1 as (select w, unnest(range(1, len(w) + 1)) p from word where len(w) <= {WP.MAX_WORD}),
cand as (select w, p, unnest(range(1, least(len(w) - p + 1, (select max(len(piece)) from vocab)) + 1)) l from at1),
best as (select c.w, c.p, max(c.l) l, arg_max(v.id, c.l) id from cand c join vocab v on v.piece = substr(c.w, c.p, c.l) and v.more = (c.p > 1) group by all),
walk as (select w, p, l, id from best where p = 1 union all select b.w, b.p, b.l, b.id from walk g join best b on b.w = g.w and b.p = g.p + g.l),
pieces as (select word.w, case when coalesce(sum(l), 0) = len(word.w) then list(id order by p) else [1] end ids from word left join walk using (w) group by word.w),
{encoded}"""


@query("wordpiece_ids", f"""
with {wordpiece_sql("select doc_id, coalesce(text, '') text from documents")}
select doc_id, len(ids)::INT n_pieces, len(list_filter(ids, lambda i: i = 1))::INT n_unknown, sha256(array_to_string(ids, ',')) ids_sha256 from e0""")
def q_wordpiece_ids(spark, sf):
    """Subword ids of every whole document by greedy longest match."""
    ids = WP.wordpiece_ids(docs(spark, sf), WP.vocab_table(spark, WP.pieces_of_bpe(public_vocabulary())))
    return ids.select("doc_id", F.size("ids0").alias("n_pieces"), F.size(F.filter("ids0", lambda i: i == ML.UNK)).alias("n_unknown"),
                      F.sha2(_join_ints(F.col("ids0")), 256).alias("ids_sha256"))


SUBWORD_PAD = f"""{wordpiece_sql("select doc_id, coalesce(text, '') text from documents")},
enc as (select doc_id, ids[1:62] ids from e0 where len(ids) > 0),
pad as (select doc_id, list_resize([2] || ids || [3], 64, 0) input_ids, list_resize(list_transform(range(len(ids) + 2), lambda i: 1), 64, 0) attention_mask,
               list_resize([1] || list_transform(ids, lambda i: 0) || [1], 64, 1) special_tokens_mask from enc)"""


def subword_encoded(spark, sf):
    return WP.wordpiece_encode(docs(spark, sf), WP.vocab_table(spark, WP.pieces_of_bpe(public_vocabulary())), max_length=64)


@query("wordpiece_pad", f"""
with {SUBWORD_PAD}
select doc_id, array_to_string(input_ids, ',') input_ids, array_to_string(attention_mask, ',') attention_mask,
       array_to_string(special_tokens_mask, ',') special_tokens_mask from pad""")
def q_wordpiece_pad(spark, sf):
    """Subword ids truncated and padded to 64."""
    return subword_encoded(spark, sf).select("doc_id", *[_join_ints(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "special_tokens_mask")])


@query("wordpiece_pad_pair", f"""
with {wordpiece_sql("select doc_id, coalesce(text, '') a, coalesce(source, '') || ' ' || coalesce(text, '') b from documents", ("a", "b"))},
ln as (select e0.doc_id, e0.ids a, e1.ids b, case when len(a) + len(b) <= 61 then len(a) when len(a) <= 31 then len(a)
         when len(b) <= 30 then 61 - len(b) else 31 end ka from e0 join e1 using (doc_id) where len(a) > 0),
ct as (select doc_id, a[1:ka] x, b[1:61 - ka] y from ln)
select doc_id, array_to_string(list_resize([2] || x || [3] || y || [3], 64, 0), ',') input_ids,
  array_to_string(list_resize(list_transform(range(len(x) + 2), lambda i: 0) || list_transform(range(len(y) + 1), lambda i: 1), 64, 0), ',') token_type_ids
from ct""")
def q_wordpiece_pad_pair(spark, sf):
    """Subword pairs (text; source and the same text), truncated longest first to 64."""
    d = docs(spark, sf).withColumn("second", F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    e = WP.wordpiece_encode(d, WP.vocab_table(spark, WP.pieces_of_bpe(public_vocabulary())), max_length=64, pair_col="second")
    return e.select("doc_id", *[_join_ints(F.col(c)).alias(c) for c in ("input_ids", "token_type_ids")])


@query("wordpiece_mlm_mask", _mlm_sql(19, 90000, SUBWORD_PAD))
def q_wordpiece_mlm_mask(spark, sf):
    """Seeded masking of subword ids, seed 19."""
    m = ML.mask_tokens(subword_encoded(spark, sf), vocab_size=90000, seed=19)
    return m.select("doc_id", _join_ints(F.col("input_ids")).alias("input_ids"), _join_ints(F.col("labels")).alias("labels"))


# -- evaluation helpers -------------------------------------------------------------

@query("label_list", """
select label, (row_number() over (order by label) - 1)::INT label_id
from (select distinct quality label from labels where quality is not null)""")
def q_label_list(spark, sf):
    """Distinct labels numbered in sorted order."""
    return RS.label_list(read_table(spark, sf, "labels"), "quality")


@query("label_id_map", """
with ll as (select label, (row_number() over (order by label) - 1)::INT label_id
            from (select distinct toxic label from labels where toxic is not null))
select l.doc_id, case when l.toxic = -1 then -1 else ll.label_id end::INT label_id
from labels l left join ll on l.toxic = ll.label""")
def q_label_id_map(spark, sf):
    """Toxicity label -> id through the label list, -1 kept."""
    lab = read_table(spark, sf, "labels")
    m = RS.map_labels(lab, RS.label_list(lab, "toxic"), "toxic")
    return m.select("doc_id", F.col("label_id").cast("int").alias("label_id"))


@query("argmax_class", f"""
with {MULTI_W},
pv as (select doc_id, max(case when target = 'a' then weight_e10 end) wa,
              max(case when target = 'b' then weight_e10 end) wb from lw group by doc_id)
select doc_id, (list_position([wa, wb], greatest(wa, wb)) - 1)::INT best_target from pv""")
def q_argmax(spark, sf):
    """Which of two targets each document is most like: argmax of its per-target weights."""
    lw = two_target_weights(spark, sf)
    pv = lw.groupBy("doc_id").agg(F.max(F.when(F.col("target") == "a", F.col("weight_e10"))).alias("wa"),
                                  F.max(F.when(F.col("target") == "b", F.col("weight_e10"))).alias("wb"))
    return pv.select("doc_id", RS.argmax(F.array("wa", "wb")).alias("best_target"))


@query("prediction_metrics", f"""
with {SIG_CTE},
x as (select (pr.prob >= 0.5)::DOUBLE p, l.quality::DOUBLE y, pr.prob s from pr join labels l using (doc_id)),
r as (select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 rank_s,
             rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 rank_y from x),
c as (select sum((p = 1 and y = 1)::DOUBLE) tp, sum((p = 0 and y = 0)::DOUBLE) tn,
             sum((p = 1 and y = 0)::DOUBLE) fp, sum((p = 0 and y = 1)::DOUBLE) fn from x)
select round(avg((p = y)::DOUBLE), 6) accuracy, round(avg((s - y) * (s - y)), 6) mse,
  round((select case when sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) > 0
          then (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) else 0.0 end from c), 6) matthews,
  round((select case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end from c), 6) f1,
  round((avg((p = y)::DOUBLE) + (select case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end from c)) / 2, 6) combined_score,
  round(corr(s, y), 6) pearson, round(corr(rank_s, rank_y), 6) spearman from r""")
def q_prediction_metrics(spark, sf):
    """Accuracy, MSE, Matthews, F1, combined score, Pearson and Spearman of the n-gram probability vs quality."""
    x = probs(spark, sf).join(read_table(spark, sf, "labels"), "doc_id").select(
        (F.col("prob") >= 0.5).cast("double").alias("pred"), F.col("quality").alias("y"), "prob")
    m = RS.prediction_metrics(x, "pred", "y", "prob")
    return m.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "mse", "matthews", "f1", "combined_score",
                                                        "pearson", "spearman")])


@query("predictions_out", f"""
with {SIG_CTE},
ll as (select label, (row_number() over (order by label) - 1)::INT label_id
       from (select distinct quality label from labels where quality is not null))
select pr.doc_id "index", ll.label::VARCHAR prediction
from pr left join ll on ll.label_id = (pr.prob >= 0.5)::INT""")
def q_predictions_out(spark, sf):
    """Prediction sink rows: index and the predicted class printed as its label."""
    ll = RS.label_list(read_table(spark, sf, "labels"), "quality")
    p = probs(spark, sf).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    return RS.format_predictions(p, "doc_id", "pred", regression=False, labels=ll)


@query("sample_cap", """
select doc_id from documents order by doc_id limit 50""")
def q_sample_cap(spark, sf):
    """max_samples cap: the first 50 rows in id order."""
    return RS.sample_cap(docs(spark, sf).select("doc_id"), 50, "doc_id")
