"""Registered preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import WEIGHTS_A_CTE, docs, query, weights_a
from ..functions import stats as ST
from ..functions import text as TX
from ..operators import features as FE
from ..operators import pack as PK
from ..operators import quality as QU
from ..operators import select as SEL
from ..operators import sentences as SE
from ..sources.io import read_table

CHUNKS_SQL = """chunks as (
  select doc_id, i::INT chunk_no, array_to_string(ws[i * 128 + 1:(i + 1) * 128], ' ') contents
  from (select doc_id, string_split(text, ' ') ws from documents) d,
       unnest(range(0, greatest(ceil(len(ws) / 128.0)::BIGINT, 1))) u(i))"""


def chunks(spark, sf):
    return QU.chunk_documents(docs(spark, sf), 128)


@query("chunk_docs", f"""
with {CHUNKS_SQL}
select doc_id, chunk_no, contents from chunks""")
def q_chunk(spark, sf):
    """128-word chunks of every document, keyed (doc_id, chunk_no)."""
    return chunks(spark, sf)


STATS_SQL = f"""{CHUNKS_SQL},
tk as (select doc_id, chunk_no, {ST.treebank_sql('contents')} t from chunks),
st as (select doc_id, chunk_no, len(t)::BIGINT length,
  case when len(t) = 0 then 0.0 else len(list_filter(t, lambda x: x = list_aggregate(t, 'mode'))) / len(t) end repeating_ratio,
  case when len(t) = 0 then 0.0 else len(list_filter(t, lambda x: not list_contains({ST.sql_list(ST.UNINFORMATIVE)}, x))) / len(t) end informative_ratio,
  case when len(t) = 0 then 0.0 else len(list_filter(t, lambda x: not list_contains({ST.sql_list(ST.DIGITS)}, x))) / len(t) end numeric_ratio
  from tk)"""


def chunk_stats(spark, sf):
    return QU.quality_stats(chunks(spark, sf), "contents")


@query("quality_stats", f"""
with {STATS_SQL}
select doc_id, chunk_no, length, round(repeating_ratio, 6) repeating_ratio,
       round(informative_ratio, 6) informative_ratio, round(numeric_ratio, 6) numeric_ratio from st""")
def q_quality_stats(spark, sf):
    """Length, repeating, informative and numeric ratios of every chunk."""
    s = chunk_stats(spark, sf)
    return s.select("doc_id", "chunk_no", "length", *[F.round(c, 6).alias(c) for c in
                    ("repeating_ratio", "informative_ratio", "numeric_ratio")])


@query("quality_mask", f"""
with {STATS_SQL}
select doc_id, chunk_no from st where {ST.quality_mask_sql()}""")
def q_quality_mask(spark, sf):
    """Chunks passing the strict quality bounds."""
    return QU.apply_quality_mask(chunk_stats(spark, sf)).select("doc_id", "chunk_no")


@query("repeating_top_n", f"""
with t as (select doc_id, {ST.treebank_sql('text')} t from documents),
c as (select doc_id, tok, count(*) c from (select doc_id, unnest(t) tok from t) group by all),
r as (select doc_id, c, row_number() over (partition by doc_id order by c desc, tok) rn from c),
top as (select doc_id, sum(c) top from r where rn <= 3 group by doc_id)
select t.doc_id, case when len(t.t) = 0 then 0.0 else round(coalesce(top.top, 0) / len(t.t), 6) end repeating_top_n
from t left join top using (doc_id)""")
def q_repeating_top_n(spark, sf):
    """Share of the 3 commonest tokens in every document."""
    r = QU.repeating_top_n(docs(spark, sf), 3)
    return r.select("doc_id", F.round("repeating_top_n", 6).alias("repeating_top_n"))


@query("blank_filter", """
select conv_id, turn from conversations
where text is not null and regexp_replace(text, '[\\s\\p{Z}\\x0B\\x1C-\\x1F\\x85]', '', 'g') <> ''""")
def q_blank(spark, sf):
    """Drop null, empty and whitespace-only texts."""
    c = read_table(spark, sf, "conversations")
    return QU.drop_blank(c, "text").select("conv_id", "turn")


@query("text_concat", """
select conv_id, turn, role || ' ' || text joined from conversations""")
def q_text_concat(spark, sf):
    """Several text columns joined with one space."""
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", TX.concat_text("role", "text").alias("joined"))


@query("whitespace_bigrams", """
select doc_id, len(w)::INT n_words, array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') bigrams
from (select item_id doc_id, list_filter(regexp_split_to_array(text, '[\\s\\p{Z}\\x0B\\x1C-\\x1F\\x85]+'), lambda x: x <> '') w from benchmark)""")
def q_ws_bigrams(spark, sf):
    """Whitespace tokens and adjacent pairs."""
    b = read_table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    w = b.select("doc_id", TX.whitespace_tokens("text").alias("w"))
    return w.select("doc_id", F.size("w").alias("n_words"), F.array_join(TX.shifted_join(F.col("w"), 2), "|").alias("bigrams"))


@query("feature_counts_xxh")
def q_features_xxh(spark, sf):
    """Fast-hash features (T6): xxhash64 buckets; same role as sha-256, other values (rows-only check)."""
    return FE.features_long(FE.ngram_features(docs(spark, sf), hash_fn="xxh64"))


@query("feature_counts_pyhash")
def q_features_pyhash(spark, sf):
    """Features in the interpreter's own hash buckets under hash seed 0 (T6); pytest compares them with child interpreters."""
    return FE.features_long(FE.ngram_features(docs(spark, sf), hash_fn="python:0"))


@query("feature_counts_jvm_xxhash")
def q_features_jvm_xxh(spark, sf):
    """Fully JVM-side features with Spark's xxhash64 (no Python), long form (rows-only check)."""
    return FE.ngram_features_sql(docs(spark, sf), hash_fn="xxhash64")


TOP100_PACK = f"""{WEIGHTS_A_CTE},
top as (select doc_id from sc where length >= 100 order by weight_e10 desc, doc_id limit 100),
ch as (select d.doc_id, d.text, d.source, row_number() over (order by d.doc_id) - 1 idx
       from documents d where d.doc_id in (select doc_id from top))"""


@query("pack_pairs", f"""
with {TOP100_PACK}
select a.doc_id, a.text || b.text contents, a.source || ',' || b.source domains
from ch a join ch b on b.idx = a.idx + 1 where a.idx % 2 = 0""")
def q_pack(spark, sf):
    """The chosen 100 documents packed two by two in id order, odd last row dropped."""
    chosen = SEL.semi_join(docs(spark, sf), SEL.top_k(weights_a(spark, sf), 100))
    p = PK.pack_pairs(chosen, "doc_id", "text", "source")
    return p.select("doc_id", F.col("text").alias("contents"), F.array_join("source", ",").alias("domains"))


@query("group_of_n", """
with i as (select item_id, row_number() over (order by item_id) - 1 idx from benchmark),
g as (select (idx // 3)::BIGINT group_no, list(item_id order by idx) items from i group by all)
select group_no, array_to_string(list_transform(items || list_value(-1, -1, -1)[1:3 - len(items)], lambda x: x::VARCHAR), ',') items
from g""")
def q_group_of_n(spark, sf):
    """Benchmark ids in groups of 3, the last group padded with -1."""
    b = read_table(spark, sf, "benchmark")
    g = PK.group_of_n(b, 3, "item_id", ["item_id"], incomplete="fill", fill_value=-1)
    return g.select("group_no", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


# -- sentence ends -----------------------------------------------------------------

@query("abbreviation_scores", f"""
with {SE.scores_sql()} select type, n, n_period, round(score, 6) + 0.0 score from ab""")
def q_abbreviation_scores(spark, sf):
    """Log-likelihood score of every word seen with a final period."""
    scores = SE.abbreviation_scores(SE.word_counts(docs(spark, sf)))
    return scores.select("type", "n", "n_period", (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query("sentence_tokens", f"""
with {SE.scores_sql()}, listed as (select coalesce(list(type), []) l from ab where score >= {SE.ABBREVIATION}),
ww as (select doc_id, {SE.words_sql("text")} ws, l from documents, listed where text is not null),
tk as (select doc_id, {SE.tokens_sql("ws", "l")} t from ww)
select doc_id, len(t)::INT n_tokens, sha256(array_to_string(t, ' ')) tokens_sha256 from tk""")
def q_sentence_tokens(spark, sf):
    """Treebank-style tokens with learned abbreviations kept whole inside sentences."""
    d = docs(spark, sf)
    listed = SE.abbreviation_scores(SE.word_counts(d)).where(F.col("score") >= SE.ABBREVIATION).select("type")
    model = SE.SentenceModel(SE._listed(listed, "abbreviations"))
    tokens = d.where("text is not null").select("doc_id", SE.sentence_tokens(F.col("text"), model).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))
