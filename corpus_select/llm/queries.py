"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_trie, extraction, fim, fingerprints, jaccard, licenses, lines, multi_index, packing, quality, simhash, token_counts
from .common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.pack(packing.cut_texts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2048), 2048)


@query("op3_bpe_encoding")
def bpe_encoding(spark, sf_dir):
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op8_token_counts")
def prefix_token_counts(spark, sf_dir):
    counts = stored(token_counts.prefix_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")), "prefix-counts")
    return token_counts.over_limit(token_counts.fit_budget(counts, 4096), 4096).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "fit_tokens")


@query("op4_document_fingerprints")
def document_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


@query("op5_quality_classifier")
def quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_html_extraction")
def html_extraction(spark, sf_dir):
    return extraction.extract(table(spark, sf_dir, "pages"))


@query("op7_license_scans", licenses.scan_sql())
def license_scans(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op6_ngram_jaccard_join")
def ngram_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links", "group_id")


@query("op9_line_dedup")
def line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = lines.dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", F.length("text").alias("n_chars"), "text")


@query("op10_inverted_multi_index")
def inverted_multi_index(spark, sf_dir):
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op11_fill_in_middle")
def fill_in_middle(spark, sf_dir):
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("output").cast("binary"), 256), F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest[0].alias("output_sha256"), digest[1].alias("restored_sha256"))


@query("op13_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_code(F.col("code")).alias("fingerprint"), "component_id", "n_copies")


@query("op12_conversation_prefix_trie")
def conversation_prefix_trie(spark, sf_dir):
    conv = F.col("conv")
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"), conv - conv % 5, F.crc32(conv.cast("string")) % 9, max_head=8)
