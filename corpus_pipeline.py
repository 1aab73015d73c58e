"""Training-data pipeline over ``documents``: quality, line dedup, near duplicates, packing.

Every stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of their input.

Null texts count as empty: quality scores them like any text, line dedup and near duplicates leave
them alone (all texts without words are one class, of which one stays), packing gives each the
closing token. Null ids are documents too; rows with the same id and text are judged alike. Further
columns, whatever their names or types, pass through all stages but the last; an empty table
stays empty. Labels of ids that are absent teach nothing.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from corpus_select.llm import jaccard, lines, packing, quality
from corpus_select.llm.common import stored, table
from corpus_select.llm.queries import tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts; it learns from the labels of those present."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, each repeated line kept where it first occurs."""
    return lines.dedup_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return jaccard.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens."""
    return packing.pack(packing.cut_texts(docs, tokenizer_file("word_bpe_49k.json"), 2048), 2048)


STAGES = [("quality", good_quality), ("line_dedup", distinct_lines), ("near_duplicates", distinct_documents), ("packing", packed)]

# Trained models, SimHash blocks and byte-pair encoding are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
