"""Streaming score-and-filter.

Arriving documents are featurised and scored row by row against a fitted
n-gram model (a broadcast B-entry vector), passed through the length filter
and a fixed weight threshold, and appended to a parquet sink. Nothing is
aggregated across rows, so the stream holds no state; top-k selection stays
a batch step over the sink.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import ngram_features
from ..operators.ngram_model import NgramModel, score_features_arrow
from ..operators.quality import apply_quality_mask, quality_stats
from ..session import checkpoint_dir

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def scored_stream(stream: DataFrame, model: NgramModel, threshold_e10: int, min_example_length: int = 100,
                  id_col: str = "doc_id", text_col: str = "text", quality_mask: bool = False) -> DataFrame:
    """The lazy streaming plan: quality mask (row-local, optional) -> features -> row score -> length and threshold filters."""
    p = model.params
    if quality_mask:
        stream = apply_quality_mask(quality_stats(stream.select(id_col, text_col), text_col)).select(id_col, text_col)
    f = ngram_features(stream.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                       n=p["n"], num_buckets=p["num_buckets"], tokenizer=p.get("tokenizer", "wordpunct"),
                       hash_fn=p.get("hash_fn", "sha256"))
    s = score_features_arrow(f, model, model.targets[0])
    if min_example_length is not None:
        s = s.where(F.col("length") >= F.lit(min_example_length))
    return s.where(F.col("weight_e10") >= F.lit(threshold_e10))


def run_score_filter(spark: SparkSession, source_glob: str, model: NgramModel, threshold_e10: int,
                     min_example_length: int = 100, schema: T.StructType = DOC_SCHEMA,
                     sink_dir: str | None = None, max_files_per_trigger: int = 64, quality_mask: bool = False) -> DataFrame:
    """Process every file available under ``source_glob`` (trigger availableNow) and return the sink.

    Sink and checkpoint live in the shared checkpoint folder, so a restarted
    query resumes exactly where it stopped.
    """
    base = sink_dir or os.path.join(checkpoint_dir(spark), f"stream_{uuid.uuid4().hex}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_glob)
    plan = scored_stream(stream, model, threshold_e10, min_example_length, quality_mask=quality_mask)
    q = (plan.writeStream.format("parquet").outputMode("append")
         .option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(plan.schema).parquet(os.path.join(base, "out"))
