"""Sources and sinks: JSONL pools, compressed JSONL, by-extension reads,
the dataset registry, materialised intermediates and result writers."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def balance(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan over the cluster when it arrives in too few partitions.

    A large input already arrives in many file splits and is returned as is
    (no shuffle). A small or unsplittable input (one row group, a ``.zst``
    file) is hash-partitioned on ``key`` so later per-key work (joins,
    aggregates on the id) can reuse that partitioning.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, key) if key else df.repartition(want)


def read_table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """One of the driver's parquet tables, balanced on ``key``."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return balance(df, key) if key else df


# -- JSONL ------------------------------------------------------------------

TEXT_SCHEMA = T.StructType([T.StructField("text", T.StringType())])

PILE_CHUNK_SCHEMA = T.StructType([
    T.StructField("contents", T.StringType()),
    T.StructField("metadata", T.StructType([T.StructField("pile_set_name", T.StringType())])),
    T.StructField("id", T.LongType()),
])

PILE_RAW_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("meta", T.StructType([T.StructField("pile_set_name", T.StringType())])),
])


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType = TEXT_SCHEMA,
               with_source: bool = False, failfast: bool = True) -> DataFrame:
    """JSON-lines reader with an explicit schema.

    Works for plain and compressed (``.zst``, ``.gz``) files. A bad line
    fails the job (the reference raises). Listing a path twice yields its rows
    twice (S2): each path is read separately and the parts are unioned.
    """
    if isinstance(paths, str):
        paths = [paths]
    mode = "FAILFAST" if failfast else "PERMISSIVE"
    parts = []
    for p in paths:
        part = spark.read.schema(schema).option("mode", mode).json(p)
        if with_source:
            part = part.withColumn("source_path", F.col("_metadata.file_path"))
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def pile_domain(df: DataFrame, meta_col: str = "metadata") -> Column:
    """Domain of a pile-shaped row: ``metadata.pile_set_name``."""
    return F.col(f"{meta_col}.pile_set_name")


def pile_chunks(df: DataFrame) -> DataFrame:
    """Chunked pile rows ``{contents, metadata{pile_set_name}, id}`` as ``doc_id, text, domain``."""
    return df.select(F.col("id").cast("long").alias("doc_id"), F.col("contents").alias("text"),
                     pile_domain(df).alias("domain"))


def with_row_id(df: DataFrame, file_col: str = "source_path", order_cols: list[str] | None = None,
                id_name: str = "doc_id") -> DataFrame:
    """Positional id for rows read straight from files: (file, row order within the file).

    The row order inside a split is taken directly over the scan (stable for
    the same files); the dense index then checkpoints once, so the ids are
    fixed from there on. For already-keyed inputs prefer the table's own id.
    """
    from ..operators.select import dense_index
    cols = order_cols or [file_col, "_row_in_file"]
    tagged = df.withColumn("_row_in_file", F.monotonically_increasing_id())
    return dense_index(tagged, cols, id_name).drop("_row_in_file")


# Suffix -> reader; every other suffix is read as JSON lines.
READERS = {
    ".txt": lambda r, path: r.text(path).withColumnRenamed("value", "text"),
    ".csv": lambda r, path: r.option("header", True).csv(path),
}


def read_by_extension(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Text lines (column ``text``), CSV or JSON, by the file's suffix; a JSON ``schema`` saves the scan that infers one."""
    reader = READERS.get(os.path.splitext(path)[1].lower(), lambda r, p: (r.schema(schema) if schema else r).json(p))
    return reader(spark.read, path)


# -- dataset registry (S6) ----------------------------------------------------

@dataclass(frozen=True)
class DatasetSpec:
    """Where a dataset lives and which columns hold its text and domain."""
    path: str
    text_columns: tuple[str, ...] = ("text",)
    domain_column: str | None = None
    id_column: str = "doc_id"
    fmt: str = "parquet"
    options: dict = field(default_factory=dict)


def load_dataset(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """Read a registered dataset and expose ``doc_id, text[, domain]``."""
    from ..functions.text import concat_text
    reader = spark.read.options(**spec.options)
    df = reader.format(spec.fmt).load(spec.path)
    cols = [F.col(spec.id_column).cast("long").alias("doc_id"), concat_text(*spec.text_columns).alias("text")]
    if spec.domain_column:
        cols.append(F.col(spec.domain_column).alias("domain"))
    return df.select(*cols)


def registry_for(sf_dir: str) -> dict[str, DatasetSpec]:
    """Registry of the driver's tables as selection datasets."""
    j = os.path.join
    return {
        "documents": DatasetSpec(j(sf_dir, "documents.parquet"), ("text",), "source"),
        "benchmark": DatasetSpec(j(sf_dir, "benchmark.parquet"), ("text",), None, "item_id"),
        "conversations": DatasetSpec(j(sf_dir, "conversations.parquet"), ("role", "text"), "role", "conv_id"),
    }


# -- materialised intermediates (S11) ---------------------------------------

def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def materialize(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Reuse a written table if present, else write ``df`` and read it back.

    The written table also cuts lineage: later stages recompute from the
    stored files after an executor loss, not from the raw text.
    """
    spark = df.sparkSession
    if overwrite or not _exists(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cache_key(**params) -> str:
    """Directory-safe name from parameters, e.g. ``n2_b10000_nofilter``."""
    parts = []
    for k in sorted(params):
        v = params[k]
        if v is None:
            v = "none"
        elif isinstance(v, (list, tuple, set)):
            v = "-".join(str(x).replace(" ", "_") for x in sorted(v))
        parts.append(f"{k}{v}")
    return "_".join(parts)


# -- sinks --------------------------------------------------------------------

def write_selected(corpus: DataFrame, chosen: DataFrame, out_dir: str, id_col: str = "doc_id",
                   mode: str = "errorifexists") -> None:
    """Write the chosen rows of the corpus as JSON lines."""
    corpus.join(chosen.select(id_col), id_col, "left_semi").write.mode(mode).json(out_dir)


def write_selected_lines(raw_lines: DataFrame, chosen: DataFrame, out_dir: str, id_col: str = "doc_id",
                         mode: str = "errorifexists") -> None:
    """Byte-exact copy: ``raw_lines`` has ``(doc_id, value)`` from ``read.text``."""
    raw_lines.join(chosen.select(id_col), id_col, "left_semi").select("value").write.mode(mode).text(out_dir)


def write_indices(chosen: DataFrame, out_dir: str, id_col: str = "doc_id", mode: str = "errorifexists") -> None:
    """All selected ids as parquet."""
    chosen.select(id_col).write.mode(mode).parquet(out_dir)


def write_tsv(df: DataFrame, out_dir: str, mode: str = "overwrite", one_file: bool = False) -> None:
    """Tab-separated result table, a header in each file.

    ``one_file`` puts all rows through one task: for tables of a few rows, such as a roll-up.
    """
    rows = df.coalesce(1) if one_file else df
    rows.write.mode(mode).option("sep", "\t").option("header", True).csv(out_dir)


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``.vec`` text file (``word v1 v2 ...``; optional ``count dim`` header) as ``(word, vec)``."""
    lines = spark.read.text(path)
    parts = F.split(F.trim("value"), " ")
    df = lines.select(parts.alias("p")).where(F.size("p") > 2)
    return df.select(F.col("p")[0].alias("word"),
                     F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("float")).alias("vec"))


def read_trials(spark: SparkSession, results_dir: str) -> DataFrame:
    """``run_name, json``: one row per trial directory's ``eval_results.json`` (S16), as ``trial_table`` takes it.

    A file that is no JSON keeps its text; its metric is then null.
    """
    df = spark.read.option("wholetext", True).text(os.path.join(results_dir, "*", "eval_results.json"))
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.select(run.alias("run_name"), F.col("value").alias("json"))


def count_rows(df: DataFrame) -> int:
    """Line count."""
    return df.count()
