"""Shared helpers of the training-data operators: stored intermediates, Arrow maps, array views."""

from __future__ import annotations

import atexit
import os
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir, ship_package

SLICE_BYTES = 24 << 20
_WRITTEN: list[tuple[SparkSession, str]] = []
_PATHS: dict[int, tuple] = {}
_TABLES: dict[str, str] = {}  # catalog tables by their folder


def prepare(spark: SparkSession, batch_bytes: int = 32 << 20) -> None:
    """Ship the package and bound Arrow batches by bytes as well as by rows."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Cuts lineage, so a lost executor costs a re-read and not a recomputation.
    The folders go when the application ends (``release``).
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex}")
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))
    df.write.option("compression", codec).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(read)] = weakref.ref(read), path
    return read


def forget(*dfs: DataFrame) -> None:
    """Delete the folders of tables that ``stored`` returned, once nothing reads them any more."""
    for df in dfs:
        ref, path = _PATHS.pop(id(df), (None, None))
        if ref is None or ref() is not df:
            raise ValueError("not a table that stored() returned")
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _WRITTEN[:] = [(s, x) for s, x in _WRITTEN if x != path]


def stored_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``stored``, as a table bucketed by ``key``: a join on the key does not move it again."""
    spark = df.sparkSession
    made = f"llm_{name}_{uuid.uuid4().hex}"
    path = os.path.join(checkpoint_dir(spark), made)
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))
    _TABLES[path] = made
    df.write.format("parquet").option("path", path).option("compression", "none").bucketBy(buckets, key).saveAsTable(made)
    return spark.table(made)


def release(spark: SparkSession | None = None) -> None:
    """Delete the intermediates this module wrote (of ``spark``, or of every session)."""
    left = []
    for s, path in _WRITTEN:
        if spark is not None and s is not spark:
            left.append((s, path))
            continue
        try:
            if path in _TABLES:
                s.sql(f"drop table if exists {_TABLES.pop(path)}")
            p = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the context is already gone; the cluster's own clean-up has it
            pass
    _WRITTEN[:] = left


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, batch_bytes: int = 32 << 20) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes; the bound holds for what is run before another one is set."""
    prepare(df.sparkSession, batch_bytes)
    return df.mapInArrow(fn, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null text as empty; other columns never travel."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Re-cut batches so that each carries at most ``limit`` bytes of text (one row at least)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def gathered(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Join small batches and cut large ones to tables of about ``limit`` bytes of text."""
    held, size = [], 0
    for b in slices(batches, text, limit):
        n = pc.sum(pc.binary_length(b.column(text))).as_py() or 0
        if held and size + n > limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held)


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """The column as one contiguous array."""
    if not isinstance(column, pa.ChunkedArray):
        return column
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def large(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One contiguous array of strings with 64-bit offsets."""
    return one_array(column.cast(pa.large_string()))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets (n + 1) from lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Concatenate the variable-length ``rows`` of ``flat``."""
    n = lengths[rows]
    out_start = starts_of(n)
    index = np.arange(out_start[-1], dtype=np.int64)
    index += np.repeat(starts[rows] - out_start[:-1], n)
    return flat[index]


def binary_array(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Large binary array over ``flat``'s bytes; ``ends`` are byte offsets (n + 1)."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])


def list_lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def codes_of(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code per value, distinct values)."""
    d = pc.dictionary_encode(flat)
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def record_batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
