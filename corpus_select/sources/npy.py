"""Embedding chunks in ``.npy`` files as a Spark source and sink.

A folder of two-dimensional arrays is one table (row, embedding). Headers are read once, on
the driver; each partition reads one range of rows of one file, so a large file is split and
memory is bounded by a batch. Rows are numbered through all files in the order of their
names, which is how positional data next to them (texts, ids) is aligned.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from numpy.lib import format as npf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package
from .staged import StagedWriter, open_fs

ROWS = 1_000_000  # of a partition, unless told otherwise
BATCH_BYTES = 8 << 20


@dataclass
class Header:
    """Where a file's numbers begin and what they are."""
    rows: int
    dim: int
    dtype: str
    offset: int


def read_header(f) -> Header:
    """Header of an open file; only two-dimensional floats in row order are taken."""
    version = npf.read_magic(f)
    shape, by_column, dtype = (npf.read_array_header_1_0 if version == (1, 0) else npf.read_array_header_2_0)(f)
    if len(shape) != 2 or (by_column and min(shape) > 1) or dtype.kind != "f":
        raise ValueError(f"not a two-dimensional array of floats in row order: {shape}, {dtype}")
    return Header(*shape, dtype.str, f.tell())


@dataclass
class Rows(InputPartition):
    """Rows [start, stop) of one file; the first is number ``first`` of the table."""
    path: str
    header: Header
    start: int
    stop: int
    first: int

    def __post_init__(self):
        super().__init__(self.first)


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Rows]:
        fs, root = open_fs(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [root] if info.type == pafs.FileType.File else sorted(
            i.path for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File and i.path.endswith(".npy"))
        out, first, dim = [], 0, None
        for path in files:
            with fs.open_input_file(path) as f:
                header = read_header(f)
            if header.rows and dim not in (None, header.dim):
                raise ValueError(f"{path} has {header.dim} numbers a row, files before it {dim}")
            dim = header.dim if header.rows else dim
            for start in range(0, header.rows, self.rows):
                out.append(Rows(path, header, start, min(start + self.rows, header.rows), first + start))
            first += header.rows
        return out or [Rows("", Header(0, 0, "<f4", 0), 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.stop == partition.start:
            return
        fs, _ = open_fs(self.path)
        h, dtype = partition.header, np.dtype(partition.header.dtype)
        step = max(1, BATCH_BYTES // max(1, h.dim * dtype.itemsize))
        with fs.open_input_file(partition.path) as f:
            f.seek(h.offset + partition.start * h.dim * dtype.itemsize)
            for at in range(partition.start, partition.stop, step):
                n = min(step, partition.stop - at)
                raw = f.read(n * h.dim * dtype.itemsize)
                if len(raw) != n * h.dim * dtype.itemsize:
                    raise ValueError(f"{partition.path} ends before row {at + n}")
                values = np.frombuffer(raw, dtype).astype(np.float32)
                number = np.arange(at, at + n) - partition.start + partition.first
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * h.dim)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.ListArray.from_arrays(ends, pa.array(values))], names=["row", "embedding"])


class NpyWriter(StagedWriter):
    """One file per task, named by the task's place: tasks of a range partitioning give files in row order."""

    def owns(self, name: str) -> bool:
        return name.startswith("chunk_") and name.endswith(".npy")

    def files(self, batches):
        from pyspark import TaskContext

        # the header holds the number of rows, so a task's rows are known before its file is opened
        held = [b.column(0) for b in batches if b.num_rows]
        if not held:
            return
        flat = [c.flatten().to_numpy(zero_copy_only=False).astype("<f4") for c in held]
        n = sum(map(len, held))
        total = sum(map(len, flat))
        if any(len(x) * n != total * len(c) for x, c in zip(flat, held)):
            raise ValueError("rows differ in length")
        head = _header_bytes(n, total // n)
        yield f"chunk_{TaskContext.get().partitionId():06d}.npy", iter([head, *(x.tobytes() for x in flat)])


def _header_bytes(rows: int, dim: int) -> bytes:
    import io

    out = io.BytesIO()
    npf.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (rows, dim)})
    return out.getvalue()


class NpyChunks(DataSource):
    """``spark.read.format("npy_chunks")`` with ``path`` and ``rows`` (of a partition); written from one array column."""

    @classmethod
    def name(cls) -> str:
        return "npy_chunks"

    def schema(self) -> str:
        return "row long, embedding array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rows", ROWS)))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    spark.dataSource.register(NpyChunks)
    return spark


def read_npy(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """(row, embedding) of a folder of ``.npy`` files, or of one file; ``rows`` at most in a partition."""
    return _registered(spark).read.format("npy_chunks").option("path", path).option("rows", rows).load()


def write_npy(emb: DataFrame, path: str, order_col: str, emb_col: str = "embedding", files: int | None = None, mode: str = "append") -> None:
    """Write the embeddings in the order of ``order_col`` (null first), one file per range of rows."""
    _registered(emb.sparkSession)
    key = F.col(order_col).asc_nulls_first()
    ranged = emb.repartitionByRange(files, key) if files else emb.repartitionByRange(key)
    ordered = ranged.sortWithinPartitions(key).select(F.col(emb_col).cast("array<float>").alias("embedding"))
    ordered.write.format("npy_chunks").option("path", path).mode(mode).save()


def npy_files(path: str) -> list[str]:
    """The data files of a folder, in row order."""
    fs, root = open_fs(path)
    return sorted(posixpath.basename(i.path) for i in fs.get_file_info(pafs.FileSelector(root)) if i.path.endswith(".npy"))
