"""Selected rows as one JSON-lines file per virtual shard, byte for byte.

``selected_samples_{i}.jsonl`` holds the chosen lines of shard i in their order. The ordered lines
are cut into pieces of about ``PIECE_BYTES``, one to a task, which are then put at their places in
the shards' files. Files are staged and renamed on commit, so a reader never sees half a file.
"""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from ..session import ship_package
from .staged import Staged, StagedWriter, open_fs

NAME = "selected_samples_{}.jsonl"
SHARD_OF = r"selected_samples_(\d+)\.jsonl$"
PIECE = "{}_{}"
PIECE_OF = r"(-?\d+)_(\d+)"
PIECE_BYTES = 32 << 20
#: rows drawn per piece, on average, to find where pieces begin
DRAWN = 32
CHUNK_BYTES = 8 << 20


class PieceWriter(StagedWriter):
    """Rows (shard, piece, line), each piece's lines of a shard together -> a file for them in ``folder``."""

    def __init__(self, path: str, folder: str):
        super().__init__(path, False)
        self.folder = folder

    def owns(self, name: str) -> bool:
        return False

    def files(self, batches):
        rows = (r for b in batches for r in _lines(b))
        held = next(rows, None)
        while held is not None:
            of, rest = held[:2], []

            def lines(first=held):
                yield first[2] + b"\n"
                for r in rows:
                    if r[:2] != first[:2]:
                        rest.append(r)
                        return
                    yield r[2] + b"\n"
            yield posixpath.join(self.folder, PIECE.format(*of)), lines()
            held = rest[0] if rest else None


def _lines(b: pa.RecordBatch):
    return zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist())


class ShardPieces(DataSource):
    """Sink ``shard_pieces`` with ``path`` and ``folder``, the name of the pieces' folder in it."""

    @classmethod
    def name(cls) -> str:
        return "shard_pieces"

    def schema(self) -> str:
        return "shard int, piece int, line binary"

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        return PieceWriter(self.options["path"], self.options["folder"])


class ShardWriter(StagedWriter):
    """Rows (shard, start, size, files) -> the shard's file, with the bytes of ``files`` from ``start`` on.

    Where files are local (or mounted), tasks share a shard's staged file, each writing its own
    range; attempts that meet write the same bytes. Elsewhere a row must bring a shard's whole file.
    """

    def owns(self, name: str) -> bool:
        return re.fullmatch(SHARD_OF.rstrip("$"), name) is not None

    def write(self, iterator) -> Staged:
        fs, root = open_fs(self.path)
        written = []
        for b in iterator:
            for r in b.to_pylist():
                name = NAME.format(r["shard"])
                own = posixpath.join(root, self.stage, name if writes_ranges(fs) else uuid.uuid4().hex)
                with _open_at(own, r["start"]) if writes_ranges(fs) else fs.open_output_stream(own) as out:
                    for file in r["files"]:
                        with fs.open_input_stream(posixpath.join(root, file)) as piece:
                            while chunk := piece.read(CHUNK_BYTES):
                                out.write(chunk)
                    if out.tell() != r["start"] + r["size"]:
                        raise OSError(f"{name}: {out.tell() - r['start']} bytes from {r['start']}, not {r['size']}")
                written.append((own, posixpath.join(root, name)))
        return Staged(written)


def writes_ranges(fs: pafs.FileSystem) -> bool:
    """Whether several tasks can write ranges of one file."""
    return isinstance(fs, pafs.LocalFileSystem)


def _open_at(path: str, start: int):
    out = os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT, 0o666), "wb")
    out.seek(start)
    return out


class JsonlShards(DataSource):
    """Sink ``jsonl_shards`` with ``path``."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_shards"

    def schema(self) -> str:
        return "shard int, start long, size long, files array<string>"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], overwrite)


def piece_starts(rows: DataFrame, keys: list[str], shards: int, piece_bytes: int) -> DataFrame:
    """One row ``starts``: the sorted keys (structs of ``keys``, shard first) where pieces begin, each shard's first among them.

    Rows are drawn in proportion to their lines' bytes, so pieces are even in bytes, not in rows.
    """
    step = max(1, piece_bytes // DRAWN)
    sized = rows.select("shard", F.struct(*keys).alias("key"), (F.octet_length("line") + 1).cast("long").alias("size"))
    drawn = sized.where(F.rand(0) * step < F.col("size")).withColumn("weight", F.greatest("size", F.lit(step)))
    before = F.sum("weight").over(Window.partitionBy("shard").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = drawn.select("shard", "key", F.floor(before / piece_bytes).alias("n")).where((F.col("n") > 0) | ~F.col("shard").between(0, shards - 1))
    within = numbered.groupBy("shard", "n").agg(F.min("key").alias("key"))
    # nulls come first: no key of a shard is before this one
    least = [F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys[1:]]
    firsts = rows.sparkSession.range(1, shards).select(F.struct(F.col("id").cast("int").alias("shard"), *least).alias("key"))
    return within.select("key").union(firsts).agg(F.sort_array(F.collect_list("key")).alias("starts"))


def piece_of(key: Column, starts: Column, n: int) -> Column:
    """How many of the ``n`` sorted ``starts`` are at most ``key``, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(n, 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(starts, at + step - 1) <= key, at + step).otherwise(at))


def _placed(path: str, folder: str) -> list[tuple[int, int, int, list[str]]]:
    """(shard, start, size, files): a row per piece, or per shard where ranges can't be written."""
    fs, root = open_fs(path)
    found = defaultdict(list)
    for info in fs.get_file_info(pafs.FileSelector(posixpath.join(root, folder), allow_not_found=True)):
        shard, piece = map(int, re.fullmatch(PIECE_OF, info.base_name).groups())
        found[shard].append((piece, info.size, posixpath.join(folder, info.base_name)))
    rows = []
    for shard, pieces in sorted(found.items()):
        _, sizes, files = zip(*sorted(pieces))
        if writes_ranges(fs):
            rows += [(shard, start, size, [file]) for start, size, file in zip(accumulate(sizes, initial=0), sizes, files)]
        else:
            rows.append((shard, 0, sum(sizes), list(files)))
    return rows


def write_shards(lines: DataFrame, path: str, shard: Column, order_cols: list[str], shards: int, line_col: str = "value", mode: str = "append",
                 piece_bytes: int = PIECE_BYTES) -> None:
    """Write ``line_col`` as it is, one file per value of ``shard`` (0 to ``shards`` - 1) that has rows, ordered by ``order_cols``.

    Null lines are left out; null shards go to none. ``mode`` is append (existing files are an
    error) or overwrite (all files of this form are replaced). A task holds about ``piece_bytes``
    of lines, however large a shard is; only copies of one line under one key stay together.
    """
    spark = lines.sparkSession
    ship_package(spark)
    for sink in (ShardPieces, JsonlShards):
        spark.dataSource.register(sink)
    rows = lines.select(shard.cast("int").alias("shard"), F.col(line_col).cast("binary").alias("line"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)])
    rows = rows.where("shard is not null and line is not null").withColumn("_line", F.xxhash64("line"))
    keys = ["shard", *[f"_o{i}" for i in range(len(order_cols))], "_line"]
    folder = f"_pieces-{uuid.uuid4().hex}"
    starts = piece_starts(rows, keys, shards, piece_bytes).persist()
    try:
        n = starts.select(F.size("starts")).first()[0]
        pieces = rows.crossJoin(F.broadcast(starts)).withColumn("piece", piece_of(F.struct(*keys), F.col("starts"), n)).drop("starts")
        dealt = pieces.repartitionById(n + 1, "piece").sortWithinPartitions(*keys)
        dealt.select("shard", "piece", "line").write.format("shard_pieces").option("path", path).option("folder", folder).mode("append").save()
        placed = _placed(path, folder)
        schema = T.StructType.fromDDL(JsonlShards({}).schema())
        spark.createDataFrame(spark.sparkContext.parallelize(placed, max(1, len(placed))), schema).write.format("jsonl_shards").option("path", path).mode(mode).save()
    finally:
        starts.unpersist()
        fs, root = open_fs(path)
        if fs.get_file_info(posixpath.join(root, folder)).type != pafs.FileType.NotFound:
            fs.delete_dir(posixpath.join(root, folder))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, value) of every line of the shard files."""
    lines = spark.read.text(path, pathGlobFilter="selected_samples_*.jsonl")
    return lines.select(F.regexp_extract(F.col("_metadata.file_name"), SHARD_OF, 1).cast("int").alias("shard"), "value")
