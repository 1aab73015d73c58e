"""Files that appear whole or not at all: a writer that stages, renames on commit and removes on abort.

Tasks write under names of their own in a staging folder beside the target. The driver renames
what successful attempts reported once all have ended; a failed attempt removes its
files, and an aborted job its staging folder. Paths may be local or any URI that Arrow's file
systems open.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import ship_package


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


@dataclass
class Staged(WriterCommitMessage):
    """(temporary name, final name) of the files of one successful attempt."""
    files: list[tuple[str, str]]


class StagedWriter(DataSourceArrowWriter):
    """Subclasses yield (final name, chunks of bytes) from a task's batches; a name must come from one task alone.

    Tasks that overwrite ``write`` may share a staged file, which then has one final name.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.stage = f"_staging-{uuid.uuid4().hex}"
        # made here, on the driver, and not by tasks: one that outlives an abort must not make it again
        fs, root = open_fs(path)
        fs.create_dir(posixpath.join(root, self.stage), recursive=True)

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        raise NotImplementedError

    def owns(self, name: str) -> bool:
        """Whether a file of the target folder belongs to this format (overwriting replaces those)."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = open_fs(self.path)
        stage = posixpath.join(root, self.stage)
        written: list[tuple[str, str]] = []
        try:
            for name, chunks in self.files(iterator):
                own = posixpath.join(stage, f"{uuid.uuid4().hex}")
                written.append((own, posixpath.join(root, name)))
                with fs.open_output_stream(own) as out:
                    for c in chunks:
                        out.write(c)
        except BaseException:
            for own, _ in written:
                if fs.get_file_info(own).type != pafs.FileType.NotFound:
                    fs.delete_file(own)
            raise
        return Staged(written)

    def commit(self, messages: list) -> None:
        fs, root = open_fs(self.path)
        files = sorted({f for m in messages if m is not None for f in m.files})  # a file may have been written by several tasks
        finals = [final for _, final in files]
        if len(set(finals)) != len(finals):
            self.abort(messages)
            raise ValueError("two tasks wrote the same file")
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(root)):
                if info.type == pafs.FileType.File and self.owns(info.base_name):
                    fs.delete_file(info.path)
        else:
            taken = [f for f in finals if fs.get_file_info(f).type != pafs.FileType.NotFound]
            if taken:
                self.abort(messages)
                raise FileExistsError(taken[0])
        for folder in {posixpath.dirname(final) for _, final in files}:
            fs.create_dir(folder, recursive=True)
        for own, final in files:
            fs.move(own, final)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, root = open_fs(self.path)
        stage = posixpath.join(root, self.stage)
        if fs.get_file_info(stage).type != pafs.FileType.NotFound:
            fs.delete_dir(stage)


class FileWriter(StagedWriter):
    """Rows (name, content) -> a file each, in folders that the name says."""

    def owns(self, name: str) -> bool:
        return False

    def files(self, batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if posixpath.normpath(name) != name or name.startswith(("/", "..")):
                    raise ValueError(f"not a name below the folder: {name}")
                yield name, iter([content])


class NamedFiles(DataSource):
    """Sink ``named_files`` with ``path``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str) -> None:
    """Write each row (name, content) as a file below ``path``, all or none; names that exist are an error. For small files."""
    spark = files.sparkSession
    ship_package(spark)
    spark.dataSource.register(NamedFiles)
    files.select("name", "content").write.format("named_files").option("path", path).mode("append").save()
