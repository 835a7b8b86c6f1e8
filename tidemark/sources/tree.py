"""Trees of files, listed, read, deleted and written by tasks. A tree must be mounted at the same path on all executors.

Listing goes level by level: tasks open the folders of a level and the folders found are the next one, so the driver holds
no names. Writing is a transaction: tasks write beside the targets, read that again and check it, and only when all
have succeeded are the files renamed; a task that fails takes its own files away, and of a task that ran twice one copy counts.
What a worker leaves that is killed while it writes ends in ``.tmp``; a mirror's cleaning removes it.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidemark.shipping import ship
from tidemark.sources.scratch import written_table

SUFFIXES = (".jsonl", ".txt")
LISTING = "relpath string, suffix string, mtime_ns long, size long"
#: Bytes that a task reads, about, and of contents handed on at a time.
TASK_BYTES, BATCH_BYTES = 64_000_000, 16_000_000


class UnsafeTargetError(RuntimeError):
    pass


def assert_safe_target(path: str, protected_root: str) -> None:
    """Refuse any target inside the protected tree, links resolved."""
    target, root = Path(path).resolve(), Path(protected_root).resolve()
    if target == root or root in target.parents:
        raise UnsafeTargetError(f"{target} is inside {root}")


def _opened(folders: DataFrame, root: str, suffixes: tuple[str, ...] | None) -> DataFrame:
    schema = pa.schema([("folder", pa.bool_()), ("relpath", pa.string()), ("suffix", pa.string()), ("mtime_ns", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for folder in b.column(0).to_pylist():
                with os.scandir(os.path.join(root, folder)) as entries:
                    for e in entries:
                        at, suffix = os.path.join(folder, e.name), os.path.splitext(e.name)[1]
                        if e.is_dir(follow_symlinks=False):
                            rows.append({"folder": True, "relpath": at})
                        elif (suffixes is None or suffix in suffixes) and e.is_file():
                            stat = e.stat()
                            rows.append({"folder": False, "relpath": at, "suffix": suffix, "mtime_ns": stat.st_mtime_ns, "size": stat.st_size})
                if len(rows) > 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return folders.mapInArrow(run, f"folder boolean, {LISTING}")


def list_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = SUFFIXES) -> DataFrame:
    """(relpath, suffix, mtime_ns, size) of the files below ``root`` with these suffixes (None: all), as a written table.

    Dot folders, leading underscores and empty files are included; links to folders are not followed. A missing root is empty."""
    ship(spark)
    folders = spark.createDataFrame([("",)] if os.path.isdir(root) else [], "relpath string")
    levels: list[DataFrame] = []
    while not levels or not folders.isEmpty():
        level = written_table(_opened(folders, root, suffixes), "listing")
        levels.append(level.where("not folder").drop("folder"))
        folders = level.where("folder").select("relpath").repartition(spark.sparkContext.defaultParallelism)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def read_files(files: DataFrame, root: str, most_text: int | None = None) -> DataFrame:
    """``files`` (relpath, suffix, mtime_ns, size) with their content; null for a .txt file of more than ``most_text`` bytes, which is not opened."""
    spark = files.sparkSession
    ship(spark)
    total = files.agg(F.sum("size")).first()[0] or 0
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, held, size = 0, [], 0
            for i, (rel, suffix, bytes_) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("relpath", "suffix", "size")), strict=True)):
                data = None
                if most_text is None or suffix != ".txt" or bytes_ <= most_text:
                    with open(os.path.join(root, rel), "rb") as f:
                        data = f.read()
                held.append(data)
                size += len(data or b"")
                if size > BATCH_BYTES or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*b.slice(begin, len(held)).columns, pa.array(held, pa.binary())], names=schema.fieldNames())
                    begin, held, size = i + 1, [], 0

    spread = files.repartition(max(1, -(-total // TASK_BYTES)), "relpath")
    return spread.mapInArrow(run, schema)


def delete_files(files: DataFrame, root: str) -> DataFrame:
    """Delete the files ``relpath`` below ``root``; the table of those that were there. A file that is gone already does no harm."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rel in b.column(0).to_pylist():
                try:
                    os.unlink(os.path.join(root, rel))
                except FileNotFoundError:
                    pass
            yield b

    return written_table(files.select("relpath").mapInArrow(run, "relpath string"), "deleted")


@dataclass
class Staged(WriterCommitMessage):
    manifest: str
    files: int


def checked(tmp: str, suffix: str) -> None:
    """Read a written file again: it is UTF-8, and each line of a .jsonl file is JSON or empty."""
    with open(tmp, encoding="utf-8", newline="\n") as f:
        for line in f:
            if suffix == ".jsonl" and line.rstrip("\n"):
                json.loads(line)


class TreeWriter(DataSourceWriter):
    """Rows (relpath, output) to files below ``path``, as one transaction.

    Options: ``path``; ``protected``, a tree into which no target may lead, links resolved. What tasks have staged is noted in
    files beside the tree, one for each task, which are read one at a time when the files are renamed."""

    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["path"])
        self.protected = options.get("protected")
        self.notes = f"{self.root}.staged-{uuid.uuid4().hex}"
        os.makedirs(self.notes)

    def write(self, iterator) -> Staged:
        attempt = uuid.uuid4().hex
        manifest = os.path.join(self.notes, attempt)
        mine: list[str] = []
        try:
            for row in iterator:
                final = os.path.join(self.root, row["relpath"])
                if self.protected:
                    assert_safe_target(final, self.protected)
                os.makedirs(os.path.dirname(final), exist_ok=True)
                mine.append(f"{final}.{attempt}.tmp")
                # the folder of notes is gone once the job is given up, and then this fails
                with open(manifest, "a", encoding="utf-8") as note:
                    note.write(json.dumps([mine[-1], final]) + "\n")
                with open(mine[-1], "wb") as f:
                    f.write(row["output"])
                checked(mine[-1], os.path.splitext(final)[1])
            if not os.path.isdir(self.notes):
                raise RuntimeError("the job was given up")
        except BaseException:
            for tmp in mine:
                if os.path.exists(tmp):
                    os.unlink(tmp)
            raise
        return Staged(manifest, len(mine))

    @staticmethod
    def _staged(manifest: str) -> Iterator[list[str]]:
        if os.path.exists(manifest):
            with open(manifest, encoding="utf-8") as f:
                yield from map(json.loads, f)

    def _discard(self, manifest: str) -> None:
        for tmp, _ in self._staged(manifest):
            if os.path.exists(tmp):
                os.unlink(tmp)
        if os.path.exists(manifest):
            os.unlink(manifest)

    def commit(self, messages: list) -> None:
        for message in messages:
            for tmp, final in self._staged(message.manifest):
                os.replace(tmp, final)
            if message.files:
                os.unlink(message.manifest)
        self.abort([])  # what is left was staged by tasks that ran twice

    def abort(self, messages: list) -> None:
        if os.path.isdir(self.notes):
            for name in os.listdir(self.notes):
                self._discard(os.path.join(self.notes, name))
            shutil.rmtree(self.notes, ignore_errors=True)


class TreeSink(DataSource):
    """``df.write.format("filetree").mode("append").option("path", root).save()`` for rows (relpath, output)."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "relpath string, output binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(dict(self.options))


def write_tree(files: DataFrame, root: str, protected: str | None = None) -> None:
    """Write ``files`` (relpath, output) below ``root``: all of them, or none. A later row of the same path replaces an earlier file."""
    spark = files.sparkSession
    ship(spark)
    spark.dataSource.register(TreeSink)
    if protected:
        assert_safe_target(root, protected)
    writer = files.select("relpath", F.col("output").cast("binary").alias("output")).write.format("filetree").mode("append").option("path", root)
    (writer.option("protected", protected) if protected else writer).save()
