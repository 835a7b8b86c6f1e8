"""Growing log files as a stream: each line once, by byte offsets.

The source follows one file or all files of a folder. An offset is the number of bytes of each file that have been
read; it always lies behind a line feed, so a last line that is still being written waits until it is whole. A batch is cut into
ranges of bytes that tasks read side by side. Files must be mounted at the same path on all executors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.shipping import ship
from tidemark.sources.corpus import METRICS

#: Bytes that one task reads, and that are looked at a time for a file's last line feed.
TASK_BYTES, LOOK_BYTES = 64 << 20, 1 << 16


class LogCutError(RuntimeError):
    """A followed file has become shorter than what was read of it."""


@dataclass
class ByteRange(InputPartition):
    path: str
    name: str
    start: int
    end: int


def complete_bytes(path: str, known: int) -> int:
    """The bytes of a file up to and with its last line feed, not before ``known``."""
    size = os.path.getsize(path)
    if size < known:
        raise LogCutError(f"{path} has {size} bytes, of which {known} were read")
    with open(path, "rb") as f:
        at = size
        while at > known:
            begin = max(known, at - LOOK_BYTES)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return known


class TailReader(DataSourceStreamReader):
    """Lines that begin in a range of bytes belong to it; ``taskbytes`` is the length of a range."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.bytes = int(options.get("taskbytes", options.get("taskBytes", TASK_BYTES)))

    def files(self) -> dict[str, str]:
        if os.path.isdir(self.path):
            return {n: os.path.join(self.path, n) for n in sorted(os.listdir(self.path)) if n[0] not in "._" and os.path.isfile(os.path.join(self.path, n))}
        return {os.path.basename(self.path): self.path} if os.path.exists(self.path) else {}

    def initialOffset(self) -> dict:
        return {"read": json.dumps({})}

    def latestOffset(self) -> dict:
        known = getattr(self, "seen", {})
        self.seen = {name: complete_bytes(path, known.get(name, 0)) for name, path in self.files().items()}
        return {"read": json.dumps(self.seen)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, upto, files = json.loads(start["read"]), json.loads(end["read"]), self.files()
        out: list[InputPartition] = []
        for name, last in upto.items():
            first = before.get(name, 0)
            if last < first:
                raise LogCutError(f"{name} has {last} whole bytes, of which {first} were read")
            out += [ByteRange(files[name], name, at, min(at + self.bytes, last)) for at in range(first, last, self.bytes)]
        return out

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            at = partition.start
            if at:
                # the line that goes on here belongs to the range before; batches begin behind a line feed
                f.seek(at - 1)
                at = at - 1 + len(f.readline())
            while at < partition.end:
                line = f.readline()
                yield partition.name, at, line.rstrip(b"\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``spark.readStream.format("tail").load(path)``: file, at (the byte at which the line begins), line."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


def tail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The stream of the lines (file, at, line) of a growing file, or of those of a folder; empty lines are lines."""
    ship(spark)
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").options(**options).load(path)


def metric_lines(lines: DataFrame) -> DataFrame:
    """The rows of metric logs among ``lines``: ts and the metrics as numbers; "unknown" and columns that a row does not
    have yet are null. Headers and empty lines are left out, columns beyond the known ones too."""
    names = [c.split()[0] for c in METRICS.split(", ")]
    parts = F.split("line", "\t")
    rows = lines.where((F.col("line") != "") & ~F.col("line").startswith(names[0] + "\t"))
    value = lambda i: F.try_element_at(parts, F.lit(i + 1))
    return rows.select("file", "at", F.try_to_timestamp(value(0)).alias("ts"), *[value(i).try_cast("double").alias(c) for i, c in enumerate(names) if i])
