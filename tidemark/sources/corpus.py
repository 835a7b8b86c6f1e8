"""Sources and sinks: a tree of .jsonl and .txt files, append-only logs, metric tables, reports."""

from __future__ import annotations

import json
import os
import time
from collections import deque
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tree import SUFFIXES, UnsafeTargetError, assert_safe_target, list_tree, read_files  # noqa: F401

CACHE = "line_hash string, verdict string, seq long"
LEDGER = "v int, at string, content_hash string, decision string, reason string, path_hint string, operator string"
METRICS = "timestamp string, disk_pct string, dimm1_temp string, zombies string, failed_units string, gpu_pm string, journal_size_mb string, cpu_tctl string, gpu_temp string, load1 string, dimm2_temp string"


def list_files(root: str) -> list[tuple[str, str, int, int]]:
    """Every .jsonl and .txt file below ``root`` (dot folders, leading underscores and empty files
    included), by relative path, with its modification time in nanoseconds and size."""
    out = []
    for folder, _, names in os.walk(root):
        for name in names:
            suffix = os.path.splitext(name)[1]
            if suffix in SUFFIXES:
                at = os.path.join(folder, name)
                stat = os.stat(at)
                out.append((os.path.relpath(at, root), suffix, stat.st_mtime_ns, stat.st_size))
    return sorted(out)


def read_corpus(spark: SparkSession, root: str, content: bool = True, most_text: int | None = None) -> DataFrame:
    """The .jsonl and .txt files below ``root``: relpath, suffix, mtime_ns, size and, unless left out, content.

    Tasks list and read; a .txt file of more than ``most_text`` bytes is not opened and has no content."""
    files = list_tree(spark, root)
    return read_files(files, root, most_text) if content else files


def strict_text(content) -> F.Column:
    """UTF-8 text, null if the bytes are not valid."""
    return F.try_validate_utf8(content.cast("string"))


def jsonl_lines(files: DataFrame) -> DataFrame:
    """(relpath, line_no, raw, is_last): lines parted by LF only, blank ones kept, of valid UTF-8 files."""
    from tidemark.functions.text import lines_of

    text = F.regexp_replace(strict_text(F.col("content")), r"\r\n?", "\n")
    lines = files.where("suffix = '.jsonl'").select("relpath", lines_of(text).alias("lines"))
    return lines.select("relpath", F.size("lines").alias("n"), F.posexplode("lines").alias("line_no", "raw")).select("relpath", F.col("line_no").cast("long").alias("line_no"), "raw", (F.col("line_no") == F.col("n") - 1).alias("is_last"))


def tolerant_lines(files: DataFrame) -> DataFrame:
    """Non-blank lines that are JSON, of files read with replacement of invalid bytes."""
    from tidemark.functions.text import LINE_BREAK

    text = F.make_valid_utf8(F.col("content").cast("string"))
    lines = files.where("suffix = '.jsonl'").select("relpath", F.posexplode(F.split(text, LINE_BREAK)).alias("line_no", "raw"))
    return lines.where((F.trim("raw") != "") & F.try_parse_json("raw").isNotNull())


def byte_lines(files: DataFrame) -> DataFrame:
    """(relpath, line_no, line): lines as bytes, parted by LF, blank ones left out."""
    # one character for each byte keeps every byte apart from the line feeds
    latin = F.decode(F.col("content"), "ISO-8859-1")
    lines = files.select("relpath", F.posexplode(F.split(latin, "\n")).alias("line_no", "one"))
    return lines.where(F.trim("one") != "").select("relpath", F.col("line_no").cast("long").alias("line_no"), F.encode("one", "ISO-8859-1").alias("line"))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def _is_file(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The append-only verdict log (line_hash, verdict, seq); a missing one is empty.

    ``seq`` orders the entries as written. The log is a folder, in which files and folders follow each other by name, or one
    file; what was appended to a file lies in the folder of its name with ``.d`` behind it."""
    out = None
    for nr, at in enumerate((path, path + ".d")):
        if _exists(spark, at):
            rows = spark.read.schema("line_hash string, verdict string").option("recursiveFileLookup", True).json(at)
            place = F.struct(F.lit(nr).alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
            rows = rows.select("line_hash", "verdict", place.alias("seq")).where("line_hash is not null")
            out = rows if out is None else out.union(rows)
    return spark.createDataFrame([], CACHE) if out is None else out


def append_verdicts(path: str, verdicts: DataFrame) -> None:
    """Add the table ``verdicts`` (line_hash, verdict) to the log, as files of a new folder that tasks write."""
    spark = verdicts.sparkSession
    folder = path + ".d" if _is_file(spark, path) else path
    verdicts.select("line_hash", "verdict").write.json(f"{folder.rstrip('/')}/{time.time_ns():020d}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The append-only override log with defaults for path_hint and operator; a missing file is an empty log."""
    if not _exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    df = spark.read.schema(LEDGER).json(path)
    return df.withColumn("path_hint", F.coalesce("path_hint", F.lit(""))).withColumn("operator", F.coalesce("operator", F.lit("unknown")))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated metric log with a header; later columns may be missing in old rows; "unknown" is null."""
    df = spark.read.schema(METRICS).option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.select("timestamp", *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in df.columns[1:]])


def stream_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The metric log as a stream of the files of a folder, with ts, the time as a timestamp."""
    rows = spark.readStream.schema(METRICS).option("sep", "\t").option("header", True).csv(folder)
    return rows.select(F.expr("try_to_timestamp(timestamp)").alias("ts"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in rows.columns[1:]])


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("RuleID string, File string").option("multiLine", True).json(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def append_lines(path: str, rows: list[dict], header: list[str] | None = None) -> None:
    """Append JSON lines, or tab-separated rows with a header where the file is new."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    new = not os.path.exists(path)
    with open(path, "a", encoding="utf-8") as f:
        if header and new:
            f.write("\t".join(header) + "\n")
        for r in rows:
            f.write(("\t".join(str(r.get(h, "unknown")) for h in header) if header else json.dumps(r, ensure_ascii=False)) + "\n")


def write_file_atomically(path: str, data: bytes | Callable[[str], None], verify=None) -> None:
    """Write beside the target (bytes, or by a function that gets the path), verify, then replace; nothing is left behind after an error."""
    tmp = path + ".tmp"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    try:
        if callable(data):
            data(tmp)
        else:
            with open(tmp, "wb") as f:
                f.write(data)
        if verify:
            verify(tmp)
        os.replace(tmp, path)
    except BaseException:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise


def retain(lines: DataFrame, keep: int, order_col: str = "line_no") -> DataFrame:
    """The last ``keep`` lines of a log."""
    return lines.orderBy(F.desc(order_col)).limit(keep)


def trim_log(path: str, keep: int = 5000, over_bytes: int = 5 * 1024 * 1024) -> bool:
    """Cut a log of more than ``over_bytes`` to its last ``keep`` lines; whether it was cut. A missing log stays missing."""
    if not os.path.exists(path) or os.path.getsize(path) <= over_bytes:
        return False
    with open(path, "rb") as f:
        last = deque(f, maxlen=keep)
    write_file_atomically(path, b"".join(last))
    return True


def delete_expired(root: str, now_ns: int, days: int = 30) -> list[str]:
    """Delete the files below ``root`` (on the driver's machine) that ``expired`` names, and return their paths."""
    before = now_ns - days * 86_400 * 1_000_000_000
    gone = [rel for rel, _, mtime, _ in list_files(root) if mtime < before]
    for rel in gone:
        os.unlink(os.path.join(root, rel))
    return gone


def expired(files: DataFrame, now_ns: int | Column, days: int = 30) -> DataFrame:
    """Files last changed more than ``days`` before ``now_ns``."""
    now = now_ns if isinstance(now_ns, Column) else F.lit(now_ns)
    return files.where(F.col("mtime_ns") < now - F.lit(days * 86_400 * 1_000_000_000))
