"""A sanitized mirror of a corpus: redact every file, report, keep the mirror clean, gate.

Files are processed by tasks (one Python pass each); errors of known kinds become rows, all others
abort the run. Counts, buckets and gates are aggregations over one table with a row for each file.
"""

from __future__ import annotations

import datetime
import json
import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import jsonwalk
from tidemark.functions.redaction import Redactor
from tidemark.functions.text import content_hash
from tidemark.operators.compare import differing_parts
from tidemark.shipping import ship
from tidemark.sources.corpus import read_corpus, write_file_atomically
from tidemark.sources.scratch import written_table
from tidemark.sources.tree import SUFFIXES, assert_safe_target, delete_files, list_tree, read_files, write_tree

MOST_TEXT_BYTES = 8 * 1024 * 1024
MOST_SPAN = 64 * 1024
SKIP_CEILING = 3
RESULT = (
    "relpath string, suffix string, error string, src_lines long, mirror_lines long, collapsed boolean, "
    "entity_counts map<string,long>, output binary"
)
#: Fixed value: the kinds of text errors that have a bucket of their own; any other is an OS error.
BUCKETS = {
    "OversizeTextError": "files_skipped_oversize",
    "UnicodeDecodeError": "files_skipped_decode",
    "LineGrowthError": "files_skipped_line_growth",
    "AnomalousRedactionSpanError": "files_skipped_anomalous_span_txt",
}


class OversizeTextError(ValueError):
    pass


class LineGrowthError(ValueError):
    pass


class AnomalousRedactionSpanError(ValueError):
    pass


PER_FILE = (OversizeTextError, LineGrowthError, AnomalousRedactionSpanError, UnicodeDecodeError, jsonwalk.MalformedLineError, OSError)


def redact_text(data: bytes, redactor: Redactor, stats: Counter) -> tuple[str, int, int, bool]:
    """A .txt file: masked text, LF counts before and after, and whether lines were merged."""
    if len(data) > MOST_TEXT_BYTES:
        raise OversizeTextError(f"{len(data)} bytes")
    text = data.decode("utf-8")
    out, types, spans = redactor.redact(text, "broad_pii")
    if any(e - s > MOST_SPAN for s, e in spans):
        raise AnomalousRedactionSpanError(f"a span of more than {MOST_SPAN} characters")
    if text.endswith("\n") and not out.endswith("\n"):
        out += "\n"
    if out.count("\n") > text.count("\n") or out.count("\r") > text.count("\r"):
        raise LineGrowthError("redaction added lines")
    if types and redactor.redact(out, "broad_pii")[1]:
        raise AssertionError("a finding is left after redaction")
    stats.update(types)
    collapsed = out.count("\n") < text.count("\n") or out.count("\r") < text.count("\r")
    return out, text.count("\n"), out.count("\n"), collapsed


def redact_jsonl(data: bytes, redactor: Redactor, stats: Counter, tolerate_last: bool) -> tuple[str, int, int, bool]:
    """A .jsonl file, line by line; every output line is JSON again."""
    text = data.decode("utf-8")
    lines, _ = jsonwalk.mask_records(text, redactor, stats, tolerate_last)
    for line in lines:
        if line:
            json.loads(line)
    out = "\n".join(lines) + ("\n" if lines and text.endswith(("\n", "\r")) else "")
    return out, len(text.splitlines()), len(out.splitlines()), False


def redact_files(files: DataFrame, tolerate_last: bool = True) -> DataFrame:
    """``files`` (relpath, suffix, content) to a table of results; output is null where an error is told.

    A file without content, of which the size is known, is one that was too large to be read."""
    ship(files.sparkSession)
    size = F.col("size") if "size" in files.columns else F.length("content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        redactor = Redactor()
        for frame in frames:
            rows = []
            for rel, suffix, data, n in zip(frame.relpath, frame.suffix, frame.content, frame["size"], strict=True):
                stats: Counter = Counter()
                try:
                    if data is None:
                        raise OversizeTextError(f"{n:.0f} bytes")
                    data = bytes(data)
                    out, src, dst, collapsed = redact_jsonl(data, redactor, stats, tolerate_last) if suffix == ".jsonl" else redact_text(data, redactor, stats)
                    rows.append((rel, suffix, None, src, dst, collapsed, dict(stats), out.encode()))
                except PER_FILE as e:
                    rows.append((rel, suffix, f"{type(e).__name__}: {e}", None, None, None, {}, None))
            yield pd.DataFrame(rows, columns=["relpath", "suffix", "error", "src_lines", "mirror_lines", "collapsed", "entity_counts", "output"]).astype({"src_lines": "Int64", "mirror_lines": "Int64", "collapsed": "boolean"})

    return files.select("relpath", "suffix", "content", size.alias("size")).mapInPandas(run, RESULT)


def check_text(data: bytes, suffix: str, redactor: Redactor, stats: Counter) -> None:
    """Count the findings of a file; invalid bytes are replaced, lines of a .jsonl file that are not JSON left out."""
    if suffix != ".jsonl":
        if len(data) > MOST_TEXT_BYTES:
            raise OversizeTextError(f"{len(data)} bytes")
        stats.update(redactor.redact(data.decode("utf-8", "replace"), "broad_pii")[1])
        return
    for line in data.decode("utf-8", "replace").splitlines():
        try:
            value = json.loads(line)
        except (json.JSONDecodeError, RecursionError):
            continue
        jsonwalk.mask_document(value, redactor, stats)


def check_files(files: DataFrame) -> DataFrame:
    """Dry run: (relpath, error, entity_counts) of every file; only a .txt file over the size limit is not read."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        redactor = Redactor()
        for frame in frames:
            rows = []
            for rel, suffix, data, n in zip(frame.relpath, frame.suffix, frame.content, frame["size"], strict=True):
                stats: Counter = Counter()
                error = None
                try:
                    if data is None:
                        raise OversizeTextError(f"{n:.0f} bytes")
                    check_text(bytes(data), suffix, redactor, stats)
                except OversizeTextError as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((rel, error, dict(stats)))
            yield pd.DataFrame(rows, columns=["relpath", "error", "entity_counts"])

    size = F.col("size") if "size" in files.columns else F.length("content")
    return files.select("relpath", "suffix", "content", size.alias("size")).mapInPandas(run, "relpath string, error string, entity_counts map<string,long>")


def summarize(results: DataFrame, unchanged: DataFrame) -> DataFrame:
    """One row: counts by kind, skip buckets, ceilings."""
    ok, txt = F.col("error").isNull(), F.col("suffix") == ".txt"
    kind = F.regexp_extract("error", "^([A-Za-z]+):", 1)
    named = [F.count_if(txt & ~ok & (kind == k)).alias(v) for k, v in BUCKETS.items()]
    other = F.count_if(txt & ~ok & ~kind.isin(*BUCKETS)).alias("files_skipped_os_error_txt")
    row = results.agg(
        F.count("*").alias("files_in_snapshot"), F.count_if(ok).alias("files_processed"), F.count_if(~ok).alias("files_errored"),
        F.count_if(~txt).alias("files_in_snapshot_jsonl"), F.count_if(txt).alias("files_in_snapshot_txt"),
        F.count_if(ok & ~txt).alias("files_processed_jsonl"), F.count_if(ok & txt).alias("files_processed_txt"),
        *named, other, F.count_if(F.col("collapsed") & txt).alias("files_line_collapsed_txt"),
        F.coalesce(F.bool_or(~ok & ~txt), F.lit(False)).alias("any_jsonl_error"),
    )
    skips = sum((F.col(c) for c in (*BUCKETS.values(), "files_skipped_os_error_txt")), F.lit(0))
    same = unchanged.agg(F.count("*").alias("unchanged_count"), F.lit(1).alias("one"))
    row = row.withColumn("one", F.lit(1)).join(same, "one").drop("one")  # one row each
    return row.select("*", (skips > SKIP_CEILING).alias("skip_ceiling_exceeded"), ((skips > SKIP_CEILING) | F.col("any_jsonl_error")).alias("failed"))


def unchanged_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files with equal time and size in both snapshots."""
    return before.join(after, ["relpath", "mtime_ns", "size"]).select("relpath")


def stale_files(mirror: DataFrame, processed: DataFrame) -> DataFrame:
    """Mirror files that this run did not write."""
    return mirror.join(processed.select("relpath"), "relpath", "left_anti")


def hash_mismatches(mirror: DataFrame, published: DataFrame) -> DataFrame:
    """Mirror files whose published copy (below projects/) differs or is missing. Only parts that differ are joined."""
    ours = mirror.select(F.concat(F.lit("projects/"), "relpath").alias("path"), content_hash(F.col("content")).alias("hash"))
    theirs = published.select(F.col("relpath").alias("path"), content_hash(F.col("content")).alias("hash"))
    ours, theirs = differing_parts(ours, theirs, ["path"])
    met = ours.join(theirs.withColumnRenamed("hash", "theirs"), "path", "left").where(~F.col("hash").eqNullSafe(F.col("theirs")))
    return met.select(F.expr("substr(path, length('projects/') + 1)").alias("relpath"))


def hash_changes(first: DataFrame, second: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Files of ``unchanged`` whose hashes differ between two runs. Only parts of the runs that differ are joined."""
    one, two = differing_parts(first.select("relpath", "hash"), second.select("relpath", "hash"), ["relpath"])
    both = one.withColumnRenamed("hash", "h1").join(two.withColumnRenamed("hash", "h2"), "relpath")
    return both.where("h1 <> h2").join(unchanged, "relpath", "left_semi").select("relpath")


def counts_by_file(results: DataFrame) -> DataFrame:
    """(relpath, entity_type, n) of all detections."""
    return results.select("relpath", F.explode("entity_counts").alias("entity_type", "n"))


def corpus_totals(results: DataFrame) -> DataFrame:
    return counts_by_file(results).groupBy("entity_type").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "entity_type")


def residue(mirror: DataFrame) -> DataFrame:
    """(relpath, entity_type, n): what a scan of the finished mirror still finds. Own placeholders are no findings."""
    return counts_by_file(check_files(mirror))


def _write_parts(path: str, head: dict, lists: dict[str, tuple[str, Iterator[str]]]) -> None:
    """A JSON object with the entries of ``head`` and, member by member as they arrive, its long ``lists``: name to brackets and JSON texts."""

    def put(tmp: str) -> None:
        with open(tmp, "w", encoding="utf-8") as f:
            f.write("{")
            for i, (name, value) in enumerate(head.items()):
                f.write((",\n" if i else "\n") + f"{json.dumps(name)}: {json.dumps(value)}")
            for i, (name, (brackets, texts)) in enumerate(lists.items()):
                f.write((",\n" if head or i else "\n") + (f"{json.dumps(name)}: " if name else "") + brackets[:-1])
                for k, text in enumerate(texts):
                    f.write((",\n  " if k else "\n  ") + text)
                f.write(brackets[1:])
            f.write("\n}\n")

    write_file_atomically(path, put)


def _write_snapshot(path: str, files: DataFrame) -> None:
    rows = files.orderBy("relpath").toLocalIterator()
    _write_parts(path, {}, {"": ("  ", (f"{json.dumps(r.relpath)}: {json.dumps({'mtime_ns': r.mtime_ns, 'size': r['size']})}" for r in rows))})


def write_summary(path: str, results: DataFrame, summary: DataFrame, **head) -> None:
    """The run's summary as a file: counts, errors and line counts by path, skipped paths by kind. Lists are written as they arrive."""
    row = summary.first().asDict()
    head |= {k: v for k, v in row.items() if k not in ("any_jsonl_error", "failed", "skip_ceiling_exceeded")}
    wrong = results.where("error is not null").orderBy("relpath")
    kept = results.where("error is null").orderBy("relpath")
    kind = F.regexp_extract("error", "^([A-Za-z]+):", 1)
    bucket = F.coalesce(*[F.when(kind == k, v) for k, v in BUCKETS.items()], F.lit("files_skipped_os_error_txt"))
    by_kind = wrong.where("suffix = '.txt'").select("relpath", bucket.alias("bucket"))

    def pairs(rows: DataFrame, column: str) -> Iterator[str]:
        return (f"{json.dumps(r.relpath)}: {json.dumps(r[column])}" for r in rows.select("relpath", column).toLocalIterator())

    def skipped() -> Iterator[str]:
        for name in (*BUCKETS.values(), "files_skipped_os_error_txt"):
            yield f"{json.dumps(name)}: [" + ", ".join(json.dumps(r.relpath) for r in by_kind.where(F.col("bucket") == name).toLocalIterator()) + "]"

    _write_parts(
        path,
        head | {"line_count_convention": {"jsonl": "splitlines()", "txt": "count(\\n)"}},
        {"errors": ("{}", pairs(wrong, "error")), "src_line_counts": ("{}", pairs(kept, "src_lines")), "mirror_line_counts": ("{}", pairs(kept, "mirror_lines")), "skipped_txt_paths": ("{}", skipped())},
    )


def clean_mirror(spark: SparkSession, target: str, processed: DataFrame) -> None:
    """Left-over .tmp files go, then files of earlier runs; anything but .jsonl and .txt that is left is an error. Tasks delete."""
    there = list_tree(spark, target, None)
    delete_files(there.where("suffix = '.tmp'"), target)
    ours = F.col("suffix").isin(*SUFFIXES)
    delete_files(stale_files(there.where(ours), processed), target)
    strange = [r.relpath for r in there.where(~ours & (F.col("suffix") != ".tmp")).limit(5).collect()]
    if strange:
        raise AssertionError(f"unexpected files in the mirror: {strange}")


def build_mirror(spark: SparkSession, source: str, target: str, protected: str | None = None, runs: str | None = None, run_id: str | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Write the mirror of ``source`` below ``target``: (results, summary, failed).

    The files of one listing are read, masked into a table and written from it as a transaction, so each is read once
    and a lost executor changes nothing. No target may lead into the protected tree, file by file. Both trees must be mounted on
    all executors. Left-over .tmp files and files of earlier runs are removed, then only .jsonl and .txt may be there. With ``runs`` the
    snapshots before and after and the summary are kept in a folder of the run there, and the summary, with the verdict
    on skipped files, beside the mirror as well."""
    assert_safe_target(target, protected or source)
    before = list_tree(spark, source)
    results = written_table(redact_files(read_files(before, source, MOST_TEXT_BYTES)), "results")
    done = results.where("error is null")
    write_tree(done.select("relpath", "output"), target, protected or source)
    results = results.drop("output")
    clean_mirror(spark, target, done)
    after = list_tree(spark, source)
    summary = written_table(summarize(results, unchanged_files(before, after)), "summary")
    verdict = summary.first()
    if runs:
        run_id = run_id or datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
        for name, files in (("snapshot-pre", before), ("snapshot-post", after)):
            _write_snapshot(os.path.join(runs, run_id, f"{name}.json"), files)
        told = {"run_id": run_id, "source_root": source, "mirror_root": target}
        write_summary(os.path.join(runs, run_id, "summary.json"), results, summary, **told)
        beside = os.path.join(os.path.dirname(os.path.abspath(target)), "summary.json")
        write_summary(beside, results, summary, **told, skip_ceiling_exceeded=bool(verdict.skip_ceiling_exceeded))
    return results, summary, bool(verdict.failed)


def publication_checks(spark: SparkSession, target: str) -> dict[str, bool | None]:
    """Gates read from a finished run: the ceiling is exactly False in the summary file, and a scan of the mirror finds nothing."""
    at = os.path.join(os.path.dirname(os.path.abspath(target)), "summary.json")
    ceiling = None
    if os.path.exists(at):
        with open(at, encoding="utf-8") as f:
            ceiling = json.load(f).get("skip_ceiling_exceeded") is False
    return {"ceiling": ceiling, "residue": residue(read_corpus(spark, target, most_text=MOST_TEXT_BYTES)).isEmpty()}


def gates(**checks: bool) -> tuple[bool, list[str]]:
    """All gates together, and the names of those that failed. A gate whose figure is missing (None) fails."""
    failed = sorted(k for k, v in checks.items() if v is not True)
    return not failed, failed


def gate_columns(**checks: Column) -> list[Column]:
    """(passed, failed) over one row of figures: all gates together, and the names of those that failed, in order; an unknown one fails."""
    failed = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in sorted(checks.items())])), ",")
    return [(failed == "").alias("passed"), failed.alias("failed")]


def session_gate(jsonl: int, oversize: int, parse_drops: int, discovered: int, committed: int) -> dict[str, bool]:
    return {"discovered": discovered == jsonl - oversize - parse_drops, "committed": committed == discovered}
