"""External classification: seeded sample, byte-bounded chunks, dispatch with retries, metrics.

The caller is an object with run(chunk: bytes, timeout: float) -> bytes; the default one applies this
library's own rules and needs no network.
"""

from __future__ import annotations

import json
import random
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.redaction import Redactor
from tidemark.functions.rules import CREDENTIAL_PREFIX
from tidemark.operators.chunking import MOST_BYTES, chunk_files, chunk_lines  # noqa: F401
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.state import latest_verdicts
from tidemark.shipping import ship
from tidemark.sources.corpus import append_verdicts, byte_lines, read_cache, read_corpus
from tidemark.sources.scratch import written_table

EVENTS = (
    "relpath string, chunk_no int, status string, flagged boolean, attempts int, elapsed_seconds double, chunk_bytes long, chunk_lines int, "
    "events array<struct<attempt:int,outcome:string,elapsed_seconds:double>>"
)


def credential_files(files: DataFrame) -> DataFrame:
    """Files whose source text holds a fixed credential prefix."""
    return files.where(F.make_valid_utf8(F.col("content").cast("string")).rlike(CREDENTIAL_PREFIX)).select("relpath")


def seeded_sample(relpaths: DataFrame, n: int, seed: int = 0, exclude: DataFrame | None = None) -> DataFrame:
    """``n`` of the paths, the same ones for a seed wherever they lie: those of least hash."""
    left = relpaths.join(exclude, "relpath", "left_anti") if exclude is not None else relpaths
    return left.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "relpath"), 256), "relpath").limit(n).orderBy("relpath")


def select_sample(source: DataFrame, mirror: DataFrame, contrast: int = 10, seed: int = 0) -> DataFrame:
    """(relpath, kind): mirror files with credentials in their source, and a seeded contrast of others."""
    paths = mirror.select("relpath")
    hot = paths.join(credential_files(source), "relpath", "left_semi")
    other = seeded_sample(paths, contrast, seed, hot)
    return hot.withColumn("kind", F.lit("credential")).union(other.withColumn("kind", F.lit("contrast"))).orderBy("relpath")


def parse_verdict(stdout: bytes) -> dict | None:
    m = re.search(r"\{.*\}", stdout.decode("utf-8", "replace"), re.S)
    try:
        value = json.loads(m[0]) if m else None
    except json.JSONDecodeError:
        return None
    return value if isinstance(value, dict) and isinstance(value.get("flagged"), bool) else None


class RuleCaller:
    """Flags a chunk with any finding of the broad rules."""

    def __init__(self) -> None:
        self.redactor = Redactor()

    def run(self, chunk: bytes, timeout: float) -> bytes:
        found = self.redactor.analyze(chunk.decode("utf-8", "replace"), "broad")
        return json.dumps({"flagged": bool(found), "reason": ", ".join(sorted({f[0] for f in found}))}).encode()


class CapabilityError(RuntimeError):
    pass


def require_capability(help_text: str, option: str) -> None:
    """Refuse to dispatch with a caller that does not know a needed option."""
    if option not in help_text:
        raise CapabilityError(f"the caller does not offer {option}")


def dispatch_chunk(lines: list[bytes], caller, timeout: float = 60.0, attempts: int = 3, base_delay: float = 0.5, sleep=time.sleep) -> dict:
    """Up to ``attempts`` calls with jittered backoff; a call that fails or gives no verdict is tried again, then deferred."""
    events, verdict, took = [], None, 0.0
    for attempt in range(1, attempts + 1):
        start = time.monotonic()
        try:
            verdict = parse_verdict(caller.run(b"\n".join(lines), timeout))
            outcome, took = ("ok" if verdict else "malformed"), time.monotonic() - start
        except TimeoutError:
            outcome, took = "timeout", timeout
        except OSError as e:
            outcome, took = f"error: {e}", time.monotonic() - start
        events.append({"attempt": attempt, "outcome": outcome, "elapsed_seconds": took})
        if verdict:
            break
        if attempt < attempts:
            sleep(base_delay * 2 ** (attempt - 1) * (0.5 + random.random()))
    return {"status": "ok" if verdict else "deferred", "flagged": verdict["flagged"] if verdict else None, "attempts": len(events), "elapsed_seconds": took, "events": events}


def dispatch(chunks: DataFrame, make_caller=RuleCaller, in_flight: int = 1, **options) -> DataFrame:
    """A call event for each chunk that is not oversize. A task has up to ``in_flight`` calls under way, each thread with a caller
    of its own; events keep the order of the chunks."""
    ship(chunks.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = threading.local()

        def call(r) -> dict:
            if not hasattr(mine, "caller"):
                mine.caller = make_caller()
            lines = [bytes(x) for x in r.lines]
            d = dispatch_chunk(lines, mine.caller, **options)
            return {"relpath": r.relpath, "chunk_no": r.chunk_no, **d, "chunk_bytes": r.chunk_bytes, "chunk_lines": len(lines)}

        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                rows = list(pool.map(call, frame.itertuples()))
                if rows:
                    yield pd.DataFrame(rows)[["relpath", "chunk_no", "status", "flagged", "attempts", "elapsed_seconds", "chunk_bytes", "chunk_lines", "events"]].astype({"flagged": "boolean"})

    return chunks.where("not oversize").mapInPandas(run, EVENTS)


def file_verdicts(events: DataFrame) -> DataFrame:
    """A file is flagged if any of its chunks is; deferred chunks are counted."""
    return events.groupBy("relpath").agg(F.count("*").alias("chunks"), F.coalesce(F.bool_or("flagged"), F.lit(False)).alias("file_flagged"), F.count_if(F.col("status") == "deferred").alias("deferred_chunks"))


def cacheable_verdicts(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """(line_hash, verdict) of the lines of answered chunks, one for each line, of its last chunk; deferred ones give nothing."""
    answered = events.where("status = 'ok'").select("relpath", "chunk_no", "flagged")
    lines = chunks.join(answered, ["relpath", "chunk_no"]).select("relpath", "chunk_no", F.explode("lines").alias("line"), "flagged")
    said = F.when(F.col("flagged"), "FLAGGED").otherwise("CLEARED")
    return lines.groupBy(F.sha2("line", 256).alias("line_hash")).agg(F.max_by(said, F.struct("relpath", "chunk_no")).alias("verdict"))


def call_metrics(events: DataFrame) -> DataFrame:
    """One row: calls by status, latencies of answered and of all calls (exact medians), flag rate, bytes."""
    calls = written_table(events.select("status", "flagged", "elapsed_seconds", "chunk_bytes"), "calls")
    ok = F.col("status") == "ok"
    counts = calls.agg(
        F.count("*").alias("dispatched"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("deferred"),
        F.count_if(F.col("flagged")).alias("chunks_flagged"), F.try_divide(F.count_if(F.col("flagged")), F.count_if(ok)).alias("fraction"),
        F.coalesce(F.sum("chunk_bytes"), F.lit(0)).alias("total_bytes_dispatched"), F.lit(1).alias("one"),
    )
    kinds = F.explode(F.when(ok, F.array(F.lit("ok"), F.lit("all"))).otherwise(F.array(F.lit("all"))))
    took = exact_quantiles(calls.select(kinds.alias("kind"), "elapsed_seconds"), ["kind"], "elapsed_seconds", {"median": 0.5})
    of = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col(name)))
    stats = took.agg(*[of(kind, c).alias(f"{kind}_{name}") for kind in ("ok", "all") for name, c in (("min", "least"), ("median", "median"), ("max", "most"))], F.lit(1).alias("one"))
    both = counts.join(stats, "one")  # one row each
    order = ["dispatched", "ok", "deferred", "ok_min", "ok_median", "ok_max", "all_min", "all_median", "all_max", "chunks_flagged", "fraction", "total_bytes_dispatched"]
    return both.select(*order)


def misses_in_order(lines: DataFrame, cached: DataFrame, answered: DataFrame) -> DataFrame:
    """Lines (relpath, line_no, line_hash) that still need a call: not cached before the run, nor
    answered (line_hash, relpath) in a file of smaller path. Repeats within one file are all misses."""
    first = answered.groupBy("line_hash").agg(F.min("relpath").alias("first_file"))
    left = lines.join(cached.select("line_hash"), "line_hash", "left_anti").join(first, "line_hash", "left")
    return left.where(F.col("first_file").isNull() | (F.col("first_file") >= F.col("relpath"))).drop("first_file")


class Run(NamedTuple):
    """``files``: a row for each file (relpath, total_lines, cache_hit_lines, cache_miss_lines, chunks, oversized_lines, file_flagged,
    deferred_chunks); ``events``: the calls, with their wave; ``waves``: how many there were."""

    files: DataFrame
    events: DataFrame
    waves: int


def classify_lines(lines: DataFrame, cached: DataFrame, make_caller=RuleCaller, most: int = MOST_BYTES, keep: Callable[[DataFrame], None] | None = None, **options) -> Run:
    """Send each line (relpath, line_no, line) once, in the first file by path that has it, unless its hash is in ``cached`` (line_hash).

    A file's lines are sent in chunks; a line that stands in it several times is sent as often. Lines of a chunk
    that is deferred pass on to the next file that has them, wave by wave, until each is answered or was tried in all its files.
    So a file's chunks are those of a run in file order, except that what an earlier file could not settle is sent in chunks of its own.
    ``keep`` gets the verdicts (line_hash, verdict) of each wave, at the latest when its calls are done. Lines longer
    than ``most`` are never sent. A task that is run again calls again."""
    hashed = written_table(lines.select("relpath", "line_no", "line", F.sha2("line", 256).alias("line_hash")), "lines")
    new = hashed.join(cached.select("line_hash").distinct(), "line_hash", "left_anti")
    pending = written_table(new.where(F.length("line") <= most), "pending")
    sent, events, waves = [], None, 0
    while not pending.isEmpty():
        first = pending.groupBy("line_hash").agg(F.min("relpath").alias("relpath"))
        wave = written_table(pending.join(first, ["line_hash", "relpath"]), "wave")
        chunks = written_table(chunk_files(wave, most), "chunks")
        calls = written_table(dispatch(chunks, make_caller, **options).withColumn("wave", F.lit(waves)), "events")
        answered = written_table(cacheable_verdicts(calls, chunks), "answered")
        if keep:
            keep(answered)
        sent.append(wave.groupBy("relpath").agg(F.count("*").alias("sent")))
        events = calls if events is None else events.unionByName(calls)
        left = pending.join(answered.select("line_hash"), "line_hash", "left_anti")
        pending = written_table(left.join(first, ["line_hash", "relpath"], "left_anti"), "pending")
        waves += 1
    if events is None:
        events = lines.sparkSession.createDataFrame([], f"{EVENTS}, wave int")
    tried = hashed.groupBy("relpath").agg(F.count("*").alias("total_lines"))
    over = new.where(F.length("line") > most).groupBy("relpath").agg(F.count("*").alias("oversized_lines"))
    misses = None
    for one in sent:
        misses = one if misses is None else misses.unionByName(one)
    verdicts = file_verdicts(events)
    files = tried.join(over, "relpath", "left").join(verdicts, "relpath", "left")
    if misses is not None:
        files = files.join(misses.groupBy("relpath").agg(F.sum("sent").alias("sent")), "relpath", "left")
    else:
        files = files.withColumn("sent", F.lit(None).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    missed = zero(F.col("sent")) + zero(F.col("oversized_lines"))
    files = files.select(
        "relpath", "total_lines", (F.col("total_lines") - missed).alias("cache_hit_lines"), missed.alias("cache_miss_lines"), zero(F.col("chunks")).alias("chunks"),
        zero(F.col("oversized_lines")).alias("oversized_lines"), F.coalesce("file_flagged", F.lit(False)).alias("file_flagged"), zero(F.col("deferred_chunks")).alias("deferred_chunks"),
    )
    return Run(files, events, waves)


def run_metrics(run: Run) -> DataFrame:
    """One row: the figures of ``call_metrics`` with the files, those flagged, and all oversize lines."""
    calls = call_metrics(run.events).withColumn("one", F.lit(1))
    files = run.files.agg(
        F.count("*").alias("total_files"), F.count_if("file_flagged").alias("files_flagged"), F.coalesce(F.sum("oversized_lines"), F.lit(0)).alias("oversized_lines_total"),
        F.coalesce(F.sum("cache_hit_lines"), F.lit(0)).alias("cache_hit_lines"), F.coalesce(F.sum("cache_miss_lines"), F.lit(0)).alias("cache_miss_lines"), F.lit(1).alias("one"),
    )
    return calls.join(files, "one").drop("one")  # one row each


def write_metrics(path: str, metrics: DataFrame, picked: DataFrame, run: Run) -> None:
    """One JSON file: the metrics, the sample by kind, the files and the calls; lists are written as they arrive."""
    row = json.loads(metrics.toJSON().first())
    lists = {
        "credential_relpaths": picked.where("kind = 'credential'").select("relpath").orderBy("relpath"),
        "contrast_relpaths": picked.where("kind = 'contrast'").select("relpath").orderBy("relpath"),
        "files": run.files.orderBy("relpath"),
        "call_events": run.events.orderBy("wave", "relpath", "chunk_no"),
    }
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(row)[:-1])
        for name, rows in lists.items():
            f.write(f", {json.dumps(name)}: [")
            for i, text in enumerate(rows.toJSON().toLocalIterator()):
                f.write((",\n" if i else "\n") + (json.dumps(json.loads(text)["relpath"]) if name.endswith("relpaths") else text))
            f.write("]")
        f.write("}\n")


def classify_sample(
    spark: SparkSession, source: str, mirror: str, cache_path: str | None = None, contrast: int = 10, seed: int = 0, make_caller=RuleCaller, **options
) -> tuple[DataFrame, DataFrame, Run]:
    """(metrics, sample, run) over a sample of the mirror: lines with a cached verdict are not sent again,
    answered lines are added to the cache, so that a second run over the same files makes no calls.

    A caller that names options it ``needs`` must offer them in its ``help_text``, or nothing is sent."""
    caller = make_caller()
    for option in getattr(caller, "needs", ()):
        require_capability(caller.help_text(), option)
    files = read_corpus(spark, mirror)
    picked = written_table(select_sample(read_corpus(spark, source), files, contrast, seed), "sample")
    lines = byte_lines(files.join(picked, "relpath", "left_semi"))
    if cache_path:
        cached = written_table(latest_verdicts(read_cache(spark, cache_path)), "cached")
        run = classify_lines(lines, cached, make_caller, keep=lambda verdicts: append_verdicts(cache_path, verdicts), **options)
    else:
        run = classify_lines(lines, spark.createDataFrame([], "line_hash string"), make_caller, **options)
    return run_metrics(run), picked, run
