"""State kept as append-only logs: verdicts by line hash, override decisions by content hash."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.corpus import append_lines

DECISIONS, VERDICTS = ("allow", "deny"), ("CLEARED", "FLAGGED")


def latest_verdicts(cache: DataFrame) -> DataFrame:
    """(line_hash, verdict): the last write wins."""
    return cache.groupBy("line_hash").agg(F.max_by("verdict", "seq").alias("verdict"))


def current_decisions(ledger: DataFrame) -> DataFrame:
    """The winning entry for each content hash: the latest `at` (as text), deny before allow on a tie."""
    best = F.max_by(F.struct(*ledger.columns), F.struct("at", "decision"))
    return ledger.groupBy("content_hash").agg(best.alias("e")).select("e.*")


def decision_for(ledger: DataFrame, content_hash: str) -> DataFrame:
    return current_decisions(ledger.where(F.col("content_hash") == content_hash))


def put_verdicts(path: str, verdicts: dict[str, str]) -> None:
    if bad := sorted(set(verdicts.values()) - set(VERDICTS)):
        raise ValueError(f"unknown verdicts {bad}")
    append_lines(path, [{"line_hash": h, "verdict": v} for h, v in verdicts.items()])


def append_decision(path: str, content_hash: str, decision: str, reason: str, path_hint: str = "", operator: str | None = None, at: str | None = None) -> dict:
    if decision not in DECISIONS:
        raise ValueError(f"decision must be one of {DECISIONS}, not {decision!r}")
    now = datetime.datetime.now(datetime.timezone.utc).isoformat()
    entry = {"v": 1, "at": at or now, "content_hash": content_hash, "decision": decision, "reason": reason, "path_hint": path_hint, "operator": operator or os.environ.get("USER", "unknown")}
    append_lines(path, [entry])
    return entry


def flag(path: str, content_hash: str, reason: str, **more: str) -> dict:
    return append_decision(path, content_hash, "deny", reason, **more)


def unflag(path: str, content_hash: str, reason: str = "unflagged", **more: str) -> dict:
    return append_decision(path, content_hash, "allow", reason, **more)


def log_redactions(path: str, counts: dict[str, int]) -> None:
    """Entity counts only, never values."""
    append_lines(path, [{"at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "counts": dict(counts)}])


def split_by_cache(lines: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(misses, hits) of ``lines`` (with line_hash) against the cached verdicts."""
    known = latest_verdicts(cache).select("line_hash")
    return lines.join(known, "line_hash", "left_anti"), lines.join(known, "line_hash", "left_semi")
