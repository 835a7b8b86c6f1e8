"""Classification in file order: what a run sends, against a pass over the files one by one."""

import json

import pytest

from tidemark.operators import classify
from tidemark.operators.state import latest_verdicts
from tidemark.sources.corpus import append_verdicts, read_cache

LINES = "relpath string, line_no long, line binary"


class Moody:
    """Flags chunks with ``bad``; gives no verdict in a chunk with ``mute:<other line>`` beside it."""

    def run(self, chunk, timeout):
        lines = chunk.decode().split("\n")
        if any(x.startswith("mute") for x in lines):
            return b"no verdict"
        return json.dumps({"flagged": any("bad" in x for x in lines)}).encode()


def one_by_one(files, known, most):
    """{path: [total, hits, misses, chunks, oversize, flagged, deferred]}, the calls, and the cache."""
    cache, out, calls = dict(known), {}, []
    for rel in sorted(files):
        misses = [x for x in files[rel] if x not in cache]
        chunks, over = classify.chunk_lines([x.encode() for x in misses], most)
        flagged = deferred = 0
        for chunk in chunks:
            said = classify.parse_verdict(Moody().run(b"\n".join(chunk), 1))
            calls.append((rel, len(chunk), said and said["flagged"]))
            if said is None:
                deferred += 1
                continue
            flagged |= said["flagged"]
            cache.update({x.decode(): said["flagged"] for x in chunk})
        out[rel] = (len(files[rel]), len(files[rel]) - len(misses), len(misses), len(chunks), len(over), bool(flagged), deferred)
    return out, calls, cache


def ran(spark, files, known=(), most=40, keep=None, **options):
    lines = spark.createDataFrame([(rel, i, bytearray(x.encode())) for rel, xs in files.items() for i, x in enumerate(xs)], LINES)
    cached = lines.where(lines.line.cast("string").isin(*known) if known else "false").selectExpr("sha2(line, 256) as line_hash")
    run = classify.classify_lines(lines.repartition(4), cached, Moody, most, keep, sleep=lambda s: None, attempts=2, **options)
    return run, {r.relpath: tuple(r)[1:] for r in run.files.collect()}


@pytest.mark.parametrize("in_flight", [1, 4])
def test_as_one_by_one(spark, in_flight):
    files = {f"f{i}": [f"line {i}", "common", f"shared {i // 2}", "bad line" if i % 3 == 0 else "good", "common", "x" * 50, f"line {i}"] for i in range(6)}
    kept = []
    run, got = ran(spark, files, ["shared 1"], keep=lambda v: kept.extend(tuple(r) for r in v.collect()), in_flight=in_flight)
    want, calls, cache = one_by_one(files, {"shared 1": False}, 40)
    assert got == want
    assert sorted((r.relpath, r.chunk_lines, r.flagged) for r in run.events.collect()) == sorted(calls)
    assert run.waves == 1
    assert len(kept) == len(cache) - 1
    metrics = classify.run_metrics(run).first()
    assert (metrics.dispatched, metrics.total_files, metrics.oversized_lines_total) == (len(calls), 6, 6)
    assert metrics.files_flagged == sum(w[5] for w in want.values())


def test_one_line_in_six_files_costs_one_call(spark):
    run, got = ran(spark, {f"f{i}": ["the same"] for i in range(6)})
    assert [(r.relpath, r.attempts, r.wave) for r in run.events.collect()] == [("f0", 1, 0)]
    assert [got[f"f{i}"][1:3] for i in range(6)] == [(0, 1)] + [(1, 0)] * 5


def test_a_deferred_line_passes_on_to_the_next_file(spark):
    files = {"a": ["mute me", "shared"], "b": ["shared"], "c": ["shared", "mute me"], "d": ["shared"]}
    run, got = ran(spark, files)
    events = sorted((r.wave, r.relpath, r.status, r.attempts) for r in run.events.collect())
    assert events == [(0, "a", "deferred", 2), (1, "b", "ok", 1), (1, "c", "deferred", 2)]
    assert got["b"][:3] == (1, 0, 1)
    assert got["d"][:3] == (1, 1, 0)
    assert got["c"][:3] == (2, 1, 1)
    assert got["a"][6] == 1


def test_the_cache_is_a_table(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_cache(spark, path).count() == 0
    for verdict in ("FLAGGED", "CLEARED", "FLAGGED", "CLEARED"):
        append_verdicts(path, spark.createDataFrame([("h", verdict), (verdict, verdict)], "line_hash string, verdict string"))
    assert {tuple(r) for r in latest_verdicts(read_cache(spark, path)).collect()} == {("h", "CLEARED"), ("FLAGGED", "FLAGGED"), ("CLEARED", "CLEARED")}
    old = tmp_path / "old.jsonl"
    old.write_text('{"line_hash": "h", "verdict": "CLEARED"}\n\n{"line_hash": "k", "verdict": "CLEARED"}\n')
    append_verdicts(str(old), spark.createDataFrame([("h", "FLAGGED")], "line_hash string, verdict string"))
    assert {tuple(r) for r in latest_verdicts(read_cache(spark, str(old))).collect()} == {("h", "FLAGGED"), ("k", "CLEARED")}


def test_no_lines(spark):
    run, got = ran(spark, {"a": ["x"]}, ["x"])
    assert run.waves == 0
    assert got == {"a": (1, 1, 0, 0, 0, False, 0)}
    assert classify.run_metrics(run).first().dispatched == 0
