"""Growing logs as a stream: restarts, cut last lines, and lines across ranges of bytes."""

import random

import pytest
from pyspark.errors import StreamingQueryException

from tidemark.streaming import growth, tail


def follow(spark, path, tmp_path, task_bytes="10"):
    out = growth.replayed(spark, tail.tail(spark, str(path), taskBytes=task_bytes), str(tmp_path / "out"), str(tmp_path / "state"))
    return sorted((r.file, r.at, r.line) for r in out.collect())


def whole_lines(path):
    data, out, at = path.read_bytes(), [], 0
    for line in data.split(b"\n")[:-1]:
        out.append((path.name, at, line.decode("utf-8", "replace")))
        at += len(line) + 1
    return out


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    rng = random.Random(7)
    log = tmp_path / "log"
    log.mkdir()
    names = ["a.tsv", "b.tsv"]
    for step in range(5):
        for name in names[: 1 + step // 2]:
            with open(log / name, "ab") as f:
                for _ in range(rng.randint(0, 12)):
                    f.write(b"x" * rng.choice([0, 1, 9, 10, 11, 60]) + rng.choice([b"", "é".encode(), b"\xff"]) + rng.choice([b"\n", b"\n", b"\r\n"]))
                f.write(rng.choice([b"", b"cut li", b"cut \xc3"]))
        (log / "_ignored").write_bytes(b"no\n")
        want = sorted(x for name in names if (log / name).exists() for x in whole_lines(log / name))
        assert follow(spark, log, tmp_path) == want
    assert follow(spark, log, tmp_path) == want


def test_ranges_of_bytes(tmp_path):
    log = tmp_path / "log.txt"
    log.write_bytes(b"\n\nab\n" + b"c" * 30 + b"\nd\n\ncut")
    assert tail.complete_bytes(str(log), 0) == log.stat().st_size - 3
    for size in range(1, 45):
        reader = tail.TailReader({"path": str(log), "taskbytes": str(size)})
        got = [row for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for row in reader.read(p)]
        assert got == whole_lines(log)


def test_a_file_that_was_cut_is_an_error(spark, tmp_path):
    log = tmp_path / "log.txt"
    log.write_bytes(b"one\ntwo\n")
    assert len(follow(spark, log, tmp_path)) == 2
    log.write_bytes(b"one\n")
    with pytest.raises(StreamingQueryException, match="of which 8 were read"):
        follow(spark, log, tmp_path)


def test_metrics_with_columns_that_came_later(spark, tmp_path):
    log = tmp_path / "health.tsv"
    log.write_text("timestamp\tdisk_pct\n2024-05-01T10:00:00\t71\n\n2024-05-01T11:00:00\tunknown\t40\t0\t0\t1\t5\t60\t55\t0.5\t41\textra\nno time\t1\n")
    out = growth.replayed(spark, tail.metric_lines(tail.tail(spark, str(log))), str(tmp_path / "out"), str(tmp_path / "state")).orderBy("at").collect()
    assert [(r.ts and r.ts.hour, r.disk_pct, r.dimm1_temp, r.dimm2_temp) for r in out] == [(10, 71.0, None, None), (11, None, 40.0, 41.0), (None, 1.0, None, None)]
