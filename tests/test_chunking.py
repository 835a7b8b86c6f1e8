"""Chunks of files that lie on many partitions against a plain next-fit pass."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.operators.chunking import chunk_files, chunk_lines, entered, pieces_of, summary_of

LINES = "relpath string, line_no long, line binary"


def next_fit(lines, most):
    chunks, over, size = [], [], 0
    for line in lines:
        if len(line) > most:
            over.append(line)
            continue
        step = len(line) + (1 if size else 0)
        if not chunks or size + step > most:
            chunks.append([])
            size, step = 0, len(line)
        chunks[-1].append(line)
        size += step
    return chunks, over


def some_lines(rng, n, most):
    return [b"x" * rng.choice([0, 0, 1, 2, 3, most // 3, most - 1, most, most + 1, rng.randint(0, most)]) for _ in range(n)]


@pytest.mark.parametrize("most", [3, 10, 37])
def test_blocks_by_their_summaries(most):
    rng = random.Random(most)
    for _ in range(400):
        lines = some_lines(rng, rng.randint(0, 25), most)
        assert chunk_lines(lines, most) == next_fit(lines, most)
        number, size, got = -1, 0, defaultdict(list)
        at = 0
        while at < len(lines):
            block = lines[at : at + rng.randint(1, 6)]
            at += len(block)
            for no, _, piece in pieces_of(block, most, number, size):
                if no >= 0:
                    got[no] += piece
            total, ahead, chunks, open_ = summary_of(np.array([len(x) for x in block if len(x) <= most], np.int64), most)
            number, size = entered({"total": total, "ahead": ahead.tolist(), "chunks": chunks.tolist(), "open": open_.tolist()}, number, size, most)
        assert [got[i] for i in range(len(got))] == next_fit(lines, most)[0]


@pytest.mark.parametrize("block_bytes", [60, 4_000_000])
def test_files(spark, block_bytes):
    rng = random.Random(block_bytes)
    files = {"large": some_lines(rng, 2500, 40), "other": some_lines(rng, 400, 40)} | {f"s{i}": some_lines(rng, rng.randint(1, 9), 40) for i in range(60)}
    rows = [(rel, 3 * i, bytearray(x)) for rel, lines in files.items() for i, x in enumerate(lines)]
    rng.shuffle(rows)
    got, over = defaultdict(dict), defaultdict(list)
    for r in chunk_files(spark.createDataFrame(rows, LINES).repartition(7), 40, block_bytes).collect():
        lines = [bytes(x) for x in r.lines]
        assert r.chunk_bytes == len(b"\n".join(lines))
        if r.oversize:
            over[r.relpath] += lines
        else:
            assert r.chunk_no not in got[r.relpath]
            got[r.relpath][r.chunk_no] = lines
    for rel, lines in files.items():
        chunks, longer = next_fit(lines, 40)
        assert [got[rel][i] for i in range(len(got[rel]))] == chunks
        assert sorted(over[rel]) == sorted(longer)


def test_one_large_file_is_spread_over_tasks(spark):
    n = 200_000
    lines = spark.range(n).selectExpr("'f' as relpath", "id as line_no", "cast(repeat('y', cast(id % 50 as int)) as binary) as line")
    out = chunk_files(lines, 2000, 100_000)
    assert out.selectExpr("sum(size(lines)) n").first().n == n
    assert out.selectExpr("max(chunk_bytes) m").first().m <= 2000
    sizes = [len(c) for c in next_fit([b"y" * (i % 50) for i in range(n)], 2000)[0]]
    assert [r.n for r in out.selectExpr("chunk_no", "size(lines) n").orderBy("chunk_no").collect()] == sizes


def test_no_lines(spark):
    assert chunk_files(spark.createDataFrame([], LINES)).count() == 0
