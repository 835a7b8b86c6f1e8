"""Next-fit chunks of ordered lines, for files of any size.

A file is no group. Lines are laid out by range of (file, line number), so a large file lies on many partitions, and
cut into blocks of bounded bytes. How a block goes on depends on one number, the bytes in the chunk that is open where it begins: that
number tells at which line the block's first own chunk starts, and from there all follows. A block's summary
is therefore the list of lines at which this may be (those within the first ``most`` bytes), each with the chunks
and the open bytes that result at the block's end. ``_entries`` goes through the summaries of a file in order, by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shipping import ship
from tidemark.sources.scratch import written_table

MOST_BYTES = 200_000
#: Bytes and lines of a block, about.
BLOCK_BYTES, BLOCK_LINES = 4_000_000, 50_000
CHUNKS = "relpath string, chunk_no int, lines array<binary>, chunk_bytes long, oversize boolean"
_PIECES = "relpath string, chunk_no int, first long, lines array<binary>, oversize boolean, part int, seq long"
_PIECE = pa.schema([("relpath", pa.string()), ("chunk_no", pa.int32()), ("first", pa.int64()), ("lines", pa.list_(pa.binary())), ("oversize", pa.bool_()), ("part", pa.int32()), ("seq", pa.int64())])
_BLOCKS = "total long, ahead array<long>, chunks array<long>, open array<long>, numbers array<long>"


def chunk_lines(lines: list[bytes], most: int = MOST_BYTES) -> tuple[list[list[bytes]], list[bytes]]:
    """Next-fit chunks of whole lines whose joined size (a byte between lines) is at most ``most``, and the lines that are longer."""
    pieces = list(pieces_of(lines, most, -1, 0))
    chunks: list[list[bytes]] = []
    for number, _, piece in pieces:
        if number >= 0:
            chunks.append(piece)
    return chunks, [line for number, _, piece in pieces if number < 0 for line in piece]


def pieces_of(lines: list[bytes], most: int, number: int, size: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(chunk number, place of its first line here, lines): the chunks of a block that is entered with ``size`` bytes in chunk
    ``number`` (-1: none yet); longer lines each by themselves as number -1."""
    held: list[bytes] = []
    first = 0
    for at, line in enumerate(lines):
        if len(line) > most:
            yield -1, at, [line]
            continue
        more = len(line) + (size > 0)
        if number < 0 or size + more > most:
            if held:
                yield number, first, held
            held, number, size, more = [], number + 1, 0, len(line)
        if not held:
            first = at
        held.append(line)
        size += more
    if held:
        yield number, first, held


def summary_of(sizes: np.ndarray, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a byte for each line, bytes up to and with each line, chunks and open bytes at the end if a chunk starts at that line).

    ``sizes``: of the lines that are not longer than ``most``. The arrays hold the lines at which the first own chunk may
    start: up to the one that exceeds ``most`` by itself and all before it."""
    upto = np.cumsum(sizes + 1)
    n = len(sizes)
    total = int(upto[-1]) if n else 0
    before = upto - sizes - 1
    # a line without bytes leaves its chunk as if the next line were the first
    start = np.arange(n)
    filled = np.where(sizes > 0, start, n)
    filled = np.minimum.accumulate(filled[::-1])[::-1] if n else filled
    after = np.full(n + 1, n)
    real = filled < n
    after[:n][real] = np.searchsorted(upto, before[filled[real]] + 1 + most, side="right")
    chunks, open_ = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = after[i]
        if j < n:
            chunks[i], open_[i] = chunks[j] + 1, open_[j]
        else:
            chunks[i], open_[i] = 1, total - before[filled[i]] - 1 if filled[i] < n else 0
    reach = min(n, int(np.searchsorted(upto, most, side="right")) + 1)
    return total, upto[:reach], chunks[:reach], open_[:reach]


def entered(block: dict, number: int, size: int, most: int) -> tuple[int, int]:
    """(chunk number, its bytes) behind a block with this summary."""
    upto = block["ahead"]
    if not upto:
        return number, size
    if number < 0 or size == 0:  # as if the block began a file, but that an empty open chunk goes on
        return number + block["chunks"][0] - (number >= 0), block["open"][0]
    at = int(np.searchsorted(upto, most - size, side="right"))
    if at >= len(upto):
        return number, size + block["total"]
    return number + block["chunks"][at], block["open"][at]


def _blocks(rows: DataFrame, most: int, block_bytes: int) -> DataFrame:
    """Pieces of the files that lie in one block, and summaries (with their lines) of the blocks of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, begun, first_file, cuts, seq = None, False, True, 0, 0
        lines: list[bytes] = []
        numbers: list[int] = []
        size = 0
        made: list[dict] = []

        def cut(whole: bool) -> None:
            nonlocal lines, numbers, size, seq, cuts
            base = {"relpath": path, "part": part, "seq": seq}
            if whole:
                made.extend({**base, "chunk_no": no, "first": numbers[at], "lines": piece, "oversize": no < 0} for no, at, piece in pieces_of(lines, most, -1, 0))
            else:
                sizes = np.array([len(x) for x in lines if len(x) <= most], np.int64)
                total, upto, chunks, open_ = summary_of(sizes, most)
                made.append({**base, "lines": lines, "total": total, "ahead": upto, "chunks": chunks, "open": open_, "numbers": numbers})
            lines, numbers, size = [], [], 0
            seq += 1
            cuts += 1

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(made, schema=schema)
            made.clear()
            return batch

        waiting = 0
        for b in batches:
            for name, number, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or name != path:
                    if begun:
                        cut(whole=not first_file and not cuts)
                        first_file = False
                    begun, path, cuts = True, name, 0
                elif size > block_bytes or len(lines) >= BLOCK_LINES:
                    cut(whole=False)
                lines.append(line)
                numbers.append(number)
                size += len(line) + 1
                waiting += len(line) + 1
                if made and waiting > BLOCK_BYTES:
                    yield out()
                    waiting = 0
        if begun:
            cut(whole=False)  # it may go on in the next partition
            yield out()

    schema = pa.schema([*_PIECE, ("total", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("ahead", "chunks", "open", "numbers")]])
    return rows.mapInArrow(run, f"{_PIECES}, {_BLOCKS}")


def _entries(blocks: DataFrame, most: int) -> DataFrame:
    """(part, seq, chunk_no, size): with how many bytes in which chunk each block of a file is entered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, begun, number, size = None, False, -1, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                if not begun or r["relpath"] != path:
                    begun, path, number, size = True, r["relpath"], -1, 0
                out.append((r["part"], r["seq"], number, size))
                number, size = entered(r, number, size, most)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["part", "seq", "chunk_no", "size"])

    ordered = blocks.select("relpath", "part", "seq", "total", "ahead", "chunks", "open").repartition("relpath").sortWithinPartitions("relpath", "part", "seq")
    return ordered.mapInArrow(run, "part int, seq long, chunk_no int, size long")


def _cut_blocks(blocks: DataFrame, most: int) -> DataFrame:
    """The pieces of blocks (relpath, part, seq, lines, numbers) of which ``entry`` and ``size`` are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                base = {"relpath": r["relpath"], "part": r["part"], "seq": r["seq"]}
                rows = [{**base, "chunk_no": no, "first": r["numbers"][at], "lines": piece, "oversize": no < 0} for no, at, piece in pieces_of(r["lines"], most, r["entry"], r["size"])]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PIECE)

    return blocks.mapInArrow(run, _PIECES)


def chunk_files(lines: DataFrame, most: int = MOST_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Chunks of each file's ``lines`` (relpath, line_no, line) in order of line_no, numbered from 0. Oversize lines get rows of their own, numbered -1."""
    spark = lines.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    laid = lines.select("relpath", "line_no", "line").repartitionByRange("relpath", "line_no").sortWithinPartitions("relpath", "line_no")
    table = written_table(_blocks(laid, most, block_bytes), "blocks")
    blocks = table.where("numbers is not null")
    entry = written_table(_entries(blocks, most).withColumnRenamed("chunk_no", "entry"), "entries")
    spread = _cut_blocks(blocks.select("relpath", "part", "seq", "lines", "numbers").join(entry, ["part", "seq"]), most)
    over = spread.where("oversize").select("relpath", "chunk_no", "lines", "oversize")
    # a chunk that lies across blocks comes in several pieces; together they have at most ``most`` bytes
    several = F.array_sort(F.collect_list(F.struct("first", "lines")))
    across = spread.where("not oversize").groupBy("relpath", "chunk_no").agg(several.alias("pieces"))
    across = across.select("relpath", "chunk_no", F.flatten(F.transform("pieces", lambda p: p["lines"])).alias("lines"), F.lit(False).alias("oversize"))
    every = table.where("numbers is null").select("relpath", "chunk_no", "lines", "oversize").union(over).union(across)
    size = F.aggregate("lines", F.lit(-1).cast("long"), lambda n, x: n + F.length(x) + 1)
    return every.select("relpath", "chunk_no", "lines", size.alias("chunk_bytes"), "oversize")
