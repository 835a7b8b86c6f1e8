"""Conversation structure repair: the cheapest edits that give a conversation's turns a legal order.

Role initials must follow the grammar ``(s?(ua)+)?``. Its four states are START, after a system turn, after a user turn
and after an assistant turn; a conversation may end in the first or the last. A forward Viterbi pass carries the least
(cost, audit string) of each state from turn to turn: a turn is kept, given the other role, or deleted, and each turn's
layer is closed by insertions (two at most lead to every state they can lead to). The audit string names the edits in
order and decides ties; together with the roles it determines the states, so it is all that has to be carried.

A conversation is not one group. Rows are laid out by range of (conversation, turn, role, hash of the text), so
a long conversation lies on many partitions, and cut into blocks of bounded rows and bytes. A block of which it is not known that it
is the whole conversation gives the best path from each state to each state; ``_chain`` combines these small
tables in order. Only layers before a row are closed, and the last one at the very end: paths then end with a row's edit,
so none is the beginning of another and the order of two prefixes decides the order of what follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches, to_arrow

START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: The state after an inserted or reroled turn, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The states from which a turn with this initial may be kept, and the state after it.
KEEPS = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
#: A block's rows and bytes of text at most (a larger text is a block of its own).
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20

TURN = T.StructType([T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
COUNTS = ("blank", "duplicate", "truncated", "illegal")

Layer = list[tuple[int, str] | None]


class Turn(NamedTuple):
    """One row, or a run of ``n`` rows that must go."""

    fault: str
    role: str
    text: str | None
    n: int


def closed(layer: Layer) -> Layer:
    """The layer with the states that insertions reach."""
    layer = list(layer)
    for _ in range(2):
        for state, best in enumerate(list(layer)):
            if best is not None:
                to, new = NEXT[state], (best[0] + INSERT, best[1] + "I")
                if layer[to] is None or new < layer[to]:
                    layer[to] = new
    return layer


def after(layer: Layer, turn: Turn) -> Layer:
    """The layer behind a turn, not closed."""
    layer = closed(layer)
    if turn.fault in ("blank", "duplicate"):
        return [best and (best[0] + DELETE * turn.n, best[1] + "D" * turn.n) for best in layer]
    out: Layer = [best and (best[0] + DELETE, best[1] + "D") for best in layer]
    extra = TRUNCATED if turn.fault == "truncated" else 0
    moves = [(state, NEXT[state], REROLE + extra, "R") for state in range(4)]
    if turn.role[:1] in KEEPS:
        states, to = KEEPS[turn.role[:1]]
        moves += [(state, to, extra, "K") for state in states]
    for state, to, cost, edit in moves:
        if layer[state] is not None:
            new = (layer[state][0] + cost, layer[state][1] + edit)
            if out[to] is None or new < out[to]:
                out[to] = new
    return out


def paths(turns: list[Turn], start: int) -> Layer:
    layer: Layer = [None] * 4
    layer[start] = (0, "")
    for turn in turns:
        layer = after(layer, turn)
    return layer


def applied(turns: list[Turn], state: int, audit: str) -> list[dict]:
    """The turns that the edits leave, from ``state`` on."""
    out, left = [], iter(turns)
    deleted = 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append({"edit": "I", "role": ROLES[state], "text": ""})
            continue
        if deleted:
            deleted -= 1
            continue
        turn = next(left)
        deleted = turn.n - 1
        if edit == "R":
            state = NEXT[state]
            out.append({"edit": "R", "role": ROLES[state], "text": turn.text})
        elif edit == "K":
            state = KEEPS[turn.role[:1]][1]
            out.append({"edit": "K", "role": turn.role, "text": turn.text})
    return out


def _blocks(rows: DataFrame, conv: T.DataType, turn: T.DataType, block_rows: int) -> DataFrame:
    """One row for each block of the sorted ``rows``.

    ``kind`` is 0 for a conversation without rows, 1 for a note that the next row's role and text were seen at an earlier
    turn, 2 for a row that stands ``copies`` times."""
    small_batches(rows.sparkSession)
    item = T.StructType([T.StructField("fault", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n", T.LongType())])
    schema = T.StructType(
        [T.StructField("conv", conv), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("whole", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
        + [T.StructField("distinct_turns", T.LongType()), T.StructField("first_turn", turn), T.StructField("last_turn", turn)]
        + [T.StructField("first_initial", T.StringType()), T.StructField("last_initial", T.StringType())]
        + [T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType())), T.StructField("items", T.ArrayType(item))]
    )
    arrow = pa.schema([(f.name, to_arrow(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made: list[dict] = []
        held: list[Turn] = []
        stats: dict = {}
        conv_now, begun, first_conv, seen_before = None, False, True, None
        seq = weight = size = cuts = waiting = 0

        def fresh() -> dict:
            return dict.fromkeys(COUNTS, 0) | {"distinct_turns": 0, "first_turn": None, "last_turn": None, "first_initial": None, "last_initial": None}

        def cut(whole: bool) -> None:
            nonlocal held, stats, seq, weight, size, cuts, waiting
            if whole:
                ends = closed(paths(held, START))
                layers = [min(ends[e] for e in FINAL if ends[e] is not None)]
            else:
                layers = [x for start in range(4) for x in paths(held, start)]
            made.append(
                {"conv": conv_now, "part": part, "seq": seq, "whole": whole, **stats, "costs": [x and x[0] for x in layers], "audits": [x and x[1] for x in layers], "items": [t._asdict() for t in held]}
            )
            waiting += weight
            held, stats, weight, size = [], fresh(), 0, 0
            seq += 1
            cuts += 1

        def out() -> pa.RecordBatch:
            nonlocal waiting
            waiting = 0
            batch = pa.RecordBatch.from_pylist(made, schema=arrow)
            made.clear()
            return batch

        for b in batches:
            for key, kind, at, role, text, blank, ended, copies, h, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or key != conv_now:
                    if begun:
                        cut(whole=not first_conv and not cuts)
                        first_conv = False
                    begun, conv_now, cuts, stats = True, key, 0, fresh()
                if kind < 2:
                    seen_before = (at, role, h, g) if kind else None
                    continue
                later, seen_before = seen_before == (at, role, h, g), None
                if blank:
                    found = [Turn("blank", role, None, copies)]
                else:
                    found = [] if later else [Turn("" if ended else "truncated", role, text, 1)]
                    if copies > len(found):
                        found.append(Turn("duplicate", role, None, copies - len(found)))
                for turn in found:
                    left = turn.n
                    while left:
                        n = min(left, block_rows)
                        extra = len(turn.text) if turn.text else 0
                        if held and (size + n > block_rows or weight + extra > BLOCK_BYTES):
                            cut(whole=False)
                        held.append(turn._replace(n=n))
                        size, weight, left = size + n, weight + extra, left - n
                        initial = role[:1]
                        if turn.fault:
                            stats[turn.fault] += n
                        if stats["first_initial"] is None:
                            stats["first_initial"] = initial
                        else:
                            stats["illegal"] += stats["last_initial"] + initial not in LEGAL
                        stats["illegal"] += n - 1
                        stats["last_initial"] = initial
                        if at is not None:
                            stats["distinct_turns"] += at != stats["last_turn"]
                            stats["last_turn"] = at
                            if stats["first_turn"] is None:
                                stats["first_turn"] = at
                if len(made) >= 64 or waiting > BLOCK_BYTES:
                    yield out()
        if begun:
            cut(whole=False)  # it may go on in the next partition
            yield out()

    return rows.mapInArrow(run, schema)


def _chain(blocks: DataFrame, conv: T.DataType, turn: T.DataType) -> DataFrame:
    """The states in which the best path of a conversation of several blocks enters and leaves each of them, and on
    its last block (``last``) the conversation's counts. A task holds one small number for each block of one conversation at a time."""
    small_batches(blocks.sparkSession)
    schema = T.StructType(
        [T.StructField("conv", conv), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("enters", T.IntegerType()), T.StructField("leaves", T.IntegerType())]
        + [T.StructField("closing", T.StringType()), T.StructField("last", T.BooleanType()), T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType()), T.StructField("distinct_turns", T.LongType())]
    )
    arrow = pa.schema([(f.name, to_arrow(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_now, begun = None, False
        places: list[tuple[int, int]] = []
        back: list[tuple[int, ...]] = []
        best: list[tuple[int, int] | None] = []  # for each state its cost and the place of its path among the four
        joined = {"illegal": 0, "distinct_turns": 0, "initial": None, "turn": None}

        def done() -> pa.RecordBatch:
            ends = closed([x and (x[0], chr(ord("a") + x[1])) for x in best])  # a letter above all edits stands for the path so far
            cost, path = min(ends[e] for e in FINAL if ends[e] is not None)
            inserted, place = path[1:], ord(path[0]) - ord("a")
            state = next(i for i, x in enumerate(best) if x is not None and x[1] == place)
            rows = []
            for (part, seq), froms in zip(reversed(places), reversed(back), strict=True):
                last = not rows
                rows.append(
                    {"conv": conv_now, "part": part, "seq": seq, "enters": froms[state], "leaves": state, "closing": inserted if last else "", "last": last,
                     "cost": cost, "illegal": joined["illegal"], "distinct_turns": joined["distinct_turns"]}
                )
                state = froms[state]
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for b in batches:
            for r in b.to_pylist():
                if not begun or r["conv"] != conv_now:
                    if begun:
                        yield done()
                    begun, conv_now, places, back, best = True, r["conv"], [], [], [(0, 0), None, None, None]
                    joined = {"illegal": 0, "distinct_turns": 0, "initial": None, "turn": None}
                found: list[tuple[int, int, str, int] | None] = []
                for leave in range(4):
                    ways = [(best[s][0] + r["costs"][4 * s + leave], best[s][1], r["audits"][4 * s + leave], s) for s in range(4) if best[s] is not None and r["costs"][4 * s + leave] is not None]
                    found.append(min(ways) if ways else None)
                order = sorted((x[1:3], e) for e, x in enumerate(found) if x is not None)
                place = {e: i for i, (_, e) in enumerate(order)}
                best = [x and (x[0], place[e]) for e, x in enumerate(found)]
                places.append((r["part"], r["seq"]))
                back.append(tuple(-1 if x is None else x[3] for x in found))
                joined["illegal"] += r["illegal"]
                joined["distinct_turns"] += r["distinct_turns"]
                if r["first_initial"] is not None:
                    if joined["initial"] is not None:
                        joined["illegal"] += joined["initial"] + r["first_initial"] not in LEGAL
                    joined["initial"] = r["last_initial"]
                if r["first_turn"] is not None:
                    joined["distinct_turns"] -= r["first_turn"] == joined["turn"]
                    joined["turn"] = r["last_turn"]
        if begun:
            yield done()

    cols = ["conv", "part", "seq", "costs", "audits", "illegal", "distinct_turns", "first_turn", "last_turn", "first_initial", "last_initial"]
    return blocks.select(*cols).repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(run, schema)


def _finish(blocks: DataFrame, conv: T.DataType) -> DataFrame:
    """(conv, part, seq, whole, audit, turns) from blocks with their ``enters`` and ``audit``."""
    small_batches(blocks.sparkSession)
    schema = T.StructType(
        [T.StructField("conv", conv), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("whole", T.BooleanType())]
        + [T.StructField("audit", T.StringType()), T.StructField("turns", T.ArrayType(TURN))]
    )
    arrow = pa.schema([(f.name, to_arrow(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 16):
                rows = []
                for r in b.slice(lo, 16).to_pylist():
                    turns = applied([Turn(**t) for t in r["items"]], r["enters"], r["audit"])
                    rows.append({k: r[k] for k in ("conv", "part", "seq", "whole", "audit")} | {"turns": turns})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return blocks.select("conv", "part", "seq", "whole", "enters", "audit", "items").mapInArrow(run, schema)


class Repaired(NamedTuple):
    """``report``: a row for each conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit).
    ``blocks``: (conv, part, seq, whole, audit, turns), the repaired turns (edit, role, text) of consecutive pieces of a
    conversation, ordered by part and seq; ``whole`` where one piece is the conversation."""

    report: DataFrame
    blocks: DataFrame

    def turns(self) -> DataFrame:
        """(conv_id, part, seq, at, edit, role, text): a row for each turn of the repaired conversations."""
        name = self.report.columns[0]
        return self.blocks.select(F.col("conv").alias(name), "part", "seq", F.posexplode("turns").alias("at", "turn")).select(name, "part", "seq", "at", "turn.*")

    def digests(self) -> DataFrame:
        """(conv_id, sha256) of the lines ``role:text`` of each repaired conversation. The hash of a conversation of
        several blocks is taken by one task that reads these in order and holds one at a time."""
        name = self.report.columns[0]
        text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
        one = self.blocks.where("whole").select(F.col("conv").alias(name), F.sha2(text, 256).alias("sha256"))
        schema = T.StructType([T.StructField(name, self.blocks.schema["conv"].dataType), T.StructField("sha256", T.StringType())])
        arrow = pa.schema([(f.name, to_arrow(f.dataType)) for f in schema.fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            conv_now, begun, digest, filled = None, False, hashlib.sha256(), False
            for b in batches:
                for key, n, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if not begun or key != conv_now:
                        if begun:
                            yield pa.RecordBatch.from_pylist([{name: conv_now, "sha256": digest.hexdigest()}], schema=arrow)
                        begun, conv_now, digest, filled = True, key, hashlib.sha256(), False
                    if n:
                        digest.update((b"\n" if filled else b"") + block.encode())
                        filled = True
            if begun:
                yield pa.RecordBatch.from_pylist([{name: conv_now, "sha256": digest.hexdigest()}], schema=arrow)

        pieces = self.blocks.where("not whole").select("conv", "part", "seq", F.size("turns").alias("n"), text.alias("block"))
        ordered = pieces.repartition("conv").sortWithinPartitions("conv", "part", "seq").select("conv", "n", "block")
        return one.unionByName(ordered.mapInArrow(run, schema))


def repair_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", known: DataFrame | None = None, block_rows: int = BLOCK_ROWS
) -> Repaired:
    """The rows of each conversation, by turn (nulls first), with the cheapest edits that make their roles legal.

    Null roles and texts count as one space. A row is blank (no character but white space), else a duplicate (role and
    text seen earlier in its conversation), else truncated (its last such character is none of ``.!?``); blank rows and
    duplicates are deleted. Rows of one turn follow each other by role, then by hash of their text; equal
    rows are adjacent. A null conversation is a conversation. Very long texts are read whole, an empty table gives an
    empty report. Other columns are left out, whatever their names. ``known``: a table whose conversations are all
    reported, also those without rows here."""
    conv_type, turn_type = rows.schema[conv_id].dataType, rows.schema[turn].dataType
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" "))
    narrow = rows.select(
        F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").alias("at"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"), said.alias("text"),
        F.xxhash64(said).alias("h"), F.xxhash64(F.lit(1), said).alias("g"),
    )
    # equal rows become one before anything is laid out by range, however many there are
    same = materialize(narrow.groupBy("conv", "at", "role", "h", "g", "text").agg(F.count("*").alias("copies")), "same_rows")
    repeated = same.groupBy("conv", "role", "h", "g").agg(F.min("at").alias("first"), F.bool_or(F.col("at").isNull()).alias("null_first"), F.count("*").alias("n"))
    repeated = materialize(repeated.where("n > 1"), "repeated")
    later = F.expr("s.conv <=> r.conv and s.role = r.role and s.h = r.h and s.g = r.g and s.at is not null and (r.null_first or s.at > r.first)")
    marks = materialize(same.select("conv", "at", "role", "h", "g").alias("s").join(repeated.alias("r"), later).select("s.*"), "marks")
    ended = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1)).isin(".", "!", "?")
    layout = ["conv", "kind", "at", "role", "text", "blank", "ended", "copies", "h", "g"]
    none = {"text": "string", "blank": "boolean", "ended": "boolean", "copies": "bigint"}
    real = same.select("*", F.lit(2).alias("kind"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), ended.alias("ended")).select(layout)
    noted = marks.select("*", F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).select(layout)
    every = real.unionByName(noted)
    if known is not None:
        both = rows.select(F.col(f"`{conv_id}`").alias("conv"), F.lit(1).alias("n")).unionByName(known.select(F.col(f"`{conv_id}`").cast(conv_type).alias("conv"), F.lit(0).alias("n")))
        empty = both.groupBy("conv").agg(F.sum("n").alias("n")).where("n = 0")
        blanks = {"at": turn_type.simpleString(), "role": "string", "h": "bigint", "g": "bigint"} | none
        every = every.unionByName(empty.select("conv", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in blanks.items()]).select(layout))
    laid = every.repartitionByRange("conv", "at", "role", "h", "g").sortWithinPartitions("conv", "at", "role", "h", "g", "kind")
    blocks = materialize(_blocks(laid, conv_type, turn_type, block_rows), "blocks")

    parts = blocks.where("not whole")
    chain = materialize(_chain(parts, conv_type, turn_type), "chain")
    on = F.expr("b.conv <=> c.conv and b.part = c.part and b.seq = c.seq")
    slice_ = F.concat(F.expr("b.audits[4 * c.enters + c.leaves]"), F.col("c.closing"))
    chosen = parts.alias("b").join(chain.alias("c"), on).select("b.*", F.col("c.enters").alias("enters"), slice_.alias("audit"))
    one = blocks.where("whole").select("*", F.lit(START).alias("enters"), F.col("audits")[0].alias("audit"))
    finished = materialize(_finish(one.unionByName(chosen), conv_type), "finished")

    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct_turns"), F.lit(0)).cast("long")
    single = blocks.where("whole").select(F.col("conv").alias(conv_id), gaps.alias("gaps"), *COUNTS, F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    told = chain.where("last").select("conv", "cost", "illegal", "distinct_turns").alias("t")
    added = parts.groupBy("conv").agg(*[F.sum(c).alias(c) for c in COUNTS if c != "illegal"], F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn")).alias("a")
    audits = finished.where("not whole").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))).alias("pieces")).select("conv", F.array_join(F.col("pieces.audit"), "").alias("audit")).alias("p")
    several = added.join(told, F.expr("a.conv <=> t.conv")).join(audits, F.expr("a.conv <=> p.conv"))
    several = several.select(F.col("a.conv").alias(conv_id), gaps.alias("gaps"), *COUNTS, "cost", "audit")
    return Repaired(single.unionByName(several), finished)


def damage_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` damaged by crc32 of ``conversation:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes ``.!?``
    from it, 3 repeats the row, 4 makes its role user. Nulls count as one space (a null turn stays null, for the order)."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(filled(conv_id), F.lit(":"), filled(turn)).cast("binary")) % 20
    new_text = F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(filled(text), ".!?", "")).otherwise(filled(text))
    new_role = F.when(fate == 4, F.lit("user")).otherwise(filled(role))
    kept = rows.where(fate != 0).select(f"`{conv_id}`", f"`{turn}`", new_role.alias(role), new_text.alias(text), F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("__copy"))
    return kept.select(conv_id, turn, role, text)
