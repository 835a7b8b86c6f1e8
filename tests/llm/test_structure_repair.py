"""Conversation repair against a search over all edit sequences."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from tidemark.llm import registry
from tidemark.llm.structure_repair import damage_conversations, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.strip(WHITE)
        if not stripped:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif stripped[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def every_repair(rows, found):
    """All edit sequences with at most two insertions at a place: (cost, audit, turns)."""
    inserts = [()] + [(a,) for a in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))

    def ways(i):
        for put in inserts:
            cost, audit, turns = 3 * len(put), "I" * len(put), [(r, "") for r in put]
            if i == len(rows):
                yield cost, audit, turns
                continue
            _, role, text = rows[i]
            options = [(4, "D", [])]
            if found[i] not in ("blank", "duplicate"):
                extra = 3 if found[i] == "truncated" else 0
                options += [(extra, "K", [(role, text)])] * bool(role) + [(3 + extra, "R", [(r, text)]) for r in ("user", "assistant")]
            rest = list(ways(i + 1))
            for (c, a, t), (c2, a2, t2) in itertools.product(options, rest):
                yield cost + c + c2, audit + a + a2, turns + t + t2

    return min((w for w in ways(0) if GRAMMAR.fullmatch("".join(r[:1] for r, _ in w[2]))), key=lambda w: w[:2])


def shortest_repair(rows, found):
    """The cheapest edits by a search over (row, last initial, edits so far), for conversations of any length."""
    import heapq

    queue = [(0, "", 0, "", ())]
    done = set()
    while queue:
        cost, audit, i, last, turns = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(turns)
        if (i, last) in done:
            continue
        done.add((i, last))

        def go(role):
            return {"": "su", "s": "u", "u": "a", "a": "u"}[last].find(role[:1]) >= 0 and role[:1] != ""

        for role in ("user", "assistant"):
            if go(role):
                heapq.heappush(queue, (cost + 3, audit + "I", i, role[0], (*turns, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, last, turns))
            if found[i] not in ("blank", "duplicate"):
                extra = 3 if found[i] == "truncated" else 0
                if go(role):
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, role[0], (*turns, (role, text))))
                for r in ("user", "assistant"):
                    if go(r):
                        heapq.heappush(queue, (cost + 3 + extra, audit + "R", i + 1, r[0], (*turns, (r, text))))


def expected(rows, search):
    """The report of one conversation from its rows (turn, role, text) in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    found = faults(rows)
    cost, audit, turns = search(rows, found)
    known = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest(),
    }


def report(spark, rows, **options):
    found = repair_conversations(spark.createDataFrame(rows, SCHEMA), **options)
    digests = {r.conv_id: r.sha256 for r in found.digests().collect()}
    out = {}
    for r in found.report.collect():
        assert r.conv_id not in out
        out[r.conv_id] = {k: v for k, v in r.asDict().items() if k != "conv_id"} | {"repaired_sha256": digests.pop(r.conv_id)}
    assert not digests
    return out


def order(rows):
    """Rows of a conversation by turn; the tests give rows of one turn the same role and text."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_all_short_conversations(spark):
    rng = random.Random(3)
    rows = {}
    for c in range(400):
        mine = []
        for t in range(rng.randint(1, 6)):
            turn = rng.choice([t, t, t, 2 * t, 3 * t + 1])
            if any(turn == r[0] for r in mine):
                continue
            row = (turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "No!", "cut", " \n", "", "end? ", None]))
            mine += [row] * rng.choice([1, 1, 1, 2])
        rows[c] = order(mine)
    got = report(spark, [(c, *r) for c, mine in rows.items() for r in mine])
    assert len(got) == len(rows)
    for c, mine in rows.items():
        assert got[c] == expected(mine, shortest_repair), mine


@pytest.mark.parametrize("block_rows", [3, 512])
def test_long_conversations_over_many_blocks(spark, block_rows):
    rng = random.Random(8)
    rows = {None: [], 7: [], 8: []}
    for c, mine in rows.items():
        for t in range(150):
            row = (None if t == 0 and c == 7 else 2 * t if t > 90 else t, rng.choice(["system", "user", "assistant", "user", "assistant", "User"]), rng.choice([f"Text {rng.randint(0, 40)}.", "cut off", " ", f"Question {t}?"]))
            mine += [row] * rng.choice([1, 1, 1, 1, 5])
    for c in range(20, 60):
        rows[c] = [(t, ("user", "assistant")[t % 2], f"{t}.") for t in range(4)]
    flat = [(c, *r) for c, mine in rows.items() for r in mine]
    rng.shuffle(flat)
    got = report(spark, flat, block_rows=block_rows)
    for c, mine in rows.items():
        assert got[c] == expected(mine, shortest_repair), c


def test_one_conversation_holds_most_rows_and_copies(spark):
    flat = [(1, 5, "user", "Same.")] * 3000 + [(1, None, "assistant", "x")] * 1000 + [(2, 0, "user", "A."), (2, 1, "assistant", "B.")]
    got = report(spark, flat, block_rows=64)
    assert got[1] == expected(order([r[1:] for r in flat if r[0] == 1]), shortest_repair)
    assert got[2]["audit"] == "KK"
    assert got[2]["cost"] == 0


def test_the_two_searches_agree():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(t, rng.choice(["system", "user", "assistant", "x"]), rng.choice(["Yes.", "No!", "cut", " "])) for t in range(rng.randint(0, 2))]
        assert shortest_repair(rows, faults(rows)) == every_repair(rows, faults(rows))


def test_turns_are_the_repaired_conversation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "cut")]
    found = repair_conversations(spark.createDataFrame(rows, SCHEMA))
    turns = [(r.edit, r.role, r.text) for r in found.turns().orderBy("part", "seq", "at").collect()]
    assert found.report.first().audit.replace("D", "") == "".join(r[0] for r in turns)
    assert GRAMMAR.fullmatch("".join(r[1][0] for r in turns))
    want = expected([r[1:] for r in rows], shortest_repair)
    assert hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in turns).encode()).hexdigest() == want["repaired_sha256"]


def test_empty_table_extra_columns_and_long_texts(spark):
    empty = repair_conversations(spark.createDataFrame([], SCHEMA + ", part int, conv string"))
    assert empty.report.count() == 0
    assert empty.digests().count() == 0
    long_text = "word " * 2_000_000 + "end."
    rows = [(1, 0, "user", long_text, 5, "a"), (1, 1, "assistant", "Fine.", 5, "b"), (2, 0, "user", long_text, 1, "c")]
    found = repair_conversations(spark.createDataFrame(rows, SCHEMA + ", part int, conv string"))
    got = {r.conv_id: (r.audit, r.cost) for r in found.report.collect()}
    assert got == {1: ("KK", 0), 2: ("KI", 3)}
    digests = {r.conv_id: r.sha256 for r in found.digests().collect()}
    assert digests[2] == hashlib.sha256(f"user:{long_text}\nassistant:".encode()).hexdigest()


def test_damage_and_query(spark, tmp_path):
    rows = [(c, t, r, x) for c in [*range(150), None] for t, (r, x) in enumerate([("system", "S. a"), ("user", "Why? b."), ("assistant", "So!"), (None, None), ("user", "Q.")])]
    rows += [(900, None, "user", "Null turn."), (None, None, "user", "Both null.")]
    damaged = {}
    for c, t, r, x in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        damaged.setdefault(c, []).extend([(t, "user" if fate == 4 else r, x)] * (0 if fate == 0 else 2 if fate == 3 else 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, damage_conversations(df).collect()), key=str)
    assert got == sorted(((c, *r) for c, mine in damaged.items() for r in mine), key=str)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    out = registry.op11_conversation_repair(spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert [f.dataType for f in out.schema.fields[1:7]] == [T.LongType()] * 6
    found = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in out.collect()}
    assert set(found) == set(damaged)
    for c, mine in damaged.items():
        assert found[c] == expected(order(mine), shortest_repair), c


def test_a_conversation_that_loses_all_rows_is_reported(spark, tmp_path):
    c = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(c, 0, "user", "Gone.")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    row = registry.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in row] == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
