"""Runs compared by digests."""

import random
from collections import Counter

import pytest

from tidemark.operators import audit, compare

SCHEMA = "k int, v string, x double"


def rows(rng, n):
    return [(rng.choice([None, rng.randint(0, n)]), rng.choice(["a", "b", None, "é"]), rng.choice([0.5, None, 1e9])) for _ in range(n)]


@pytest.mark.parametrize("changes", [0, 1, 40])
def test_differences(spark, changes):
    rng = random.Random(changes)
    before = rows(rng, 600) + [(7, "same", 1.0)] * 5
    after = list(before)
    for _ in range(changes):
        at = rng.randrange(len(after))
        after[at : at + 1] = rng.choice([[], [after[at], after[at]], [(rng.randint(0, 9), "new", None)]])
    rng.shuffle(after)
    a, b = spark.createDataFrame(before, SCHEMA).repartition(3), spark.createDataFrame(after, SCHEMA).repartition(5)
    got = Counter(tuple(r) for r in audit.differences(a, b).collect())
    x, y = Counter(before), Counter(after)
    assert got == Counter({(*r, "before"): n for r, n in (x - y).items()}) + Counter({(*r, "after"): n for r, n in (y - x).items()})


def test_only_leaves_that_differ_are_left(spark):
    a = spark.range(20_000).selectExpr("cast(id as int) as k", "cast(id as string) as v", "0.5D as x")
    b = a.selectExpr("k", "if(k = 77, 'other', v) as v", "x")
    left, right = compare.differing_parts(a, b, ["k"])
    assert {r.k for r in left.collect()} == {r.k for r in right.collect()}
    assert 1 <= left.count() <= 5
    assert [df.count() for df in compare.differing_parts(a, a.repartition(7), ["k"])] == [0, 0]
    assert [df.count() for df in compare.differing_parts(a.limit(0), a.limit(0), ["k"])] == [0, 0]
    assert [df.count() for df in compare.differing_parts(a.limit(0), b, ["k"])] == [0, 20_000]
