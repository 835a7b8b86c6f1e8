"""Exact quantiles against sorted lists."""

import math
import random
import statistics

import pytest

from tidemark.operators.quantiles import exact_quantiles

PROBABILITIES = {"zero": 0.0, "low": 0.1, "mid": 0.5, "high": 0.93, "one": 1.0}


def continuous(values, p):
    s = sorted(values)
    x = p * (len(s) - 1)
    lo = math.floor(x)
    return s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (x - lo)


def discrete(values, p):
    s = sorted(values)
    return s[max(math.ceil(p * len(s)) - 1, 0)]


def groups(seed):
    rng = random.Random(seed)
    return {
        ("a", 1): [rng.gauss(0, 1) for _ in range(1500)],
        ("a", None): [rng.choice([1.0, 1.0, 1.0, 2.0, -3.5]) for _ in range(900)],
        (None, 1): [7.0] * 700 + [rng.random() * 1e9 for _ in range(40)],
        ("b", 1): [float(i) for i in range(11)],
        ("b", 2): [5.0],
        ("c", 2): [1.0, 2.0, 4.0, 9.0],
        ("d", 1): [2.0**k for k in range(-500, 500)],
    }


@pytest.mark.parametrize("few", [5, 100, 10_000])
@pytest.mark.parametrize("kind", [continuous, discrete])
def test_groups(spark, few, kind):
    data = groups(few)
    rows = [(*k, v) for k, vs in data.items() for v in [*vs, None]] + [("none", 3, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(6)
    got = exact_quantiles(df, ["g", "h"], "v", PROBABILITIES, discrete=kind is discrete, few=few).collect()
    assert len(got) == len(data) + 1
    for r in got:
        if r.g == "none":
            assert (r.n, r.least, r.most, r.mid) == (0, None, None, None)
            continue
        vs = data[r.g, r.h]
        assert (r.n, r.least, r.most) == (len(vs), min(vs), max(vs))
        for name, p in PROBABILITIES.items():
            assert r[name] == pytest.approx(kind(vs, p), rel=1e-12, abs=1e-12)


def test_whole_table_integers_and_no_rows(spark):
    values = [random.Random(4).randint(0, 10**12) for _ in range(3000)] + [17] * 5000
    df = spark.createDataFrame([(v,) for v in values], "v long")
    row = exact_quantiles(df, [], "v", {"mid": 0.5, "late": 0.9}, few=50).first()
    assert (row.n, row.mid) == (8000, statistics.median(values))
    assert row.late == pytest.approx(continuous(values, 0.9))
    empty = exact_quantiles(df.where("v < 0"), [], "v", {"mid": 0.5}).collect()
    assert [tuple(r) for r in empty] == [(0, None, None, None)]
    with pytest.raises(ValueError, match="between 0 and 1"):
        exact_quantiles(df, [], "v", {"x": 1.5})
