"""Interval joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit
from tidemark.plans import catalog


def number(rng):
    return rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 5)), rng.uniform(-1, 1) * 10 ** rng.randint(-6, 9)])


def test_points_in_intervals(spark):
    rng = random.Random(1)
    points = [(i, rng.choice("xy"), rng.choice([number(rng), None if i % 9 == 0 else 3.0])) for i in range(120)]
    intervals = []
    for j in range(150):
        low = number(rng)
        intervals.append((j, rng.choice("xy"), low, rng.choice([low, low + abs(number(rng)), low + 1, low - 1, points[j % 120][2]])))
    got = audit.containing(spark.createDataFrame(points, "i int, g string, at double"), spark.createDataFrame(intervals, "j int, g string, low double, high double"), ["g"])
    want = sorted((i, j) for i, g, at in points for j, h, low, high in intervals if g == h and None not in (at, high) and low <= at <= high)
    assert sorted((r.i, r.j) for r in got.collect()) == want
    assert len(want) > 500


def test_pairs_of_ranges(spark):
    rng = random.Random(2)
    ranges = []
    for k in range(160):
        low = number(rng)
        ranges.append((k, low, rng.choice([low, low + abs(number(rng)), low - 1, None])))
    ranges += [(200, 4.0, 4.0), (201, 4.0, 4.0), (202, 4.0, 9.0), (203, -1e9, 1e10)]
    got = audit.overlapping_pairs(spark.createDataFrame(ranges, "k int, lo double, hi double"), "k", "lo", "hi")
    real = [r for r in ranges if r[2] is not None and r[1] <= r[2]]
    want = sorted((a[0], b[0]) for a in real for b in real if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2])
    assert sorted(map(tuple, got.collect())) == want


def test_more_ranges_than_a_report_of_all_pairs(spark):
    n = audit.MOST_GROUPS + 100
    ranges = spark.range(n).selectExpr("id as k", "id * 10.0D as lo", "id * 10.0D + 10 as hi")
    with pytest.raises(ValueError, match="overlapping_pairs"):
        audit.range_overlaps(ranges, "k", "lo", "hi")
    assert audit.overlapping_pairs(ranges, "k", "lo", "hi").count() == n - 1
    assert audit.overlapping_pairs(ranges.limit(0), "k", "lo", "hi").count() == 0


def test_cells_are_not_broadcast(spark):
    """The planner knows the tables' sizes, not that of the cells, which are many times as many rows."""
    ranges = spark.range(50).selectExpr("id as k", "id * 1.0D as lo", "id + 3.0D as hi")
    plan = audit.overlapping_pairs(ranges, "k", "lo", "hi")
    assert plan.count() == 49 + 48 + 47
    executed = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in executed and "Broadcast" not in executed


def test_values_and_endless_ranges(spark):
    """Ranges without length have one level together; ends may be infinite or NaN, which is greater than all numbers."""
    inf, nan = float("inf"), float("nan")
    intervals = [(0, 0.0, inf), (1, -inf, 0.0), (2, -inf, inf), (3, 2.0, nan), (4, inf, inf), (5, -0.0, 0.0), (6, 1e-7, 1e-7), (7, 4e8, 4e8), (8, -1e300, 1e300), (9, nan, nan)]
    points = [-inf, -5.0, 0.0, -0.0, 1e-7, 2.0, 4e8, 1e301, inf, nan]
    rank = lambda x: (x != x, 0 if x != x else x)
    got = audit.containing(spark.createDataFrame(list(enumerate(points)), "i int, at double"), spark.createDataFrame(intervals, "j int, low double, high double"))
    want = sorted((i, j) for i, at in enumerate(points) for j, low, high in intervals if rank(low) <= rank(at) <= rank(high))
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_bands_are_spread(spark):
    """The bands' query is dealt by cells: with the bands broadcast, the matches are made in as few tasks as the customers' file has."""
    met = catalog.QUERIES["overlapping_bands"](spark, "/root/testdata/sf0.01")
    assert met.count() == 940
    executed = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in executed and "Broadcast" not in executed


def test_matches_are_made_in_many_tasks(spark):
    """Adaptive execution sees the cells' bytes, not the matches they make, and would put small cells together into one task."""
    met = catalog.QUERIES["overlapping_bands"](spark, "/root/testdata/sf0.01")
    assert met.select(F.spark_partition_id()).distinct().count() > 2 * spark.sparkContext.defaultParallelism
