"""Exact quantiles of groups of any size, without a group's values in memory.

Each wanted quantile is a rank. Values are counted between splitting points (approximate quantiles, a sketch
of bounded size), the interval that holds the rank is kept and split again, until it holds few values; those are ranked exactly.
A splitting point is an interval of its own, so a value that most rows share is found at once. Every pass is one scan with partial
aggregation; only groups that are still large take part in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.scratch import written_table

#: Values of one interval that are ranked by a sort, and splitting points of a pass.
FEW, SPLITS = 10_000, 64


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float], discrete: bool = False, few: int = FEW) -> DataFrame:
    """A row for each group: the keys ``by``, the number ``n`` of values that are not null, ``least``, ``most`` and a column
    for each named probability, null for a group without values.

    Continuous quantiles lie between two values in proportion to the place p (n - 1); ``discrete`` ones are the first value of which
    at least p n values are not greater. Null keys are groups like others; NaN counts as greater than any number."""
    if bad := [p for p in probabilities.values() if not 0 <= p <= 1]:
        raise ValueError(f"probabilities lie between 0 and 1, not {bad}")
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.col(f"`{value}`").alias("__v"))
    counts = rows.groupBy(*keys).agg(F.count("__v").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    counts = written_table(counts, "counts")
    places = [F.lit(p) * F.col("__n") if discrete else F.lit(p) * (F.col("__n") - 1) for p in probabilities.values()]
    lower = [F.greatest(F.ceil(x) - 1, F.lit(0)) if discrete else F.floor(x) for x in places]
    upper = lower if discrete else [F.least(F.floor(x) + 1, F.col("__n") - 1) for x in places]
    ranks = counts.where("__n > 0").select(*keys, "__n", F.explode(F.array_distinct(F.array(*lower, *upper))).alias("__rank"))
    states = ranks.select(*keys, "__rank", F.lit(None).cast(rows.schema["__v"].dataType).alias("__low"), F.lit(None).cast(rows.schema["__v"].dataType).alias("__high"), F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__in"), F.lit(False).alias("__found"))
    values = rows.where("__v is not null")
    states = written_table(states, "ranks")
    while not (large := states.where((F.col("__in") > few) & ~F.col("__found"))).isEmpty():
        states = written_table(states.where((F.col("__in") <= few) | F.col("__found")).unionByName(_narrowed(values, large, keys)), "ranks")
    found = _ranked(values, states.where(~F.col("__found")), keys).unionByName(states.where("__found").select(*keys, "__rank", F.col("__low").alias("__v")))
    told = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))
    both = _joined(counts, told, keys, "left")
    columns = []
    for name, place, lo, hi in zip(probabilities, places, lower, upper, strict=True):
        a, b = F.try_element_at("__at", lo), F.try_element_at("__at", hi)
        between = a if discrete else F.when(a == b, a.cast("double")).otherwise(a + (b - a) * (place - F.floor(place)))
        columns.append(F.when(F.col("__n") > 0, between).alias(name))
    return both.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], F.col("__n").alias("n"), F.col("__least").alias("least"), F.col("__most").alias("most"), *columns)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equal join in which null keys meet; the right side is one row for each key or rank."""
    if not keys:
        return left.withColumn("__one", F.lit(1)).join(right.withColumn("__one", F.lit(1)), "__one", how).drop("__one")
    renamed = right.select(*[F.col(c).alias(f"__r{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r{k}"))
    return left.join(renamed, on, how).drop(*[f"__r{k}" for k in keys])


def _inside(value: Column) -> Column:
    return (F.col("__low").isNull() | (value > F.col("__low"))) & (F.col("__high").isNull() | (value < F.col("__high")))


def _narrowed(values: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """The states with the interval between two splitting points, or the splitting point, that holds their rank."""
    mine = [*keys, "__rank", "__low", "__high", "__below", "__in", "__found"]
    open_ = _joined(values, states, keys).where(_inside(F.col("__v")))
    grid = F.array(*[F.lit((i + 1) / (SPLITS + 1)) for i in range(SPLITS)])
    cuts = open_.groupBy(*mine).agg(F.percentile_approx("__v", grid, 100 * SPLITS).alias("__cuts"))
    cut = written_table(cuts.withColumn("__cuts", F.array_distinct("__cuts")), "cuts")
    # an odd place is a splitting point, an even one lies before, between or behind them
    at = F.size(F.filter("__cuts", lambda c: c < F.col("__v"))) * 2 + F.exists("__cuts", lambda c: c == F.col("__v")).cast("int")
    counted = _joined(values, cut, keys).where(_inside(F.col("__v"))).groupBy(*mine, "__cuts", at.alias("__place")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*keys, "__rank").orderBy("__place")) + F.col("__below")  # at most 2 * SPLITS + 1 rows
    some = counted.withColumn("__upto", upto).where((F.col("__upto") > F.col("__rank")) & (F.col("__upto") - F.col("__c") <= F.col("__rank")))
    half, point = F.floor(F.col("__place") / 2).cast("int"), F.col("__place") % 2 == 1
    low = F.when(point | (half > 0), F.try_element_at("__cuts", F.when(point, half + 1).otherwise(half))).otherwise(F.col("__low"))
    high = F.when(point, F.lit(None)).when(half < F.size("__cuts"), F.try_element_at("__cuts", half + 1)).otherwise(F.col("__high"))
    return some.select(*keys, "__rank", low.alias("__low"), high.alias("__high"), (F.col("__upto") - F.col("__c")).alias("__below"), F.col("__c").alias("__in"), point.alias("__found"))


def _ranked(values: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __rank, __v) of the states whose intervals hold few values."""
    inside = _joined(values, states, keys).where(_inside(F.col("__v")))
    counted = inside.groupBy(*keys, "__rank", "__below", "__v").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*keys, "__rank").orderBy("__v")) + F.col("__below")  # at most ``few`` rows
    some = counted.withColumn("__upto", upto).where((F.col("__upto") > F.col("__rank")) & (F.col("__upto") - F.col("__c") <= F.col("__rank")))
    return some.select(*keys, "__rank", "__v")
