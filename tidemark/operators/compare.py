"""Two runs compared by digests: a tree of two levels over hashed keys, of which only the leaves that differ are looked at row by row.

A leaf's digest is the number of its rows and sums and parities of two hashes of each row, so it does not depend on their order and is
added up where the rows are. Equal runs are compared by a few thousand digests and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import written_table

#: Leaves of the first level, and of each of them on the second; the numbers of leaves that differ are bounded by these and broadcast.
LEAVES, FINER = 4096, 128


def _digest(rows: DataFrame, columns: Sequence[str], by: list[str]) -> DataFrame:
    h, g = (F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns]) for seed in (1, 2))
    part = lambda x: F.sum(F.pmod(x, F.lit(1 << 31)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), part(h).alias("sum_h"), F.bit_xor(h).alias("xor_h"), part(g).alias("sum_g"), F.bit_xor(g).alias("xor_g"))


def _unequal(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """The groups of which the digests differ or one is missing."""
    both = first.unionByName(second).groupBy(*by, "n", "sum_h", "xor_h", "sum_g", "xor_g").agg(F.count("*").alias("times"))
    return written_table(both.where("times < 2").select(*by).distinct(), "differing")


def differing_parts(first: DataFrame, second: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables whose keys lie in leaves that differ in the ``columns`` (default: all), repeats included.

    Rows that only one table has, or that differ, are among them; of equal tables nothing is left. Columns are of types that can be
    hashed, so no maps."""
    columns = list(columns or first.columns)
    places = [F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key]), F.lit(n)).cast("int") for seed, n in ((3, LEAVES), (4, FINER))]
    parts = [df.withColumn("__leaf", places[0]) for df in (first, second)]
    leaves = _unequal(*[_digest(df, columns, ["__leaf"]) for df in parts], ["__leaf"])
    if leaves.isEmpty():
        return first.limit(0), second.limit(0)
    inside = [df.join(F.broadcast(leaves), "__leaf", "left_semi").withColumn("__fine", places[1]) for df in parts]
    fine = _unequal(*[_digest(df, columns, ["__leaf", "__fine"]) for df in inside], ["__leaf", "__fine"])
    return tuple(df.join(F.broadcast(fine), ["__leaf", "__fine"], "left_semi").drop("__leaf", "__fine") for df in inside)
