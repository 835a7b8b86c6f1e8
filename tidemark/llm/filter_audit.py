"""Interaction of document filters: what each removes, repeats and wastes, alone and in every order.

Each document gets a mask with one bit for each filter that it fails. Most filters look at the text alone; the last one
fails a document whose text stands under a smaller id anywhere in the table. For that one texts are routed by
fingerprint: an RDD is partitioned by xxhash, and a partition stores under each hash a chain of the different texts that
share it, in full, with the least id seen. Whatever is not the least id is emitted as failing. Each task first
does the same with its own rows, so of a text that stands on a third of all rows a task sends one record.

Everything else follows from counts: ``combineByKey`` adds up, for each part of the corpus, how many documents (all,
good, toxic) have each mask, and an order's steps are sums over these few numbers.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import Any

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shipping import ship

from .common import materialize

#: Text that a task holds before it sends its records on, and that a routed partition holds on average.
HELD_BYTES, ROUTED_BYTES = 32 << 20, 32 << 20
MOST_FILTERS = 6
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"


class Text:
    """A whole text and what the filters count in it."""

    def __init__(self, text: str):
        self.text = text
        self.data = text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def upper(self) -> int:
        return len(self.data) - len(self.data.translate(None, UPPER))


#: The filters of the text: letter and what fails a document.
CHECKS: dict[str, Callable[[Text], bool]] = {
    "A": lambda t: len(t.words) < 200,
    "B": lambda t: 100 * len(set(t.words)) < 50 * len(t.words),
    "C": lambda t: 100 * t.upper > 3 * len(t.text),
    "D": lambda t: len(t.data.translate(None, SYMBOLS)) < len(t.data),
}
DUPLICATE = "E"


class Chains:
    """Texts by fingerprint: a chain of [text, mask, least id, {part: rows}] under each hash.

    ``add`` yields (id, part, mask, rows) of ids that cannot be the least."""

    def __init__(self, bit: int):
        self.bit, self.chains, self.size = bit, {}, 0

    def add(self, key: int, text: bytes, mask: int, id_: Any, parts: dict[str, int]) -> Iterator[tuple]:
        chain = self.chains.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                break
        else:
            chain.append([text, mask, id_, dict(parts)])
            self.size += len(text) + 200
            return
        lost, lost_parts = id_, parts
        if id_ < entry[2]:
            lost, lost_parts = entry[2], entry[3]
            entry[2], entry[3] = id_, dict(parts)
        elif id_ == entry[2]:
            for part, n in parts.items():
                entry[3][part] = entry[3].get(part, 0) + n
            return
        for part, n in lost_parts.items():
            yield lost, part, mask | self.bit, n

    def entries(self) -> Iterator[tuple[int, list]]:
        for key, chain in self.chains.items():
            for entry in chain:
                yield key, entry
        self.chains, self.size = {}, 0


def _routed(rows: Iterator, checks: dict[str, Callable[[Text], bool]]) -> Iterator[tuple[int, tuple]]:
    """(route, record) for a task's rows: (text, mask, id, parts) by the text's hash, or a decided (None, mask, id, parts), added up and spread by id."""
    tests = [(1 << i, test) for i, test in enumerate(checks.values())]
    chains = Chains(1 << len(checks))
    decided: Counter = Counter()

    def sent() -> Iterator[tuple[int, tuple]]:
        for key, entry in chains.entries():
            yield key, tuple(entry)
        for (id_, part, mask), n in decided.items():
            yield xxhash.xxh64_intdigest(repr((id_, part))), (None, mask, id_, {part: n})
        decided.clear()

    for id_, part, text in rows:
        seen = Text(text)
        mask = sum(bit for bit, test in tests if test(seen))
        if id_ is None:
            decided[None, part, mask] += 1
        else:
            for *lost, n in chains.add(xxhash.xxh64_intdigest(seen.data), seen.data, mask, id_, {part: 1}):
                decided[tuple(lost)] += n
        if chains.size + 200 * len(decided) > HELD_BYTES:
            yield from sent()
    yield from sent()


def _decided(records: Iterator, bit: int) -> Iterator[tuple]:
    """(id, part, mask, rows) for the records of one partition."""
    chains = Chains(bit)
    for key, (text, mask, id_, parts) in records:
        if text is None:
            for part, n in parts.items():
                yield id_, part, mask, n
        else:
            yield from chains.add(key, text, mask, id_, parts)
    for _, (_, mask, id_, parts) in chains.entries():
        for part, n in parts.items():
            yield id_, part, mask, n


def filter_masks(docs: DataFrame, checks: dict[str, Callable[[Text], bool]] = CHECKS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, n): how many rows of an id and part fail the filters in ``mask`` (a bit for each of ``checks``, in their order, then one for
    texts that a smaller id has as well). Rows without an id have no smaller id and are none; null texts are empty."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = max(spark.sparkContext.defaultParallelism, math.ceil(total / ROUTED_BYTES))
    bit = 1 << len(checks)
    routed = narrow.rdd.mapPartitions(lambda rows: _routed(rows, checks)).partitionBy(routes, lambda key: key)
    masks = routed.mapPartitions(lambda records: _decided(records, bit))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())])
    return spark.createDataFrame(masks, schema, verifySchema=False)


def _steps(counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of a part's counts (all, good and toxic by mask)."""
    mask = np.arange(1 << len(letters))
    found, shapley = [], dict.fromkeys(letters, 0)
    for order in itertools.permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            fails, passed = (mask & bit) > 0, (mask & before) == 0
            lost = counts[:, fails & passed].sum(axis=1).tolist()
            shapley[letter] += lost[0]
            before |= bit
            kept, redundant = counts[0, (mask & before) == 0].sum(), counts[0, fails & ~passed].sum()
            found.append((letter, ("".join(order), step, int(kept), lost[0], int(redundant), int(counts[0, bit]), lost[1], lost[2])))
    for letter, row in found:
        yield (*row, shapley[letter])


def audit_filters(
    docs: DataFrame, labels: DataFrame, checks: dict[str, Callable[[Text], bool]] = CHECKS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """A row for each part, order of the filters and step: the documents kept after it, removed by it, redundant (they fail
    its filter and were removed before), unique_fails (they fail its filter alone), good_lost and toxic_lost (removed and so labelled) and shapley (what
    its filter removes, over all orders).

    Null and empty texts are one text; very long texts are read whole. Rows that repeat an id count one by one and are no
    duplicates of each other; of an id labelled twice, each label counts once. Documents without an id have no
    label. An empty table has no parts and gives no rows; other columns are left out, whatever their names."""
    spark = docs.sparkSession
    letters = "".join(checks) + DUPLICATE
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"the orders of {len(letters)} filters are too many to list")
    masks = materialize(filter_masks(docs, checks, id_col, text_col, part_col), "masks").groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    marked = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("label_id"))
    marked = marked.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    judged = masks.join(marked, F.col("id") == F.col("label_id"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False)))
    shape = (3, 1 << len(letters))

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[:, mask] += (n, n * good, n * toxic)
        return counts

    by_part = judged.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: add(np.zeros(shape, np.int64), row), add, np.add)
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return spark.createDataFrame(by_part.flatMap(lambda x: ((x[0], *row) for row in _steps(x[1], letters))), schema, verifySchema=False)
