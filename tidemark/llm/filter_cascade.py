"""URL filters with Bloom filter cascades.

A list of rules (host, path, verdict) is encoded per verdict. Level 1 of a cascade holds the listed
keys. Level 2 holds the keys of the corpus that level 1 takes for listed ones, level 3 the listed
keys that level 2 takes for such, and so on until no false positive is left. The corpus's complete
key universe is known, so a key's depth tells exactly whether it is listed: judging a url needs no join (building
a cascade has one, of the universe with the list).

A url's keys are every suffix of its host (by labels) with every prefix of its path that has the
length of some rule's path; the longest listed key wins. Only suffixes and prefixes that can equal
a rule are formed, so long urls stay cheap and nothing is lost.

A cascade is built by aggregations only (bits of a level are or-ed by 64-bit word) and its levels are collected,
checked against ``max_filter_bytes``; a list or universe that needs a larger level is split by key hash into
parts with cascades of their own, and split again if a part comes out too large. One pass over the urls
probes as many cascades as keep below ``max_filter_bytes`` together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MASK, append_columns, materialize, mix, release, small_batches

#: Bits per key and probes of the first level and of the later ones.
FIRST, LATER = (12.0, 8), (2.9, 2)
MOST_LEVELS, MOST_PARTS = 60, 4096


@dataclass
class Level:
    bits: np.ndarray  # 64-bit words
    probes: int
    level: int

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = np.uint64(64 * len(self.bits))
        out = np.ones(len(a), bool)
        for i in range(self.probes):
            at = probe_at(a, b, i, self.level, m)
            out &= ((self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def probe_at(a: np.ndarray, b: np.ndarray, i: int, level: int, m: np.uint64) -> np.ndarray:
    """The i-th bit of a key in a level of m bits; levels hash independently of one another."""
    salt = np.uint64((level * 0x9E3779B97F4A7C15) & MASK)
    return (mix(a + salt) + np.uint64(i) * (mix(b ^ salt) | np.uint64(1))) % m


def depth(cascade: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first level (0 is the first) that does not hold the key."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for level in cascade:
        live = live[level.holds(a[live], b[live])]
        out[live] += 1
    return out


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("cascade"), key)


class LevelTooLarge(ValueError):
    pass


def _build_level(keys: DataFrame, n: int, level: int, max_bytes: int) -> Level:
    per_key, probes = FIRST if level == 0 else LATER
    words = max(1, int(np.ceil(n * per_key / 64)))
    if words * 8 > max_bytes:
        raise LevelTooLarge(f"a level of {words * 8} bytes exceeds {max_bytes}")
    small_batches(keys.sparkSession)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(x).view(np.uint64) for x in batch.columns)
            at = np.concatenate([probe_at(a, b, i, level, np.uint64(64 * words)) for i in range(probes)])
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64))], names=["at"])

    at = keys.select("a", "b").mapInArrow(places, "at long")
    set_bits = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    bits = np.zeros(words, np.uint64)
    got = set_bits.toArrow()  # at most one row for each word of the level, whose size is checked above
    bits[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Level(bits, probes, level)


def _probe(df: DataFrame, levels: list[Level], name: str) -> DataFrame:
    """Adds how many of the levels in a row hold the key (a, b)."""
    shared = df.sparkSession.sparkContext.broadcast(levels)

    def make():
        return lambda a, b: [depth(shared.value, np.asarray(a).view(np.uint64), np.asarray(b).view(np.uint64))]

    return append_columns(df, [F.col("a"), F.col("b")], [T.StructField(name, T.LongType())], make)


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int) -> list[Level]:
    """Cascade of the keys ``listed`` that is exact on ``universe`` (both: key, a, b; distinct)."""
    inside, outside = listed, universe.join(listed.select("key"), "key", "left_anti")
    cascade: list[Level] = []
    while (n := inside.count()) or not cascade:
        if len(cascade) == MOST_LEVELS:
            raise ValueError("two keys have the same 128-bit hash")
        level = _build_level(inside, n, len(cascade), max_bytes)
        cascade.append(level)
        positives = _probe(outside, [level], "d").where("d = 1").select("key", "a", "b")
        inside, outside = materialize(positives, "positives"), inside
    return cascade


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty without "://"."""
    rest = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(rest, lower).otherwise(""), F.when(rest, path).otherwise("")


def candidate_keys(host: Column, path: Column, most_labels: int, path_lengths: list[int]) -> Column:
    """The url's keys that can equal a rule, longest first (of equal length, the longer host)."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most_labels))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    keys = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.flatten(F.array(*[
                F.when(F.length(path) >= k, F.array(F.struct((-(F.length(s) + k)).alias("o"), (-F.length(s)).alias("h"), F.concat(s, F.substring(path, 1, k)).alias("key")))).otherwise(F.array().cast("array<struct<o:int,h:int,key:string>>"))
                for k in path_lengths
            ])),
        )
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(keys), lambda x: x["key"]))


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame,
    url_col: str = "url",
    default: str = "allow",
    max_filter_bytes: int = 64_000_000,
) -> DataFrame:
    """``pages`` with host, path, rule (the longest fitting rule's host and path, else null) and verdict.

    ``rules`` are (host, path, verdict) rows. A rule fits its host and all subdomains if the url's
    path starts with the rule's; the longest host and path together win, then the longer host.
    Without a fitting rule the verdict is ``default``. A null url or one without "://" has an empty
    host and path and fits no rule. Repeated rules count once; of rules that differ only in their
    verdict the first verdict by name wins. Very long urls form only the keys that can equal a rule. Pages are judged row by row; an empty table stays
    empty, an empty list gives ``default`` throughout. Input columns named like an output column are replaced.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    a, b = _hashes(F.col("key"))
    keyed = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select("host", "path", "verdict", F.concat("host", "path").alias("key")).select("*", a.alias("a"), b.alias("b"))
    keyed = materialize(keyed, "rules")
    shape = keyed.agg(F.max(F.size(F.split("host", r"\.", -1))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count("*").alias("n"), F.collect_set("verdict").alias("verdicts")).first()
    host, path = url_parts(F.col(f"`{url_col}`"))
    base = pages.drop("host", "path", "rule", "verdict")
    wide = pages.select(*[pages[f"`{c}`"] for c in base.columns], host.alias("host"), path.alias("path"))
    if not shape.n:
        return wide.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = candidate_keys(F.col("host"), F.col("path"), shape.labels, sorted(shape.lengths))
    wide = wide.withColumn("__keys", keys)
    universe = materialize(wide.select(F.explode("__keys").alias("key")).distinct().select("key", a.alias("a"), b.alias("b")), "universe")

    verdicts = sorted(shape.verdicts)
    parts = 1 << max(0, int(np.ceil(1.1 * shape.n * FIRST[0] / 8 / max_filter_bytes)) - 1).bit_length()
    def cascades() -> Iterator[tuple[int, int, int, list[Level]]]:
        """(verdict, part, parts, levels), one at a time; a part whose cascade is too large is split by itself."""
        todo = [(v, part, parts) for v in range(len(verdicts)) for part in range(parts)]
        while todo:
            v, part, of = todo.pop(0)
            mine = F.pmod(F.col("b"), F.lit(of)) == part
            listed = keyed.where((F.col("verdict") == verdicts[v]) & mine).select("key", "a", "b")
            try:
                yield v, part, of, build_cascade(listed, universe.where(mine), max_filter_bytes)
            except LevelTooLarge:
                if of >= MOST_PARTS:
                    raise
                todo[:0] = [(v, part, 2 * of), (v, part + of, 2 * of)]

    wide = wide.withColumn("__hit", F.lit(-1).cast("long")).withColumn("__verdict", F.lit(-1).cast("long"))
    together: list[tuple[int, int, int, list[Level]]] = []
    size = 0
    written = None
    for one in cascades():
        n = sum(level.bits.nbytes for level in one[3])
        if together and size + n > max_filter_bytes:
            # what these cascades say is written, and they are gone before the next ones are built
            judged, shared = _judge(wide, together)
            wide = materialize(judged, "judged")
            shared.destroy()
            if written is not None:
                release(written)
            written, together, size = wide, [], 0
        together.append(one)
        size += n
    wide, _ = _judge(wide, together)
    rule = F.when(F.col("__hit") >= 0, F.try_element_at("__keys", (F.col("__hit") + 1).cast("int")))
    named = F.when(F.col("__verdict") >= 0, F.element_at(F.array(*map(F.lit, verdicts)), (F.col("__verdict") + 1).cast("int"))).otherwise(default)
    return wide.select(*base.columns, "host", "path", rule.alias("rule"), named.alias("verdict"))


def _judge(wide: DataFrame, passes: list[tuple[int, int, int, list[Level]]]) -> tuple[DataFrame, Broadcast]:
    """Take the url's first key in any of these cascades (verdict, part, parts, levels), which are broadcast, if it comes before the one found so far."""
    shared = wide.sparkSession.sparkContext.broadcast(passes)
    keys = F.col("__keys")
    pairs = (F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(F.lit("cascade"), k)))

    def make():
        def run(a: pa.ListArray, b: pa.ListArray, hit: pa.Array, verdict: pa.Array) -> list:
            hit, verdict = np.array(hit), np.array(verdict)
            ends = np.cumsum(np.array([len(x) for x in a]))
            av, bv = np.asarray(a.flatten()).view(np.uint64), np.asarray(b.flatten()).view(np.uint64)
            for v, part, parts, cascade in shared.value:
                mine = np.flatnonzero(bv.view(np.int64) % parts == part)
                at = mine[depth(cascade, av[mine], bv[mine]) % 2 == 1]
                row, first = np.unique(np.searchsorted(ends, at, "right"), return_index=True)
                place = at[first] - np.concatenate([[0], ends])[row]
                better = (hit[row] < 0) | (place < hit[row])
                hit[row[better]], verdict[row[better]] = place[better], v
            return [hit, verdict]

        return run

    fields = [T.StructField("__hit", T.LongType()), T.StructField("__verdict", T.LongType())]
    return append_columns(wide, [*pairs, F.col("__hit"), F.col("__verdict")], fields, make), shared
