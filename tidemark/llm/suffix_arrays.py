"""Benchmark decontamination with suffix arrays over the training words.

The documents of a task are gathered into shards of a bounded number of words. A shard is a word
sequence over the benchmark's vocabulary (any other word ends a match) with its suffix array. The
windows that begin the test suffixes are binary-searched in every shard, each different one once;
the range found holds all places where it occurs verbatim. From these places the longest verbatim
matches follow by a binary search among the benchmark's own sorted suffixes. Windows that occur in
the same items share one list of them, so neither repeated words nor shared passages multiply.

The suffix array leaves out suffixes with fewer benchmark words ahead than the shortest window,
which cannot hold a match, and is sorted to a window's length. Matches that hold no window are not
reported. Words are known by 64-bit hashes.

The benchmark is read in blocks of bounded size. A few blocks at a time are broadcast, and one pass
over the documents searches them, so the benchmark's total size is not limited: each
``pass_blocks * block_bytes`` of it cost one pass. Documents are not shuffled.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, materialize, mix, small_batches, text_bytes

#: A-Z become a-z; other ASCII but digits and letters parts words.
TO_WORDS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class TestBlock:
    """A block of benchmark items as arrays: the distinct windows that begin its suffixes, each with the set
    of items it occurs in, and the sorted suffixes of all items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.ids, self.window = [i for i, _ in items], window
        hasher = WordHash()
        hashes = [hasher.of(words) for _, words in items]
        self.vocabulary = np.unique(np.concatenate(hashes))
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.per_key = max(1, 62 // self.bits)
        sequences = [self.numbers(h) for h in hashes]
        widths = np.array([min(window, len(s)) for s in sequences])
        self.least, self.longest = int(widths.min()), max(map(len, sequences))
        self.flat = np.concatenate([np.append(s, 0) for s in sequences])
        self.starts = np.cumsum([0, *(len(s) + 1 for s in sequences[:-1])])
        n = np.array([len(s) for s in sequences]) - widths + 1
        item, width = np.repeat(np.arange(len(items)), n), np.repeat(widths, n)
        self._windows(item, width, np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + self.starts[item])
        self._sort_suffixes()

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary from 1; 0 for any other word."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def _windows(self, item: np.ndarray, width: np.ndarray, at: np.ndarray) -> None:
        keys = []
        for depth in range(0, int(width.max()), self.per_key):
            key = np.zeros(len(at), np.int64)
            for j in range(depth, depth + self.per_key):
                key = (key << self.bits) | np.where(j < width, self.flat[np.minimum(at + j, len(self.flat) - 1)], 0)
            keys.append(key)
        order = np.lexsort((item, *keys, width))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (width, *keys)], axis=0)
        which = np.cumsum(new) - 1
        head = order[new]
        self.width, self.keys, self.at = width[head], [k[head] for k in keys], at[head]
        # windows of the same items form a class, so that a passage many items share is named once
        pairs = np.unique(which * len(self.ids) + item[order])
        of, member = pairs // len(self.ids), pairs % len(self.ids)
        begin = np.searchsorted(of, np.arange(len(head) + 1))
        prints = np.add.reduceat(mix(member.astype(np.uint64) + np.uint64(1)), begin[:-1])
        _, one, self.window_class = np.unique(prints, return_index=True, return_inverse=True)
        self.class_items = [member[begin[w] : begin[w + 1]] for w in one]

    def _sort_suffixes(self) -> None:
        rank = self.flat
        step = 1
        while step < 2 * self.longest:
            after = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), rank.dtype)])[: len(rank)]
            values, rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)
            if len(values) == len(rank):
                break
            step *= 2
        places = np.flatnonzero(self.flat)
        self.order = places[np.argsort(rank[places], kind="stable")]
        stops = np.flatnonzero(self.flat == 0)
        self.ahead = np.zeros(len(self.flat), np.int64)
        self.ahead[places] = stops[np.searchsorted(stops, places)] - places


class Shard:
    """Suffix array of a word-number sequence; 0 stands for any other word and ends a match."""

    def __init__(self, ids: np.ndarray, tests: TestBlock) -> None:
        self.tests, self.bits, self.per_key = tests, tests.bits, tests.per_key
        stops = np.flatnonzero(ids == 0)
        places = np.flatnonzero(ids)
        ahead = stops[np.searchsorted(stops, places)] - places  # benchmark words ahead; ids ends with 0
        fit = ahead >= tests.least
        self.ids = np.concatenate([ids, np.zeros(self.per_key, ids.dtype)])
        pos, ahead = places[fit], ahead[fit]
        order = np.argsort(key := self.key(pos, ahead, 0), kind="stable")
        pos, ahead, key = pos[order], ahead[order], key[order]
        self.first = key
        new = np.ones(len(pos), bool)
        new[1:] = key[1:] != key[:-1]
        for depth in range(self.per_key, int(tests.width.max()), self.per_key):
            tied = ~new
            tied[:-1] |= ~new[1:]
            where = np.flatnonzero(tied)
            if not len(where):
                break
            group = np.cumsum(new)[where]
            k = self.key(pos[where], ahead[where], depth)
            order = np.lexsort((k, group))
            pos[where], ahead[where], k = pos[where][order], ahead[where][order], k[order]
            new[where[1:]] |= (k[1:] != k[:-1]) & ~new[where[1:]]
        self.pos, self.ahead = pos, ahead

    def key(self, pos: np.ndarray, ahead: np.ndarray, depth: int) -> np.ndarray:
        """The words depth to depth + per_key of the suffixes, packed; 0 beyond their end."""
        key = np.zeros(len(pos), np.int64)
        for j in range(depth, depth + self.per_key):
            at = np.minimum(pos + j, len(self.ids) - 1)
            key = (key << self.bits) | np.where(j < ahead, self.ids[at], 0)
        return key

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct window the range of the suffix array that begins with it."""
        tests = self.tests
        lo, hi = np.zeros(len(tests.width), np.int64), np.full(len(tests.width), len(self.pos), np.int64)
        for level, key in enumerate(tests.keys):
            depth = level * self.per_key
            taken = np.clip(tests.width - depth, 0, self.per_key)
            free = (self.per_key - taken) * self.bits  # bits that the window leaves open
            low, high = key, key + (np.int64(1) << free) - 1
            if level == 0:
                lo = np.searchsorted(self.first, low, "left")
                hi = np.searchsorted(self.first, high, "right")
            else:
                live = np.flatnonzero((lo < hi) & (taken > 0))
                lo[live], hi[live] = (
                    self.bisect(lo[live], hi[live], depth, low[live], False),
                    self.bisect(lo[live], hi[live], depth, high[live], True),
                )
        return lo, np.maximum(lo, hi)

    def bisect(self, lo: np.ndarray, hi: np.ndarray, depth: int, key: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            got = self.key(self.pos[mid], self.ahead[mid], depth)
            right = got <= key[open_] if after else got < key[open_]
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in the shard, number of the distinct window there): at most one for each place and width."""
        lo, hi = self.ranges()
        n = hi - lo
        w = np.repeat(np.arange(len(n)), n)
        return self.pos[lo[w] + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)], w


class Extender:
    """The longest benchmark match from given places of a shard: a binary search among the benchmark's sorted
    suffixes, with common lengths found by comparing prefix hashes."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ids: np.ndarray, tests: TestBlock) -> None:
        self.ids, self.tests = ids, tests
        stops = np.flatnonzero(ids == 0)
        self.ahead = stops[np.searchsorted(stops, np.arange(len(ids)))] - np.arange(len(ids))
        n = max(len(ids), len(tests.flat)) + 1
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, self.BASE)]))
        self.mine, self.theirs = self._sums(ids), self._sums(tests.flat)

    def _sums(self, numbers: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(numbers.astype(np.uint64)) * self.power[: len(numbers)])])

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(p), np.int64), np.minimum(self.ahead[p], self.tests.ahead[q])
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            a, b = p[open_], q[open_]
            same = (self.mine[a + mid] - self.mine[a]) * self.power[b] == (self.theirs[b + mid] - self.theirs[b]) * self.power[a]
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1
        return low

    def longest(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the number of words of its longest match and where in the benchmark it begins."""
        order = self.tests.order
        lo, hi = np.zeros(len(p), np.int64), np.full(len(p), len(order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            q, a = order[mid], p[open_]
            n = self.common(a, q)
            right = self.tests.flat[q + n] < self.ids[a + n]
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        before, after = order[np.maximum(lo - 1, 0)], order[np.minimum(lo, len(order) - 1)]
        n, m = self.common(p, before), self.common(p, after)
        return np.maximum(n, m), np.where(n >= m, before, after)


#: Places whose longest matches are looked up together.
TOGETHER = 200_000
Found = tuple[list[int], list[str], dict]


def match_shard(hashes: np.ndarray, starts: np.ndarray, tests: TestBlock) -> dict[int, Found]:
    """Of the documents of a shard (word hashes, one gap after each) that hold a window: spans of hit words
    (begin and end alternate), ids of the items with a window there, and the longest match."""
    ids = tests.numbers(hashes)
    ids[starts[1:] - 1] = 0
    place, w = Shard(ids, tests).matches()
    if not len(place):
        return {}
    n = len(ids)
    covered = np.cumsum(np.bincount(place, minlength=n + 1) - np.bincount(place + tests.width[w], minlength=n + 1)) > 0
    turns = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=np.int8(0)))  # begins and ends in turn; a gap parts documents
    of_turn = np.searchsorted(starts, turns[::2], "right") - 1
    docs, first = np.unique(of_turn, return_index=True)
    last = np.append(first[1:], len(of_turn))
    classes = np.unique((np.searchsorted(starts, place, "right") - 1) * len(tests.class_items) + tests.window_class[w])
    of_class, classes = classes // len(tests.class_items), classes % len(tests.class_items)
    extend = Extender(ids, tests)
    widest = np.lexsort((-tests.width[w], place))
    place, one = np.unique(place[widest], return_index=True)
    w = w[widest][one]
    parts = [extend.longest(place[s : s + TOGETHER]) for s in range(0, len(place), TOGETHER)]
    length, where = (np.concatenate(x) for x in zip(*parts, strict=True))
    short = length < tests.window  # then only a whole short item holds its window
    length[short], where[short] = tests.width[w[short]], tests.at[w[short]]
    of_place = np.searchsorted(starts, place, "right") - 1
    order = np.lexsort((place, -length, of_place))
    best = order[np.searchsorted(of_place[order], docs)]
    out: dict[int, Found] = {}
    for d, lo, hi, k in zip(docs.tolist(), first.tolist(), last.tolist(), best.tolist(), strict=True):
        items = np.unique(np.concatenate([tests.class_items[c] for c in classes[slice(*np.searchsorted(of_class, (d, d + 1)))]]))
        item = int(np.searchsorted(tests.starts, where[k], "right")) - 1
        longest = {"words": int(length[k]), "item_id": tests.ids[item], "item_at": int(where[k] - tests.starts[item]), "doc_at": int(place[k] - starts[d])}
        out[d] = ((turns[2 * lo : 2 * hi] - starts[d]).tolist(), sorted({tests.ids[i] for i in items.tolist()} - {None}), longest)
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[TestBlock]:
    """The items that have words, in blocks of about ``block_bytes`` of text; the driver holds one block's words at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), text_bytes(text_col).alias("t")).distinct().orderBy("i", "t")
    for row in rows.toLocalIterator():
        if words := words_of(bytes(row.t)):
            block.append((row.i, words))
            size += len(row.t)
        if size >= block_bytes:
            yield TestBlock(block, window)
            block, size = [], 0
    if block:
        yield TestBlock(block, window)


def _search(docs: DataFrame, blocks: list[TestBlock], shard_words: int) -> tuple[DataFrame, Broadcast]:
    """Merge the hits of some blocks, which are broadcast, into the columns of ``docs`` that begin with __; texts are parted into words once."""
    tests = docs.sparkSession.sparkContext.broadcast(blocks)
    schema = docs.schema
    at = {n: i for i, n in enumerate(schema.fieldNames())}
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, sequences, total = WordHash(), [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            for t in b.column(at["__text"]):
                sequences.append(hasher.of(words_of(t.as_py())))
                total += len(sequences[-1])
            held.append(b)
            if total >= shard_words:
                yield from merge(held, sequences)
                held, sequences, total = [], [], 0
        if held:
            yield from merge(held, sequences)
        pa.default_memory_pool().release_unused()

    def merge(held: list[pa.RecordBatch], sequences: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gap = np.zeros(1, np.uint64)
        starts = np.cumsum([0, *(len(s) + 1 for s in sequences)])
        hashes = np.concatenate([x for s in sequences for x in (s, gap)])
        found = [match_shard(hashes, starts, block) for block in tests.value]
        k = 0
        for b in held:
            n_words = pa.array([len(s) for s in sequences[k : k + b.num_rows]], pa.int64())
            new = {"__words": n_words}
            if any(k <= d < k + b.num_rows for f in found for d in f):
                old = [b.column(at[c]).to_pylist() for c in ("__spans", "__items", "__longest")]
                for i in range(b.num_rows):
                    for spans, items, longest in (f[k + i] for f in found if k + i in f):
                        old[0][i] = old[0][i] + spans
                        old[1][i] = old[1][i] + items
                        old[2][i] = max(old[2][i], longest, key=lambda x: x["words"])
                new |= {c: pa.array(x, b.column(at[c]).type) for c, x in zip(("__spans", "__items", "__longest"), old, strict=True)}
            k += b.num_rows
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(i)) for n, i in at.items()], names=list(at))

    return docs.mapInArrow(run, schema), tests


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shard_words: int = 600_000,
    block_bytes: int = 4_000_000,
    pass_blocks: int = 4,
) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted strings) and longest (words, item_id, item_at, doc_at).

    Words: A-Z lower-cased runs of digits, letters and any character beyond ASCII. A window is
    ``window`` consecutive words of an item, or the whole item if it has fewer words. n_hit counts
    the document's words inside any occurrence of a window; item_ids names the items with a window
    in the document; longest is the longest verbatim match with an item that holds a window of it, with its places
    (0 words, null if none; of equal ones the first in the document).
    Null and empty texts have no words and no hits. Items without words match nothing; items with a
    null id hit words but are not named; repeated items count once. Repeated documents are judged
    row by row; a very long one makes a shard of its own. An empty table or benchmark gives no hits. Input columns named like an output
    column are replaced.
    """
    outputs = ("n_words", "n_hit", "item_ids", "longest")
    kept = docs.drop(*outputs)
    empty = "cast(named_struct('words', 0L, 'item_id', null, 'item_at', 0L, 'doc_at', 0L) as struct<words:bigint,item_id:string,item_at:bigint,doc_at:bigint>)"
    wide = kept.select(
        *[kept[f"`{c}`"] for c in kept.columns],
        text_bytes(text_col).alias("__text"),
        F.lit(0).cast("long").alias("__words"),
        F.expr("cast(array() as array<bigint>)").alias("__spans"),
        F.expr("cast(array() as array<string>)").alias("__items"),
        F.expr(empty).alias("__longest"),
    )
    blocks = iter(benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes))
    passes = iter(lambda: list(itertools.islice(blocks, pass_blocks)), [])
    first, second = next(passes, []), next(passes, None)  # without items each document still gets its number of words
    if second is None:
        return _united(_search(wide, first, shard_words)[0], kept.columns)
    # several passes: each is written by itself, and its blocks are gone before the next one's are broadcast
    texts = materialize(wide.withColumn("__row", F.monotonically_increasing_id()), "texts")
    found = []
    for i, some in enumerate(itertools.chain([first, second], passes)):
        hits, shared = _search(texts, some, shard_words)
        hits = hits.select("__row", F.lit(i).alias("__pass"), "__words", "__spans", "__items", "__longest")
        found.append(materialize(hits.where("size(__spans) > 0") if i else hits, "hits"))
        shared.destroy()
    every = functools.reduce(DataFrame.unionByName, found)
    best = F.max_by("__longest", F.struct(F.col("__longest.words"), -F.col("__pass")))
    merged = every.groupBy("__row").agg(
        F.max("__words").alias("__words"), F.flatten(F.collect_list("__spans")).alias("__spans"), F.flatten(F.collect_list("__items")).alias("__items"), best.alias("__longest")
    )  # as many arrays as passes found something
    return _united(texts.drop("__words", "__spans", "__items", "__longest", "__text").join(merged, "__row"), kept.columns)


def _united(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct hit words over the spans of all blocks (begin and end alternate), then the final columns."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size("__spans") / 2).cast("int") - 1), lambda i: F.struct(
        F.element_at("__spans", (i * 2 + 1).cast("int")).alias("s"), F.element_at("__spans", (i * 2 + 2).cast("int")).alias("e"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(
        pairs, zero,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"),
            F.greatest(a["end"], x["e"]).alias("end"),
        ),
    )["n"]
    return wide.select(
        *[wide[f"`{c}`"] for c in columns],
        F.col("__words").alias("n_words"),
        F.when(F.size("__spans") > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.array_sort(F.array_distinct("__items")).alias("item_ids"),
        F.col("__longest").alias("longest"),
    )
