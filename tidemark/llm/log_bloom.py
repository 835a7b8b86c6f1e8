"""Language-model scoring with a log-frequency Bloom filter.

1. Words and word pairs of the training texts are counted in one pass: pre-aggregated within tasks,
   then brought together by block (a remainder of the key's hash) and summed there. A row on the way holds the
   keys and counts of one block, ``ROW_KEYS`` at most, as two byte strings.
2. The filter holds the quantised count of every word and every pair: for a count of level q it
   contains the n-gram once for each level up to q. A reader probes levels further and further apart until
   one is missing, then halves. Counts up to 7 have levels of their own; above, levels lie a factor of about 1.15
   apart, and a hash of the key decides between the two levels around a count in proportion to its place, so
   that counts are right on average and those after a word add up to the word's own count.
   Each block has a filter of its own, sized by its n-grams. Blocks of ``MAX_BROADCAST`` bytes together are broadcast;
   more than that stay in the shared scratch folder.
3. One pass over all texts scores them: a task gathers the tokens of many texts and probes block after
   block, those of the folder read one at a time. The word estimate is additive, P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), with
   one share for all words that training never met; the pair estimate is smoothed by it (Dirichlet prior),
   P(w | v) = (c(v, w) + ``PRIOR`` P(w)) / (c(v) + ``PRIOR`` + f), where f is the number of words that the filter is expected
   to take for followers of v by mistake. Over the whole vocabulary the probabilities after any word sum to one, but
   for the rounding of counts and the filter's mistakes.
4. The same pass adds up the exact base score over frequent tokens (relative frequency ``FLOOR`` or
   more, at most 1 / FLOOR by arithmetic, so they may be broadcast) and writes each text's rarer
   tokens with their numbers. Those alone are joined with the full table of word counts to complete
   the base score; the table itself is never broadcast.

Keys are 64-bit hashes whose last bit tells words (0) from pairs (1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MASK, WordHash, materialize, mix, small_batches, text_bytes, to_arrow

FLOOR = 2e-7
#: Least ratio of neighbouring count levels beyond the whole numbers that lie closer.
RATIO = 1.15
#: Probes, and bits of the filter for each entry, of level 1 (is the n-gram there at all) and of the levels above.
FIRST, ABOVE = (22, 32), (8, 12)
#: Weight of the word estimate in a pair estimate, in tokens; what is added to each word's count.
PRIOR, ADDED = 30.0, 0.1
#: Tokens that a task gathers before it hands on their counts, and before it reads the filter.
FLUSH, GROUP = 1_500_000, 900_000
#: Keys in a row of counts that goes to a block.
ROW_KEYS = 20_000
#: Training text for each block of the filter; size of the files the blocks lie in; largest filter that is broadcast.
BLOCK_TEXT, FILE_BYTES, MAX_BROADCAST = 16_000_000, 128_000_000, 32_000_000
END = xxhash.xxh64_intdigest(b"\n") & ~1  # no word is a line feed


def token_hashes(text: bytes, hasher: WordHash) -> np.ndarray:
    return np.append(hasher.of(text.lower().split()), np.uint64(END)) & np.uint64(MASK - 1)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) + second) | np.uint64(1)


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(blocks)).astype(np.uint16 if blocks <= 1 << 16 else np.int64)  # 16 bits are sorted faster


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    h, k = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(h)
    h, k = h[order], k[order]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[head], np.add.reduceat(k, head) if len(h) else k


def _counted(texts: DataFrame, blocks: int) -> DataFrame:
    """(h, n) of all words of ``texts`` (column __text), and (block, first, above): each block's filter of all words and pairs."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHash(), [], 0
        for b in batches:
            for t in b.column(0):
                held.append(token_hashes(t.as_py(), hasher))
                size += len(held[-1])
            if size >= FLUSH:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)
        pa.default_memory_pool().release_unused()

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words = np.concatenate(held)
        before = np.append(words[-1:], words[:-1])  # a text's end precedes the next text, the last one's the first
        for keys in (words, pair_hashes(before, words)):
            h, n = np.unique(keys, return_counts=True)
            yield from packed(h, n.astype(np.uint32))  # at most the tokens held

    def packed(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        of = _block(h, blocks)
        order = np.argsort(of, kind="stable")
        of, h, n = of[order], h[order], n[order]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        rows = [(int(of[a]), h[i : min(i + ROW_KEYS, b)].tobytes(), n[i : min(i + ROW_KEYS, b)].tobytes()) for a, b in zip(starts, np.append(starts[1:], len(of)), strict=True) for i in range(a, b, ROW_KEYS)]
        for i in range(0, len(rows), 50):
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows[i : i + 50], strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "h", "n"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, size, least = [], [], 0, FLUSH
        for b in batches:
            for hs, ns in zip(b.column(1), b.column(2), strict=True):
                keys.append(np.frombuffer(hs.as_py(), np.uint64))
                n.append(np.frombuffer(ns.as_py(), np.uint32).astype(np.int64))
                size += len(keys[-1])
            if size >= least:
                h, k = _summed(keys, n)
                keys, n, size, least = [h], [k], len(h), max(FLUSH, 2 * len(h))
        if not size:
            return
        h, k = _summed(keys, n)
        keys, n = [], []
        word = np.flatnonzero(h & np.uint64(1) == 0)
        for s in range(0, len(word), 100_000):
            at = word[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(k[at]), pa.nulls(len(at), pa.int32()), *[pa.nulls(len(at), pa.binary())] * 2], names=names)
        of = _block(h, blocks)
        for block in np.unique(of):  # one, unless tasks were given several
            mine = of == block
            bloom = LogBloom.of_counts(h[mine], k[mine])
            bits = [pa.array([x.tobytes()], pa.binary()) for x in (bloom.first, bloom.above)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([block], pa.int32()), *bits], names=names)
        pa.default_memory_pool().release_unused()

    names = ["h", "n", "block", "first", "above"]
    counts = texts.mapInArrow(count, "block int, h binary, n binary").repartitionById(blocks, F.col("block"))
    return counts.mapInArrow(build, "h long, n long, block int, first binary, above binary")


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a table of bounded size (h, n), ordered by h."""
    got = df.toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, -1 if missing."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def level_counts() -> np.ndarray:
    """The count that each level stands for, from level 1."""
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, round(out[-1] * RATIO)))
    return np.array(out, np.int64)


LEVELS = level_counts()


def levels_of(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each count's level: one of the two around it, by a hash of the key, so that the mean is right."""
    low = np.searchsorted(LEVELS, n, "right") - 1
    high = np.minimum(low + 1, len(LEVELS) - 1)
    draw = (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(float) / (1 << 53)
    return 1 + low + (draw * (LEVELS[high] - LEVELS[low]) < n - LEVELS[low])


def _probe(keys: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(keys + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return a, mix(a) | np.uint64(1)


class Bits:
    """A Bloom filter over (key, level)."""

    def __init__(self, bits: np.ndarray, probes: int) -> None:
        self.bits, self.probes, self.m = bits, probes, np.uint64(64 * len(bits))

    @classmethod
    def of(cls, parts: Iterator[tuple[np.ndarray, int]], entries: int, probes: int, per_entry: int) -> Bits:
        """The filter of some (keys, level)."""
        m = 64 * max(1, -(-entries * per_entry // 64))
        flags = np.zeros(m, bool)
        for keys, level in parts:
            a, step = _probe(keys, level)
            for i in range(probes):
                flags[(a + np.uint64(i) * step) % np.uint64(m)] = True
        return cls(np.packbits(flags, bitorder="little").view(np.uint64), probes)

    def held(self, keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
        """Which of the keys are there, a key leaving at its first missing bit."""
        a, step = _probe(keys, level)
        live = np.arange(len(keys))
        for i in range(self.probes):
            at = (a + np.uint64(i) * step) % self.m
            there = (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            if not there.all():
                live, a, step = live[there], a[there], step[there]
        out = np.zeros(len(keys), bool)
        out[live] = True
        return out


@dataclass
class LogBloom:
    """N-grams and their quantised counts: the bits of level 1 and those of the levels above."""

    first: np.ndarray
    above: np.ndarray

    @classmethod
    def of_counts(cls, keys: np.ndarray, n: np.ndarray) -> LogBloom:
        q = levels_of(keys, n)
        first = Bits.of(iter([(keys, 1)]), len(keys), *FIRST)
        higher = ((keys[q >= level], level) for level in range(2, int(q.max(initial=1)) + 1))
        return cls(first.bits, Bits.of(higher, int((q - 1).sum()), *ABOVE).bits)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key's level; 0 where level 1 is missing."""
        found = np.flatnonzero(Bits(self.first, FIRST[0]).held(keys, 1))
        above = Bits(self.above, ABOVE[0])
        low, high = np.ones(len(found), np.int64), np.full(len(found), len(LEVELS), np.int64)
        reach = np.ones(len(found), np.int64)  # how far up to look while no missing level is known
        open_ = np.arange(len(found))
        while len(open_):
            step = np.minimum(reach[open_], (high[open_] - low[open_] + 1) // 2)
            level = low[open_] + step
            there = above.held(keys[found[open_]], level)
            low[open_[there]] = level[there]
            high[open_[~there]] = level[~there] - 1
            reach[open_[there]] *= 2
            open_ = open_[low[open_] < high[open_]]
        out = np.zeros(len(keys))
        out[found] = LEVELS[low - 1]
        return out


@dataclass
class Filter:
    """The filter's blocks (number, bits of level 1, bits of the levels above): in memory, or in files that all executors can read."""

    blocks: int
    held: list[tuple[int, bytes, bytes]] | None = None
    path: str = ""

    def read(self) -> Iterator[tuple[int, memoryview, memoryview]]:
        """All blocks, those in files one in memory at a time."""
        if self.held is not None:
            yield from ((block, memoryview(first), memoryview(above)) for block, first, above in self.held)
            return
        fs, path = pyarrow.fs.FileSystem.from_uri(self.path)
        for f in fs.get_file_info(pyarrow.fs.FileSelector(path)):
            if f.base_name.endswith(".parquet"):
                with fs.open_input_file(f.path) as source:
                    for b in pq.ParquetFile(source, buffer_size=1 << 22).iter_batches(1, columns=["block", "first", "above"], use_threads=False):
                        for block, first, above in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                            yield block, first.as_buffer(), above.as_buffer()

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Estimated counts of distinct keys; every block is gone through once."""
        of = _block(keys, self.blocks)
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(self.blocks + 1))
        out = np.zeros(len(keys))
        for block, first, above in self.read():
            at = order[ends[block] : ends[block + 1]]
            if len(at):
                out[at] = LogBloom(np.frombuffer(first, np.uint64), np.frombuffer(above, np.uint64)).count(keys[at])
        return out


@dataclass
class Model:
    total: int
    distinct: int
    words: np.ndarray  # hashes of frequent tokens, sorted
    counts: np.ndarray
    filter: Filter
    least: int
    prior: float = PRIOR

    @property
    def scale(self) -> float:
        return self.total + ADDED * (self.distinct + 1)

    @property
    def mistaken(self) -> float:
        """Expected number of words that the filter takes for followers of a given word by mistake."""
        probes, per_entry = FIRST
        return (1 - np.exp(-probes / per_entry)) ** probes * self.distinct

    def log_probabilities(self, u: np.ndarray, now: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after the one before it; tokens are given by their places in ``u``."""
        pairs, which = np.unique(pair_hashes(u[before], u[now]), return_inverse=True)
        which = which.astype(np.int32)
        counts = self.filter.count(np.concatenate([u, pairs]))
        count, joint = counts[: len(u)], counts[len(u) :]
        at = find(self.words, u)
        count[at >= 0] = self.counts[at[at >= 0]]
        prior = self.prior * (count + ADDED) / self.scale
        base = count[before]
        return np.log10((np.minimum(joint[which], base) + prior[now]) / (base + self.prior + self.mistaken))


def train(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all texts in ``docs`` and the table (h, n) of all their token counts."""
    texts = docs.select(text_bytes(text_col).alias("__text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, int(np.ceil(size / BLOCK_TEXT)))
    counted = materialize(_counted(texts, blocks), "counted")
    table = counted.where("block is null").select("h", "n")
    filters = counted.where("block is not null").select("block", "first", "above")
    whole = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    bits = filters.agg(F.coalesce(F.sum(F.octet_length("first") + F.octet_length("above")), F.lit(0)).alias("n")).first().n
    if bits <= MAX_BROADCAST:
        shared = Filter(blocks, [(r.block, bytes(r.first), bytes(r.above)) for r in filters.collect()])
    else:
        filters = materialize(filters.coalesce(max(1, int(np.ceil(bits / FILE_BYTES)))), "filters")
        shared = Filter(blocks, path=filters._tidemark_path)
    total = int(whole.total)
    least = max(1, int(np.ceil(FLOOR * total)))
    words, counts = _arrays(table.where(F.col("n") >= least))  # at most 1 / FLOOR rows
    return Model(total, int(whole.distinct), words, counts, shared, least), table


def score(docs: DataFrame, model: Model, table: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words of the text (A-Z lower-cased, parted by ASCII white space) and one end.
    base_score adds log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens; score is the model's log10
    probability of the text. Null and empty texts consist of the end alone. Without training texts
    every count is 0. A very long text is scored whole, in a group of its own. Repeated rows are scored one by one; an empty table stays empty. Input columns
    named like an output column are replaced.
    """
    outputs = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    base = docs.drop(*outputs)
    columns = [c for c in base.columns if c != text_col]
    scale = model.scale
    shared = docs.sparkSession.sparkContext.broadcast(model)

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("__known", T.LongType()), T.StructField("__base", T.DoubleType()), T.StructField("score", T.DoubleType())]
    fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("__keys", "__times")]
    small_batches(docs.sparkSession)
    slim = docs.select(*[docs[f"`{c}`"] for c in columns], text_bytes(text_col).alias("__text"))
    schema = T.StructType([*slim.drop("__text").schema.fields, *fields])
    names, kinds = schema.fieldNames(), [to_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, kept, held, size = WordHash(), [], [], 0
        for b in batches:
            if b.num_rows:
                kept.append(b.columns[:-1])
                held.append([token_hashes(t.as_py(), hasher) for t in b.columns[-1]])
                size += sum(map(len, held[-1]))
            if size >= GROUP:
                yield from scores(kept, held)
                kept, held, size = [], [], 0
        if held:
            yield from scores(kept, held)
        pa.default_memory_pool().release_unused()

    def scores(kept: list[list[pa.Array]], held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rows = [len(part) for part in held]
        n = np.array([len(x) for part in held for x in part])
        h = np.concatenate([x for part in held for x in part])
        held.clear()
        u, inverse = np.unique(h, return_inverse=True)
        inverse = inverse.astype(np.int32)
        before = np.append(inverse[-1], inverse[:-1])  # a text's end precedes the next text, the last one's the first
        logs = m.log_probabilities(u, inverse, before)
        del before
        at = find(m.words, u)
        base = np.zeros(len(u))
        base[at >= 0] = np.log10((m.counts[at[at >= 0]] + ADDED) / scale)
        token = row = 0
        for columns_, many in zip(kept, rows, strict=True):
            of = n[row : row + many]
            mine = slice(token, token + int(of.sum()))
            new = batch(of, h[mine], base[inverse[mine]], (at >= 0)[inverse[mine]], logs[mine])
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(new, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns_, *arrays], names=names)
            token, row = mine.stop, row + many

    def batch(n: np.ndarray, h: np.ndarray, base: np.ndarray, frequent: np.ndarray, logs: np.ndarray) -> list:
        row = np.repeat(np.arange(len(n)), n)
        sums = np.bincount(row, base, len(n))
        known = np.bincount(row[frequent], minlength=len(n))
        rare = np.flatnonzero(~frequent)
        order = rare[np.lexsort((h[rare], row[rare]))]
        hr, rr = h[order], row[order]
        new = np.ones(len(order), bool)
        new[1:] = (hr[1:] != hr[:-1]) | (rr[1:] != rr[:-1])
        head = np.flatnonzero(new)
        offsets = pa.array(np.searchsorted(rr[head], np.arange(len(n) + 1)), pa.int32())
        keys = pa.ListArray.from_arrays(offsets, pa.array(hr[head].view(np.int64)))
        times = pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(head, len(order))), pa.int64()))
        return [n, known, sums, np.bincount(row, logs, len(n)), keys, times]

    scored = materialize(slim.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "scored")

    rare = scored.select("__row", F.explode(F.arrays_zip(F.col("__keys").alias("h"), F.col("__times").alias("k"))).alias("x")).select("__row", F.col("x.h").alias("h"), F.col("x.k").alias("k"))
    met = rare.join(table, "h", "left")
    c = F.coalesce("n", F.lit(0))
    rest = met.groupBy("__row").agg(
        F.sum(F.col("k") * F.log10((c + ADDED) / F.lit(float(scale)))).alias("rest"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("seen")
    )
    rest = materialize(rest.withColumnRenamed("__row", "__r"), "rest")
    out = scored.drop("__keys", "__times").join(rest, F.col("__row") == F.col("__r"), "left")
    return out.select(
        *[F.col(f"`{c}`") for c in columns],
        "n_tokens",
        (F.col("__known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("__base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
    )
