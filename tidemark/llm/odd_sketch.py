"""Near-duplicate detection: MinHash bands find candidates, odd sketches weed them, full sets confirm them.

A document's set holds the distinct hashes of its ``width``-word shingles (64 bits; A-Z lower-cased,
words are runs of characters other than ASCII white space; a text of fewer words is one shingle).

1. Each text gets its set's fingerprint, the MinHash samples folded into band keys, and an odd
   sketch: each sample flips one bit of a bitmap, so the XOR of two bitmaps counts the samples in
   which two sets differ. Texts with equal sets become one representative.
2. Members of a bucket are compared with its least member only (a star, never all pairs). Of the
   members whose odd sketches are near enough, each takes its nearest one, and the full sets decide.
3. Buckets whose members then still belong to several components get the exact treatment. Their
   members are dealt into blocks of about ``BLOCK`` rows; every pair of a bucket's blocks is looked at
   in one task, in memory, without emitting pairs: odd sketches tell which members have a plausible
   partner in another component, and of those the full sets' intersections are counted at once by a
   matrix product. Only links that join two components leave the task (fewer than its rows).
   A pair that shares a bucket is thus either in one component already or is compared.
   An open bucket of more than ``MANY`` members is first parted by a second, independent set of bands
   over its members' full sets; a pair of it at the threshold shares one of those buckets as surely as
   it shared the first. Blocks are bounded by rows and by the shingles in them.

A distinct set is a node, whatever rows have it. Different sets under one id are linked with each other, and sets
of rows without an id link others like any set.

A pair at the threshold shares no bucket with probability (1 - 0.8^4)^28, below 4e-7, and is
weeded out by its sketch with about the same probability.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, append_columns, materialize, mix, release, small_batches, text_bytes, windows
from .components import connected_components

BANDS, ROWS, WORDS64 = 28, 4, 8
SAMPLES, BITS = BANDS * ROWS, 64 * WORDS64
#: Rows in a block on average, and shingles (a larger set is a block of its own).
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
#: Members beyond which an open bucket is parted by further bands.
MANY = 2048
#: Bits of the filter that thins the documents before a join with ids: for each id, and at most.
ID_BITS, MOST_ID_BITS = 16, 1 << 27
BAND_COLS = [f"b{i}" for i in range(BANDS)]
SKETCH_COLS = [f"s{i}" for i in range(WORDS64)]


def shingle_set(words: list[bytes], width: int, hasher: WordHash) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hasher.of(words)
    if len(h) >= width:
        return np.unique(windows(h, width))
    return windows(h, len(h)) ^ mix(np.array([len(h)], np.uint64))


def _constants(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 63, (2, SAMPLES), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def minhash(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(x), 512):
        np.minimum(m, ((x[None, s : s + 512] ^ b[:, None]) * a[:, None]).min(axis=1), out=m)
    return m


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key


def fingerprint(x: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.uint64)


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit words."""
    at = mix(m + mix(np.arange(SAMPLES, dtype=np.uint64))) >> np.uint64(64 - int(math.log2(BITS)))
    odd = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def similarity(xor_bits: float) -> float:
    """Jaccard similarity estimated from the population count of two odd sketches' XOR."""
    d = min(xor_bits, BITS / 2 - 0.5)
    return 1 + BITS / (4 * SAMPLES) * math.log(1 - 2 * d / BITS)


def most_xor_bits(percent: int) -> int:
    """Largest XOR count kept: five to six standard deviations of the estimate below the threshold."""
    j = percent / 100
    least = max(0.0, j - 5.3 * math.sqrt(j * (1 - j) / SAMPLES) - 0.02)
    return math.ceil(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - least) / BITS)))


def sketch_documents(docs: DataFrame, text_col: str, width: int, seed: int) -> DataFrame:
    """``docs`` with n_shingles, the set's fingerprint (null for an empty set), band keys and sketch."""
    fields = [T.StructField("n_shingles", T.LongType(), False), T.StructField("fa", T.LongType()), T.StructField("fb", T.LongType())]
    fields += [T.StructField(c, T.LongType()) for c in (*BAND_COLS, *SKETCH_COLS)]

    def make():
        hasher, (a, b) = WordHash(), _constants(seed)

        def run(texts: pa.Array) -> list:
            n, rows, null = [], [], []
            for t in texts:
                x = shingle_set(t.as_py().lower().split(), width, hasher)
                n.append(len(x))
                null.append(not len(x))
                row = np.zeros(2 + BANDS + WORDS64, np.uint64)
                if len(x):
                    row[:2] = fingerprint(x)
                    m = minhash(x, a, b)
                    row[2 : 2 + BANDS] = band_keys(m)
                    row[2 + BANDS :] = odd_sketch(m)
                rows.append(row)
            cols = np.array(rows).view(np.int64)
            return [pa.array(n, pa.int64()), *(pa.array(np.ascontiguousarray(cols[:, i]), mask=np.array(null)) for i in range(cols.shape[1]))]

        return run

    return append_columns(docs, [text_bytes(text_col)], fields, make)


def _sets_of(nodes: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, x): the full shingle sets of the nodes ``nodes`` (id), as bytes, read from one row ``k`` of each.

    A bitmap of the rows' keys, of bounded size, is broadcast and lets pass the wanted rows and
    a few others before anything is shuffled; the join then decides, by key and fingerprint."""
    spark = docs.sparkSession
    small_batches(spark)
    wanted = materialize(nodes.join(reps.select(F.col("rep").alias("id"), "k", "fa", "fb"), "id"), "wanted")
    n = wanted.count()
    m = min(MOST_ID_BITS, 1 << max(16, (ID_BITS * n).bit_length()))
    place = F.pmod("k", F.lit(m))
    words = wanted.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(m // 64, np.uint64)
    bitmap[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for b in batches:
            at = b.column(2).to_numpy()
            some = np.flatnonzero((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
            sets = [shingle_set(b.column(1)[i].as_py().lower().split(), width, hasher) for i in some.tolist()]
            prints = np.array([fingerprint(x) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
            columns = [b.column(0).take(pa.array(some)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "fa", "fb", "x"])

    found = docs.select("k", text_bytes("text").alias("text"), place.alias("at")).mapInArrow(run, "k long, fa long, fb long, x binary")
    return materialize(found.join(wanted, ["k", "fa", "fb"]).groupBy("id").agg(F.max("x").alias("x")), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the threshold."""
    left = sets.select(F.col("id").alias("u"), F.col("x").alias("xu"))
    right = sets.select(F.col("id").alias("v"), F.col("x").alias("xv"))
    both = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "xu", "xv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for xu, xv in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(xu.as_buffer(), np.uint64), np.frombuffer(xv.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, T.StructType([pairs.schema["u"], pairs.schema["v"]]))


def _in_blocks(members: DataFrame, shingles) -> DataFrame:
    """``members`` (bk, rep, ...) once for each pair of blocks (gi <= gj) of their bucket that they take part in, with their block.

    ``shingles``: what a member adds to a block's memory."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(shingles) / BLOCK_SHINGLES)).cast("int")
    sizes = materialize(members.groupBy("bk").agg(blocks.alias("blocks")), "sizes")
    dealt = members.join(sizes, "bk").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keyed = paired.withColumn("gi", F.least("block", "other")).withColumn("gj", F.greatest("block", "other")).drop("other")
    return keyed.repartition("bk", "gi", "gj").sortWithinPartitions("bk", "gi", "gj")


def _second_bands(sets: DataFrame, seed: int) -> DataFrame:
    """(rep, key): the keys of an independent set of bands over full sets (id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _constants(seed)
        for batch in batches:
            keys = [band_keys(minhash(np.frombuffer(x.as_buffer(), np.uint64), a, b)).view(np.int64) for x in batch.column(1)]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.concatenate(keys))], names=["rep", "key"])

    return sets.select("id", "x").mapInArrow(run, "rep long, key long")


def _parted(members: DataFrame, reps: DataFrame, docs: DataFrame, width: int, seed: int) -> DataFrame:
    """``members`` with their buckets of more than MANY members replaced by the open ones among those of further bands."""
    large = materialize(members.groupBy("bk").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("bk"), "large")
    if large.isEmpty():
        return members
    inside = materialize(members.join(large, "bk"), "inside")
    sets = _sets_of(inside.select(F.col("rep").alias("id")).distinct(), reps, docs, width)
    keys = materialize(_second_bands(sets, seed), "second_bands")
    finer = materialize(inside.join(keys, "rep").withColumn("bk", F.xxhash64("bk", "key")).drop("key"), "finer")
    open_ = _one_of_equal(finer, F.min("label") < F.max("label"))
    out = materialize(members.join(large, "bk", "left_anti").unionByName(finer.join(open_, "bk")), "parted")
    release(large, inside, sets, keys, finer)
    return out


def _by_group(df: DataFrame, fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """``fn`` over the rows of each (bk, gi, gj) of a table from ``_in_blocks``; groups have a bounded size."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            keys = np.column_stack([b.column(b.schema.get_field_index(k)).to_numpy() for k in ("bk", "gi", "gj")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and tuple(keys[lo]) != key:
                        yield from done(held)
                        held = []
                    key = tuple(keys[lo])
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from done(held)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fn(pa.Table.from_batches(held))
        if out is not None:
            yield from out.to_batches()

    return df.mapInArrow(run, schema)


def _pairs_of_interest(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Labels, and a matrix of the pairs to look at: other component, and other block unless the group is one block."""
    label, block = rows.column("label").to_numpy(), rows.column("block").to_numpy()
    wanted = label[:, None] != label[None, :]
    if rows.column("gi")[0].as_py() != rows.column("gj")[0].as_py():
        wanted &= block[:, None] != block[None, :]
    return label, wanted


def plausible_members(rows: pa.Table, percent: int) -> pa.Table | None:
    """The members with a partner of another component whose set size and odd sketch are near enough."""
    _, wanted = _pairs_of_interest(rows)
    if not wanted.any():
        return None
    n = rows.column("n_shingles").to_numpy()
    wanted &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    apart = np.zeros(wanted.shape, np.int64)
    for c in SKETCH_COLS:
        s = rows.column(c).to_numpy().view(np.uint64)
        apart += np.bitwise_count(s[:, None] ^ s[None, :])
    wanted &= apart <= most_xor_bits(percent)
    return rows.filter(pa.array(wanted.any(axis=1))).select(["bk", "rep", "label"])


def joining_links(rows: pa.Table, percent: int) -> pa.Table | None:
    """Links between members of different components, confirmed on full sets; of several that join the same components, one."""
    label, wanted = _pairs_of_interest(rows)
    if not wanted.any():
        return None
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("x").combine_chunks()]
    n = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(n)), n)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    column = np.cumsum(np.diff(column, prepend=column[:1]) != 0)
    common = np.zeros((len(n), len(n)), np.float32)
    step = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, (lo, lo + step))
        x = np.zeros((len(n), step), np.float32)
        x[row[i:j], column[i:j] - lo] = 1
        common += x @ x.T
    wanted &= (common > 0) & (100 * common >= percent * (n[:, None] + n[None, :] - common))
    parent: dict = {}

    def root(a):
        while parent.get(a, a) != a:
            a = parent[a]
        return a

    rep, u, v = rows.column("rep").to_numpy(), [], []
    for i, j in np.argwhere(np.triu(wanted)).tolist():
        a, b = root(label[i]), root(label[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            u.append(rep[i])
            v.append(rep[j])
    return pa.table({"u": pa.array(u, rows.schema.field("rep").type), "v": pa.array(v, rows.schema.field("rep").type)}) if u else None


def _one_of_equal(members: DataFrame, condition) -> DataFrame:
    """The buckets (bk) that meet ``condition``, one of those with equal members (compared by count, sum and XOR of hashes)."""
    h = F.xxhash64("rep")
    signed = members.groupBy("bk").agg(
        F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("total"), F.bit_xor(h).alias("parity"), condition.alias("wanted")
    )
    return materialize(signed.where("wanted").groupBy("n", "total", "parity").agg(F.min("bk").alias("bk")).select("bk"), "one_of_equal")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, seed: int = 7
) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id and kept.

    component_id is the least id reachable over links of at least ``percent`` / 100 similarity,
    itself included; kept is true where that is the row's own id.
    Null and empty texts, and texts without words, have no shingle and link with nothing. Very long texts
    count with their whole sets. Rows that repeat an id are one document: the links of all its texts count, and
    they share a component. Rows with a null id link like others; without an id in reach their component is
    null and they are kept. An empty table gives an empty table. Other input columns are left out, whatever their names.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    narrow = narrow.withColumn("k", F.xxhash64("id", "text"))
    sketches = materialize(sketch_documents(narrow, "text", width, seed).drop("text"), "sketches")
    reps = sketches.where("fa is not null").groupBy("fa", "fb").agg(F.min("k").alias("k"), F.min("id").alias("first"), *[F.min(c).alias(c) for c in ("n_shingles", *BAND_COLS, *SKETCH_COLS)])
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    several = (F.min("fa") < F.max("fa")) | (F.min("fb") < F.max("fb"))
    repeated = materialize(sketches.where("fa is not null and id is not null").groupBy("id").agg(several.alias("several")).where("several").select("id"), "repeated")
    same_id = None
    if not repeated.isEmpty():
        of_id = materialize(sketches.select("id", "fa", "fb").join(repeated, "id").distinct().join(reps.select("fa", "fb", "rep"), ["fa", "fb"]).select("id", "rep"), "of_id")
        same_id = materialize(of_id.join(of_id.groupBy("id").agg(F.min("rep").alias("v")), "id").select(F.col("rep").alias("u"), "v").where("u <> v"), "same_id")
    banded = reps.select("rep", F.explode(F.array(*BAND_COLS)).alias("bk"))
    buckets = materialize(
        banded.groupBy("bk").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top")).where("pivot < top").select("bk", "pivot"), "buckets"
    )
    shared = materialize(banded.join(buckets, "bk"), "shared")
    stars = materialize(shared.where("rep <> pivot").select(F.col("rep").alias("u"), F.col("pivot").alias("v")).distinct(), "stars")
    one = reps.select(F.col("rep").alias("u"), F.col("n_shingles").alias("nu"), *[F.col(c).alias(f"u{c}") for c in SKETCH_COLS])
    two = reps.select(F.col("rep").alias("v"), F.col("n_shingles").alias("nv"), *[F.col(c).alias(f"v{c}") for c in SKETCH_COLS])
    apart = sum((F.bit_count(F.col(f"u{c}").bitwiseXOR(F.col(f"v{c}"))) for c in SKETCH_COLS), F.lit(0))
    # sets of too different sizes cannot reach the threshold; sketches too far apart do not
    plausible = (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")) & (apart <= most_xor_bits(percent))
    nearest = materialize(
        stars.join(one, "u").join(two, "v").where(plausible).groupBy("u").agg(F.min(F.struct(apart.alias("d"), "v")).alias("x")).select("u", "x.v"),
        "nearest",
    )
    sets = _sets_of(_ids(nearest), reps, narrow, width)
    links = _confirm(nearest, sets, percent)
    links = materialize(links if same_id is None else links.union(same_id), "links")
    labels = connected_components(links)
    release(stars, nearest, sets)

    named = labels.select(F.col("id").alias("rep"), "label")
    members = materialize(shared.join(named, "rep", "left").select("bk", "rep", F.coalesce("label", "rep").alias("label")), "members")
    apart = F.min("label") < F.max("label")
    mixed = _one_of_equal(members, apart)
    if not mixed.isEmpty():
        open_members = materialize(members.join(mixed, "bk").join(reps.select("rep", "n_shingles", *SKETCH_COLS), "rep"), "open")
        open_members = _parted(open_members, reps, narrow, width, seed + 1)
        found = materialize(_by_group(_in_blocks(open_members, F.lit(0)), lambda t: plausible_members(t, percent), "bk long, rep long, label long").distinct(), "plausible")
        found = found.join(_one_of_equal(found, F.count("*") > 1), "bk")
        sets = _sets_of(found.select(F.col("rep").alias("id")).distinct(), reps, narrow, width)
        whole = materialize(found.join(sets.withColumnRenamed("id", "rep"), "rep"), "whole")
        late = materialize(_by_group(_in_blocks(whole, F.octet_length("x") / 8), lambda t: joining_links(t, percent), "u long, v long"), "late")
        if not late.isEmpty():
            labels = connected_components(links.union(late))
        release(open_members, found, sets, whole)
    release(members, mixed)

    labels = materialize(labels.withColumnRenamed("id", "rep").join(reps.select("rep", "first"), "rep"), "labelled")
    least = materialize(labels.groupBy("label").agg(F.min("first").alias("least")), "least")
    named = labels.join(least, "label").select("rep", "least", F.lit(True).alias("linked"))
    components = reps.select("fa", "fb", "rep", "first").join(named, "rep", "left").select("fa", "fb", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("label"))
    components = materialize(components, "components")
    release(reps, buckets, shared, links, labels, least)
    found = sketches.select("id", "n_shingles", "fa", "fb").join(components, ["fa", "fb"], "left")
    component = F.coalesce("label", "id")
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
