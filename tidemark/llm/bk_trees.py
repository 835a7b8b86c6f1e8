"""Near-duplicates by SimHash: BK-trees over fingerprints, searched within a Hamming radius.

In a BK-tree a node's children hang at integer Hamming distances, one child to a distance. A search within radius r goes from a node
at distance d only into the children at d - r to d + r; by the triangle inequality no other subtree holds a hit.

1. Each text gets its 64-bit fingerprint. Different fingerprints are the nodes, however many rows have them.
2. The 64 bits are cut into r + 2 pieces. Two fingerprints within r agree in two of them at least, so each fingerprint
   belongs to a bucket for each two pieces, and only buckets of several fingerprints matter. A bucket is one tree, or several if it is large.
3. Buckets are dealt into groups whose trees stay below ``PASS_NODES``. For each group, tasks build the trees, the
   trees are broadcast, and the fingerprints of this group alone are searched in them; links are written before the next group's trees
   are broadcast. The trees of a group that is larger (one hot bucket) take several such passes.
4. A task's links are reduced to a spanning forest, links are joined to components.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialize, release, small_batches, text_bytes
from .components import connected_components

SEED, BITS = 42, 64
#: Nodes of a tree, of a task's trees and of the trees that are broadcast together (16 bytes each).
TREE_NODES, SHARD_NODES, PASS_NODES = 1 << 16, 1 << 18, 1 << 21
#: Nodes looked at together in a search, and shingles hashed together.
FRONTIER, SHINGLES = 1 << 18, 1 << 16
#: Children of a node lie at distances below this.
SPAN = BITS + 1


def simhash(words: list[bytes], width: int) -> int:
    """Bit i is set if it is set in over half of the hashes of the ``width``-word shingles."""
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    n = max(1, len(words) - width + 1)
    votes = np.zeros(BITS, np.int64)
    for lo in range(0, n, SHINGLES):
        some = words[lo : lo + SHINGLES + width - 1] if n > 1 else words
        shingles = map(b" ".join, zip(*(some[j:] for j in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter(map(digest, shingles), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 5, name: str = "fingerprint") -> DataFrame:
    """``docs`` with the SimHash of each whole text as a long (A-Z lower-cased, words parted by ASCII white space; without words 0)."""

    def run(texts: pa.Array) -> list:
        return [np.array([simhash(t.as_py().lower().split(), width) for t in texts], np.uint64).view(np.int64)]

    return append_columns(docs, [text_bytes(text_col)], [T.StructField(name, T.LongType(), False)], lambda: run)


class Forest(NamedTuple):
    """BK-trees in flat arrays. The first nodes are the roots, in the order of ``buckets``, which may hold a bucket several times. ``edge`` is
    parent * SPAN + distance for the others, ascending over the nodes; a node's children are thus a run in which distances ascend."""

    buckets: np.ndarray
    codes: np.ndarray
    edge: np.ndarray


def build(buckets: np.ndarray, trees: np.ndarray, codes: np.ndarray) -> Forest:
    """One tree for each run of equal (bucket, tree); the rows are sorted by both and codes differ within a tree.

    All trees grow together, level by level: the first of those that wait at a place becomes its node, the others
    move on to the child at their distance to it."""
    group = np.cumsum(np.concatenate([[0], (buckets[1:] != buckets[:-1]) | (trees[1:] != trees[:-1])])) if len(codes) else np.zeros(0, np.int64)
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    roots = buckets[heads]
    place = group - len(heads)  # of a root, negative
    waiting, made, edges, n = codes, [], [], 0
    while len(waiting):
        first = np.diff(place, prepend=place[0] - 1) != 0
        at = np.cumsum(first) - 1
        node = waiting[first]
        made.append(node)
        edges.append(place[first])
        rest = ~first
        distance = np.bitwise_count(waiting[rest] ^ node[at[rest]]).astype(np.int64)
        place = (n + at[rest]) * SPAN + distance
        n += len(node)
        order = np.argsort(place, kind="stable")
        place, waiting = place[order], waiting[rest][order]
    return Forest(roots, np.concatenate([*made, codes[:0]]), np.concatenate([*edges, np.zeros(0, np.int64)]))


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which run, and the place, for each number of the runs lo..hi."""
    length = hi - lo
    which = np.repeat(np.arange(len(lo)), length)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + lo[which]


def search(forest: Forest, buckets: np.ndarray, codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes searched, smaller codes within the radius) of the trees of each code's bucket."""
    query, node = _runs(np.searchsorted(forest.buckets, buckets), np.searchsorted(forest.buckets, buckets, side="right"))
    todo = [(query, node)]
    while todo:
        query, node = todo.pop()
        if len(query) > FRONTIER:
            todo += [(query[i : i + FRONTIER], node[i : i + FRONTIER]) for i in range(0, len(query), FRONTIER)]
            continue
        here, there = codes[query], forest.codes[node]
        d = np.bitwise_count(here ^ there).astype(np.int64)
        hit = (d <= radius) & (there < here)
        if hit.any():
            yield here[hit], there[hit]
        lo = np.searchsorted(forest.edge, node * SPAN + np.maximum(d - radius, 0))
        hi = np.searchsorted(forest.edge, node * SPAN + np.minimum(d + radius, BITS), side="right")
        which, child = _runs(lo, hi)
        if len(child):
            todo.append((query[which], child))


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links than nodes that join the same components."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _members(codes: DataFrame, radius: int) -> DataFrame:
    """(bucket, code, n): the buckets of n > 1 different ``codes``."""
    cuts = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    pieces = [F.shiftrightunsigned("code", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in itertools.pairwise(cuts)]
    buckets = [F.xxhash64(F.lit(i), *two) for i, two in enumerate(itertools.combinations(pieces, 2))]
    every = codes.select("code", F.explode(F.array(*buckets)).alias("bucket"))
    shared = materialize(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared_buckets")
    return every.join(shared, "bucket")


def _trees(members: DataFrame, shards: int) -> DataFrame:
    """(buckets, codes, edge): the trees of (bucket, tree, code), as bytes, a row for each of ``shards`` shares of them."""
    small_batches(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        shard = None

        def done() -> pa.RecordBatch:
            forest = build(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in forest], names=Forest._fields)

        for b in batches:
            shards_, bucket, tree, code = (c.to_numpy() for c in b.columns)
            cuts = [0, *(np.flatnonzero(np.diff(shards_)) + 1).tolist(), len(shards_)]
            for lo, hi in itertools.pairwise(cuts):
                if hi > lo:
                    if held and shards_[lo] != shard:
                        yield done()
                        held = []
                    shard = shards_[lo]
                    held.append([bucket[lo:hi].copy(), tree[lo:hi].copy(), code[lo:hi].view(np.uint64).copy()])
        if held:
            yield done()

    placed = members.select(F.pmod(F.xxhash64("bucket", "tree"), F.lit(shards)).cast("int").alias("shard"), "bucket", "tree", "code")
    return placed.repartition("shard").sortWithinPartitions("shard", "bucket", "tree").mapInArrow(run, "buckets binary, codes binary, edge binary")


def _probe(members: DataFrame, trees: list[tuple[bytes, bytes, bytes]], radius: int) -> tuple[DataFrame, object]:
    """(u, v): links that join what the members' searches in the broadcast ``trees`` find; and the broadcast."""
    spark = members.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = [Forest(np.frombuffer(b, np.int64), np.frombuffer(c, np.uint64), np.frombuffer(e, np.int64)) for b, c, e in shared.value]
        for b in batches:
            bucket, code = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            found = [pair for forest in forests for pair in search(forest, bucket, code, radius)]
            if found:
                u, v = spanning(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return members.select("bucket", "code").mapInArrow(run, "u long, v long"), shared


def links_within(codes: DataFrame, radius: int = 2, tree_nodes: int = TREE_NODES, pass_nodes: int = PASS_NODES) -> DataFrame:
    """(u, v): links that join the different longs ``code`` of ``codes`` which differ in at most ``radius`` bits."""
    spark = codes.sparkSession
    members = _members(codes, radius)
    total = members.agg(F.count("*")).first()[0]
    groups = max(1, math.ceil(total / pass_nodes))
    tree = F.pmod(F.xxhash64("code"), F.ceil(F.col("n") / tree_nodes))
    dealt = members.select("bucket", "code", tree.cast("long").alias("tree"), F.pmod("bucket", F.lit(groups)).cast("int").alias("part"))
    table = materialize(dealt.repartitionByRange("part", "code"), "members", partition_by="part")
    out = []
    # one row and at most a pass's bytes are on the driver at a time
    for part, n in sorted(tuple(r) for r in table.groupBy("part").agg(F.count("*")).collect()):
        mine = table.where(F.col("part") == part)
        passes = math.ceil(n / pass_nodes)
        for i in range(passes):
            some = mine.where(F.pmod("tree", F.lit(passes)) == i)
            trees = [tuple(r) for r in _trees(some, math.ceil(n / passes / SHARD_NODES)).collect()]
            found, shared = _probe(mine, trees, radius)
            out.append(materialize(found, "links"))
            shared.destroy()
    release(table)
    if not out:
        return spark.createDataFrame([], "u long, v long")
    return spark.read.schema("u long, v long").parquet(*[x._tidemark_path for x in out])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 2, **sizes: int
) -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (16 hexadecimal digits) and component_id, the least id reachable
    over fingerprints that differ in at most ``radius`` bits, itself included.

    Null and empty texts, and texts without words, have the fingerprint zero and link like others; very long texts count whole.
    Rows that repeat an id are one document: the links of all its texts count. Rows with a null id link like others; without an
    id in reach their component is null. An empty table gives an empty table. Other columns are left out, whatever their names."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    printed = materialize(fingerprints(narrow, "text", width, "code").select("id", "code"), "fingerprints")
    codes = materialize(printed.groupBy("code").agg(F.min("id").alias("first")), "codes")
    links = links_within(codes.select("code"), radius, **sizes)
    of_id = printed.where("id is not null").groupBy("id").agg(F.min("code").alias("v"), F.max("code").alias("top")).where("v < top").select("id", "v")
    of_id = materialize(of_id, "repeated_ids")
    if not of_id.isEmpty():
        links = links.union(printed.join(of_id, "id").select(F.col("code").alias("u"), "v").where("u <> v").distinct())
    labels = materialize(connected_components(links).withColumnRenamed("id", "code").join(codes, "code"), "labels")
    least = labels.groupBy("label").agg(F.min("first").alias("least"))
    linked = labels.join(least, "label").select("code", "least", F.lit(True).alias("linked"))
    every = codes.join(linked, "code", "left").select("code", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    found = printed.join(materialize(every, "components"), "code")
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")
