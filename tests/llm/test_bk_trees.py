"""SimHash near-duplicates against a comparison of all pairs."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from tidemark.llm import bk_trees, registry

LOWER = {i: i + 32 for i in range(65, 91)}
WHITE = " \t\n\x0b\x0c\r"


def fingerprint(text, width):
    t = (text or "").translate(LOWER)
    for c in WHITE:
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Node to the set of nodes it reaches."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            parent[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def check(spark, rows, width=5, radius=2, schema="doc_id long, text string", **sizes):
    df = spark.createDataFrame(rows, schema)
    got = bk_trees.near_duplicates(df, width=width, radius=radius, **sizes)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [fingerprint(r[1], width) for r in rows]
    nodes = list(range(len(rows)))
    near = components(nodes, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= radius or rows[a][0] is not None and rows[a][0] == rows[b][0])
    least = {}
    for n in nodes:
        if rows[n][0] is not None:
            least[near[n]] = min(rows[n][0], least.get(near[n], rows[n][0]))
    want = [(rows[n][0], f"{prints[n]:016x}", least.get(near[n])) for n in nodes]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    return want


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one two"), (5, "ONE TWO"), (6, "É É é"), (7, "one two three"), (None, "one two three"), (None, "alone here")]
    for i in range(10, 40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([40, 120, 400]))]
        rows.append((i, " ".join(base)))
        for k in range(rng.choice([0, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((100 * i + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize(("width", "radius"), [(3, 2), (5, 2), (2, 5), (3, 0)])
def test_against_all_pairs(spark, width, radius):
    want = check(spark, corpus(width), width, radius)
    if radius == 5:
        assert len({c for _, _, c in want}) < len({f for _, f, _ in want})


def test_repeated_ids_null_ids_and_many_copies(spark):
    rows = corpus(9) + [(50, "first text of this id"), (50, "quite another text under it"), (49, "quite another text under it"), (50, "first text of this id"), (None, None)]
    check(spark, rows + [(1000 + i % 50, "the same text on most rows") for i in range(400)], 3)


def codes_near(rng, n):
    """Different codes, many of them few bits apart."""
    out = set()
    while len(out) < n:
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 30])):
            out.add(c)
            c ^= 1 << rng.randrange(64)
            c ^= (rng.random() < 0.5) << rng.randrange(64)
    return sorted(out)[:n]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_trees_find_what_a_scan_finds(radius):
    rng = random.Random(radius)
    codes = np.array(codes_near(rng, 600), np.uint64)
    buckets = np.sort(np.array([rng.choice([3, 7, 7, 7, -2]) for _ in codes], np.int64))
    trees = np.concatenate([np.sort(np.array([rng.choice([0, 1]) for _ in range((buckets == b).sum())])) for b in np.unique(buckets)])
    forest = bk_trees.build(buckets, trees, codes)
    assert sorted(forest.codes.tolist()) == sorted(codes.tolist())
    assert (np.diff(forest.edge) > 0).all()
    for k in np.flatnonzero(forest.edge >= 0):
        parent, distance = divmod(int(forest.edge[k]), bk_trees.SPAN)
        assert int(forest.codes[parent] ^ forest.codes[k]).bit_count() == distance
    got = {(int(u), int(v)) for us, vs in bk_trees.search(forest, buckets, codes, radius) for u, v in zip(us, vs, strict=True)}
    place = dict(zip(codes.tolist(), buckets.tolist(), strict=True))
    want = {(a, b) for a in codes.tolist() for b in codes.tolist() if b < a and place[a] == place[b] and (a ^ b).bit_count() <= radius}
    assert got == want


def test_search_in_small_pieces(monkeypatch):
    rng = random.Random(4)
    codes = np.array(codes_near(rng, 400), np.uint64)
    forest = bk_trees.build(np.zeros(400, np.int64), np.zeros(400, np.int64), codes)

    def hits():
        return sorted((int(u), int(v)) for us, vs in bk_trees.search(forest, np.zeros(400, np.int64), codes, 2) for u, v in zip(us, vs, strict=True))

    whole = hits()
    monkeypatch.setattr(bk_trees, "FRONTIER", 7)
    assert hits() == whole


def test_several_passes_and_split_buckets(spark):
    codes = codes_near(random.Random(6), 1500)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    want = components(codes, lambda a, b: (a ^ b).bit_count() <= 2)
    for tree_nodes, pass_nodes in ((1 << 16, 1 << 21), (5, 300)):
        links = bk_trees.links_within(spark.createDataFrame(signed, "code long"), 2, tree_nodes=tree_nodes, pass_nodes=pass_nodes).collect()
        pairs = {(r.u % (1 << 64), r.v % (1 << 64)) for r in links}
        parent = {c: c for c in codes}

        def root(n):
            while parent[n] != n:
                n = parent[n]
            return n

        for a, b in pairs:
            parent[root(a)] = root(b)
        groups, wanted = {}, {}
        for c in codes:
            groups.setdefault(root(c), set()).add(c)
            wanted.setdefault(want[c], set()).add(c)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_spanning_forest():
    u, v = np.array([5, 5, 9, 8, 3, 7], np.uint64), np.array([3, 9, 3, 7, 5, 8], np.uint64)
    a, b = bk_trees.spanning(u, v)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(5, 3), (8, 7), (9, 3)]


def test_empty_table_clashing_columns_and_long_text(spark):
    assert bk_trees.near_duplicates(spark.createDataFrame([], "doc_id long, text string, fingerprint int")).count() == 0
    long_text = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(5, long_text, 1, "a"), (4, long_text + " tail", 2, "b"), (3, "other words", 3, "c")]
    want = check(spark, rows, 3, schema="doc_id long, text string, code int, component_id string")
    assert {c for i, _, c in want if i != 3} == {4}


def test_query(spark, tmp_path):
    rows = corpus(21)
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.op13_simhash_duplicates(spark, str(tmp_path))
    assert out.schema["component_id"].dataType == T.LongType()
    assert {(r.doc_id, r.fingerprint) for r in out.collect()} == {(i, f"{fingerprint(t, 3):016x}") for i, t in rows}
