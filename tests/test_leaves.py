"""Leaves and findings of JSON lines against the walker that masks them."""

import json
import random
from collections import Counter

from tidemark.functions import jsonwalk
from tidemark.functions.redaction import Redactor
from tidemark.operators import leaves

LINES = "relpath string, line_no long, raw string"


def walked(raw):
    """{(path, profile, value)} of a line by a plain recursion."""
    out = []

    def go(value, path, place):
        if isinstance(value, str):
            out.append((place, jsonwalk.profile_of(path), value))
        elif isinstance(value, dict):
            for k, v in value.items():
                if k not in jsonwalk.KEEP_KEYS:
                    go(v, (*path, k), place + (f".{k}" if k.isalnum() else f'."{k}"'))
        elif isinstance(value, list):
            for i, v in enumerate(value):
                go(v, (*path, i), f"{place}[{i}]")

    try:
        go(json.loads(raw), (), "$")
    except (json.JSONDecodeError, TypeError):
        return []
    return out


def made(rng, depth=0):
    kind = rng.random()
    if depth > 8 or kind < 0.35:
        return rng.choice(["", "plain", 'quo"te\n', "é☃", "ann@host.org", "sk-ant-" + "a" * 24 + " b@host.org", 1, 2.5, None, True, " "])
    if kind < 0.6:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    keys = ["message", "content", "text", "summary", "title", "id", "usage", "a", "b c", "x.y", "*"]
    return {k: made(rng, depth + 1) for k in rng.sample(keys, rng.randint(0, 4))}


def test_leaves_of_random_lines(spark):
    rng = random.Random(2)
    raws = [json.dumps({"message": {"content": [made(rng), {"text": made(rng)}]}, "content": made(rng), "n": made(rng)}, ensure_ascii=bool(i % 2)) for i in range(150)]
    raws += ["not json", None, "", '"root"', "[" * 40 + '"deep"' + "]" * 40, '{"a":1,"a":"last"}', "[]", "{}"]
    df = spark.createDataFrame([("f", i, r) for i, r in enumerate(raws)], LINES)
    for steps in (6, 1):
        got = Counter((r.line_no, r.leaf_path, r.profile, r.value) for r in leaves.string_leaves(df, steps).collect())
        want = Counter((i, *leaf) for i, raw in enumerate(raws) for leaf in walked(raw))
        assert got == want


def test_findings_count_what_masking_counts(spark):
    rng = random.Random(6)
    raws = [json.dumps({"message": {"content": [{"text": made(rng)}, made(rng)]}, "title": made(rng)}) for _ in range(80)]
    df = spark.createDataFrame([("f", i, r) for i, r in enumerate(raws)], LINES)
    found = leaves.leaf_findings(leaves.string_leaves(df)).collect()
    got = Counter((r.line_no, r.entity_type) for r in found)
    want, redactor = Counter(), Redactor()
    values = {(i, path): value for i, raw in enumerate(raws) for path, _, value in walked(raw)}
    for i, raw in enumerate(raws):
        counts = Counter()
        jsonwalk.mask_record(raw, redactor, counts)
        want.update({(i, e): n for e, n in counts.items()})
    assert got == want
    assert len(got) > 20
    for r in found:
        part = values[r.line_no, r.leaf_path][r.start : r.end]
        assert part == "ann@host.org" or part.startswith("sk-ant-") or part == "b@host.org"


def test_no_lines(spark):
    assert leaves.string_leaves(spark.createDataFrame([], LINES)).count() == 0
