"""The filter audit against SQL and against a count of each order, document by document."""

import collections
import itertools
import random

import duckdb
import pytest

from tidemark.llm import filter_audit, registry

LABELS = "doc_id long, quality int, toxic int"
WHITE = " \t\n\x0b\x0c\r"


def words(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def failing(docs):
    """The letters that each row (id, text, part) fails."""
    out = []
    for i, text, _ in docs:
        t = text or ""
        w = words(t)
        fails = {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        fails |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        out.append(fails)
    return out


def expected(docs, labels):
    fails = failing(docs)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    shapley = collections.Counter()
    parts = {p or "" for _, _, p in docs}
    for part in parts:
        mine = [(i, f) for (i, _, p), f in zip(docs, fails, strict=True) if (p or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, letter in enumerate(order):
                reach = [(i, f) for i, f in mine if not f & set(order[:k])]
                gone = [i for i, f in reach if letter in f]
                out[part, order, k + 1] = [
                    len(reach) - len(gone), len(gone), sum(letter in f and bool(f & set(order[:k])) for _, f in mine), sum(f == {letter} for _, f in mine),
                    sum(i in good for i in gone), sum(i in toxic for i in gone),
                ]
                shapley[part, letter] += len(gone)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def report(df):
    rows = [tuple(r) for r in df.collect()]
    out = {r[:3]: r[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def table(seed):
    rng = random.Random(seed)
    long_text = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \n", "short text", "LOUD TEXT", "a # b", long_text, long_text + " A" * 30, "same " * 260, long_text + " 100 %", "É" * 300, "same " * 260 + "*", "\x0b".join(map(str, range(200)))]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_against_each_order(spark, seed):
    docs, labels = table(seed)
    got = report(filter_audit.audit_filters(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5), spark.createDataFrame(labels, LABELS)))
    assert got == expected(docs, labels)


def test_sql(spark, tmp_path):
    docs, labels = table(3)
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    with duckdb.connect() as db:
        for name in ("documents", "labels"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        found = db.execute(registry.ORACLES["op12_filter_audit"])
        columns = [c[0] for c in found.description]
        want = {r[:3]: r[3:] for r in found.fetchall()}
    out = registry.op12_filter_audit(spark, str(tmp_path))
    assert out.columns == columns
    assert report(out) == want == expected(docs, labels)


def test_a_text_on_most_rows_and_collisions(spark, monkeypatch):
    docs = [(i % 700, "copy " * 50, "en") for i in range(2000)] + [(5000 + i, f"text {i}", "en") for i in range(50)]
    masks = filter_audit.filter_masks(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(6))
    counts = collections.Counter()
    for r in masks.collect():
        counts[r.mask & 16 > 0] += r.n
    assert counts == {False: 53, True: 1997}
    # one hash for all texts: the chain tells them apart
    monkeypatch.setattr(filter_audit.xxhash, "xxh64_intdigest", lambda x: 7)
    some = [(3, "en", "a"), (1, "en", "a"), (2, "en", "b"), (1, "de", "a"), (None, "en", "a"), (9, "en", "b")]
    sent = [r for half in (some[:3], some[3:]) for r in filter_audit._routed(iter(half), filter_audit.CHECKS)]
    got = collections.Counter()
    for id_, part, mask, n in filter_audit._decided(iter(sent), 16):
        got[id_, part, mask & 16] += n
    assert got == {(3, "en", 16): 1, (1, "en", 0): 1, (2, "en", 0): 1, (1, "de", 0): 1, (None, "en", 0): 1, (9, "en", 16): 1}


def test_texts_are_sent_on_when_a_task_holds_many(monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", 2000)
    rows = [(i, "en", f"t{i % 40} " * 20) for i in range(400)]
    sent = list(filter_audit._routed(iter(rows), filter_audit.CHECKS))
    assert len(sent) > 50
    failed = sorted(id_ for id_, _, mask, n in filter_audit._decided(iter(sent), 16) for _ in range(n) if mask & 16)
    assert failed == list(range(40, 400))


def test_empty_table_clashing_columns_long_text_and_other_filters(spark):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    empty = filter_audit.audit_filters(spark.createDataFrame([], "doc_id long, text string, lang string, part string, mask int"), labels)
    assert empty.count() == 0
    docs = spark.createDataFrame([(1, "word " * 2_000_000, "en", "x", 3), (2, "b", "en", "y", 4)], "doc_id long, text string, lang string, part string, mask int")
    rows = filter_audit.audit_filters(docs, labels, checks={"L": lambda t: len(t.text) > 1000}).collect()
    assert {(r.filter_order, r.step, r.removed, r.good_lost) for r in rows} == {("LE", 1, 1, 1), ("LE", 2, 0, 0), ("EL", 1, 0, 0), ("EL", 2, 1, 1)}
    with pytest.raises(ValueError, match="too many"):
        filter_audit.audit_filters(docs, labels, checks={c: len for c in "abcdefg"})
