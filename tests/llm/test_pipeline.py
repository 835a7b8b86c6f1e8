"""The pipeline stage by stage against brute force, with rows that are hard to handle."""

import re

import corpus_pipeline
from tidemark.llm import boosted_rules, language_id

from .test_operators import LOWER, components_of

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        at[name] = (before, docs.collect())
        if name != "mixture":
            assert docs.columns == COLUMNS
            assert {tuple(r) for r in at[name][1]} <= {tuple(r) for r in before}
    source = spark.read.parquet(f"{SF}/documents.parquet")
    before, after = at["language_id"]
    model = language_id.train_language_model(source)
    keep = language_id.identify(source.select("doc_id", "text"), model).where("lang_pred <> 'und' and score >= 0.5").collect()
    assert {r.doc_id for r in after} == {r.doc_id for r in keep}
    before, after = at["quality_rules"]
    frame = spark.createDataFrame(before, source.schema)
    trees = boosted_rules.train_rules(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in after} == {r.doc_id for r in boosted_rules.apply_rules(frame, trees).where("kept").collect()}
    before, after = at["near_duplicates"]
    assert {r.doc_id for r in after} == {c for _, c in components_of([(r.doc_id, r.text) for r in before], 5).values()}
    before, after = at["decontamination"]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    joined = {r.doc_id: f" {' '.join(split(r.text))} " for r in before}
    windows = {" ".join(w[k : k + min(10, len(w))]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := split(r.text)) for k in range(len(w) - min(10, len(w)) + 1)}
    assert {r.doc_id for r in after} == {i for i, t in joined.items() if not any(f" {w} " in t for w in windows)}
    before, after = at["mixture"]
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    assert after and 0.5 * words(before) < words(after) < 1.5 * words(before)
    assert {(r.doc_id, r.copy) for r in after} and max(r.copy for r in after) <= 3


def test_hard_rows(spark):
    prose = "the quick brown fox said that all of the good people in town would come to the fair on the next day and eat bread "
    rows = [(1, prose, "en", "a", 1, "s"), (1, prose, "en", "a", 1, "s"), (None, prose + "again", None, None, None, None), (2, None, "en", "a", 0, "s"), (3, "", None, "b", 0, None)]
    rows += [(4, (prose + "%d " % 7) * 400, "en", "b", 2, "s")] + [(10 + i, f"{prose} {'xyz' * i} number {i} of many", "en", "b", 5, "s") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
        out = stage(spark, docs, SF)
        if name != "mixture":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            ids = [r.doc_id for r in out.collect()]
            assert ids.count(1) == 1 and None not in ids  # the row without an id is near the first
        assert out.count() > 0


def test_near_duplicates_by_row(spark):
    prose = "the quick brown fox said that all of the good people in town would come to the fair on the next day and eat bread "
    other = "a wholly different text with words of its own that nobody else in this table has written down before today "
    rows = [(1, prose, "x"), (1, other, "y"), (2, prose + "again", "z"), (None, other + "now", "a"), (None, "no copy of mine is to be found anywhere in here at all", "b"), (None, "no copy of mine is to be found anywhere in here at all", "b"), (3, None, "c"), (3, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    for _ in range(2):
        got = corpus_pipeline.remove_near_duplicates(spark, docs, SF)
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[1], rows[4], rows[6]], key=str)


def test_clashing_columns_stay(spark):
    rows = [(i, f"some words of text number {i}", "en", "s", 9, 7, "here", 1.5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, copies int, shard string, target double")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:8] == docs.columns and len(set(out.columns)) == len(out.columns)
        assert {(r["size"], r.copies, r.shard, r.target) for r in out.collect()} <= {(9, 7, "here", 1.5)}
