"""The training-data pipeline: documents through five operators of tidemark.llm, each stage written and reread.

In every stage a row stands for itself: rows that repeat a doc_id are judged one by one. Null and empty texts
have no language and are rejected by the first stage; very long texts are read whole; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import boosted_rules, language_id, mixture, odd_sketch, suffix_arrays
from tidemark.llm.common import materialize, read_table, release

#: A document whose most likely language has less than this probability is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def _packed(docs: DataFrame, *others: Column | str) -> DataFrame:
    """The whole row beside its text, so that no operator's column can clash with one of the row's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text", *others)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with text in a recognisable language. The model is fitted on the documents' own languages.

    Null and empty texts and those without a letter go; equal rows are judged alike and all stay or go."""
    model = language_id.train_language_model(docs)
    found = language_id.identify(_packed(docs), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("__row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees, which are trained on the table labels.

    Null and empty texts fail the base rules; equal rows are judged alike and all stay or go."""
    trees = boosted_rules.train_rules(docs, read_table(spark, sf_dir, "labels"))
    return boosted_rules.apply_rules(_packed(docs), trees).where("kept").select("__row.*")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id, then the least hash of its row.

    A document with a null doc_id counts behind all others. Different texts under one doc_id are documents of
    their own. Of rows that are equal in all columns (but maps) one stays, also if they have no text."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema.fields if _hashable(f.dataType)]
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*columns).alias("hash"))
    rows = _packed(docs, key.alias("__key"))
    found = odd_sketch.near_duplicates(rows, id_col="__key")
    # a table as long as the rejected documents, split or broadcast by the planner
    found = materialize(found.select("__key", "kept"), "judged")
    gone = found.where("not kept").select("__key").distinct()
    left = rows.join(gone, "__key", "left_anti")
    repeated = found.where("kept").groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key")
    repeated = materialize(repeated, "repeated_rows")
    if not repeated.isEmpty():
        one = left.join(repeated, "__key", "left_semi").groupBy("__key").agg(F.first("__row").alias("__row"))
        left = left.join(repeated, "__key", "left_anti").select("__key", "__row").union(one)
    return left.select("__row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts hold none; equal rows are judged alike."""
    found = suffix_arrays.decontaminate(_packed(docs), read_table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select("__row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to the target weights: a row for each time a document is taken, with copy, shard and rank
    (mix_copy and so on where the documents have such a column). Null and empty texts have no words and may be taken
    or not; equal rows are taken together."""
    planned = mixture.plan_mixture(_packed(docs, "doc_id", "source"))
    out = mixture.mix(planned)
    names = [F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in ("copy", "shard", "rank")]
    return out.select("__row.*", *names)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("mixture", mix_sources),
]
#: The classifiers and the seeded draws cannot be written in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``. A stage's table is deleted as soon as the next one is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
