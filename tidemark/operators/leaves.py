"""String leaves of JSON lines as a table, and findings with their places.

Lines become VARIANT values. A step replaces each object or array by its members and leaves everything else as it is,
so steps follow each other in one stage; what is nested more deeply than ``STEPS`` goes on from a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.jsonwalk import KEEP_KEYS, NARROW_PATHS
from tidemark.functions.redaction import with_redaction
from tidemark.functions.rules import CREDENTIALS
from tidemark.sources.scratch import written_table

#: Levels of nesting that are opened in one stage.
STEPS = 6
_LEVEL, _INDEX = "\u0001", "\u0002"
#: Narrow paths as they are noted beside a leaf: a mark for each level, and one for any array index.
_NARROW = ["".join(_LEVEL + (_INDEX if p == "*" else p) for p in path) for path in NARROW_PATHS]


def _is_container(value: Column) -> Column:
    return F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)<")


def _opened(rows: DataFrame) -> DataFrame:
    """``rows`` (relpath, line_no, path, shape, value) with objects and arrays replaced by their members.

    Members under a kept key go with all that is below them, empty containers as well."""
    keep = [c for c in rows.columns if c not in ("path", "shape", "value")]
    each = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("value").outer()).toDF("__pos", "__key", "__member"))
    key, pos = F.col("__key"), F.col("__pos")
    plain = key.rlike("^[A-Za-z0-9_]+$")
    name = F.when(key.isNull(), F.concat(F.lit("["), pos, F.lit("]"))).when(plain, F.concat(F.lit("."), key)).otherwise(F.concat(F.lit('."'), key, F.lit('"')))
    some = each.where((pos.isNotNull() & (key.isNull() | ~key.isin(*sorted(KEEP_KEYS)))) | (pos.isNull() & ~_is_container(F.col("value"))))
    return some.select(
        *keep, F.when(pos.isNull(), F.col("path")).otherwise(F.concat("path", name)).alias("path"),
        F.when(pos.isNull(), F.col("shape")).otherwise(F.concat("shape", F.lit(_LEVEL), F.coalesce(key, F.lit(_INDEX)))).alias("shape"),
        F.when(pos.isNull(), F.col("value")).otherwise(F.col("__member")).alias("value"),
    )


def string_leaves(lines: DataFrame, steps: int = STEPS) -> DataFrame:
    """(relpath, line_no, leaf_path, profile, value) of each string in the JSON lines ``lines`` (relpath, line_no, raw).

    Values under the kept keys are no leaves, at any depth; of a repeated key the last counts. Lines that are no JSON, null ones
    included, have none. Profile is narrow on the paths named for it, from the root, else broad."""
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = lines.select("relpath", "line_no", F.lit("$").alias("path"), F.lit("").alias("shape"), F.try_parse_json("raw").alias("value")).where("value is not null")
    done = []
    while True:
        for _ in range(steps):
            parsed = _opened(parsed)
        kind = F.schema_of_variant("value")
        rest = F.when(_is_container(F.col("value")), F.to_json("value"))
        text = F.when(kind == "STRING", F.variant_get("value", "$", "string"))
        found = written_table(parsed.select("relpath", "line_no", "path", "shape", rest.alias("rest"), text.alias("value")).where("rest is not null or value is not null"), "leaves")
        done.append(found.where("rest is null").drop("rest"))
        left = found.where("rest is not null")
        if left.isEmpty():
            break
        parsed = left.select("relpath", "line_no", "path", "shape", F.parse_json("rest").alias("value"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    profile = F.when(F.col("shape").isin(*_NARROW), "narrow").otherwise("broad")
    return out.select("relpath", "line_no", F.col("path").alias("leaf_path"), profile.alias("profile"), "value")


def leaf_findings(leaves: DataFrame) -> DataFrame:
    """(relpath, line_no, leaf_path, entity_type, start, end, score) of all detections in the leaves, each by its profile.

    Places are characters of the leaf's text. Detections may overlap; their counts are those of a redaction."""
    found = with_redaction(leaves, "value", "narrow").select("relpath", "line_no", "leaf_path", "profile", F.explode("findings").alias("f"))
    return found.where((F.col("profile") == "narrow") | F.col("f.entity_type").isin(*CREDENTIALS)).select("relpath", "line_no", "leaf_path", "f.*")
