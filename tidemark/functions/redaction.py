"""Finding and masking secrets and personal data, in plain Python and over DataFrames."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.rules import CREDENTIALS, HINTS, PROFILES, SHAPES, build_rules, entities_for_profile, folded
from tidemark.shipping import ship

Finding = tuple[str, int, int, float]

SPAN = T.StructType([T.StructField("entity_type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])


def placeholder(entity: str) -> str:
    return f"[{entity}]"


OWN_PLACEHOLDERS = frozenset(placeholder(e) for e in (*CREDENTIALS, "EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS"))


def is_own_placeholder(text: str) -> bool:
    return text.strip() in OWN_PLACEHOLDERS


def own_placeholder(text: Column) -> Column:
    """Whether a text is one of our placeholders and nothing else."""
    return F.trim(text).isin(*sorted(OWN_PLACEHOLDERS))


class Redactor:
    """All rules, compiled once."""

    def __init__(self) -> None:
        self.rules = [(r, r.compiled(), re.compile(SHAPES[r.pattern]) if r.pattern in SHAPES else None) for r in build_rules()]

    def analyze(self, text: str, profile: str) -> list[Finding]:
        """All detections of the profile, overlapping ones included, in order of place."""
        wanted = set(entities_for_profile(profile))
        low = folded(text)
        found: dict[tuple[str, int, int], float] = {}
        for rule, pattern, shape in self.rules:
            if rule.entity in wanted and (shape.search(text) if shape else any(h in low for h in HINTS[rule.entity])):
                for m in pattern.finditer(text):
                    if m[0] and m[0] not in OWN_PLACEHOLDERS and (rule.accepts is None or rule.accepts(m[0])):
                        key = (rule.entity, m.start(), m.end())
                        found[key] = max(found.get(key, 0.0), rule.score)
        return sorted(((e, s, t, score) for (e, s, t), score in found.items()), key=lambda f: (f[1], f[2], f[0]))

    @staticmethod
    def resolve(found: list[Finding]) -> list[Finding]:
        """Of overlapping detections the one with the higher score stays, then the longer, then the first."""
        kept: list[tuple[int, int, Finding]] = []  # by place, none overlapping
        for f in sorted(found, key=lambda f: (-f[3], f[1] - f[2], f[1], f[0])):
            at = bisect.bisect_left(kept, (f[1], f[2]))
            if (at == 0 or kept[at - 1][1] <= f[1]) and (at == len(kept) or f[2] <= kept[at][0]):
                kept.insert(at, (f[1], f[2], f))
        return [f for _, _, f in kept]

    @classmethod
    def masked(cls, text: str, found: list[Finding]) -> str:
        """The text with what stays of ``found`` replaced."""
        out, at = [], 0
        for entity, start, end, _ in cls.resolve(found):
            out += [text[at:start], placeholder(entity)]
            at = end
        return "".join([*out, text[at:]])

    def redact(self, text: str, profile: str) -> tuple[str, list[str], list[tuple[int, int]]]:
        """The masked text, the types of all detections, and their spans in the source text."""
        found = self.analyze(text, profile) if text else []
        return self.masked(text, found), [f[0] for f in found], [(f[1], f[2]) for f in found]


def with_redaction(df: DataFrame, text_col: str, profile: str = "broad") -> DataFrame:
    """``df`` with redacted (string) and findings (array of entity_type, start, end, score).

    All rules are tried in one pass; substrings and shapes that a match needs rule most of them out for a text. Null texts stay null
    without findings."""
    entities_for_profile(profile)
    ship(df.sparkSession)
    kept = df.drop("redacted", "findings")
    text = F.col(f"`{text_col}`")
    wide = df.select(*[df[f"`{c}`"] for c in kept.columns], text.alias("__text"))
    schema = T.StructType([*kept.schema.fields, T.StructField("redacted", T.StringType()), T.StructField("findings", T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        redactor = Redactor()
        for b in batches:
            texts, spans = [], []
            for text_ in b.column(b.num_columns - 1).to_pylist():
                found = redactor.analyze(text_, profile) if text_ else []
                texts.append(redactor.masked(text_, found) if found else text_)
                spans.append([{"entity_type": e, "start": s, "end": t, "score": x} for e, s, t, x in found])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(spans, kind)], names=names)

    return wide.mapInArrow(run, schema)


def profile_entities(spark) -> DataFrame:
    """The dimension table (profile, entity_type)."""
    return spark.createDataFrame([(p, e) for p, es in PROFILES.items() for e in es], "profile string, entity_type string")
