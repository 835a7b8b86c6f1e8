"""Column expressions: line counts, hashes, verdicts, fixed-offset fields, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.splitlines() parts lines at.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def lf_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "\n", ""))).cast("long")


def cr_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "\r", ""))).cast("long")


def splitlines_count(text: Column) -> Column:
    """Number of lines in the sense of splitlines(): a final break ends the last line."""
    breaks = F.regexp_count(text, F.lit(LINE_BREAK))
    open_end = ~text.rlike(rf"(?s)(?:{LINE_BREAK})\z") & (text != "")
    return (breaks + open_end.cast("int")).cast("long")


def content_hash(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def lines_of(text: Column) -> Column:
    """Lines parted by LF only; one final LF belongs to the last line; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1))


def verdict(stdout: Column) -> Column:
    """The Boolean `flagged` of the first { to the last }; null if that is no such object."""
    obj = F.regexp_extract(stdout, r"(?s)\{.*\}", 0)
    found = F.try_variant_get(F.try_parse_json(obj), "$.flagged", "variant")
    return F.when(F.schema_of_variant(found) == "BOOLEAN", F.try_variant_get(F.try_parse_json(obj), "$.flagged", "boolean"))


def u32_le(data: Column, offset: int) -> Column:
    """Unsigned little-endian 32-bit number at a byte offset."""
    byte = lambda i: F.conv(F.hex(F.substring(data, offset + 1 + i, 1)), 16, 10).cast("long")
    return sum((byte(i) * F.lit(256**i) for i in range(1, 4)), byte(0))


def series_title(series: Column, number: Column, title: Column) -> Column:
    return F.format_string("%s Book %s - %s", series, number.cast("string"), title)


def log_identifier(line: Column) -> Column:
    """The fifth field of a journal line, without [pid] and the final colon."""
    field = F.try_element_at(F.split(F.trim(line), r"\s+"), F.lit(5))
    return F.regexp_replace(F.regexp_replace(field, r"\[.*", ""), ":$", "")


def band(value: Column, warn: float, fail: float) -> Column:
    """ok up to ``warn``, then warn, and fail above ``fail`` (both strict); unknown for null."""
    return F.when(value.isNull(), "unknown").when(value > fail, "fail").when(value > warn, "warn").otherwise("ok")
