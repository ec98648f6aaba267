"""Null handling, text and time helpers built from Spark's own functions."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(path: str) -> Column:
    """Nested column by dotted path; ``@timestamp`` is quoted where needed."""
    return F.col("`@timestamp`") if path == "@timestamp" else F.col(path)


def filled(c: Column) -> Column:
    """Blank text counts as missing."""
    return F.nullif(c.cast("string"), F.lit(""))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cols])


def truth(predicate: Column) -> Column:
    """Null never matches, also under a later NOT."""
    return F.coalesce(predicate, F.lit(False))


def text(c: Column) -> Column:
    """Lowered text, missing as ''."""
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def contains_any(c: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def basename(c: Column, sep: str = "/") -> Column:
    return F.substring_index(c, sep, -1)


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters of a string, two decimals; 0 for blank or missing text."""
    total = F.length(c).cast("double")
    chars = F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1)))

    def term(acc: Column, ch: Column) -> Column:
        p = (F.length(c) - F.length(F.replace(c, ch, F.lit("")))) / total
        return acc - p * F.log2(p)

    return F.when(F.length(c) > 0, F.round(F.aggregate(chars, F.lit(0.0), term), 2)).otherwise(F.lit(0.0))


def decode_hex(c: Column) -> Column:
    """Hex-encoded command text to plain text; anything that is not at least 12 hex digits stays as it is."""
    squeezed = F.regexp_replace(c, r"\s", "")
    plain = F.decode(F.try_to_binary(squeezed, F.lit("hex")), "UTF-8")
    return F.when(squeezed.rlike("^([0-9A-Fa-f]{2}){6,}$"), plain).otherwise(c)


def parse_iso(c: Column) -> Column:
    """ISO-8601 text to timestamp: drop Z, keep six fraction digits, null when it does not parse."""
    bare = F.replace(c, F.lit("Z"), F.lit(""))
    micro = F.regexp_replace(bare, r"(\.\d{6})\d+$", "$1")
    ok = bare.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d*)?$")
    return F.when(ok, F.try_to_timestamp(F.regexp_replace(micro, r"\.$", "")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def index_day(ts: Column, shift_hours: int = 0) -> Column:
    """Daily index name part; the host agent names its days eight hours ahead of UTC."""
    return F.date_format(ts + F.make_interval(hours=F.lit(shift_hours)), "yyyy.MM.dd")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def glob_to_regex(pattern: str) -> str:
    """Shell wildcard to a Java regex that must cover the whole text."""
    body = fnmatch.translate(pattern)
    body = re.sub(r"^\(\?s:(.*)\)\\[Zz]$", r"\1", body, flags=re.S)
    # fnmatch uses atomic groups, which Java knows too
    return f"(?s)^(?:{body})$"


def literal(value) -> str:
    """SQL text of a constant."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def pick(values, index: Column) -> Column:
    """The entry of a fixed list at a zero-based index; '' in the list means missing."""
    entries = F.expr("array(" + ", ".join(literal(v) for v in values) + ")")
    return filled(F.element_at(entries, (index + 1).cast("int")))


def fence(df: DataFrame, names: list[str]) -> DataFrame:
    """Keep later filters on costly columns from being pushed below them.

    Pushing a filter down repeats the expressions it reads. For wide predicate
    sets that multiplies the work, so the columns pass through a one-row generator,
    which filters on its output do not cross.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    packed = df.select(*rest, F.explode_outer(F.array(F.struct(*names))).alias("__f"))
    return packed.select(*rest, *[F.col(f"__f.{n}").alias(n) for n in names])


def spread(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """One row per entry of a computed array.

    A plain explode makes Spark infer a filter on the array and push it down,
    which repeats everything the array is built from; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def is_json_object(value: Column) -> Column:
    """Whether a text is one complete JSON object; false for null. A broken text parses to a struct of nulls, so that says nothing."""
    return F.json_object_keys(value).isNotNull()


def rejected(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines that should hold a JSON object and do not. Blank lines and comments are no records."""
    line = F.ltrim(value)
    return lines.where((line != "") & ~line.startswith("#") & ~is_json_object(F.col(value)))
