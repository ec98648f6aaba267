"""Column helpers shared by the operators of this subpackage.

Operators keep every input column. They carry the input row as one struct, so no
name of theirs can clash with it; where a result column has the name of an input
column, the result replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that, and much faster, where every character is one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def digest(*cols: Column) -> list[Column]:
    """128 bits of the columns as two independent 64-bit hashes."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)]


def packed(df: DataFrame, *drop: str) -> Column:
    """The input row without ``drop`` as one struct."""
    names = [c for c in df.columns if c not in drop]
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias("row") if names else F.struct(F.lit(None).cast("int").alias("_")).alias("row")


def unpacked(df: DataFrame, results: list[str]) -> DataFrame:
    """The packed columns again, followed by ``results``, which win over columns of the same name."""
    keep = [c for c in df.schema["row"].dataType.names if c not in results and c != "_"]
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *results)


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n
