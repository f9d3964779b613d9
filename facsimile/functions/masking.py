"""Masks, redaction, row and table fingerprints, JSON-safe cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.names import is_redacted_name


def mask(column: Column, visible: int = 3) -> Column:
    """Stars for all but the last ``visible`` characters; short values become all stars."""
    size = F.length(column)
    hidden = F.when(size <= visible, size).otherwise(size - visible)
    tail = F.when(size <= visible, F.lit("")).otherwise(F.substring(column, -visible, visible))
    return F.concat(F.repeat(F.lit("*"), hidden), tail)


def record_hash(df: DataFrame, columns: list[str] | None = None, salt: str | None = None) -> Column:
    """SHA-256 of ``name=value`` pairs in name order, joined by a bar, after an optional salt."""
    pairs = [
        F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None")))
        for c in sorted(columns or df.columns)
    ]
    body = F.concat_ws("|", *pairs)
    return F.sha2(F.concat(F.lit(f"{salt}:"), body) if salt else body, 256)


def redact(df: DataFrame) -> DataFrame:
    """Replace every column whose name carries a secret word by a fixed marker."""
    return df.select(*[
        F.lit("[REDACTED]").alias(c) if is_redacted_name(c) else F.col(c) for c in df.columns
    ])


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: a SHA-256 that depends on the rows of a table, not on their order or partitioning.

    Rows are digested one by one and the digests added up, so nothing is sorted or shuffled but
    one partial sum per task.
    """
    digest = record_hash(df)
    part = lambda start: F.conv(F.substring("digest", start, 15), 16, 10).cast("decimal(38,0)")
    sums = df.select(digest.alias("digest")).agg(
        F.count(F.lit(1)).alias("num_rows"),
        *[F.coalesce(F.sum(part(1 + 15 * i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)],
    )
    body = F.concat_ws("|", F.col("num_rows").cast("string"), *[F.col(f"s{i}") for i in range(4)])
    return sums.select("num_rows", F.sha2(body, 256).alias("fingerprint"))


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column."""
    def clean(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            finite = ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))
            return F.when(finite, column).alias(field.name)
        return column
    return df.select(*[clean(f) for f in df.schema.fields])
