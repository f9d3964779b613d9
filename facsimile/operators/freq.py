"""Value frequencies per column: the shared core of profiling, fidelity and fitting.

One scan unpivots the wanted columns and counts (column, value) pairs with map-side partial
aggregation, so a value that fills a third of the table costs one row per task in the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators.columns import FLOAT, INTEGER, kinds


def _families(df: DataFrame, columns: list[str]) -> list[tuple[str, list[str]]]:
    by_kind = kinds(df)
    integers = [c for c in columns if by_kind[c] == INTEGER]
    floats = [c for c in columns if by_kind[c] == FLOAT]
    others = [c for c in columns if by_kind[c] not in (INTEGER, FLOAT)]
    return [(t, cs) for t, cs in (("bigint", integers), ("double", floats), ("string", others)) if cs]


def _melt(df: DataFrame, columns: list[str], cast: str, by: list[str]) -> DataFrame:
    # adding 0.0 folds -0.0 into 0.0 before values are compared as text
    cells = [
        ((F.col(c).cast(cast) + F.lit(0.0)) if cast == "double" else F.col(c).cast(cast)).alias(c)
        for c in columns
    ]
    keys = [F.col(b) for b in by]
    return (
        df.select(*keys, *cells)
        .unpivot(by, columns, "column", "value")
        .where(F.col("value").isNotNull())
    )


def _digested(melted: DataFrame, cast: str) -> DataFrame:
    """Long texts replaced by 128-bit digests, where only equality matters: 16 bytes a value in the shuffle."""
    if cast != "string":
        return melted
    return melted.withColumn("value", F.struct(
        F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), F.col("value"), F.length("value")).alias("b")
    ))


def value_counts(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """``(by..., column, value, n)`` of every non-null value, value as text.

    Numbers are counted as numbers and only their distinct values are turned into text.
    """
    by = by or []
    columns = [c for c in (columns or df.columns) if c not in by]
    parts = [
        _melt(df, cs, cast, by)
        .groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("value", F.col("value").cast("string"))
        for cast, cs in _families(df, columns)
    ]
    return reduce(DataFrame.unionByName, parts)


def numeric_counts(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(by..., column, value, n)`` of numeric columns, value as double."""
    by = by or []
    return (
        _melt(df, columns, "double", by)
        .groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, unique_count)``: exact numbers of distinct non-null values."""
    columns = columns or df.columns
    parts = [
        _digested(_melt(df, cs, cast, []), cast).groupBy("column", "value").agg(F.lit(1).alias("one"))
        .groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
        for cast, cs in _families(df, columns)
    ]
    return reduce(DataFrame.unionByName, parts)


def side_counts(
    both: DataFrame, columns: list[str], numeric: bool = False, digest: bool = False,
) -> DataFrame:
    """``(column, value, n_real, n_synth)`` of a tagged union: both tables in one aggregate.

    With ``digest`` the values are only good for counting, which spares the shuffle of long texts.
    """
    families = [("double", columns)] if numeric else _families(both, columns)
    parts = []
    for cast, cs in families:
        melted = _melt(both, cs, cast, ["side"])
        counted = (_digested(melted, cast) if digest else melted).groupBy("column", "value").agg(
            F.count_if(F.col("side") == "real").alias("n_real"),
            F.count_if(F.col("side") == "synth").alias("n_synth"),
        )
        parts.append(counted if numeric else counted.withColumn("value", F.col("value").cast("string")))
    return reduce(DataFrame.unionByName, parts)


def row_digest(df: DataFrame, columns: list[str] | None = None):
    """128-bit digest of a row as two longs; null flags are part of it, so (a, null) != (null, a)."""
    columns = columns or df.columns
    flags = [F.col(c).isNull() for c in columns]
    cells = [F.col(c) for c in columns]
    return F.struct(
        F.xxhash64(*flags, *cells).alias("a"),
        F.xxhash64(F.lit(1), *cells, *flags).alias("b"),
    )


def duplicate_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., num_rows, duplicate_count)``: rows beyond the first of each group of equal rows.

    Digests are shuffled instead of rows: 16 bytes a row whatever the width of the table.
    """
    by = by or []
    columns = [c for c in df.columns if c not in by]
    groups = (
        df.select(*by, row_digest(df, columns).alias("digest"))
        .groupBy(*by, "digest").agg(F.count(F.lit(1)).alias("n"))
    )
    return groups.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"),
    )
