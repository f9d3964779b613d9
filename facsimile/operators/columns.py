"""Schema-driven column handling shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, FLOAT, BOOLEAN, STRING, DATETIME, OTHER = (
    "integer", "float", "boolean", "string", "datetime", "other",
)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.IntegralType):
        return INTEGER
    if isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        return FLOAT
    if isinstance(data_type, T.StringType):
        return STRING
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return OTHER


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def of_kind(df: DataFrame, *wanted: str) -> list[str]:
    """Columns of the given kinds, in schema order."""
    return [name for name, kind in kinds(df).items() if kind in wanted]


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer and floating columns; booleans are not numeric here."""
    return of_kind(df, INTEGER, FLOAT)


def string_columns(df: DataFrame) -> list[str]:
    return of_kind(df, STRING)


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing: turn it into null once, so that every aggregate skips it."""
    def clean(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(field.name), F.col(field.name)).alias(field.name)
        return F.col(field.name)
    return df.select(*[clean(f) for f in df.schema.fields])


def common_columns(real: DataFrame, synth: DataFrame) -> list[str]:
    """Columns of the real table that the other one also has, in real order."""
    present = set(synth.columns)
    return [c for c in real.columns if c in present]


def tagged_union(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Both tables in one frame with a ``side`` column; types are widened per column."""
    real_types = {f.name: f.dataType for f in real.schema.fields}
    synth_types = {f.name: f.dataType for f in synth.schema.fields}

    def shaped(df: DataFrame, side: str) -> DataFrame:
        return missing_as_null(df.select(*[
            _aligned(c, real_types[c], synth_types[c]).alias(c) for c in columns
        ])).withColumn("side", F.lit(side))

    return shaped(real, "real").unionByName(shaped(synth, "synth"))


def _aligned(name: str, left: T.DataType, right: T.DataType) -> Column:
    if left == right:
        return F.col(name)
    numeric = (INTEGER, FLOAT, BOOLEAN)
    if kind_of(left) in numeric and kind_of(right) in numeric:
        return F.col(name).cast("double")
    return F.col(name).cast("string")


def coerce(df: DataFrame, column_types: dict[str, str]) -> DataFrame:
    """Cast columns to their detected coarse type; unreadable cells become null."""
    def cast(name: str) -> Column:
        wanted = column_types.get(name)
        column = F.col(name)
        if wanted == "numerical":
            return column.try_cast("double").alias(name)
        if wanted == "boolean":
            return column.try_cast("int").alias(name)
        if wanted == "categorical":
            text = column.cast("string")
            return F.when(text != "nan", text).alias(name)
        return column
    return df.select(*[cast(c) for c in df.columns])


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the cells of a one-row result to every row, as a scalar subquery: no join, no shuffle of ``df``."""
    cells = row.select(F.struct(*row.columns).alias("_row")).scalar()
    return df.withColumn("_row", cells).select(*df.columns, *[F.col("_row")[c].alias(c) for c in row.columns])


def long_rows(names: list[str], fields: dict[str, dict[str, Column]]) -> Column:
    """``inline``-able array with one struct per column: turns one wide aggregate into k rows."""
    return F.array(*[
        F.struct(F.lit(n).alias("column"), *[col.alias(k) for k, col in fields[n].items()])
        for n in names
    ])
