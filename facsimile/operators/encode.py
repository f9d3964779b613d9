"""Numeric encodings of mixed tables with one dictionary shared by all sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.functions.dates import epoch_seconds
from facsimile.operators.columns import BOOLEAN, DATETIME, FLOAT, INTEGER, STRING, kinds, missing_as_null
from facsimile.operators.prefix import running_totals, text_bounds, text_range
from facsimile.operators.quantiles import quantiles

# dictionaries up to this size are carried inside the plan
INLINE_CODES = 256
NULL_LEVEL = "nan"


def text_level(name: str) -> Column:
    """A string cell as a category; null is the level ``nan``."""
    return F.coalesce(F.col(name).cast("string"), F.lit(NULL_LEVEL))


def dictionary(df: DataFrame, name: str) -> DataFrame:
    """``(value, code)``: distinct levels of a string column numbered from 0 in text order."""
    levels = df.select(text_level(name).alias("value")).groupBy("value").agg(F.lit(1).alias("one"))
    placed = running_totals(levels, [], text_range(F.col("value"), text_bounds(levels, "value")), ["value"], ["one"])
    return placed.select("value", F.col("one_before").alias("code"))


def encode_strings(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace string columns by their dictionary codes.

    Small dictionaries become a lookup inside the plan; larger ones an equi-join that the optimizer
    broadcasts by size or splits where a level is hot.
    """
    if not columns:
        return df
    # rough level counts only choose between the two forms
    rough = df.agg(*[F.approx_count_distinct(text_level(c)).alias(c) for c in columns]).first()
    small = [c for c in columns if rough[c] <= INLINE_CODES // 2]
    lookups: dict[str, list[str]] = {c: [] for c in small}
    if small:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), text_level(c).alias("value")) for c in small])
        for r in df.select(F.inline(cells)).distinct().collect():
            lookups[r["column"]].append(r["value"])
    for c in (c for c in columns if c not in lookups):
        codes = dictionary(df, c).select(F.col("value").alias("_level"), F.col("code").alias("_code"))
        df = df.withColumn("_level", text_level(c)).join(codes, "_level", "left").withColumn(
            c, F.col("_code").cast("double")
        ).drop("_level", "_code")

    def cell(c: str) -> Column:
        if c not in lookups:
            return F.col(c)
        levels = F.array(*[F.lit(v) for v in sorted(lookups[c])])
        return (F.array_position(levels, text_level(c)) - 1).cast("double").alias(c)

    return df.select(*[cell(c) for c in df.columns])


def numeric_cell(df: DataFrame, name: str) -> Column:
    """A non-string cell as a double; datetimes as seconds."""
    kind = kinds(df)[name]
    if kind == DATETIME:
        return epoch_seconds(F.col(name), df.schema[name].dataType)
    if kind == BOOLEAN:
        return F.col(name).cast("int").cast("double")
    return F.col(name).cast("double")


def encode_table(df: DataFrame, columns: list[str], keep: list[str], fill: str = "zero") -> DataFrame:
    """``keep`` columns plus every other column as a double without nulls.

    ``fill`` is ``zero`` (distances) or ``median`` (model features, then zero).
    """
    df = missing_as_null(df)
    by_kind = kinds(df)
    texts = [c for c in columns if by_kind[c] == STRING]
    numbers = [c for c in columns if by_kind[c] in (INTEGER, FLOAT, BOOLEAN, DATETIME)]
    cells = [numeric_cell(df, c).alias(c) if c in numbers else F.col(c) for c in columns]
    coded = encode_strings(df.select(*keep, *cells), texts)
    fills = {c: 0.0 for c in numbers}
    if fill == "median" and numbers:
        medians = quantiles(coded, numbers, {"median": 0.5}).collect()
        fills.update({r["column"]: r["median"] for r in medians if r["median"] is not None})
    return coded.na.fill(fills).select(*keep, *columns)


def scaling(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (0 becomes 1): one row on the driver."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scaled(name: str, scale: dict[str, tuple[float, float]]) -> Column:
    mean, deviation = scale[name]
    return (F.col(name) - F.lit(float(mean))) / F.lit(float(deviation))
