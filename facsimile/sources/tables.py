"""Reading and writing user tables."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.operators.columns import missing_as_null

PREVIEW_ROWS = 5
_DAMAGED = "�"


class RejectedTable(ValueError):
    """The input is not a usable table."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, check: bool = True) -> DataFrame:
    """A CSV table with a header and inferred types; unusable input is rejected with a reason.

    Inference and the check are one pass over the data each.  For large tables pass a schema, and
    ``check=False`` when the writer is trusted; a malformed row then fails the first job that meets it.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    try:
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
        if not df.columns:
            raise RejectedTable("the table is empty or has no columns")
        if check:
            _check_rows(df)
    except (PySparkException, Py4JJavaError) as error:
        raise RejectedTable("malformed CSV: unable to parse rows") from error
    return missing_as_null(df)


def _check_rows(df: DataFrame) -> None:
    """One aggregate that parses every cell: there are rows, all of them well formed and UTF-8."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    damaged = F.lit(False)
    for name in texts:
        damaged = damaged | F.coalesce(F.contains(name, F.lit(_DAMAGED)), F.lit(False))
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(damaged).alias("damaged"),
        *[F.count(c).alias(f"cells_{i}") for i, c in enumerate(df.columns)],
    ).first()
    if not row["rows"]:
        raise RejectedTable("the table has no data rows")
    if row["damaged"] or any(_DAMAGED in c for c in df.columns):
        raise RejectedTable("invalid encoding: UTF-8 is required")


def read_table(spark: SparkSession, path: str, source: str = "parquet", schema=None) -> DataFrame:
    """A table in any format Spark reads; CSV goes through ``read_csv``."""
    if source == "csv":
        return read_csv(spark, path, schema)
    reader = spark.read.format(source)
    df = (reader.schema(schema) if schema else reader).load(path)
    if not df.columns:
        raise RejectedTable("the table has no columns")
    if df.limit(1).isEmpty():
        raise RejectedTable("the table has no data rows")
    return missing_as_null(df)


def write_table(df: DataFrame, path: str, source: str = "parquet", mode: str = "errorifexists") -> str:
    """Write a table; the job's commit makes it appear whole or not at all."""
    writer = df.write.mode(mode)
    (writer.option("header", True).csv(path) if source == "csv" else writer.format(source).save(path))
    return path


def preview(df: DataFrame, order_by: list[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order_by).limit(rows)
