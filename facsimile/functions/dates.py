"""Date-like strings: the shape tests, the accepted formats and epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Shapes of a date string, accepted formats in order of trial
DATE_SHAPES = [
    r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}",
    r"^\d{1,2}\s+\w{3}\s+\d{4}",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
]
DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "MM-dd-yyyy",
    "dd-MM-yyyy",
    "dd MMM yyyy",
]


def looks_like_date(value: Column) -> Column:
    return value.rlike("|".join(DATE_SHAPES))


def parse_date(value: Column) -> Column:
    """The first accepted format that reads the string; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS])


def epoch_seconds(column: Column, data_type: T.DataType) -> Column:
    """Whole seconds since 1970 of a date, a timestamp or a date string, whatever the session zone."""
    if isinstance(data_type, T.TimestampNTZType):
        origin = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
        return F.timestamp_diff("SECOND", origin, column).cast("double")
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("double") * 86400.0
    if isinstance(data_type, T.TimestampType):
        return F.unix_seconds(column).cast("double")
    origin = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("SECOND", origin, parse_date(column).cast("timestamp_ntz")).cast("double")
