"""One row of evidence per column: what role inference, profiling and fitting decide on."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.functions import dates
from facsimile.operators.columns import DATETIME, STRING, kinds, long_rows, numeric_columns, string_columns
from facsimile.operators.freq import distinct_counts, row_digest
from facsimile.session import cut_lineage

# rows of the table head that samples are read from
HEAD_ROWS = 1000
# Published sample sizes (only with ``sampled``) and content patterns of the role rules
CONTENT_SAMPLE = 25
DATE_SAMPLE = 20
COARSE_DATE_SAMPLE = 10
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
HEX_PATTERN = r"^[0-9a-fA-F]{16,}$"
# every accepted date format starts like this; other strings are not tried
DATE_START = r"^[+-]?\d+[-/ ]"


@dataclass(frozen=True)
class ColumnFacts:
    """Evidence about one column; ``position`` is its place in the table."""

    column: str
    position: int
    dtype: str
    kind: str
    rows: int
    non_null: int
    n_unique: int
    low: float | None
    high: float | None
    avg_length: float | None
    date_share: float | None
    date_parses: bool
    coarse_date_parses: bool
    uuid_share: float | None
    hex_share: float | None

    @property
    def unique_ratio(self) -> float:
        return self.n_unique / self.non_null if self.non_null else 0.0

    @property
    def is_zero_one(self) -> bool:
        """At most two values, all of them 0 or 1."""
        return self.n_unique <= 2 and all(v in (0.0, 1.0) for v in (self.low, self.high) if v is not None)

    @property
    def is_datetime_like(self) -> bool:
        if self.kind == DATETIME:
            return True
        return self.kind == STRING and (self.date_share or 0.0) >= 0.8 and self.date_parses


def first_values(df: DataFrame, columns: list[str], size: int, order_by: list[str] | None = None) -> DataFrame:
    """``(column, place, value)``: the first non-null values per column, as text, in a stated row order.

    Without an order the rows are taken by digest, so the sample is the same on every run.  One pass
    keeps the head of the table in a bounded heap per task; a column that is mostly missing there
    gets a pass of its own.  Nothing is sorted as a whole.
    """
    keys = [F.col(c) for c in order_by] if order_by else [row_digest(df)]
    rows = df.select(F.struct(*keys).alias("row_order"), *[F.col(c).cast("string").alias(c) for c in columns])
    head = cut_lineage(rows.orderBy("row_order").limit(HEAD_ROWS))
    seen = head.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    sparse = [c for i, c in enumerate(columns) if seen["rows"] == HEAD_ROWS and seen[f"n{i}"] < size]
    dense = [c for c in columns if c not in sparse]
    parts = [
        rows.where(F.col(c).isNotNull()).orderBy("row_order", c).limit(size)
        .select("row_order", F.lit(c).alias("column"), F.col(c).alias("value"))
        for c in sparse
    ]
    if dense:
        parts.append(head.select("row_order", *dense).unpivot(["row_order"], dense, "column", "value").where(
            F.col("value").isNotNull()))
    # at most HEAD_ROWS rows per column reach this window
    window = Window.partitionBy("column").orderBy("row_order", "value")
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("place", F.row_number().over(window))
        .where(F.col("place") <= size)
        .select("column", "place", "value")
    )


def content_shares(samples: DataFrame) -> DataFrame:
    """Shares of date-like, UUID and hex strings in the first values of each column."""
    value, place = F.col("value"), F.col("place")
    dated = F.when(place <= DATE_SAMPLE, value)
    coarse = F.when(place <= COARSE_DATE_SAMPLE, value)
    share = lambda test: F.avg(test.cast("int"))
    return samples.groupBy("column").agg(
        share(dates.looks_like_date(dated)).alias("date_share"),
        _all_parse(dated).alias("date_parses"),
        _all_parse(coarse).alias("coarse_date_parses"),
        share(value.rlike(UUID_PATTERN)).alias("uuid_share"),
        share(value.rlike(HEX_PATTERN)).alias("hex_share"),
    )


def _all_parse(value):
    # values outside the sample are null here and must not count as failures
    verdicts = [
        F.bool_and(F.when(value.isNotNull(), F.try_to_timestamp(value, F.lit(f)).isNotNull()))
        for f in dates.DATE_FORMATS
    ]
    return F.coalesce(F.greatest(*verdicts), F.lit(False))


def _content(value: Column) -> dict[str, Column]:
    """The aggregates of a text column's content over all its rows."""
    share = lambda test: F.avg(test.cast("int"))
    return {
        "date": share(dates.looks_like_date(value)),
        "parses": F.coalesce(F.bit_and(_formats_read(value)) != 0, F.lit(False)),
        "uuid": share(value.rlike(UUID_PATTERN)),
        "hex": share(value.rlike(HEX_PATTERN)),
    }


def _formats_read(value: Column) -> Column:
    """One bit for each date format that reads ``value``; null stays null."""
    bits = [
        F.when(F.try_to_timestamp(value, F.lit(f)).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0))
        for k, f in enumerate(dates.DATE_FORMATS)
    ]
    read = F.when(value.rlike(DATE_START), reduce(Column.__add__, bits)).otherwise(F.lit(0))
    return F.when(value.isNotNull(), read)


def column_facts(df: DataFrame, order_by: list[str] | None = None, sampled: bool = False) -> DataFrame:
    """``ColumnFacts`` fields, one row per column.

    Shares of dates, UUIDs and hex strings, and whether one date format reads them all, cover every
    non-null value; with ``sampled`` only the published number of first values in the stated order.
    """
    by_kind = kinds(df)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numbers, texts = set(numeric_columns(df)), string_columns(df)
    value = lambda c: F.col(c).cast("double")
    nothing = F.lit(None).cast("double")
    names = df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"{i}_n") for i, c in enumerate(names)],
        *[F.min(value(c)).alias(f"{i}_low") for i, c in enumerate(names) if c in numbers],
        *[F.max(value(c)).alias(f"{i}_high") for i, c in enumerate(names) if c in numbers],
        *[F.avg(F.length(c)).alias(f"{i}_len") for i, c in enumerate(names) if c in texts],
        *[a.alias(f"{i}_{n}") for i, c in enumerate(names) if c in texts and not sampled for n, a in _content(F.col(c)).items()],
    )
    base = wide.select(F.inline(long_rows(names, {
        c: {
            "position": F.lit(i),
            "dtype": F.lit(types[c]),
            "kind": F.lit(by_kind[c]),
            "rows": F.col("rows"),
            "non_null": F.col(f"{i}_n"),
            "low": F.col(f"{i}_low") if c in numbers else nothing,
            "high": F.col(f"{i}_high") if c in numbers else nothing,
            "avg_length": F.col(f"{i}_len") if c in texts else nothing,
            **({} if sampled else {
                "date_share": F.col(f"{i}_date") if c in texts else nothing,
                "date_parses": F.col(f"{i}_parses") if c in texts else F.lit(False),
                "coarse_date_parses": F.col(f"{i}_parses") if c in texts else F.lit(False),
                "uuid_share": F.col(f"{i}_uuid") if c in texts else nothing,
                "hex_share": F.col(f"{i}_hex") if c in texts else nothing,
            }),
        }
        for i, c in enumerate(names)
    })))
    facts = base.join(distinct_counts(df), "column", "left").withColumn(
        "n_unique", F.coalesce("unique_count", F.lit(0))
    ).drop("unique_count")
    if not sampled:
        return facts
    if texts:
        shares = content_shares(first_values(df, texts, CONTENT_SAMPLE, order_by))
        facts = facts.join(shares, "column", "left")
    else:
        facts = facts.select(
            "*", nothing.alias("date_share"), F.lit(False).alias("date_parses"),
            F.lit(False).alias("coarse_date_parses"), nothing.alias("uuid_share"), nothing.alias("hex_share"),
        )
    return facts


def collect_facts(df: DataFrame, order_by: list[str] | None = None, sampled: bool = False) -> list[ColumnFacts]:
    """The evidence rows on the driver, in table order: one per column, never data rows."""
    rows = [r.asDict() for r in column_facts(df, order_by, sampled).collect()]
    facts = [
        ColumnFacts(**{
            **row,
            "date_parses": bool(row["date_parses"]),
            # a text column without any value reads as dates vacuously
            "coarse_date_parses": bool(row["coarse_date_parses"]) or row["non_null"] == 0,
        })
        for row in rows
    ]
    return sorted(facts, key=lambda f: f.position)
