"""Fitting a table: per-column parameters, category probabilities and a correlation matrix.

A fitted model is three tables, one row per column, per category and per pair of columns.  Fitting
the rows of many sites at once only adds the site to the grouping keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.dates import epoch_seconds
from facsimile.operators.columns import BOOLEAN, DATETIME, FLOAT, INTEGER, STRING, kinds, long_rows, missing_as_null, with_row
from facsimile.operators.facts import collect_facts
from facsimile.operators.freq import row_digest, value_counts
from facsimile.operators.moments import correlations, numeric_moments
from facsimile.operators.roles import identifier_columns, semantic_type
from facsimile.session import cut_lineage, local_rows

# Words read as true, fallback spreads, size of the text pool
TRUE_WORDS = ["true", "yes", "1", "t", "y"]
MIN_NUMERIC_STD = 0.01
MIN_DATETIME_STD = 1.0
TEXT_POOL = 100
TEXT_FREQUENCIES = 50

PARAMS_SCHEMA = (
    "column string, position int, kind string, data_type string, rows long, missing_rate double, mean double,"
    " std double, low double, high double, is_integer boolean, p_true double, constant string, with_time boolean"
)


@dataclass
class Model:
    """A fitted table.  ``params`` is one row per column (on the driver, in table order), ``probs`` the
    ``(column, category, p)`` table of categorical columns, ``pools`` the ``(place, value)`` texts of text columns and
    ``corr`` the ``(col_i, col_j) -> r`` pairs of numeric and datetime columns."""

    params: list[dict]
    probs: DataFrame | None
    pools: dict[str, DataFrame] = field(default_factory=dict)
    corr: dict[tuple[str, str], float] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [p["column"] for p in self.params]

    def of_kind(self, *wanted: str) -> list[dict]:
        return [p for p in self.params if p["kind"] in wanted]

    def params_table(self, spark) -> DataFrame:
        names = T.StructType.fromDDL(PARAMS_SCHEMA).fieldNames()
        return local_rows(spark, [tuple(p.get(n) for n in names) for p in self.params], PARAMS_SCHEMA)


def column_kinds(
    df: DataFrame, order_by: list[str] | None = None, keep: tuple[str, ...] = (), sampled: bool = False,
) -> dict[str, str]:
    """The model kind of each column: constant, boolean, datetime, text, numeric or categorical."""
    facts = collect_facts(df, order_by, sampled)
    ids = set(identifier_columns(facts, keep))
    return {f.column: model_kind(semantic_type(f, f.column in ids), f) for f in facts}


def model_kind(semantic: str, fact) -> str:
    if fact.n_unique <= 1:
        return "constant"
    if semantic in ("boolean", "datetime", "text", "numeric"):
        return semantic
    return "numeric" if fact.kind in (INTEGER, FLOAT) else "categorical"


def missing_rates(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., column, missing_rate)``."""
    by = by or []
    columns = [c for c in df.columns if c not in by]
    wide = missing_as_null(df).groupBy(*by).agg(*[
        F.avg(F.col(c).isNull().cast("int")).alias(f"{i}_rate") for i, c in enumerate(columns)
    ])
    return wide.select(*by, F.inline(long_rows(columns, {
        c: {"missing_rate": F.col(f"{i}_rate")} for i, c in enumerate(columns)
    })))


def model_value(df: DataFrame, column: str) -> Column:
    """A numeric or datetime column as the double the correlation works on."""
    data_type = df.schema[column].dataType
    if kinds(df)[column] in (DATETIME, STRING):
        return epoch_seconds(F.col(column), data_type)
    return F.col(column).cast("double")


def fit_spread(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(by..., column, mean, std, low, high)`` of numeric columns and of datetimes in epoch seconds."""
    by = by or []
    df = missing_as_null(df)
    is_date = {c: kinds(df)[c] in (DATETIME, STRING) for c in columns}
    values = df.select(*by, *[model_value(df, c).alias(c) for c in columns])
    found = numeric_moments(values, columns, by)
    dated = F.col("column").isin([c for c in columns if is_date[c]])
    floor = F.when(dated, F.lit(MIN_DATETIME_STD)).otherwise(F.lit(MIN_NUMERIC_STD))
    return found.select(
        *by, "column",
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.when(F.col("std") > 0, F.col("std")).otherwise(floor).alias("std"),
        F.coalesce("min", F.lit(0.0)).alias("low"),
        F.coalesce(F.col("max"), F.when(dated, F.lit(0.0)).otherwise(F.lit(1.0))).alias("high"),
    )


def truth(df: DataFrame, column: str) -> Column:
    """The boolean reading of a two-valued column, null where missing."""
    kind = kinds(df)[column]
    if kind == BOOLEAN:
        return F.col(column)
    if kind == STRING:
        return F.lower(column).isin(TRUE_WORDS)
    return F.col(column) == 1


def fit_boolean(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(by..., column, p_true)``; one half where nothing is known."""
    by = by or []
    df = missing_as_null(df)
    wide = df.groupBy(*by).agg(*[
        F.coalesce(F.avg(truth(df, c).cast("int")), F.lit(0.5)).alias(f"{i}_p") for i, c in enumerate(columns)
    ])
    return wide.select(*by, F.inline(long_rows(columns, {
        c: {"p_true": F.col(f"{i}_p")} for i, c in enumerate(columns)
    })))


def fit_constant(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(by..., column, constant)``: the one value as text; null when the column is all null."""
    by = by or []
    wide = missing_as_null(df).groupBy(*by).agg(*[
        F.min(F.col(c).cast("string")).alias(f"{i}_v") for i, c in enumerate(columns)
    ])
    return wide.select(*by, F.inline(long_rows(columns, {
        c: {"constant": F.col(f"{i}_v")} for i, c in enumerate(columns)
    })))


def fit_categorical(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(by..., column, category, p)``: frequencies of all non-null levels, adding up to one."""
    by = by or []
    counts = value_counts(missing_as_null(df), columns, by)
    totals = counts.groupBy(*by, "column").agg(F.sum("n").alias("total"))
    return counts.join(totals, [*by, "column"]).select(
        *by, "column", F.col("value").alias("category"), (F.col("n") / F.col("total")).alias("p")
    )


def text_pool(df: DataFrame, column: str, order_by: list[str] | None = None, size: int | None = TEXT_POOL) -> DataFrame:
    """``(place, value)``: the distinct texts by their first row, verbatim, numbered from 1.

    ``size`` keeps the first ones only, a distributed top-k; None keeps all.  The pool releases real strings.
    """
    keys = [F.col(c) for c in order_by] if order_by else [row_digest(df)]
    rows = df.where(F.col(column).isNotNull()).select(F.struct(*keys).alias("row_order"), F.col(column).alias("value"))
    first = rows.groupBy("value").agg(F.min("row_order").alias("row_order"))
    if size is None:
        return numbered(first, ["row_order", "value"]).select("place", "value")
    ordered = F.array_sort(F.collect_list(F.struct("row_order", "value")))
    # at most ``size`` rows reach this aggregate
    return first.orderBy("row_order", "value").limit(size).agg(ordered.alias("items")).select(F.posexplode("items")).select(
        (F.col("pos") + 1).alias("place"), F.col("col")["value"].alias("value")
    )


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``place``, its number from 1 in ``order``: sorted by ranges, then each range's rows are
    counted and numbered on from the ranges before.  No task sees more than its range."""
    inside = (1 << 33) - 1  # monotonic ids are a partition's number, then 33 bits within it
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sizes.select("_part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_offset"))
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn(
        "place", F.col("_offset") + F.col("_row").bitwiseAND(F.lit(inside)) + 1).drop("_part", "_row", "_offset")


def clock_columns(df: DataFrame, columns: list[str], order_by: list[str] | None = None) -> dict[str, bool]:
    """Whether string dates keep their clock time: if the first value in the stated order has one; without an order, if any has."""
    if not columns:
        return {}
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order_by, c))) if order_by else F.max(F.when(F.contains(c, F.lit(" ")), F.col(c)))
    return df.agg(*[F.coalesce(F.contains(first(c), F.lit(" ")), F.lit(False)).alias(c) for c in columns]).first().asDict()


def text_frequencies(df: DataFrame, column: str, size: int = TEXT_FREQUENCIES) -> DataFrame:
    """``(category, p)`` of the most common texts, ties by text."""
    counts = value_counts(df, [column])
    total = df.agg(F.count(column).alias("total"))
    return with_row(counts.orderBy(F.desc("n"), "value").limit(size), total).select(
        F.col("value").alias("category"), (F.col("n") / F.col("total")).alias("p")
    )


def fit_correlation(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(by..., col_i, col_j, r)`` over numeric columns and datetimes in seconds; undefined is 0."""
    by = by or []
    df = missing_as_null(df)
    values = df.select(*by, *[model_value(df, c).alias(c) for c in columns])
    return correlations(values, columns, by).withColumn("r", F.coalesce("r", F.lit(0.0)))


def fit(
    df: DataFrame, order_by: list[str] | None = None, keep: tuple[str, ...] = (),
    known_kinds: dict[str, str] | None = None, pool_size: int | None = None, sampled: bool = False,
) -> Model:
    """Fit every column of ``df``.  Only parameters, one row per column or pair, reach the driver.

    Text columns are drawn from all their real strings; ``pool_size`` keeps the first ones only (published: TEXT_POOL).
    ``sampled`` decides kinds on the published number of first values.
    """
    df = missing_as_null(df)
    spark = df.sparkSession
    found = known_kinds or column_kinds(df, order_by, keep, sampled)
    names = df.columns
    of = lambda *ks: [c for c in names if found[c] in ks]
    types = {f.name: f.dataType for f in df.schema.fields}
    params = {
        c: {
            "column": c, "position": i, "kind": found[c], "data_type": types[c].simpleString(),
            "is_integer": isinstance(types[c], T.IntegralType), "with_time": False,
        }
        for i, c in enumerate(names)
    }

    def take(rows: DataFrame) -> None:
        for row in rows.collect():
            params[row["column"]].update(row.asDict())

    take(missing_rates(df))
    rows = df.count()
    for p in params.values():
        p["rows"] = rows
    spread = of("numeric", "datetime")
    if spread:
        take(fit_spread(df, spread))
    if of("boolean"):
        take(fit_boolean(df, of("boolean")))
    if of("constant"):
        take(fit_constant(df, of("constant")))
    stamped = [c for c in of("datetime") if isinstance(types[c], T.StringType)]
    for c, timed in clock_columns(df, stamped, order_by).items():
        params[c]["with_time"] = timed
    corr = {}
    if len(spread) > 1:
        corr = {(r["col_i"], r["col_j"]): r["r"] for r in fit_correlation(df, spread).collect()}
    pools = {c: text_pool(df, c, order_by, pool_size) for c in of("text")}
    probs = fit_categorical(df, of("categorical")) if of("categorical") else None
    return Model([params[c] for c in names], probs, pools, corr)

