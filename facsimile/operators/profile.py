"""Table and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.operators import roles
from facsimile.operators.columns import missing_as_null, numeric_columns, with_row
from facsimile.operators.facts import collect_facts, first_values
from facsimile.operators.freq import duplicate_counts, value_counts
from facsimile.operators.moments import numeric_moments
from facsimile.operators.quantiles import quantiles
from facsimile.session import local_rows

SAMPLE_VALUES = 5
TOP_CATEGORIES = 10


def percent(part, whole):
    return F.round(F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0)), 2)


def memory_bytes(df: DataFrame):
    """Aggregate: fixed widths plus text bytes; an estimate, not comparable across engines."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    fixed = sum(1 if isinstance(f.dataType, T.BooleanType) else 8 for f in df.schema.fields if f.name not in text)
    total = F.count(F.lit(1)) * F.lit(fixed)
    for name in text:
        total = total + F.coalesce(F.sum(F.octet_length(name)), F.lit(0))
    return total


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows, memory estimate."""
    df = missing_as_null(df)
    width = len(df.columns)
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    cells = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        missing.alias("missing_count"),
        memory_bytes(df).alias("memory_usage_bytes"),
    )
    repeats = duplicate_counts(df).select("duplicate_count")
    return with_row(cells, repeats).select(
        "row_count",
        F.lit(width).alias("column_count"),
        "missing_count",
        percent(F.col("missing_count"), F.col("row_count") * F.lit(width)).alias("missing_percentage"),
        "duplicate_count",
        percent(F.col("duplicate_count"), F.col("row_count")).alias("duplicate_percentage"),
        "memory_usage_bytes",
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """``(column, missing_count, missing_percentage, nullable)`` per column."""
    df = missing_as_null(df)
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{i}_missing") for i, c in enumerate(df.columns)],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{i}_missing").alias("missing_count"))
        for i, c in enumerate(df.columns)
    ])
    return wide.select("rows", F.inline(rows)).select(
        "column", "missing_count",
        percent(F.col("missing_count"), F.col("rows")).alias("missing_percentage"),
        (F.col("missing_count") > 0).alias("nullable"),
    )


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, min, max, mean, median, std, q25, q75)``, four decimals."""
    df = missing_as_null(df)
    spread = quantiles(df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    joined = numeric_moments(df, columns).join(spread, "column", "left")
    fields = ["min", "max", "mean", "median", "std", "q25", "q75"]
    return joined.select("column", *[F.round(f, 4).alias(f) for f in fields])


def top_categories(df: DataFrame, columns: list[str], top_n: int = TOP_CATEGORIES) -> DataFrame:
    """``(column, place, value, count, percentage, num_categories)``; ties by value."""
    df = missing_as_null(df)
    counts = value_counts(df, columns)
    totals = counts.groupBy("column").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("num_categories")
    )
    numbers = F.when(F.col("column").isin(numeric_columns(df)), F.col("value").try_cast("double"))
    window = Window.partitionBy("column").orderBy(F.desc("n"), numbers, "value")
    # the place filter is pushed below the shuffle, so a column with many values sends few of them
    top = counts.withColumn("place", F.row_number().over(window)).where(F.col("place") <= top_n)
    return top.join(totals, "column").select(
        "column", "place", "value", F.col("n").alias("count"),
        percent(F.col("n"), F.col("total")).alias("percentage"), "num_categories",
    )


def sample_values(df: DataFrame, columns: list[str], order_by: list[str] | None = None) -> DataFrame:
    """``(column, place, value)``: the first five non-null values per column in a stated order."""
    return first_values(missing_as_null(df), columns, SAMPLE_VALUES, order_by)


def column_profile(df: DataFrame, order_by: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The full profile, one row per column, with nested numeric and categorical parts."""
    df = missing_as_null(df)
    facts = collect_facts(df, order_by)
    ids = set(roles.identifier_columns(facts, keep))
    target, sensitive = roles.target_column(facts), roles.sensitive_columns(facts)
    typed = {f.column: roles.semantic_type(f, f.column in ids) for f in facts}
    base = local_rows(
        df.sparkSession,
        [
            (
                f.position, f.column, f.dtype, typed[f.column], f.rows - f.non_null, f.n_unique, f.rows,
                f.column in ids, f.column == target, f.column in sensitive,
            )
            for f in facts
        ],
        "position int, column string, dtype string, semantic_type string, missing_count long,"
        " unique_count long, rows long, identifier boolean, target_candidate boolean,"
        " sensitive_candidate boolean",
    ).select(
        "position", "column", "dtype", "semantic_type", (F.col("missing_count") > 0).alias("nullable"),
        "missing_count", percent(F.col("missing_count"), F.col("rows")).alias("missing_percentage"),
        "unique_count", percent(F.col("unique_count"), F.col("rows")).alias("unique_percentage"),
        "identifier", "target_candidate", "sensitive_candidate",
    )
    samples = sample_values(df, df.columns, order_by).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"])
        .alias("sample_values")
    )
    result = base.join(samples, "column", "left")
    numeric = [c for c, t in typed.items() if t == "numeric"]
    if numeric:
        stats = numeric_stats(df, numeric)
        stats = stats.select("column", F.struct(*stats.columns[1:]).alias("numeric_stats"))
        result = result.join(stats, "column", "left")
    categorical = [c for c, t in typed.items() if t in ("categorical", "boolean", "constant")]
    if categorical:
        entry = F.struct("place", "value", "count", "percentage")
        tops = top_categories(df, categorical).groupBy("column").agg(
            F.first("num_categories").alias("num_categories"),
            F.array_sort(F.collect_list(entry)).alias("top_categories"),
        )
        result = result.join(tops, "column", "left")
    return result


def ingest_stats(df: DataFrame, column_types: dict[str, str]) -> DataFrame:
    """Summary at ingest: moments of numerical columns, most common value of categorical ones."""
    df = missing_as_null(df)
    blank = {c: F.lit(None).cast(t) for c, t in (
        ("mean", "double"), ("std", "double"), ("min", "double"), ("max", "double"),
        ("unique", "long"), ("top", "string"),
    )}
    parts = []
    numerical = [c for c, t in column_types.items() if t == "numerical" and c in df.columns]
    if numerical:
        parts.append(numeric_moments(df, numerical).select(
            "column", F.lit("numerical").alias("type"),
            *[F.round(f, 2).alias(f) for f in ("mean", "std", "min", "max")],
            blank["unique"].alias("unique"), blank["top"].alias("top"), F.col("n_missing").alias("missing"),
        ))
    categorical = [c for c, t in column_types.items() if t == "categorical" and c in df.columns]
    if categorical:
        tops = top_categories(df, categorical, 1).select(
            "column", F.col("num_categories").alias("unique"), F.col("value").alias("top")
        )
        missing = missing_profile(df.select(*categorical)).select("column", F.col("missing_count").alias("missing"))
        parts.append(missing.join(tops, "column", "left").select(
            "column", F.lit("categorical").alias("type"),
            *[blank[f].alias(f) for f in ("mean", "std", "min", "max")],
            F.coalesce("unique", F.lit(0)).alias("unique"), "top", "missing",
        ))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
