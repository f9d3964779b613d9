"""Running sums over an ordered table without an ordered single-task window.

The order is cut into ranges by a rule that depends on the value alone, the ranges are summed, and
each row gets the sum of the ranges before it plus a running sum inside its own range.  The rule is
a fixed list of boundaries (or a hash), never a partition number, so a retried task finds every row
in the same range.  Callers aggregate to distinct values first: a value that fills a third of the
table is one row here.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.session import shuffle_width

# characters of a text that a cut of the text order keeps
SORT_KEY = 48


def running_totals(
    frame: DataFrame, groups: list[str], bucket: Column, order: list[str], measures: list[str],
) -> DataFrame:
    """Add ``<m>_before`` and ``<m>_total`` for each measure, within ``groups`` in (bucket, order).

    ``bucket`` must be monotone in the order, or be the leading part of it.
    """
    frame = frame.withColumn("bucket", bucket)
    keys = [*groups, "bucket"]
    block = frame.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = block.select(
        *keys,
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"{m}_offset") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = frame.select("*", *[F.sum(m).over(inside).alias(f"{m}_inside") for m in measures])
    joined = running.join(offsets, keys)
    for m in measures:
        joined = joined.withColumn(
            f"{m}_before", F.col(f"{m}_offset") + F.col(f"{m}_inside") - F.col(m)
        ).drop(f"{m}_offset", f"{m}_inside")
    return joined.drop("bucket")


def _merged(cuts: dict[str, list[float] | None]) -> list[float]:
    return sorted({float(v) + 0.0 for values in cuts.values() for v in values or []})


def _steps(spark, columns: int) -> list[float]:
    # ranges per column, so that all columns together fill the cluster's shuffle width
    ranges = max(2, -(-shuffle_width(spark) // max(1, columns)))
    return [i / ranges for i in range(1, ranges)]


def value_ranges(df: DataFrame, columns: list[str], with_nulls: bool = False):
    """Sorted cut points of numeric columns, merged: between two cuts no column holds more than its share of rows.

    One scan with mergeable quantile sketches.  The list is fixed on the driver, so that every later
    use sees the same cuts.  Cuts steer balance only: any list gives the same running sums.
    ``with_nulls`` adds the number of nulls of each column, counted in the same scan.
    """
    steps = _steps(df.sparkSession, len(columns))
    cuts = [F.percentile_approx(F.col(c).cast("double"), steps, max(100, 4 * len(steps))) for c in columns]
    nulls = [F.count_if(F.col(c).isNull()) for c in columns] if with_nulls else []
    found = list(df.agg(*[m.alias(f"m{i}") for i, m in enumerate([*cuts, *nulls])]).first())
    merged = _merged(dict(zip(columns, found)))
    return (merged, dict(zip(columns, found[len(columns):]))) if with_nulls else merged


def long_ranges(counts: DataFrame) -> list[float]:
    """``value_ranges`` of a long ``(column, value, ...)`` table."""
    steps = _steps(counts.sparkSession, 2)
    cuts = counts.groupBy("column").agg(
        F.percentile_approx("value", steps, max(100, 4 * len(steps))).alias("cuts")
    ).collect()
    return _merged({r["column"]: r["cuts"] for r in cuts})


def text_bounds(levels: DataFrame, name: str) -> list[str]:
    """Sorted short keys that cut the text order of ``levels`` into ranges of similar size.

    They are the first characters of the levels with the smallest digests, so few and short whatever
    the texts are.  Any list gives the same running sums.
    """
    wanted = shuffle_width(levels.sparkSession) - 1
    cuts = levels.orderBy(F.xxhash64(name), name).limit(wanted).select(F.substring(name, 1, SORT_KEY).alias("cut")).collect()
    return sorted({r["cut"] for r in cuts if r["cut"] is not None})


def text_range(value: Column, bounds: list[str]) -> Column:
    """How many of the sorted strings lie below the value, by bisection."""
    listed = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<string>")

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        below = F.get(listed, middle) < value
        open_ = state["low"] < state["high"]
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(open_ & ~below, middle).otherwise(state["high"]).alias("high"),
        )
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))
    return F.coalesce(F.aggregate(steps, start, halve)["low"], F.lit(0))


def ordered_totals(
    counts: DataFrame, ranges: list[float], measures: list[str], by: list[str] | None = None,
) -> DataFrame:
    """Running totals of ``(by..., column, value, measures...)`` in value order within each column."""
    splits = [float("-inf"), *ranges, float("inf")]
    placed = Bucketizer(splits=splits, inputCol="value", outputCol="_range", handleInvalid="keep").transform(counts) \
        if ranges else counts.withColumn("_range", F.lit(0.0))
    totals = running_totals(placed, [*(by or []), "column"], F.col("_range").cast("int"), ["value"], measures)
    return totals.drop("_range")
