"""Exact quantiles with linear interpolation, read off running totals of distinct values.

The built-in exact percentile merges all distinct values of a column in one task's memory; this
keeps them spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators.freq import numeric_counts
from facsimile.operators.prefix import long_ranges, ordered_totals
from facsimile.session import cut_lineage


def quantiles_of_counts(
    totals: DataFrame, probabilities: dict[str, float], by: list[str] | None = None,
) -> DataFrame:
    """One row per column from ``ordered_totals`` over measure ``n``; one field per probability."""
    keys = [*(by or []), "column"]
    before, after = F.col("n_before"), F.col("n_before") + F.col("n")

    def at(position):
        return F.max(F.when((before <= position) & (position < after), F.col("value")))

    picked = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("n_total") - 1)
        picked += [
            at(F.floor(place)).alias(f"{name}_low"),
            at(F.ceil(place)).alias(f"{name}_high"),
            F.max(place - F.floor(place)).alias(f"{name}_part"),
        ]
    grouped = totals.groupBy(*keys).agg(*picked)
    return grouped.select(*keys, *[
        (F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n)
        for n in probabilities
    ])


def quantiles(df: DataFrame, columns: list[str], probabilities: dict[str, float]) -> DataFrame:
    """``(column, <name>...)`` for numeric columns of ``df``."""
    # read for the cuts, the sums of the ranges and within them
    counts = cut_lineage(numeric_counts(df, columns))
    totals = ordered_totals(counts, long_ranges(counts), ["n"])
    return quantiles_of_counts(totals, probabilities)
