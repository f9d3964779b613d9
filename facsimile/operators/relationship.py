"""Relationship fidelity: how well a synthetic table keeps the associations between columns."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators.association import correlation_ratio, cramers_v, spearman
from facsimile.operators.columns import (
    BOOLEAN, FLOAT, INTEGER, common_columns, kinds, numeric_columns, string_columns, tagged_union,
)
from facsimile.operators.grades import at_least_zero, status
from facsimile.operators.moments import correlation_cells, correlations
from facsimile.session import local_rows

# Score slope, warning limits
SLOPE = 150.0
LIMITS = {"pearson_mae": 0.25, "cramers_v_mae": 0.3}


def side_by_side(cells: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``(keys..., real_value, synth_value, delta)`` from one value per side."""
    at = lambda side: F.max(F.when(F.col("side") == side, F.col(value)))
    both = cells.groupBy(*keys).agg(at("real").alias("real_value"), at("synth").alias("synth_value"))
    return both.withColumn("delta", F.abs(F.col("real_value") - F.col("synth_value")))


def pearson_delta(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """All k x k cells of both Pearson matrices; undefined cells are 0."""
    both = tagged_union(real, synth, columns)
    return side_by_side(correlation_cells(both, columns, ["side"]), "r", ["col_i", "col_j"])


def spearman_delta(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """All k x k cells of both rank-correlation matrices; undefined cells are 0."""
    both = tagged_union(real, synth, columns)
    cells = correlation_cells(both, columns, ["side"], spearman(both, columns, ["side"]))
    return side_by_side(cells, "r", ["col_i", "col_j"])


def association_columns(real: DataFrame, columns: list[str], limit: int | None = None) -> list[str]:
    """Text columns with more than one level; the first ``limit`` by name when there are more."""
    texts = [c for c in string_columns(real) if c in columns]
    if not texts:
        return []
    spread = real.agg(*[(F.min(c) != F.max(c)).alias(c) for c in texts]).first()
    valid = [c for c in texts if spread[c]]
    return sorted(valid)[:limit] if limit and len(valid) > limit else valid


def cramers_delta(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Upper triangle of both Cramér's V matrices."""
    both = tagged_union(real, synth, columns)
    found = cramers_v(both, list(combinations(columns, 2)), ["side"])
    return side_by_side(found, "v", ["col_i", "col_j"])


def target_delta(real: DataFrame, synth: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """``(column, method, real_value, synth_value, delta)``: association of each column with the target."""
    columns = columns or common_columns(real, synth)
    both = tagged_union(real, synth, columns)
    by_kind = kinds(real.select(*columns))
    numeric = lambda c: by_kind[c] in (INTEGER, FLOAT, BOOLEAN)
    features = [c for c in columns if c != target]
    numbers = [c for c in features if numeric(c)]
    texts = [c for c in features if not numeric(c)]
    parts = []

    def add(found: DataFrame, feature: str, method: str, value: str) -> None:
        cells = found.select("side", F.col(feature).alias("column"), F.lit(method).alias("method"), F.col(value).alias("value"))
        parts.append(cells)

    if numeric(target):
        plain = both.select("side", *[F.col(c).cast("double").alias(c) for c in [target, *numbers]])
        if numbers:
            pairs = [(target, c) for c in numbers]
            add(correlations(plain, [target, *numbers], ["side"], pairs), "col_j", "pearson", "r")
        if texts:
            add(correlation_ratio(both, [(c, target) for c in texts], ["side"]), "col_i", "eta", "eta")
    else:
        if texts:
            add(cramers_v(both, [(target, c) for c in texts], ["side"]), "col_j", "cramers_v", "v")
        if numbers:
            add(correlation_ratio(both, [(target, c) for c in numbers], ["side"]), "col_j", "eta", "eta")
    cells = reduce(DataFrame.unionByName, parts)
    # a pair that is undefined on either side is left out of the mean
    return side_by_side(cells, "value", ["column", "method"]).where(F.col("delta").isNotNull())


def relationship_fidelity(
    real: DataFrame, synth: DataFrame, target: str | None = None, limit: int | None = None,
) -> DataFrame:
    """One row: score over the applicable checks, status and one error per check."""
    columns = common_columns(real, synth)
    numbers = [c for c in numeric_columns(real) if c in columns]
    valid = association_columns(real, columns, limit)
    checks: list[tuple[str, DataFrame]] = []
    if len(numbers) >= 2:
        checks.append(("pearson_mae", pearson_delta(real, synth, numbers)))
        checks.append(("spearman_mae", spearman_delta(real, synth, numbers)))
    if len(valid) >= 2:
        checks.append(("cramers_v_mae", cramers_delta(real, synth, valid)))
    if target and target in columns and len(columns) > 1:
        checks.append(("target_association_mae", target_delta(real, synth, target, columns)))
    names = ["pearson_mae", "spearman_mae", "cramers_v_mae", "target_association_mae"]
    empty = local_rows(real.sparkSession, [], "check string, mae double")
    rows = reduce(DataFrame.unionByName, [
        delta.agg(F.avg("delta").alias("mae")).select(F.lit(name).alias("check"), "mae") for name, delta in checks
    ], empty)
    total = rows.agg(
        F.avg(at_least_zero(100.0 - F.col("mae") * SLOPE)).alias("raw_score"),
        *[F.round(F.max(F.when(F.col("check") == n, F.col("mae"))), 4).alias(n) for n in names],
    )
    score = F.coalesce(F.round("raw_score", 2), F.lit(100.0))
    return total.select(
        score.alias("score"), status(score).alias("status"), F.col("raw_score").isNotNull().alias("applicable"), *names
    )


def relationship_warnings(fidelity: DataFrame) -> DataFrame:
    """``(pillar, message)`` for elevated errors."""
    # The wording of the messages below
    texts = {
        "pearson_mae": "Numeric Pearson correlation MAE is elevated (%.3f).",
        "cramers_v_mae": "Categorical association (Cramér's V) MAE is elevated (%.3f).",
    }
    return reduce(DataFrame.unionByName, [
        fidelity.where(F.col(c) > limit).select(
            F.lit("relationship").alias("pillar"), F.format_string(texts[c], F.col(c)).alias("message")
        )
        for c, limit in LIMITS.items()
    ])
