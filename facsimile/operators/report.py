"""The quality report: pillars, weighted fidelity score, readiness verdict and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators.columns import with_row
from facsimile.operators.grades import grade

# Pillar weights, readiness limits, verdicts
PILLAR_WEIGHTS = {"structural": 0.25, "statistical": 0.35, "relationship": 0.20, "ml_utility": 0.20}
MIN_FIDELITY = 65.0
MIN_PROTECTION = 60.0
VERDICTS = {
    (True, True): "Deployment Ready: Satisfies standard fidelity and privacy criteria.",
    (True, False): "Privacy Review Required: Fidelity is adequate, but privacy guarantees or collision risks"
                   " require adjustment.",
    (False, True): "Fidelity Review Required: Privacy is protected, but statistical or ML utility is degraded.",
    (False, False): "Revision Required: Both fidelity and privacy protection fall below standard deployment thresholds.",
}


def pillar_weight(pillar: str = "pillar"):
    weight = F.lit(0.0)
    for name, value in PILLAR_WEIGHTS.items():
        weight = F.when(F.col(pillar) == name, F.lit(value)).otherwise(weight)
    return weight


def fidelity_score(pillars: DataFrame) -> DataFrame:
    """One row from ``(pillar, score, applicable)``: weighted score over applicable pillars and its grade."""
    used = F.col("applicable") & F.col("score").isNotNull()
    weight = F.when(used, pillar_weight())
    total = pillars.agg(
        F.round(F.coalesce(F.try_divide(F.sum(weight * F.col("score")), F.sum(weight)), F.lit(0.0)), 2)
        .alias("data_fidelity_score"),
        F.array_sort(F.collect_list(F.when(used, F.col("pillar")))).alias("applicable_pillars"),
    )
    return total.withColumn("data_fidelity_grade", grade(F.col("data_fidelity_score")))


def verdict(fidelity, protection, collisions):
    """Which of the four outcomes the two dimensions give."""
    good = fidelity >= MIN_FIDELITY
    safe = (protection >= MIN_PROTECTION) & (collisions == 0)
    return (
        F.when(good & safe, F.lit(VERDICTS[True, True]))
        .when(good, F.lit(VERDICTS[True, False]))
        .when(safe, F.lit(VERDICTS[False, True]))
        .otherwise(F.lit(VERDICTS[False, False]))
    )


def executive_summary(pillars: DataFrame, privacy: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row: fidelity and privacy scores side by side, verdict and number of warnings."""
    joined = with_row(with_row(fidelity_score(pillars), privacy), warnings.agg(F.count(F.lit(1)).alias("warnings_count")))
    return joined.select(
        "data_fidelity_score", "data_fidelity_grade", "privacy_protection_score",
        grade(F.col("privacy_protection_score")).alias("privacy_protection_grade"),
        "raw_privacy_risk_score", F.col("risk_level").alias("privacy_risk_level"),
        verdict(F.col("data_fidelity_score"), F.col("privacy_protection_score"), F.col("exact_count")).alias("trust_verdict"),
        "applicable_pillars", "warnings_count",
    )


def metric_rows(pillar: str, row: DataFrame) -> DataFrame:
    """A one-row result as ``(pillar, metric, value)`` rows, values as text."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns
    ])
    return row.select(F.lit(pillar).alias("pillar"), F.inline(cells))


def as_json(rows: DataFrame) -> DataFrame:
    """``(pillar, report)``: one JSON document per pillar of ``metric_rows``; a handful of cells each."""
    return rows.groupBy("pillar").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))).alias("report")
    )
