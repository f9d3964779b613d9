"""Score-to-label rules shared by the pillars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower score bounds of the grades
GRADES = [("A", 90), ("B", 75), ("C", 60), ("D", 40)]


def grade(score: Column) -> Column:
    label = F.lit("F")
    for name, bound in reversed(GRADES):
        label = F.when(score >= bound, F.lit(name)).otherwise(label)
    return label


def status(score: Column, passed: float = 75.0, warning: float = 50.0) -> Column:
    return (
        F.when(score >= passed, F.lit("passed"))
        .when(score >= warning, F.lit("warning"))
        .otherwise(F.lit("failed"))
    )


def level(value: Column, low: float, medium: float, high: float) -> Column:
    return (
        F.when(value <= low, F.lit("low"))
        .when(value <= medium, F.lit("medium"))
        .when(value <= high, F.lit("high"))
        .otherwise(F.lit("critical"))
    )


def at_least_zero(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


def grade_of(score: float) -> str:
    """The grade of a score already on the driver."""
    return next((name for name, bound in GRADES if score >= bound), "F")
