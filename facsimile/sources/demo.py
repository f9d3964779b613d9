"""The built-in demo table: clipped-normal health features and three correlated outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.functions import rng

# Fixed values: (mean, deviation, low, high) of the measured features, weighted choices, risk rules
MEASURES = {
    "age": (55, 15, 18, 95),
    "blood_pressure_systolic": (130, 20, 80, 200),
    "blood_pressure_diastolic": (82, 12, 50, 130),
    "cholesterol": (200, 40, 100, 400),
    "bmi": (27, 5, 15, 50),
    "glucose": (110, 30, 60, 300),
    "heart_rate": (75, 12, 45, 130),
}
CHOICES = {
    "gender": [("Male", 0.48), ("Female", 0.52)],
    "smoking_status": [("Never", 0.45), ("Former", 0.30), ("Current", 0.25)],
}
RISKS = [
    ("age", 55, 0.3), ("bmi", 30, 0.2), ("cholesterol", 240, 0.15),
    ("blood_pressure_systolic", 140, 0.2), ("glucose", 140, 0.15),
]
SMOKER_RISK = 0.2
OUTCOMES = {"diabetes": (0.15, 0.45), "hypertension": (0.1, 0.5), "heart_disease": (0.2, 0.55)}
COLUMNS = [
    "age", "gender", "blood_pressure_systolic", "blood_pressure_diastolic", "cholesterol", "bmi", "glucose",
    "heart_rate", "smoking_status", "diabetes", "hypertension", "heart_disease",
]


def demo_table(spark: SparkSession, rows: int = 1000, seed: int = 42) -> DataFrame:
    """``rows`` demo records; record i depends on (seed, i) only."""
    df = spark.range(rows)
    for name, (mean, deviation, low, high) in MEASURES.items():
        value = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), mean + deviation * rng.normal(seed, name, "id")))
        df = df.withColumn(name, F.round(value, 1) if name == "bmi" else value.cast("int"))
    for name, options in CHOICES.items():
        df = df.withColumn(name, _choice(rng.uniform(seed, name, "id"), options))
    risk = sum(
        (F.when(F.col(c) > limit, F.lit(weight)).otherwise(F.lit(0.0)) for c, limit, weight in RISKS), F.lit(0.0)
    ) + F.when(F.col("smoking_status") == "Current", F.lit(SMOKER_RISK)).otherwise(F.lit(0.0))
    df = df.withColumn("risk", risk)
    for name, (noise, limit) in OUTCOMES.items():
        ill = F.col("risk") + noise * rng.normal(seed, name, "id") > limit
        if name == "hypertension":
            ill = ill | (F.col("blood_pressure_systolic") > 140)
        df = df.withColumn(name, ill.cast("int"))
    return df.select(*COLUMNS)


def _choice(u: Column, options: list[tuple[str, float]]) -> Column:
    upto, picked = 1.0, F.lit(options[-1][0])
    for (name, _), (_, weight) in zip(reversed(options[:-1]), reversed(options)):
        upto -= weight
        picked = F.when(u < upto, F.lit(name)).otherwise(picked)
    return picked
