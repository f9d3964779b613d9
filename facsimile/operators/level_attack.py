"""Attribute inference without a list of classes: what single levels of the other columns give away.

An attacker counts, in the synthetic table, which class goes with each level of each other column, and believes
for a real row the level that is surest of its class.  Counts are long tables, so a target may have as many classes
as there are rows; nothing but the two figures of the result reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators.encode import text_level
from facsimile.operators.freq import row_digest
from facsimile.session import cut_lineage


def best_levels(synth: DataFrame, target: str, features: list[str]) -> DataFrame:
    """``(feature, level, guess, share, support)``: the most common class of each level, ties to the first in text order."""
    cells = synth.select(text_level(target).alias("guess"), *[text_level(c).alias(c) for c in features]).unpivot("guess", features, "feature", "level")
    counts = cells.groupBy("feature", "level", "guess").agg(F.count(F.lit(1)).alias("n"))
    # one row for each level of a column, whatever the number of classes: the surest class by a map-side minimum
    best = counts.groupBy("feature", "level").agg(F.sum("n").alias("support"), F.min(F.struct((-F.col("n")).alias("less"), "guess")).alias("top"))
    return best.select("feature", "level", F.col("top.guess").alias("guess"), (-F.col("top.less") / F.col("support")).alias("share"), "support")


def guesses(rows: DataFrame, synth: DataFrame, target: str, features: list[str]) -> DataFrame:
    """``rows`` grouped by class and features, ``(class, n, guess)``; a row without a known level gets the most common class of all.

    Of several levels the one with the largest share wins, then the largest support, then the first feature.
    """
    # written before it is joined: a level that most rows have is then split over tasks, or the table broadcast by its size
    known = cut_lineage(best_levels(synth, target, features))
    common = synth.groupBy(text_level(target).alias("class")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "class").limit(1)
    levels = rows.select(text_level(target).alias("class"), *[text_level(c).alias(c) for c in features])
    counted = levels.withColumn("id", row_digest(levels, features)).groupBy("class", "id", *features).agg(F.count(F.lit(1)).alias("n"))
    # rows alike in all features get the same guess: each such group asks once
    asked = counted.select("id", *features).distinct().unpivot("id", features, "feature", "level")
    place = F.array_position(F.array(*map(F.lit, features)), F.col("feature"))
    best = asked.join(known, ["feature", "level"]).groupBy("id").agg(
        F.max(F.struct("share", "support", (-place).alias("first"), "guess")).alias("top"))
    told = counted.select("class", "id", "n").join(best.select("id", F.col("top.guess").alias("guess")), "id", "left")
    return told.join(common.select(F.col("class").alias("usual")), F.lit(True), "left").select(
        "class", "n", F.coalesce("guess", "usual").alias("guess"))


def level_attack(real: DataFrame, synth: DataFrame, target: str, features: list[str]) -> DataFrame:
    """One row ``(accuracy, baseline_accuracy, advantage, n_classes)``.

    The baseline always guesses the most common class of the real rows.  Without other columns every
    guess is the most common synthetic class.  An empty real table has no accuracy.
    """
    if features:
        told = guesses(real, synth, target, features)
    else:
        usual = synth.groupBy(text_level(target).alias("guess")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), "guess").limit(1)
        told = real.groupBy(text_level(target).alias("class")).agg(F.count(F.lit(1)).alias("n")).join(usual.select("guess"), F.lit(True), "left")
    scored = told.agg(F.sum(F.when(F.col("class") == F.col("guess"), F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("total"))
    classes = real.groupBy(text_level(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    usual = classes.agg(F.max("n").alias("most"))
    both = classes.select("class").union(synth.select(text_level(target))).distinct().agg(F.count(F.lit(1)).alias("n_classes"))
    accuracy = F.round(F.col("hits") / F.col("total"), 4)
    baseline = F.round(F.col("most") / F.col("total"), 4)
    joined = scored.join(usual, F.lit(True)).join(both, F.lit(True))  # three tables of one row
    return joined.select(
        accuracy.alias("accuracy"), baseline.alias("baseline_accuracy"),
        F.round(F.greatest(F.lit(0.0), accuracy - baseline), 4).alias("advantage"), "n_classes")
