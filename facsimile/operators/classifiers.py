"""Tree classifiers on encoded tables, and their scores, with Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators import softmax
from facsimile.operators.scoring import auc_from_totals, confusion, macro_scores, roc_points, score_totals

# Sizes of the published models
SEED = 42
FOREST = {"numTrees": 100, "maxDepth": 10}
BOOSTING = {"maxIter": 100, "maxDepth": 5}
ATTACK_FOREST = {"numTrees": 100, "maxDepth": 10}
ATTRIBUTE_FOREST = {"numTrees": 50, "maxDepth": 3, "minInstancesPerNode": 10}
TOP_FEATURES = 10
MAX_CLASSES = 1000


class TooManyClasses(ValueError):
    """A label that is no classification target."""


def class_list(df: DataFrame, label: str, most: int = MAX_CLASSES) -> list[str]:
    """Levels of a label as text in order; a label with more than ``most`` raises."""
    text = F.coalesce(F.col(label).cast("string"), F.lit("nan"))
    rows = df.select(text.alias("level")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise TooManyClasses(f"'{label}' has more than {most} classes")
    return sorted(r["level"] for r in rows)


def label_index(label: str, classes: list[str]):
    text = F.coalesce(F.col(label).cast("string"), F.lit("nan"))
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), text) - 1).cast("double")


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over every core: short tables arrive in a task or two, and each level of each tree reads them again."""
    width = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(width, df.rdd.getNumPartitions()))


def train(df: DataFrame, model: str, classes: int, settings: dict | None = None, weight: str | None = None):
    """Fit on ``(features, label)``; a forest may weigh its rows by a column.  Boosting is binary in Spark ML, so more classes go by ``softmax``."""
    df = spread(df)
    if model == "GradientBoosting":
        chosen = settings or BOOSTING
        if classes > 2:
            return softmax.fit(df, classes, chosen.get("maxIter", BOOSTING["maxIter"]), chosen.get("maxDepth", BOOSTING["maxDepth"]), SEED)
        return GBTClassifier(seed=SEED, **chosen).fit(df)
    weights = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(seed=SEED, **weights, **(settings or FOREST)).fit(df)


def predictions(model, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(label, prediction, scores)``: one score per class; ``keep`` columns beside them, of Spark ML's models."""
    found = model.transform(df)
    if isinstance(model, softmax.SoftmaxModel):
        return found.select("label", "prediction", F.col("probability").alias("scores"))
    scores = "probability" if "probability" in found.columns else "rawPrediction"
    return found.select("label", "prediction", vector_to_array(scores).alias("scores"), *keep)


def auc_of(found: DataFrame, classes: int, weight: str | None = None) -> float | None:
    """Exact area under the curve; the unweighted mean of one-against-rest areas for more classes."""
    if classes == 2:
        rows = found.select((F.col("label") == 1.0).alias("hit"), F.col("scores")[1].alias("score"), *([weight] if weight else []))
        return auc_from_totals(score_totals(rows, F.col("hit"), "score", weight=weight)).first()["auc"]
    each = found.select("label", F.posexplode("scores").alias("class", "score"), *([weight] if weight else []))
    totals = score_totals(each, F.col("label") == F.col("class"), "score", ["class"], weight)
    areas = [r["auc"] for r in auc_from_totals(totals, ["class"]).collect()]
    return sum(areas) / len(areas) if areas and None not in areas else None


def evaluate(found: DataFrame, classes: int) -> dict[str, float | None]:
    """Accuracy, macro F1, precision, recall and AUC of a prediction table."""
    scores = macro_scores(confusion(found, "label", "prediction")).first().asDict()
    area = auc_of(found, classes)
    scores["roc_auc"] = round(area, 4) if area is not None else None
    return scores


def roc_curve(found: DataFrame) -> DataFrame:
    """``(position, fpr, tpr)`` of a binary prediction table."""
    rows = found.select((F.col("label") == 1.0).alias("hit"), F.col("scores")[1].alias("score"))
    return roc_points(score_totals(rows, F.col("hit"), "score"))


def top_importances(model, features: list[str]) -> list[tuple[str, float]]:
    """The ten most important features."""
    weights = model.featureImportances.toArray()
    ranked = sorted(zip(features, weights), key=lambda fw: -fw[1])
    return [(f, round(float(w), 4)) for f, w in ranked[:TOP_FEATURES]]
