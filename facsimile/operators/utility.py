"""ML utility: models trained on synthetic rows against models trained on real rows, both tested on real ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators.classifiers import (
    assembled, class_list, evaluate, label_index, predictions, top_importances, train,
)
from facsimile.operators.columns import common_columns, tagged_union
from facsimile.operators.encode import encode_table
from facsimile.operators.freq import row_digest
from facsimile.operators.grades import grade_of
from facsimile.operators.split import split
from facsimile.session import cut_lineage, local_rows

# Share of real rows held out, gap metrics, warning limit
TEST_FRACTION = 0.2
GAPS = {
    "accuracy_gap": "accuracy", "f1_gap": "f1_score", "auc_gap": "roc_auc",
    "precision_gap": "precision", "recall_gap": "recall",
}
GAP_WARNING = 0.15
MODELS = ("RandomForest", "GradientBoosting")


def prepared(real: DataFrame, synth: DataFrame, target: str, key: list[str] | None = None):
    """Encoded vectors of both tables: ``(side, is_test, label, features)``, the feature names and classes.

    One dictionary per string column covers both tables.  Without a key, equal rows fall on the same
    side of the split.
    """
    columns = common_columns(real, synth)
    key = [k for k in (key or []) if k in real.columns]
    marked = split(
        real.withColumn("_key", F.concat_ws("|", *key) if key else row_digest(real).cast("string")),
        ["_key"], TEST_FRACTION, target,
    ).drop("_key")
    both = tagged_union(
        marked.select(*columns, "is_test"), synth.select(*columns).withColumn("is_test", F.lit(False)),
        [*columns, "is_test"],
    )
    features = [c for c in columns if c != target and c not in key]
    classes = class_list(both, target)
    coded = encode_table(
        both.withColumn("label", label_index(target, classes)), features, ["side", "is_test", "label"], "median"
    )
    rows = assembled(coded, features).select("side", "is_test", "label", "features")
    return cut_lineage(rows), features, classes


def ml_utility(
    real: DataFrame, synth: DataFrame, target: str, key: list[str] | None = None,
    models: tuple[str, ...] = MODELS, settings: dict[str, dict] | None = None,
) -> DataFrame:
    """``(model, regime, metric, value)``: scores of TRTR and TSTR, importances, gaps and the utility score.

    Utility and gaps compare the random forests only, as published.
    """
    rows, features, classes = prepared(real, synth, target, key)
    test = rows.where("is_test").select("label", "features")
    sources = {
        "trtr": rows.where((F.col("side") == "real") & ~F.col("is_test")).select("label", "features"),
        "tstr": rows.where(F.col("side") == "synth").select("label", "features"),
    }
    found: list[tuple[str, str, str, float | None]] = []
    scores: dict[tuple[str, str], dict] = {}
    for name in models:
        for regime, source in sources.items():
            fitted = train(source, name, len(classes), (settings or {}).get(name))
            # written once: several scores read the predictions
            scored = cut_lineage(predictions(fitted, test))
            scores[name, regime] = evaluate(scored, len(classes))
            found += [(name, regime, m, v) for m, v in scores[name, regime].items()]
            found += [(name, regime, f"importance:{f}", w) for f, w in top_importances(fitted, features)]
    if "RandomForest" in models:
        gaps = {}
        for gap, metric in GAPS.items():
            a, b = (scores["RandomForest", r][metric] for r in ("trtr", "tstr"))
            gaps[gap] = round(abs(a - b), 4) if a is not None and b is not None else None
        known = [v for v in gaps.values() if v is not None]
        mean_gap = sum(known) / len(known) if known else 0.5
        utility = round(max(0.0, 100 * (1 - mean_gap * 2)), 2)
        found += [("RandomForest", "gap", g, v) for g, v in gaps.items()]
        found.append(("RandomForest", "gap", "utility_score", utility))
    found.append(("all", "data", "target_classes", float(len(classes))))
    return local_rows(
        real.sparkSession, [(m, r, k, None if v is None else float(v)) for m, r, k, v in found],
        "model string, regime string, metric string, value double",
    )


def utility_pillar(
    real: DataFrame, synth: DataFrame, target: str | None, key: list[str] | None = None,
    report: DataFrame | None = None, **options,
) -> DataFrame:
    """One row: applicable, score, grade, status, gaps and the reason when not applicable.

    The score rests on the random forests, so only they are trained unless ``models`` says otherwise.
    """
    schema = (
        "applicable boolean, score double, grade string, status string, reason string, accuracy_gap double,"
        " f1_gap double, auc_gap double, precision_gap double, recall_gap double"
    )
    spark = real.sparkSession
    reason = None
    if not target or target not in real.columns or target not in synth.columns:
        reason = "No valid target column found for ML evaluation."
    elif real.where(F.col(target).isNotNull()).select(target).distinct().limit(2).count() < 2:
        reason = f"Target column '{target}' has fewer than 2 unique classes."
    if reason:
        return local_rows(spark, [(False, None, "N/A", "not_applicable", reason, *[None] * 5)], schema)
    options = {"models": MODELS[:1], **options}
    report = report if report is not None else ml_utility(real, synth, target, key, **options)
    values = {r["metric"]: r["value"] for r in report.where(F.col("regime") == "gap").collect()}
    score = values["utility_score"]
    status = "passed" if score >= 75 else "warning" if score >= 50 else "failed"
    return local_rows(
        spark, [(True, score, grade_of(score), status, None, *[values[g] for g in GAPS])], schema
    )


def utility_warnings(pillar: DataFrame) -> DataFrame:
    """``(pillar, message)``: large gaps, or why the pillar does not apply."""
    # The wording of the messages below
    tag = F.lit("ml_utility").alias("pillar")
    gap = lambda column, name: pillar.where(F.col(column) > GAP_WARNING).select(tag, F.format_string(
        f"Large {name} gap between TRTR and TSTR (%.4f).", F.col(column)).alias("message"))
    idle = pillar.where(~F.col("applicable")).select(tag, F.col("reason").alias("message"))
    return gap("accuracy_gap", "accuracy").unionByName(gap("f1_gap", "F1")).unionByName(idle)
