"""The quality report of a (real, synthetic) pair: five pillars and one verdict."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators import audit, relationship, report, statistical, structural, utility
from facsimile.operators.columns import missing_as_null
from facsimile.operators.facts import collect_facts
from facsimile.operators.roles import identifier_columns, target_column
from facsimile.session import cut_lineage


@dataclass
class QualityReport:
    """One-row pillar tables, the per-column scores, all warnings and the summary."""

    structural: DataFrame
    statistical: DataFrame
    relationship: DataFrame
    ml_utility: DataFrame
    privacy: DataFrame
    column_scores: DataFrame
    warnings: DataFrame
    summary: DataFrame

    def metrics(self) -> DataFrame:
        """``(pillar, metric, value)`` of all pillars."""
        parts = [report.metric_rows(n, getattr(self, n)) for n in
                 ("structural", "statistical", "relationship", "ml_utility", "privacy")]
        return reduce(DataFrame.unionByName, parts)


def quality_report(
    real: DataFrame, synth: DataFrame, target: str | None = None, order_by: list[str] | None = None,
    key: list[str] | None = None, sample_rows: int | None = None, ignore_ids: bool = False, **utility_options,
) -> QualityReport:
    """Evaluate a synthetic table.

    Column roles are read from the real table and applied to both.  The structural pillar sees the
    undropped tables unless ``ignore_ids``; ``sample_rows`` bounds the audits.
    """
    real, synth = missing_as_null(real), missing_as_null(synth)
    facts = collect_facts(real, order_by)
    ids = identifier_columns(facts)
    target = target or target_column(facts)
    real_part, synth_part = real.drop(*ids), synth.drop(*ids)

    structure = cut_lineage(structural.structural_fidelity(real, synth, tuple(ids) if ignore_ids else ()))
    scores = cut_lineage(statistical.column_scores(real_part, synth_part))
    stats = cut_lineage(statistical.statistical_fidelity(real_part, synth_part, scores=scores))
    relations = cut_lineage(relationship.relationship_fidelity(real_part, synth_part, target))
    ml = utility.utility_pillar(real_part, synth_part, target, key, **utility_options)
    privacy = cut_lineage(audit.privacy_pillar(real, synth, key=key, sample_rows=sample_rows, order_by=order_by))
    warnings = reduce(DataFrame.unionByName, [
        structural.structural_warnings(real, synth),
        statistical.statistical_warnings(scores, stats),
        relationship.relationship_warnings(relations),
        utility.utility_warnings(ml),
        audit.privacy_warnings(privacy),
    ])
    pillar = lambda name, df, applicable: df.select(
        F.lit(name).alias("pillar"), F.col("score").cast("double").alias("score"), applicable.alias("applicable")
    )
    pillars = reduce(DataFrame.unionByName, [
        pillar("structural", structure, F.lit(True)), pillar("statistical", stats, F.lit(True)),
        pillar("relationship", relations, F.col("applicable")), pillar("ml_utility", ml, F.col("applicable")),
    ])
    summary = report.executive_summary(pillars, privacy, warnings)
    return QualityReport(structure, stats, relations, ml, privacy, scores, warnings, summary)
