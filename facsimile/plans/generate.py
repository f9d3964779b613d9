"""End-to-end synthesis: profile, drop identifiers, charge the budget, fit, sample, protect, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.functions import rng
from facsimile.operators import model as models
from facsimile.operators.columns import missing_as_null
from facsimile.operators.facts import collect_facts
from facsimile.operators.mechanisms import PrivacyParams, clip_bound, privacy_summary, protect
from facsimile.operators.roles import identifier_columns, semantic_type, target_column
from facsimile.operators.sample import ROW, sample
from facsimile.session import local_rows
from facsimile.sources.registry import Registry
from facsimile.sources.tables import preview, read_table, write_table


class BudgetExhausted(ValueError):
    """The dataset's privacy budget does not cover the request."""


@dataclass
class Generated:
    """A synthetic table with its model and, when protected, its privacy rows."""

    table: DataFrame
    model: models.Model
    identifiers: list[str]
    target: str | None
    privacy: DataFrame | None = None
    summary: DataFrame | None = None


def synthesize(
    real: DataFrame, num_rows: int, privacy: PrivacyParams | None = None, seed=None,
    order_by: list[str] | None = None, keep: tuple[str, ...] = (),
) -> Generated:
    """A synthetic table of ``num_rows`` rows without the identifier columns of ``real``.

    Fitting is a few aggregates; drawing and protecting rows is one narrow job unless a text column
    has a very large domain.  Without ``privacy`` no noise is added.
    """
    real = missing_as_null(real)
    seed = rng.fresh_seed() if seed is None else seed
    facts = collect_facts(real, order_by)
    ids, target = identifier_columns(facts, keep), target_column(facts)
    working = real.drop(*ids)
    known = {f.column: models.model_kind(semantic_type(f, False), f) for f in facts if f.column not in ids}
    fitted = models.fit(working, [c for c in (order_by or []) if c in working.columns] or None, known_kinds=known)
    drawn = sample(fitted, real.sparkSession, num_rows, seed, keep_row_id=True)
    if privacy is None:
        return Generated(drawn.drop(ROW), fitted, ids, target)
    bounded = PrivacyParams(privacy.epsilon, privacy.delta, privacy.mechanism, privacy.sensitivity, clip_bound(working))
    table, metadata = protect(drawn, working, bounded, [ROW], target, seed)
    return Generated(table.drop(ROW), fitted, ids, target, metadata, privacy_summary(metadata, bounded))


def generate(
    registry: Registry, dataset_id: str, num_rows: int, output: str, privacy: PrivacyParams | None = PrivacyParams(),
    seed=None, source: str = "parquet", order_by: list[str] | None = None,
) -> dict:
    """Run a whole generation for a registered dataset and record it.

    The budget is charged before fitting and not given back on failure.
    """
    real = registry.load_dataset(dataset_id)
    if real is None:
        raise ValueError(f"dataset {dataset_id} not found")
    if privacy is not None and not registry.spend(dataset_id, privacy.epsilon, privacy.delta, "generate_statistical"):
        left = registry.budget(dataset_id)["remaining_epsilon"]
        raise BudgetExhausted(f"privacy budget exhausted, remaining epsilon {left:.4f}")
    try:
        made = synthesize(real, num_rows, privacy, seed, order_by)
        write_table(made.table, output, source)
    except Exception:
        registry.record_run(dataset_id, None, "failed", source)
        raise
    run_id = registry.record_run(dataset_id, output, source=source)
    written = read_table(registry.spark, output, source)
    return {
        "run_id": run_id, "dataset_id": dataset_id, "output": output, "columns": written.columns,
        "num_rows_generated": num_rows, "identifiers_dropped": made.identifiers, "target_column": made.target,
        "dp_metadata": made.summary.first().asDict() if made.summary is not None else None,
        "reproducible_run": seed is not None,
        "preview": [r.asDict() for r in preview(written, written.columns).collect()],
        "privacy_budget": registry.budget(dataset_id).asDict() if privacy is not None else None,
    }


def model_tables(made: Generated) -> dict[str, DataFrame]:
    """The fitted model as tables: parameters, category probabilities and correlations."""
    spark = made.table.sparkSession
    tables = {
        "params": made.model.params_table(spark),
        "corr": local_rows(
            spark, [(a, b, float(r)) for (a, b), r in made.model.corr.items()], "col_i string, col_j string, r double"
        ),
    }
    if made.model.probs is not None:
        tables["probs"] = made.model.probs.select("column", "category", F.col("p").alias("p"))
    return tables
