"""The registered queries, each over whole given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from facsimile.plans.catalog import federation, fidelity, privacy, profiling, scoring, synthesis

_FAMILIES = (profiling, fidelity, synthesis, privacy, scoring, federation)


def queries() -> dict:
    return {name: run for family in _FAMILIES for name, run in family.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
