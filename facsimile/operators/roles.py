"""Column roles from evidence rows: identifiers, target, sensitive columns, semantic and coarse types."""

from __future__ import annotations

from pyspark.sql import DataFrame

from facsimile.functions import names
from facsimile.operators.columns import BOOLEAN, DATETIME, FLOAT, INTEGER, STRING
from facsimile.operators.facts import ColumnFacts, collect_facts
from facsimile.session import local_rows

# Thresholds of the published rules
MIN_INDEX_SIZE = 20
MIN_INDEX_RATIO = 0.98
MIN_CONTENT_SHARE = 0.6
MAX_TARGET_CLASSES = 20
MIN_TARGET_SCORE = 25.0
TEXT_AVG_LENGTH = 30
TEXT_UNIQUE_RATIO = 0.7
MAX_SENSITIVE = 5


def is_identifier(fact: ColumnFacts) -> bool:
    """Does the column name a record rather than describe it?  The protections come first."""
    name = names.normalize_name(fact.column)
    explicit = names.is_explicit_id_name(name)
    numeric = fact.kind in (INTEGER, FLOAT)

    described = (
        fact.n_unique <= 1
        or fact.kind == BOOLEAN
        or (numeric and fact.n_unique == 2 and fact.is_zero_one)
        or fact.is_datetime_like
        or (not explicit and (fact.kind == FLOAT or names.is_measurement_name(name)))
    )
    if described:
        return False

    countable = fact.kind in (INTEGER, STRING)
    if explicit or (names.is_known_id_name(name) and countable):
        return True
    if names.is_guid_name(name) and countable and (fact.unique_ratio >= 0.20 or fact.n_unique >= 10):
        return True
    if fact.kind == STRING:
        shares = (fact.uuid_share or 0.0, fact.hex_share or 0.0)
        return max(shares) >= MIN_CONTENT_SHARE
    return (
        fact.kind == INTEGER
        and min(fact.rows, fact.n_unique) >= MIN_INDEX_SIZE
        and fact.unique_ratio >= MIN_INDEX_RATIO
    )


def identifier_columns(facts: list[ColumnFacts], keep: tuple[str, ...] = ()) -> list[str]:
    """Identifier columns in table order; ``keep`` overrides the rule for columns the caller knows."""
    return [f.column for f in facts if f.column not in keep and is_identifier(f)]


def drop_identifiers(
    df: DataFrame, order_by: list[str] | None = None, keep: tuple[str, ...] = (), sampled: bool = False,
) -> DataFrame:
    return df.drop(*identifier_columns(collect_facts(df, order_by, sampled), keep))


def target_score(fact: ColumnFacts, is_last: bool) -> float | None:
    """How much a column looks like an outcome; None when it cannot be one."""
    name = names.normalize_name(fact.column)
    strength = names.target_strength(name)
    unfit = (
        not 2 <= fact.n_unique <= MAX_TARGET_CLASSES
        or fact.is_datetime_like
        or (fact.kind == FLOAT and strength is None)
        or (names.is_measurement_name(name) and strength != "strong")
    )
    if unfit:
        return None
    score = {"strong": 80.0, "moderate": 40.0, None: 0.0}[strength]
    if names.has_flag_prefix(name) and strength != "strong":
        score -= 40.0
    for limit, bonus in ((2, 20.0), (6, 10.0), (10, 5.0)):
        if fact.n_unique <= limit:
            score += bonus
            break
    return score + (5.0 if is_last else 0.0)


def target_column(facts: list[ColumnFacts]) -> str | None:
    """The best-scoring column, the earliest on ties; None below the threshold."""
    last = max((f.position for f in facts), default=-1)
    best, best_score = None, MIN_TARGET_SCORE
    for fact in facts:
        if is_identifier(fact):
            continue
        score = target_score(fact, fact.position == last)
        if score is not None and (score > best_score or (best is None and score >= best_score)):
            best, best_score = fact.column, score
    return best


def sensitive_columns(facts: list[ColumnFacts], limit: int | None = MAX_SENSITIVE) -> list[str]:
    """Columns with a sensitive word first, then small-domain columns, never identifiers."""
    open_facts = [f for f in facts if not is_identifier(f)]
    named = [f.column for f in open_facts if names.is_sensitive_name(names.normalize_name(f.column))]
    small = [f.column for f in open_facts if 2 <= f.n_unique <= 5 and f.column not in named]
    return (named + small)[:limit]


def semantic_type(fact: ColumnFacts, identifier: bool) -> str:
    if fact.is_datetime_like:
        return "datetime"
    if identifier:
        return "identifier"
    if fact.n_unique <= 1:
        return "constant"
    if fact.kind == BOOLEAN or (fact.kind in (INTEGER, FLOAT) and fact.is_zero_one):
        return "boolean"
    if fact.kind in (INTEGER, FLOAT):
        return "numeric"
    long_text = (fact.avg_length or 0.0) >= TEXT_AVG_LENGTH
    if fact.kind == STRING and long_text and fact.unique_ratio >= TEXT_UNIQUE_RATIO:
        return "text"
    return "categorical"


def coarse_type(fact: ColumnFacts) -> str:
    """Ingest type: boolean, categorical, numerical or datetime."""
    if fact.kind == BOOLEAN:
        return "boolean"
    if fact.kind in (INTEGER, FLOAT):
        if fact.is_zero_one:
            return "boolean"
        few = fact.n_unique <= 20 and fact.rows and fact.n_unique / fact.rows < 0.05
        return "categorical" if few else "numerical"
    if fact.kind == DATETIME or (fact.kind == STRING and fact.coarse_date_parses):
        return "datetime"
    return "categorical"


def role_table(
    df: DataFrame, order_by: list[str] | None = None, keep: tuple[str, ...] = (), sampled: bool = False,
) -> DataFrame:
    """``(column, position, semantic_type, coarse_type, identifier, target, sensitive)`` per column."""
    facts = collect_facts(df, order_by, sampled)
    ids, target, sensitive = set(identifier_columns(facts, keep)), target_column(facts), sensitive_columns(facts)
    rows = [
        (
            f.column, f.position, semantic_type(f, f.column in ids), coarse_type(f),
            f.column in ids, f.column == target, f.column in sensitive,
        )
        for f in facts
    ]
    return local_rows(
        df.sparkSession, rows,
        "column string, position int, semantic_type string, coarse_type string,"
        " identifier boolean, target boolean, sensitive boolean",
    )
