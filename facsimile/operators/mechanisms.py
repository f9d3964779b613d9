"""Differential-privacy mechanisms on columns and on a whole synthetic table.

The rules follow the published behaviour: every column is perturbed with the full epsilon, and
sensitivities, clip ranges and response domains come from the real table unprotected.  Columns of
one row compose in sequence, so the honest total is ``epsilon_sequential`` in the metadata.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.functions import rng
from facsimile.operators.accounting import rdp_epsilon
from facsimile.operators.columns import BOOLEAN, FLOAT, INTEGER, STRING, kinds, missing_as_null, numeric_columns
from facsimile.operators.freq import value_counts
from facsimile.operators.prefix import running_totals, text_bounds, text_range
from facsimile.operators.quantiles import quantiles
from facsimile.operators.sample import INLINE_DOMAIN
from facsimile.session import cut_lineage, local_rows


@dataclass(frozen=True)
class PrivacyParams:
    """Arguments of a protection run."""

    epsilon: float = 1.0
    delta: float = 1e-5
    mechanism: str = "gaussian"
    sensitivity: float = 1.0
    clip_bound: float = 1.0


def laplace_scale(sensitivity: float, epsilon: float) -> float:
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    return sensitivity / epsilon


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    if epsilon <= 0 or delta <= 0:
        raise ValueError("epsilon and delta must be positive")
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def laplace_noise(value: Column, sensitivity: float, epsilon: float, seed, tag: str, key: list[str]) -> Column:
    return value.cast("double") + rng.laplace(laplace_scale(sensitivity, epsilon), seed, tag, *key)


def gaussian_noise(
    value: Column, sensitivity: float, epsilon: float, delta: float, seed, tag: str, key: list[str],
) -> Column:
    return value.cast("double") + F.lit(gaussian_sigma(sensitivity, epsilon, delta)) * rng.normal(seed, tag, *key)


def clip_bound(df: DataFrame) -> float:
    """Spread between the largest and the smallest numeric cell of a table; 1 when there is none."""
    columns = numeric_columns(df)
    if not columns:
        return 1.0
    df = missing_as_null(df)
    row = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"low_{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(c).cast("double")).alias(f"high_{i}") for i, c in enumerate(columns)],
    ).first()
    lows = [row[f"low_{i}"] for i in range(len(columns)) if row[f"low_{i}"] is not None]
    highs = [row[f"high_{i}"] for i in range(len(columns)) if row[f"high_{i}"] is not None]
    return (max(highs) - min(lows) if lows else 0.0) or 1.0


def column_sensitivity(real: DataFrame, columns: list[str], bound: float) -> DataFrame:
    """``(column, sensitivity)``: one and a half interquartile ranges, at least 1, at most the bound."""
    spread = quantiles(missing_as_null(real), columns, {"q25": 0.25, "q75": 0.75})
    wide = F.greatest(F.lit(1.5) * (F.col("q75") - F.col("q25")), F.lit(1.0))
    return spread.select("column", F.least(wide, F.lit(float(bound))).alias("sensitivity"))


def keep_probability(epsilon: float, domain_size: int) -> float:
    """Chance of an honest answer; written so that a large epsilon does not overflow."""
    return 1.0 / (1.0 + (domain_size - 1) * math.exp(-epsilon))


def _response(value: Column, first: Column, second: Column, keep: Column) -> Column:
    # the second candidate stands in when the first is the value itself: uniform over all other values
    other = F.when(first == value, second).otherwise(first)
    return F.when(value.isNull(), value).when(keep, value).otherwise(other)


def _places(name: str, size: int, seed, key: list[str]) -> tuple[Column, Column]:
    """Two domain positions: uniform, and uniform among the rest."""
    first = F.floor(rng.uniform(seed, f"response:{name}", *key) * F.lit(size)).cast("long")
    step = F.floor(rng.uniform(seed, f"response2:{name}", *key) * F.lit(max(size - 1, 1))).cast("long")
    return first, F.pmod(first + step + F.lit(1), F.lit(size))


def randomized_response(
    value: Column, name: str, domain: list, epsilon: float, seed, key: list[str],
) -> Column:
    """Keep the value with the honest probability, else any other domain value; nulls stay null."""
    if not domain:
        return value
    first, second = _places(name, len(domain), seed, key)
    keep = rng.uniform(seed, f"keep:{name}", *key) < F.lit(keep_probability(epsilon, len(domain)))
    values = F.array(*[F.lit(v) for v in domain])
    return _response(value, F.get(values, first.cast("int")), F.get(values, second.cast("int")), keep)


def randomized_response_joined(
    df: DataFrame, name: str, domain: DataFrame, size: int, epsilon: float, seed, key: list[str],
) -> DataFrame:
    """Randomised response over a domain of any size, ``domain`` being ``(value, place)``.

    Positions are drawn for every row, kept or not: the joins run on uniform keys, never on the
    values, so a value held by a third of the rows does not matter.
    """
    first, second = _places(name, size, seed, key)
    drawn = df.withColumn("first_place", first).withColumn("second_place", second)
    for which in ("first", "second"):
        side = domain.select(F.col("place").alias(f"{which}_place"), F.col("value").alias(f"{which}_value"))
        drawn = drawn.join(side, f"{which}_place", "left")
    keep = rng.uniform(seed, f"keep:{name}", *key) < F.lit(keep_probability(epsilon, size))
    answer = _response(F.col(name), F.col("first_value"), F.col("second_value"), keep)
    return drawn.withColumn(name, answer).drop("first_place", "second_place", "first_value", "second_value")


def numbered_domain(real: DataFrame, name: str) -> DataFrame:
    """``(value, place)``: the distinct values of a column numbered from 0 in text order, without a single-task sort."""
    values = value_counts(real, [name]).select("value", F.lit(1).alias("one"))
    placed = running_totals(values, [], text_range(F.col("value"), text_bounds(values, "value")), ["value"], ["one"])
    return placed.select("value", F.col("one_before").alias("place"))


def respond(df: DataFrame, real: DataFrame, name: str, epsilon: float, seed, key: list[str]) -> DataFrame:
    """``df`` with randomised responses in ``name`` over the levels of ``real``, in text order.

    One job lists the levels up to INLINE_DOMAIN; a larger domain is numbered and joined.  Both give the same rows.
    """
    levels = [r["value"] for r in value_counts(real, [name]).select("value").limit(INLINE_DOMAIN + 1).collect()]
    if len(levels) <= INLINE_DOMAIN:
        return df.withColumn(name, randomized_response(F.col(name), name, sorted(levels), epsilon, seed, key))
    domain = cut_lineage(numbered_domain(real, name))
    return randomized_response_joined(df, name, domain, domain.count(), epsilon, seed, key)


def protect(
    df: DataFrame, real: DataFrame, params: PrivacyParams, key: list[str], target: str | None = None, seed=None,
) -> tuple[DataFrame, DataFrame]:
    """Perturb a synthetic table; returns it with ``(column, type, mechanism, ...)`` metadata rows.

    ``key`` names columns that identify a row of ``df``; they steer the draws and pass through.
    Known seeds are for tests and experiments: leave ``seed`` unset for a release.
    """
    seed = rng.fresh_seed() if seed is None else seed
    real = missing_as_null(real)
    df_kinds, real_kinds = kinds(df), kinds(real)
    columns = [c for c in df.columns if c in real.columns and c not in key]
    open_columns = [c for c in columns if c != target]
    numbers = [c for c in open_columns if df_kinds[c] in (INTEGER, FLOAT)]
    texts = [c for c in open_columns if df_kinds[c] == STRING]
    measured = [c for c in numbers if real_kinds[c] in (INTEGER, FLOAT)]
    sensitivity = {c: 1.0 for c in numbers}
    limits: dict[str, tuple] = {}
    if measured:
        for row in column_sensitivity(real, measured, params.clip_bound).collect():
            sensitivity[row["column"]] = row["sensitivity"]
        ranges = real.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in measured]).first()
        limits = {c: tuple(ranges[c]) for c in measured}
    domains = {}
    if texts:
        sizes = value_counts(real, texts).groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()
        domains = {r["column"]: r["n"] for r in sizes}
    small = [c for c in texts if domains.get(c, 0) <= INLINE_DOMAIN]
    levels: dict[str, list[str]] = {c: [] for c in small}
    if small:
        for r in value_counts(real, small).collect():
            levels[r["column"]].append(r["value"])

    result = df
    for name in (c for c in texts if c not in levels):
        result = randomized_response_joined(
            result, name, numbered_domain(real, name), domains[name], params.epsilon, seed, key
        )

    draws = rng.Draws(seed)

    def cell(name: str) -> Column:
        value = F.col(name)
        if name in levels:
            return randomized_response(value, name, sorted(levels[name]), params.epsilon, draws, key).alias(name)
        if name not in open_columns:
            return value
        if df_kinds[name] == BOOLEAN:
            return randomized_response(value, name, [True, False], params.epsilon, draws, key).alias(name)
        if name in numbers:
            return _noisy(value, name, df.schema[name].dataType, limits.get(name)).alias(name)
        return value

    def _noisy(value: Column, name: str, data_type, limit) -> Column:
        if params.mechanism == "laplace":
            noisy = laplace_noise(value, sensitivity[name], params.epsilon, draws, f"noise:{name}", key)
        else:
            noisy = gaussian_noise(
                value, sensitivity[name], params.epsilon, params.delta, draws, f"noise:{name}", key
            )
        if df_kinds[name] == INTEGER:
            noisy = F.bround(noisy, 0)
        if limit and limit[0] is not None:
            noisy = F.greatest(F.lit(limit[0]).cast("double"), F.least(F.lit(limit[1]).cast("double"), noisy))
            # greatest/least skip nulls; a missing value must stay missing
            noisy = F.when(value.isNotNull(), noisy)
        return noisy.cast(data_type)

    cells = [cell(c).alias(c) for c in df.columns]
    protected = draws.over(result).select(*cells)
    return protected, _metadata(df, params, columns, target, df_kinds, sensitivity, domains)


def _metadata(df, params, columns, target, df_kinds, sensitivity, domains) -> DataFrame:
    rows = []
    for c in columns:
        if c == target:
            rows.append((c, "target_column", "preserved", None, None, None))
        elif df_kinds[c] == BOOLEAN:
            rows.append((c, "boolean", "randomized_response", None, 2, params.epsilon))
        elif df_kinds[c] in (INTEGER, FLOAT):
            rows.append((c, "numeric", params.mechanism, round(sensitivity[c], 4), None, params.epsilon))
        elif df_kinds[c] == STRING:
            rows.append((c, "categorical", "randomized_response", None, domains.get(c, 0), params.epsilon))
        else:
            rows.append((c, "datetime", "unprotected", None, None, None))
    return local_rows(
        df.sparkSession, rows,
        "column string, type string, mechanism string, sensitivity double, domain_size long, epsilon double",
    )


def privacy_summary(metadata: DataFrame, params: PrivacyParams) -> DataFrame:
    """One row: requested and accounted epsilon of a protection run.

    Gaussian columns are composed by Rényi accounting; Laplace runs report the requested epsilon.
    """
    rows = metadata.collect()
    noisy = [r for r in rows if r["mechanism"] == "gaussian"]
    perturbed = [r for r in rows if r["epsilon"] is not None]
    if noisy:
        steps = [(1.0, gaussian_sigma(1.0, params.epsilon, params.delta))] * len(noisy)
        actual = rdp_epsilon(steps, params.delta)
    else:
        actual = params.epsilon
    covered = [r for r in rows if r["mechanism"] != "unprotected"]
    return local_rows(
        metadata.sparkSession,
        [(
            params.mechanism, float(params.epsilon), float(params.delta), round(actual, 6),
            float(params.epsilon * len(perturbed)), len(covered), len(noisy),
        )],
        "mechanism string, epsilon_requested double, delta_requested double, epsilon_actual double,"
        " epsilon_sequential double, num_columns_protected int, rdp_steps int",
    )
