"""Models fitted at separate sites, merged as a weighted grouped aggregate.

A site is a value of the ``site`` column.  Every fit is the ordinary fit with the site in the grouping
keys, and a merge groups by what is left: the result cannot depend on the order of the sites.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions import rng
from facsimile.operators import model as models
from facsimile.operators.columns import kinds, missing_as_null, with_row
from facsimile.operators.facts import collect_facts
from facsimile.operators.mechanisms import gaussian_sigma
from facsimile.operators.roles import identifier_columns
from facsimile.session import local_rows

SITE = "site"
MIN_STD = 0.01


def combine_sites(sites: dict[str, DataFrame], order_by: list[str] | None = None) -> DataFrame:
    """All site tables in one frame with a ``site`` column; each site's identifier columns are dropped,
    a column that a site lacks is null there."""
    tagged = []
    for name, table in sites.items():
        ids = identifier_columns(collect_facts(table, order_by))
        tagged.append(table.drop(*ids).withColumn(SITE, F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def site_list(df: DataFrame) -> DataFrame:
    """``(site, records, weight)``."""
    sizes = df.groupBy(SITE).agg(F.count(F.lit(1)).alias("records"))
    return with_row(sizes, df.agg(F.count(F.lit(1)).alias("all_records"))).select(
        SITE, "records", (F.col("records") / F.col("all_records")).alias("weight")
    )


def site_spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(site, column, mean, std, low, high)``; sites without a value of the column are left out."""
    fitted = models.fit_spread(df, columns, [SITE])
    seen = models.missing_rates(df.select(SITE, *columns), [SITE]).where(F.col("missing_rate") < 1.0)
    return fitted.join(seen.select(SITE, "column"), [SITE, "column"], "left_semi")


def _mean(value: str, strict: bool) -> Column:
    total = F.sum(F.col("weight") * F.col(value))
    return total if strict else F.try_divide(total, F.sum("weight"))


def merge_spread(fitted: DataFrame, sites: DataFrame, strict: bool = False) -> DataFrame:
    """``(column, mean, std, low, high)``: weighted means of means and deviations, outermost limits.

    Weights are renormalised over the sites that have the column; ``strict`` keeps the plain weighted
    sum, which shrinks when a site lacks it.
    """
    return fitted.join(sites, SITE).groupBy("column").agg(
        _mean("mean", strict).alias("mean"),
        F.greatest(F.lit(MIN_STD), _mean("std", strict)).alias("std"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )


def merge_categorical(fitted: DataFrame, sites: DataFrame) -> DataFrame:
    """``(column, category, p)``: weighted frequencies over the union of levels, adding up to one."""
    summed = fitted.join(sites, SITE).groupBy("column", "category").agg(
        F.sum(F.col("weight") * F.col("p")).alias("share")
    )
    return _normalised(summed)


def _normalised(shares: DataFrame) -> DataFrame:
    totals = shares.groupBy("column").agg(F.sum("share").alias("total"))
    return shares.join(totals, "column").select("column", "category", (F.col("share") / F.col("total")).alias("p"))


def merge_correlation(fitted: DataFrame, sites: DataFrame) -> DataFrame:
    """``(col_i, col_j, r)``: weighted mean of the sites' matrices."""
    return fitted.join(sites, SITE).groupBy("col_i", "col_j").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))


def merge_rates(fitted: DataFrame, sites: DataFrame, value: str) -> DataFrame:
    """``(column, <value>)``: weighted mean of a per-column rate."""
    return fitted.join(sites, SITE).groupBy("column").agg(F.sum(F.col("weight") * F.col(value)).alias(value))


def noisy_spread(merged: DataFrame, sigma: float, seed) -> DataFrame:
    """Gaussian noise on merged means and, at half strength, on deviations."""
    noise = lambda tag: F.lit(float(sigma)) * rng.normal(seed, tag, "column")
    return merged.withColumn("mean", F.col("mean") + noise("mean")).withColumn(
        "std", F.greatest(F.lit(MIN_STD), F.abs(F.col("std") + noise("std") * 0.5))
    )


def noisy_categorical(merged: DataFrame, sigma: float, seed) -> DataFrame:
    """Non-negative noise at a tenth of the strength on every frequency, then normalised."""
    noise = F.abs(F.lit(0.1 * sigma) * rng.normal(seed, "share", "column", "category"))
    return _normalised(merged.select("column", "category", (F.col("p") + noise).alias("share")))


def noisy_correlation(merged: DataFrame, sigma: float, seed) -> DataFrame:
    """Symmetric noise at a tenth of the strength off the diagonal, clipped to [-1, 1]."""
    both = (rng.normal(seed, "corr", "col_i", "col_j") + rng.normal(seed, "corr", "col_j", "col_i")) / 2.0
    moved = F.col("r") + F.lit(0.1 * sigma) * both
    return merged.withColumn("r", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), moved)))


def federated_fit(
    df: DataFrame, epsilon: float = 1.0, delta: float = 1e-5, apply_noise: bool = True, seed=None,
    order_by: list[str] | None = None, strict: bool = False, pool_size: int | None = None,
) -> models.Model:
    """The merged model of all sites.  Text pools hold real strings of the sites, as in a single fit, all unless ``pool_size`` is given."""
    df = missing_as_null(df)
    sites = site_list(df)
    if sites.limit(2).count() < 2:
        raise ValueError("federated fitting needs at least 2 sites")
    seed = rng.fresh_seed() if seed is None else seed
    sigma = gaussian_sigma(1.0, epsilon, delta) if apply_noise and epsilon > 0 else 0.0
    data = df.drop(SITE)
    found = models.column_kinds(data, order_by)
    of = lambda *ks: [c for c in data.columns if found[c] in ks]
    types = {f.name: f.dataType for f in data.schema.fields}
    params = {
        c: {
            "column": c, "position": i, "kind": found[c], "data_type": types[c].simpleString(),
            "is_integer": kinds(data)[c] == "integer", "with_time": False,
        }
        for i, c in enumerate(data.columns)
    }

    for c, timed in models.clock_columns(data, [c for c in of("datetime") if isinstance(types[c], T.StringType)], order_by).items():
        params[c]["with_time"] = timed

    def take(rows: DataFrame) -> None:
        for row in rows.collect():
            params[row["column"]].update(row.asDict())

    take(merge_rates(models.missing_rates(df, [SITE]), sites, "missing_rate"))
    corr = {}
    spread = of("numeric", "datetime")
    if spread:
        merged = merge_spread(site_spread(df, spread), sites, strict)
        take(noisy_spread(merged, sigma, seed) if sigma else merged)
    if len(spread) > 1:
        merged = merge_correlation(models.fit_correlation(df, spread, [SITE]), sites)
        merged = noisy_correlation(merged, sigma, seed) if sigma else merged
        corr = {(r["col_i"], r["col_j"]): r["r"] for r in merged.collect()}
    if of("boolean"):
        take(merge_rates(models.fit_boolean(df, of("boolean"), [SITE]), sites, "p_true"))
    if of("constant"):
        take(models.fit_constant(data, of("constant")))
    probs = None
    if of("categorical"):
        probs = merge_categorical(models.fit_categorical(df, of("categorical"), [SITE]), sites)
        probs = noisy_categorical(probs, sigma, seed) if sigma else probs
    pools = {c: models.text_pool(data, c, order_by, pool_size) for c in of("text")}
    return models.Model([params[c] for c in data.columns], probs, pools, corr)


def training_history(
    df: DataFrame, rounds: int, epsilon: float = 1.0, delta: float = 1e-5, apply_noise: bool = True,
) -> DataFrame:
    """``(round, sites_participated, total_records, dp_noise_sigma)``.

    Rounds refit the same rows, so one merge stands for all of them; they only label the history.
    """
    sigma = gaussian_sigma(1.0, epsilon, delta) if apply_noise and epsilon > 0 else 0.0
    summary = site_list(df).agg(F.count(F.lit(1)).alias("sites_participated"), F.sum("records").alias("total_records"))
    return summary.select(
        F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"), "sites_participated", "total_records",
        F.lit(round(sigma, 6)).alias("dp_noise_sigma"),
    )


def site_register(sites: dict[str, DataFrame], names: dict[str, str] | None = None) -> DataFrame:
    """``(site, name, records, columns)`` of registered sites, identifiers dropped."""
    rows = []
    spark = next(iter(sites.values())).sparkSession
    for site, table in sites.items():
        ids = identifier_columns(collect_facts(table))
        rows.append((site, (names or {}).get(site, site), table.count(), [c for c in table.columns if c not in ids]))
    return local_rows(spark, rows, "site string, name string, records long, columns array<string>")
