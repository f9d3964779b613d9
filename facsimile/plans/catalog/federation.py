"""Models fitted per site and merged; market segments are the sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.operators import federated
from facsimile.operators import model as models
from facsimile.operators import sample as draws
from facsimile.plans.catalog.shared import SEED, normal, table

SIGMA = 0.25
SPREAD = ["c_nationkey", "c_acctbal"]


def _sites(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("site"), *SPREAD)


def _order_sites(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("site"), "o_orderstatus")


def federated_sites(spark, sf):
    return federated.site_list(_sites(spark, sf)).withColumn("weight", F.round("weight", 6))


def federated_site_fit(spark, sf):
    found = federated.site_spread(_sites(spark, sf), SPREAD)
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


def _merged_spread(spark, sf):
    sites = _sites(spark, sf)
    return federated.merge_spread(federated.site_spread(sites, SPREAD), federated.site_list(sites))


def federated_merge_numeric(spark, sf):
    return _merged_spread(spark, sf).withColumns({c: F.round(c, 4) for c in ("mean", "std")})


def federated_merge_numeric_noisy(spark, sf):
    noisy = federated.noisy_spread(_merged_spread(spark, sf), SIGMA, SEED)
    return noisy.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


def federated_merge_missing_column(spark, sf):
    # one site does not record balances: weights are renormalised over the others
    sites = _sites(spark, sf).withColumn("c_acctbal", F.when(F.col("site") != "BUILDING", F.col("c_acctbal")))
    found = federated.merge_spread(federated.site_spread(sites, SPREAD), federated.site_list(sites))
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


def _merged_categorical(spark, sf):
    sites = _order_sites(spark, sf)
    return federated.merge_categorical(models.fit_categorical(sites, ["o_orderstatus"], ["site"]), federated.site_list(sites))


def federated_merge_categorical(spark, sf):
    return _merged_categorical(spark, sf).withColumn("p", F.round("p", 6))


def federated_merge_categorical_noisy(spark, sf):
    return federated.noisy_categorical(_merged_categorical(spark, sf), SIGMA, SEED).withColumn("p", F.round("p", 6))


def _merged_correlation(spark, sf):
    sites = _sites(spark, sf)
    return federated.merge_correlation(models.fit_correlation(sites, SPREAD, ["site"]), federated.site_list(sites))


def federated_merge_correlation(spark, sf):
    return _merged_correlation(spark, sf).withColumn("r", F.round("r", 6))


def federated_merge_correlation_noisy(spark, sf):
    return federated.noisy_correlation(_merged_correlation(spark, sf), SIGMA, SEED).withColumn("r", F.round("r", 6))


def federated_history(spark, sf):
    return federated.training_history(_sites(spark, sf), 3, 1.0, 1e-5)


def federated_generate(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("site"), "o_orderstatus", "o_totalprice", "o_orderdate")
    fitted = federated.federated_fit(orders, 5.0, seed=SEED)
    return draws.sample(fitted, spark, orders.count(), SEED)


QUERIES = {
    f.__name__: f for f in (
        federated_sites, federated_site_fit, federated_merge_numeric, federated_merge_numeric_noisy,
        federated_merge_missing_column, federated_merge_categorical, federated_merge_categorical_noisy,
        federated_merge_correlation, federated_merge_correlation_noisy, federated_history, federated_generate,
    )
}

_FIT = " UNION ALL ".join(
    f"SELECT c_mktsegment AS site, '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM customer GROUP BY 1"
    for c in SPREAD)
_WEIGHTS = "w AS (SELECT c_mktsegment AS site, count(*) AS records, count(*)::DOUBLE / (SELECT count(*) FROM customer) AS weight FROM customer GROUP BY 1)"
_MERGED = f"""WITH {_WEIGHTS}, f AS ({_FIT}), g AS (SELECT "column", sum(weight * mean) / sum(weight) AS mean, greatest(0.01::DOUBLE, sum(weight * std) / sum(weight)) AS std,
    min(low) AS low, max(high) AS high FROM f JOIN w USING (site) GROUP BY 1)"""
_SHARES = """WITH w AS (SELECT o_orderpriority AS site, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS weight, count(*) AS n FROM orders GROUP BY 1),
    f AS (SELECT o_orderpriority AS site, o_orderstatus AS category, count(*)::DOUBLE AS c FROM orders GROUP BY 1, 2),
    g AS (SELECT 'o_orderstatus' AS "column", category, sum(weight * c / n) AS p FROM f JOIN w USING (site) GROUP BY 2)"""
_CORR = f"""WITH {_WEIGHTS}, f AS (SELECT c_mktsegment AS site, corr(c_nationkey, c_acctbal) AS r FROM customer GROUP BY 1),
    g AS (SELECT 'c_nationkey' AS col_i, 'c_acctbal' AS col_j, sum(weight * r) AS r FROM f JOIN w USING (site))"""
_SEEN = _FIT.replace("FROM customer", "FROM v")

ORACLES = {
    "federated_sites": f"WITH {_WEIGHTS} SELECT site, records, round(weight, 6) AS weight FROM w",
    "federated_site_fit": f"SELECT site, \"column\", round(mean, 4) AS mean, round(std, 4) AS std, low, high FROM ({_FIT})",
    "federated_merge_numeric": f"{_MERGED} SELECT \"column\", round(mean, 4) AS mean, round(std, 4) AS std, low, high FROM g",
    "federated_merge_numeric_noisy": f"""{_MERGED} SELECT "column", round(mean + {SIGMA}::DOUBLE * {normal(SEED, 'mean', '"column"')}, 4) AS mean,
        round(greatest(0.01::DOUBLE, abs(std + {SIGMA}::DOUBLE * {normal(SEED, 'std', '"column"')} * 0.5::DOUBLE)), 4) AS std, low, high FROM g""",
    "federated_merge_missing_column": f"""
        WITH v AS (SELECT c_mktsegment, c_nationkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS c_acctbal FROM customer),
        {_WEIGHTS}, f AS ({_SEEN})
        SELECT "column", round(sum(weight * mean) / sum(weight), 4) AS mean, round(greatest(0.01::DOUBLE, sum(weight * std) / sum(weight)), 4) AS std,
               min(low) AS low, max(high) AS high FROM f JOIN w USING (site) WHERE mean IS NOT NULL GROUP BY 1""",
    "federated_merge_categorical": f"{_SHARES} SELECT \"column\", category, round(p / sum(p) OVER (), 6) AS p FROM g",
    "federated_merge_categorical_noisy": f"""{_SHARES}, h AS (SELECT "column", category, p + abs({0.1 * SIGMA}::DOUBLE * {normal(SEED, 'share', '"column"', 'category')}) AS q FROM g)
        SELECT "column", category, round(q / sum(q) OVER (), 6) AS p FROM h""",
    "federated_merge_correlation": f"{_CORR} SELECT col_i, col_j, round(r, 6) AS r FROM g",
    "federated_merge_correlation_noisy": f"""{_CORR} SELECT col_i, col_j, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, r + {0.1 * SIGMA}::DOUBLE
        * ({normal(SEED, 'corr', 'col_i', 'col_j')} + {normal(SEED, 'corr', 'col_j', 'col_i')}) / 2)), 6) AS r FROM g""",
    "federated_history": """
        SELECT CAST(i AS INTEGER) AS round, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS sites_participated, (SELECT count(*) FROM customer) AS total_records,
               4.844805::DOUBLE AS dp_noise_sigma FROM range(1, 4) AS t(i)""",
}
