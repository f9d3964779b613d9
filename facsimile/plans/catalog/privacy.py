"""Mechanisms, accounting and the budget ledger."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from facsimile.operators import accounting, mechanisms
from facsimile.plans.catalog.shared import SEED, laplace, normal, table, uniform

EPSILON, DELTA, BUDGET = 1.0, 1e-5, 2.0
ANSWER_EPSILON = 1.5


def laplace_column(spark, sf):
    orders = table(spark, sf, "orders")
    noisy = mechanisms.laplace_noise(F.col("o_totalprice"), 50.0, EPSILON, SEED, "price", ["o_orderkey"])
    return orders.select("o_orderkey", F.round(noisy, 3).alias("noisy"))


def gaussian_column(spark, sf):
    orders = table(spark, sf, "orders")
    noisy = mechanisms.gaussian_noise(F.col("o_totalprice"), 50.0, EPSILON, DELTA, SEED, "price", ["o_orderkey"])
    return orders.select("o_orderkey", F.round(noisy, 3).alias("noisy"))


def randomized_response(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    answered = mechanisms.respond(orders, orders, "priority", ANSWER_EPSILON, SEED, ["o_orderkey"])
    return answered.select("o_orderkey", F.col("priority").alias("answer"))


def randomized_response_large(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    return mechanisms.respond(customer, customer, "c_name", 6.0, SEED, ["c_custkey"])


def column_sensitivity(spark, sf):
    lines = table(spark, sf, "lineitem")
    found = mechanisms.column_sensitivity(lines, ["l_quantity", "l_extendedprice", "l_tax"], 30_000.0)
    return found.withColumn("sensitivity", F.round("sensitivity", 4))


def protect_table(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    params = mechanisms.PrivacyParams(EPSILON, DELTA, "laplace", clip_bound=mechanisms.clip_bound(orders.select("o_totalprice")))
    found = mechanisms.protect(orders, orders, params, ["o_orderkey"], "o_orderstatus", SEED)[0]
    return found.withColumn("o_totalprice", F.round("o_totalprice", 2))


def protect_metadata(spark, sf):
    orders = table(spark, sf, "orders").drop("o_custkey")
    params = mechanisms.PrivacyParams(EPSILON, DELTA, clip_bound=1e9)
    return mechanisms.protect(orders, orders, params, ["o_orderkey"], "o_orderstatus", SEED)[1].drop("sensitivity")


def _steps(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("dataset_id"), F.lit(1.0).alias("sensitivity"), (F.col("value") + 5.0).alias("sigma"))


def rdp_orders(spark, sf):
    return accounting.rdp_by_order(_steps(spark, sf), ["dataset_id"]).withColumn("rdp", F.round("rdp", 6))


def rdp_epsilon(spark, sf):
    found = accounting.rdp_epsilon_table(_steps(spark, sf), DELTA, ["dataset_id"])
    return found.withColumn("epsilon", F.round("epsilon", 6))


def _requests(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("dataset_id"), F.col("event_id").alias("seq"), (F.col("value") / 100.0).alias("epsilon"),
        F.lit(1e-6).alias("delta"), F.col("event_type").alias("operation"))


def budget_admission(spark, sf):
    return accounting.admit(_requests(spark, sf), BUDGET).select("dataset_id", "seq", "accepted")


def budget_admission_one_ledger(spark, sf):
    # the whole table as the history of one dataset: the long path
    one = _requests(spark, sf).withColumn("dataset_id", F.lit("all"))
    return accounting.admit(one, 50.0).select("dataset_id", "seq", "accepted")


def budget_state(spark, sf):
    registry = table(spark, sf, "customer").select(F.col("c_custkey").alias("dataset_id"))
    return accounting.budget_state(accounting.admit(_requests(spark, sf), BUDGET), BUDGET, registry)


def budget_history(spark, sf):
    found = accounting.budget_history(accounting.admit(_requests(spark, sf), BUDGET), 5)
    return found.select("dataset_id", "seq", "operation", F.round("cumulative_epsilon", 6).alias("cumulative_epsilon"))


QUERIES = {
    f.__name__: f for f in (
        laplace_column, gaussian_column, randomized_response, randomized_response_large, column_sensitivity,
        protect_table, protect_metadata, rdp_orders, rdp_epsilon, budget_admission, budget_admission_one_ledger,
        budget_state, budget_history,
    )
}

_SIGMA = 50.0 * math.sqrt(2 * math.log(1.25 / DELTA)) / EPSILON


def _answer(column, name, epsilon, key="o_orderkey"):
    """SQL: randomised response over the sorted levels ``d`` of a column."""
    first = f"CAST(floor({uniform(SEED, f'response:{name}', key)} * len(d)) AS BIGINT)"
    step = f"CAST(floor({uniform(SEED, f'response2:{name}', key)} * (len(d) - 1)) AS BIGINT)"
    keep = f"{uniform(SEED, f'keep:{name}', key)} < 1.0::DOUBLE / (1.0::DOUBLE + (len(d) - 1) * exp(-{epsilon}::DOUBLE))"
    return (
        f"CASE WHEN {keep} THEN {column} WHEN d[1 + {first}] = {column} THEN d[1 + ({first} + {step} + 1) % len(d)] ELSE d[1 + {first}] END"
    )


_PRIORITIES = "(SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS d FROM orders)"
_STEPS = "(SELECT user_id AS dataset_id, sum(1.0::DOUBLE / (2.0::DOUBLE * (value + 5.0::DOUBLE) ** 2)) AS unit FROM events GROUP BY 1)"
_ALPHAS = "(SELECT unnest([" + ", ".join(f"{float(a)}::DOUBLE" for a in accounting.ALPHA_ORDERS) + "]) AS alpha)"


def _fold(dataset, budget):
    """SQL: ordered admission, one request after the other."""
    return f"""q AS (SELECT {dataset} AS dataset_id, event_id AS seq, event_type AS operation, CAST(round(value / 100.0::DOUBLE * 1000000.0::DOUBLE) AS BIGINT) AS cost,
                    row_number() OVER (PARTITION BY {dataset} ORDER BY event_id) AS i FROM events),
        f AS (SELECT dataset_id, 0::BIGINT AS i, 0::BIGINT AS used, false AS accepted FROM (SELECT DISTINCT dataset_id FROM q)
              UNION ALL SELECT q.dataset_id, q.i, CASE WHEN f.used + q.cost <= {budget} THEN f.used + q.cost ELSE f.used END, f.used + q.cost <= {budget}
              FROM f JOIN q ON q.dataset_id = f.dataset_id AND q.i = f.i + 1),
        a AS (SELECT q.dataset_id, q.seq, q.operation, q.cost, f.accepted FROM q JOIN f ON q.dataset_id = f.dataset_id AND q.i = f.i)"""


ORACLES = {
    "laplace_column": f"SELECT o_orderkey, round(o_totalprice + {laplace('50.0::DOUBLE', SEED, 'price', 'o_orderkey')}, 3) AS noisy FROM orders",
    "gaussian_column": f"SELECT o_orderkey, round(o_totalprice + {_SIGMA!r}::DOUBLE * {normal(SEED, 'price', 'o_orderkey')}, 3) AS noisy FROM orders",
    "randomized_response": f"SELECT o_orderkey, {_answer('o_orderpriority', 'priority', ANSWER_EPSILON)} AS answer FROM orders, {_PRIORITIES}",
    "randomized_response_large": f"SELECT c_custkey, {_answer('c_name', 'c_name', 6.0, 'c_custkey')} AS c_name FROM customer, (SELECT list(DISTINCT c_name ORDER BY c_name) AS d FROM customer)",
    "column_sensitivity": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(least(greatest(1.5::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 1.0::DOUBLE), 30000.0::DOUBLE), 4) AS sensitivity FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_tax")),
    "protect_table": f"""
        WITH p AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, least(greatest(1.5::DOUBLE * (quantile_cont(o_totalprice, 0.75)
                   - quantile_cont(o_totalprice, 0.25)), 1.0::DOUBLE), max(o_totalprice) - min(o_totalprice)) AS b FROM orders)
        SELECT o_orderkey, o_orderstatus, round(greatest(lo, least(hi, o_totalprice + {laplace(f'b / {EPSILON}::DOUBLE', SEED, 'noise:o_totalprice', 'o_orderkey')})), 2) AS o_totalprice,
               {_answer('o_orderpriority', 'o_orderpriority', EPSILON)} AS o_orderpriority FROM orders, p, {_PRIORITIES}""",
    "protect_metadata": """
        SELECT 'o_orderstatus' AS "column", 'target_column' AS type, 'preserved' AS mechanism, NULL::BIGINT AS domain_size, NULL::DOUBLE AS epsilon
        UNION ALL SELECT 'o_totalprice', 'numeric', 'gaussian', NULL, 1.0::DOUBLE
        UNION ALL SELECT 'o_orderdate', 'datetime', 'unprotected', NULL, NULL
        UNION ALL SELECT 'o_orderpriority', 'categorical', 'randomized_response', (SELECT count(DISTINCT o_orderpriority) FROM orders), 1.0::DOUBLE""",
    "rdp_orders": f"SELECT dataset_id, alpha, round(alpha * unit, 6) AS rdp FROM {_STEPS}, {_ALPHAS}",
    "rdp_epsilon": f"""
        WITH c AS (SELECT dataset_id, alpha, alpha * unit + {math.log(1 / DELTA)!r}::DOUBLE / (alpha - 1) AS e FROM {_STEPS}, {_ALPHAS})
        SELECT dataset_id, round(min(e), 6) AS epsilon, arg_min(alpha, e) AS best_alpha FROM c GROUP BY 1""",
    "budget_admission": f"WITH RECURSIVE {_fold('user_id', int(BUDGET * 1e6))} SELECT dataset_id, seq, accepted FROM a",
    "budget_admission_one_ledger": f"WITH RECURSIVE {_fold(chr(39) + 'all' + chr(39), 50_000_000)} SELECT dataset_id, seq, accepted FROM a",
    "budget_state": f"""
        WITH RECURSIVE {_fold('user_id', int(BUDGET * 1e6))},
        s AS (SELECT dataset_id, sum(cost) AS used, count(*) * 1e-6::DOUBLE AS delta, count(*) AS n FROM a WHERE accepted GROUP BY 1),
        j AS (SELECT c_custkey AS dataset_id, coalesce(used, 0) AS used, coalesce(delta, 0) AS delta, coalesce(n, 0) AS n FROM customer LEFT JOIN s ON s.dataset_id = c_custkey)
        SELECT dataset_id, {BUDGET}::DOUBLE AS max_epsilon, used / 1000000.0::DOUBLE AS total_epsilon_used, round(delta, 10) AS total_delta_used,
               (2000000 - used) / 1000000.0::DOUBLE AS remaining_epsilon, ((20000 * used + 2000000) // 4000000) / 100.0::DOUBLE AS utilization_pct,
               CASE WHEN used >= 1800000 THEN 'critical' WHEN used >= 1500000 THEN 'high' WHEN used >= 1000000 THEN 'medium' END AS warning_level,
               n AS num_queries FROM j""",
    "budget_history": f"""
        WITH RECURSIVE {_fold('user_id', int(BUDGET * 1e6))},
        h AS (SELECT dataset_id, seq, operation, sum(cost) OVER (PARTITION BY dataset_id ORDER BY seq) / 1000000.0::DOUBLE AS c,
                     row_number() OVER (PARTITION BY dataset_id ORDER BY seq DESC) AS back FROM a WHERE accepted)
        SELECT dataset_id, seq, operation, round(c, 6) AS cumulative_epsilon FROM h WHERE back <= 5""",
}
