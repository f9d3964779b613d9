"""Fitting and drawing."""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.functions.dates import epoch_seconds
from facsimile.operators import model as models
from facsimile.operators import sample as draws
from facsimile.plans import generate
from facsimile.operators.mechanisms import PrivacyParams
from facsimile.plans.catalog.shared import NUMBERS, REAL, SEED, TEXTS, derived, melt, normal, table, uniform

DRAWN_KINDS = {"o_totalprice": "numeric", "o_orderdate": "datetime"}
NULL_RATES = {"o_totalprice": 0.1, "o_orderstatus": 0.25}


def _real(spark, sf):
    return derived(spark, sf, REAL, "lineitem")


def missing_rates(spark, sf):
    return models.missing_rates(_real(spark, sf)).withColumn("missing_rate", F.round("missing_rate", 6))


def fit_numeric(spark, sf):
    found = models.fit_spread(_real(spark, sf), NUMBERS)
    return found.select("column", *[F.round(c, 4).alias(c) for c in ("mean", "std", "low", "high")])


def fit_datetime(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_shipdate", F.col("l_shipdate").cast("string").alias("l_shiptext"))
    found = models.fit_spread(lines, ["l_shipdate", "l_shiptext"])
    return found.select("column", *[F.round(c, 2).alias(c) for c in ("mean", "std", "low", "high")])


def fit_categorical(spark, sf):
    return models.fit_categorical(_real(spark, sf), TEXTS).withColumn("p", F.round("p", 6))


def fit_boolean(spark, sf):
    flags = table(spark, sf, "labels").select(
        "quality", F.when(F.col("toxic") == 1, F.lit("Yes")).otherwise(F.lit("no")).alias("toxic_text"),
        (F.col("quality") == F.col("toxic")).alias("agree"),
    )
    return models.fit_boolean(flags, flags.columns).withColumn("p_true", F.round("p_true", 6))


def fit_constant(spark, sf):
    fixed = table(spark, sf, "orders").select(
        F.when(F.col("o_totalprice") > 0, F.lit("ok")).alias("state"), F.lit(None).cast("int").alias("nothing"),
    )
    return models.fit_constant(fixed, ["state", "nothing"])


def fit_correlation(spark, sf):
    return models.fit_correlation(_real(spark, sf), NUMBERS).withColumn("r", F.round("r", 6))


def text_pool(spark, sf):
    return models.text_pool(table(spark, sf, "documents"), "text", ["doc_id"])


def text_pool_whole(spark, sf):
    """All texts of the corpus, numbered by their first document."""
    return models.text_pool(table(spark, sf, "documents"), "text", ["doc_id"], None)


def text_frequencies(spark, sf):
    found = models.text_frequencies(table(spark, sf, "conversations"), "text")
    return found.withColumn("p", F.round("p", 6))


def sample_correlated(spark, sf):
    orders = table(spark, sf, "orders").select(*DRAWN_KINDS)
    fitted = models.fit(orders, known_kinds=DRAWN_KINDS)
    drawn = draws.sample(fitted, spark, orders.count(), SEED, keep_row_id=True)
    return drawn.select(
        "row_id", F.round("o_totalprice", 2).alias("o_totalprice"),
        epoch_seconds(F.col("o_orderdate"), drawn.schema["o_orderdate"].dataType).cast("long").alias("seconds"),
    )


def sample_categorical(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    fitted = models.fit(orders, known_kinds={c: "categorical" for c in orders.columns})
    return draws.sample(fitted, spark, orders.count(), SEED, keep_row_id=True)


def sample_boolean_text(spark, sf):
    mixed = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("doc_id", "quality", "text")
    kinds = {"quality": "boolean", "text": "text"}
    fitted = models.fit(mixed.drop("doc_id"), known_kinds=kinds)
    fitted.pools = {"text": models.text_pool(mixed, "text", ["doc_id"], None)}
    return draws.sample(fitted, spark, mixed.count(), SEED, keep_row_id=True)


def sample_large_domain(spark, sf):
    names = table(spark, sf, "customer").select("c_name", "c_mktsegment")
    fitted = models.fit(names, known_kinds={"c_name": "categorical", "c_mktsegment": "categorical"})
    return draws.sample(fitted, spark, names.count(), SEED, keep_row_id=True)


def inject_nulls(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return draws.inject_nulls(orders, NULL_RATES, SEED, ["o_orderkey"])


def generate_table(spark, sf):
    lines = table(spark, sf, "lineitem")
    return generate.synthesize(lines, lines.count(), PrivacyParams(5.0), SEED, ["l_orderkey", "l_linenumber"]).table


def model_parameters(spark, sf):
    fitted = models.fit(_real(spark, sf), known_kinds={**{c: "numeric" for c in NUMBERS}, **{c: "categorical" for c in TEXTS}})
    found = fitted.params_table(spark)
    return found.select("column", "position", "kind", "rows", "is_integer", *[F.round(c, 4).alias(c) for c in ("missing_rate", "mean", "std")])


QUERIES = {
    f.__name__: f for f in (
        missing_rates, fit_numeric, fit_datetime, fit_categorical, fit_boolean, fit_constant, fit_correlation, text_pool, text_pool_whole,
        text_frequencies, sample_correlated, sample_categorical, sample_boolean_text, sample_large_domain, inject_nulls,
        generate_table, model_parameters,
    )
}

_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]]


def _stretches(column):
    """SQL: levels of a customer column in text order with the cuts of whole weights."""
    return f"""(SELECT v, (sum(w) OVER (ORDER BY v) - w)::DOUBLE / sum(w) OVER ()::DOUBLE AS low, sum(w) OVER (ORDER BY v)::DOUBLE / sum(w) OVER ()::DOUBLE AS high FROM (
        SELECT v, greatest(1, CAST(round_even(n::DOUBLE / sum(n) OVER ()::DOUBLE * 4503599627370496.0::DOUBLE, 0) AS HUGEINT)) AS w
        FROM (SELECT {column} AS v, count(*) AS n FROM customer GROUP BY 1)))"""


def _levels(column):
    return f"""(SELECT {column} AS v, coalesce(lag(upto) OVER (ORDER BY v), 0) AS low, upto AS high FROM (
        SELECT {column} AS v, {column}, CAST(sum(n) OVER (ORDER BY {column}) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS upto
        FROM (SELECT {column}, count(*) AS n FROM orders GROUP BY 1)))"""


ORACLES = {
    "missing_rates": f"WITH t AS ({REAL}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS missing_rate FROM t" for c in NUMBERS + TEXTS),
    "fit_numeric": f"""WITH t AS ({REAL}), m AS ({melt('t', NUMBERS, 'DOUBLE')}) SELECT "column", round(avg(value), 4) AS mean,
        round(CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 0.01::DOUBLE END, 4) AS std, round(min(value), 4) AS low, round(max(value), 4) AS high FROM m GROUP BY 1""",
    "fit_datetime": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(e), 2) AS mean, round(stddev_samp(e), 2) AS std, round(min(e), 2) AS low, round(max(e), 2) AS high"
        " FROM (SELECT floor(epoch(l_shipdate))::DOUBLE AS e FROM lineitem)" for c in ("l_shipdate", "l_shiptext")),
    "fit_categorical": f"""WITH t AS ({REAL}), m AS ({melt('t', TEXTS, 'VARCHAR')}) SELECT "column", value AS category,
        round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY "column"), 6) AS p FROM m GROUP BY 1, 2""",
    "fit_boolean": """
        SELECT 'quality' AS "column", round(avg(quality::DOUBLE), 6) AS p_true FROM labels
        UNION ALL SELECT 'toxic_text', round(avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM labels
        UNION ALL SELECT 'agree', round(avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END), 6) FROM labels""",
    "fit_constant": """
        SELECT 'state' AS "column", CASE WHEN max(o_totalprice) > 0 THEN 'ok' END AS constant FROM orders
        UNION ALL SELECT 'nothing', NULL FROM orders HAVING count(*) > 0""",
    "fit_correlation": f"WITH t AS ({REAL}) " + " UNION ALL ".join(
        f"SELECT '{a}' AS col_i, '{b}' AS col_j, round(coalesce(corr({a}, {b}), 0), 6) AS r FROM t" for a, b in _PAIRS),
    "text_pool": """
        SELECT CAST(row_number() OVER (ORDER BY first_id) AS INTEGER) AS place, text AS value FROM
        (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text ORDER BY first_id LIMIT 100)""",
    "text_pool_whole": """
        SELECT row_number() OVER (ORDER BY first_id) AS place, text AS value FROM (SELECT text, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text)""",
    "text_frequencies": """
        SELECT text AS category, round(count(*)::DOUBLE / (SELECT count(text) FROM conversations), 6) AS p
        FROM conversations GROUP BY text ORDER BY count(*) DESC, text LIMIT 50""",
    "sample_correlated": f"""
        WITH o AS (SELECT o_totalprice AS x, floor(epoch(o_orderdate))::DOUBLE AS y FROM orders),
        p AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, min(x) AS lx, max(x) AS hx, avg(y) AS my, stddev_samp(y) AS sy, min(y) AS ly, max(y) AS hy,
                     corr(x, y) AS r, sqrt(1 + 1e-6::DOUBLE) AS a FROM o),
        c AS (SELECT *, r / a AS b, sqrt(1 + 1e-6::DOUBLE - (r / a) ** 2) AS d FROM p),
        z AS (SELECT i, {normal(SEED, 'normal:o_totalprice', 'i')} AS z0, {normal(SEED, 'normal:o_orderdate', 'i')} AS z1
              FROM range((SELECT count(*) FROM orders)) AS t(i))
        SELECT i AS row_id, round(greatest(lx, least(hx, a * z0 * sx + mx)), 2) AS o_totalprice,
               CAST(floor(greatest(ly, least(hy, (b * z0 + d * z1) * sy + my))) AS BIGINT) AS seconds FROM z, c""",
    "sample_categorical": f"""
        WITH u AS (SELECT i, {uniform(SEED, 'category:o_orderstatus', 'i')} AS u0, {uniform(SEED, 'category:o_orderpriority', 'i')} AS u1
                   FROM range((SELECT count(*) FROM orders)) AS t(i)),
        a AS {_levels('o_orderstatus')}, b AS {_levels('o_orderpriority')}
        SELECT i AS row_id, a.v AS o_orderstatus, b.v AS o_orderpriority FROM u
        JOIN a ON u0 >= a.low AND u0 < a.high JOIN b ON u1 >= b.low AND u1 < b.high""",
    "sample_large_domain": f"""
        WITH u AS (SELECT i, {uniform(SEED, 'category:c_name', 'i')} AS u0, {uniform(SEED, 'category:c_mktsegment', 'i')} AS u1
                   FROM range((SELECT count(*) FROM customer)) AS t(i)),
        a AS {_stretches('c_name')}, b AS {_stretches('c_mktsegment')}
        SELECT i AS row_id, a.v AS c_name, b.v AS c_mktsegment FROM u
        JOIN a ON u0 >= a.low AND u0 < a.high JOIN b ON u1 >= b.low AND u1 < b.high""",
    "sample_boolean_text": f"""
        WITH j AS (SELECT doc_id, quality, text FROM labels JOIN documents USING (doc_id)),
        f AS (SELECT list(text ORDER BY first_id) AS pool FROM (SELECT text, min(doc_id) AS first_id FROM j GROUP BY text)),
        p AS (SELECT avg(quality::DOUBLE) AS p FROM j)
        SELECT i AS row_id, CASE WHEN {uniform(SEED, 'boolean:quality', 'i')} < p THEN 1 ELSE 0 END AS quality,
               pool[1 + CAST(floor({uniform(SEED, 'text:text', 'i')} * len(pool)) AS INTEGER)] AS text
        FROM range((SELECT count(*) FROM j)) AS t(i), f, p""",
    "inject_nulls": f"""
        SELECT o_orderkey, CASE WHEN {uniform(SEED, 'missing:o_orderstatus', 'o_orderkey')} >= 0.25::DOUBLE THEN o_orderstatus END AS o_orderstatus,
               CASE WHEN {uniform(SEED, 'missing:o_totalprice', 'o_orderkey')} >= 0.1::DOUBLE THEN o_totalprice END AS o_totalprice FROM orders""",
    "model_parameters": f"WITH t AS ({REAL}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, '{'numeric' if c in NUMBERS else 'categorical'}' AS kind, count(*) AS rows,"
        f" {'true' if c == 'l_linenumber' else 'false'} AS is_integer, round(1 - count({c})::DOUBLE / count(*), 4) AS missing_rate,"
        + (f" round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std" if c in NUMBERS else " NULL::DOUBLE AS mean, NULL::DOUBLE AS std")
        + " FROM t" for i, c in enumerate(NUMBERS + TEXTS)),
}
