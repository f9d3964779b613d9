"""Profiles, roles, row functions and table lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.functions import masking
from facsimile.functions import rng
from facsimile.operators import facts, profile, roles
from facsimile.operators.columns import coerce
from facsimile.operators.freq import distinct_counts, duplicate_counts, value_counts
from facsimile.operators.split import bounded_sample, split
from facsimile.plans.catalog.shared import NUMBERS, REAL, TEXTS, derived, melt, table, uniform
from facsimile.sources.registry import latest_outputs
from facsimile.sources.tables import preview

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _real(spark, sf):
    return derived(spark, sf, REAL, "lineitem")


def profile_table(spark, sf):
    return profile.table_profile(_real(spark, sf)).drop("memory_usage_bytes")


def profile_memory(spark, sf):
    return profile.table_profile(table(spark, sf, "documents")).select("row_count", "memory_usage_bytes")


def profile_missing(spark, sf):
    return profile.missing_profile(_real(spark, sf))


def profile_numeric(spark, sf):
    return profile.numeric_stats(_real(spark, sf), NUMBERS)


def profile_categories(spark, sf):
    return profile.top_categories(_real(spark, sf), [*TEXTS, "l_linenumber"])


def profile_unique(spark, sf):
    return distinct_counts(table(spark, sf, "lineitem"))


def profile_duplicates(spark, sf):
    return duplicate_counts(_real(spark, sf).select("l_linenumber", "l_quantity", "l_tax", "l_returnflag"))


def profile_columns(spark, sf):
    found = profile.column_profile(table(spark, sf, "orders"), ["o_orderkey"])
    return found.select(
        "column", "semantic_type", "missing_count", "unique_count", "unique_percentage", "identifier",
        F.col("numeric_stats.median").alias("median"), F.col("top_categories")[0]["value"].alias("top_value"),
        F.array_join("sample_values", ",").alias("samples"),
    )


def value_frequencies(spark, sf):
    return value_counts(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


def sample_values(spark, sf):
    part = table(spark, sf, "part")
    return profile.sample_values(part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), ["p_name", "p_type", "p_size"], ["p_partkey"])


def ingest_stats(spark, sf):
    events = table(spark, sf, "events")
    kinds = {"value": "numerical", "user_id": "numerical", "event_type": "categorical"}
    return profile.ingest_stats(events, kinds)


def column_facts(spark, sf):
    found = facts.column_facts(table(spark, sf, "events"), ["event_id"])
    return found.select(
        "column", "rows", "non_null", "n_unique", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"),
        F.round("avg_length", 4).alias("avg_length"), F.round("date_share", 4).alias("date_share"),
    )


def roles_customer(spark, sf):
    return roles.role_table(table(spark, sf, "customer"), ["c_custkey"])


def roles_orders(spark, sf):
    # order dates as text, as they come out of a CSV file
    orders = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return roles.role_table(orders, ["o_orderkey"])


def roles_events(spark, sf):
    return roles.role_table(table(spark, sf, "events"), ["event_id"])


def roles_labels(spark, sf):
    return roles.role_table(table(spark, sf, "labels").withColumnRenamed("toxic", "label"), ["doc_id"])


def drop_identifiers(spark, sf):
    return roles.drop_identifiers(table(spark, sf, "customer"), ["c_custkey"])


def coerce_types(spark, sf):
    events = table(spark, sf, "events").select("event_id", "props", "user_id", "value")
    return coerce(events, {"props": "numerical", "user_id": "categorical", "value": "numerical"})


def mask_column(spark, sf):
    customer = table(spark, sf, "customer")
    return customer.select("c_custkey", masking.mask(F.col("c_name")).alias("masked"), masking.mask(F.col("c_mktsegment"), 9).alias("segment"))


def record_hashes(spark, sf):
    conversations = table(spark, sf, "conversations")
    return conversations.select("conv_id", "turn", masking.record_hash(conversations, salt="pepper").alias("digest"))


def redact_columns(spark, sf):
    return masking.redact(table(spark, sf, "customer"))


def table_fingerprint(spark, sf):
    return masking.table_fingerprint(table(spark, sf, "documents"))


def json_safe_cells(spark, sf):
    broken = table(spark, sf, "supplier").select(
        "s_suppkey", F.when(F.col("s_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal")).alias("balance"),
        F.when(F.col("s_nationkey") == 3, F.lit(float("inf"))).otherwise(F.col("s_acctbal")).alias("limit_value"),
    )
    return masking.json_safe(broken)


def preview_rows(spark, sf):
    return preview(table(spark, sf, "part"), ["p_partkey"])


def latest_run(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("user_id").alias("dataset_id"), F.concat(F.lit("out/"), F.col("event_id").cast("string")).alias("output"),
        F.when(F.col("event_type") == "purchase", F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        F.col("ts").alias("created_at"),
    )
    return latest_outputs(runs)


def sample_bounded(spark, sf):
    return bounded_sample(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey")


def split_stratified(spark, sf):
    return split(table(spark, sf, "orders"), ["o_orderkey"], 0.3, "o_orderpriority").select("o_orderkey", "o_orderpriority", "is_test")


def split_plain(spark, sf):
    return split(table(spark, sf, "customer"), ["c_custkey"], 0.2).select("c_custkey", "is_test")


def split_repeated(spark, sf):
    """Lines split by their order, which several lines share: exact numbers of each flag, and where the cut lies."""
    marked = split(table(spark, sf, "lineitem"), ["l_orderkey"], 0.3, "l_returnflag")
    draw = rng.uniform(42, "split", "l_orderkey")
    return marked.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"), F.round(F.max(F.when(F.col("is_test"), draw)), 12).alias("last_test"),
        F.round(F.min(F.when(~F.col("is_test"), draw)), 12).alias("first_train"))


def drop_missing(spark, sf):
    return _real(spark, sf).na.drop(subset=["l_tax"]).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f for f in (
        profile_table, profile_memory, profile_missing, profile_numeric, profile_categories, profile_unique,
        profile_duplicates, profile_columns, value_frequencies, sample_values, ingest_stats, column_facts,
        roles_customer, roles_orders, roles_events, roles_labels, drop_identifiers, coerce_types, mask_column,
        record_hashes, redact_columns, table_fingerprint, json_safe_cells, preview_rows, latest_run,
        sample_bounded, split_stratified, split_repeated, split_plain, drop_missing,
    )
}

_LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
_REAL_COLUMNS = NUMBERS + TEXTS
_FREQ = "SELECT \"column\", value, count(*) AS n FROM m GROUP BY ALL"


def _role_row(source, name, position, semantic, coarse, identifier="false", target="false", sensitive="false"):
    return (
        f"SELECT '{name}' AS \"column\", {position} AS position, {semantic} AS semantic_type, {coarse} AS coarse_type,"
        f" {identifier} AS identifier, {target} AS target, {sensitive} AS sensitive FROM {source} HAVING count(*) > 0"
    )


def _unique_integer(name):
    """The unique-integer rule for a column without any missing value."""
    return f"(count(DISTINCT {name}) >= 20 AND count(DISTINCT {name}) >= 0.98 * count(*))"


def _id_or(name, otherwise):
    return f"CASE WHEN {_unique_integer(name)} THEN 'identifier' ELSE '{otherwise}' END"


def _coarse(name):
    return f"CASE WHEN count(DISTINCT {name}) <= 20 AND count(DISTINCT {name}) < 0.05 * count(*) THEN 'categorical' ELSE 'numerical' END"


def _small(name):
    return f"(count(DISTINCT {name}) BETWEEN 2 AND 5)"


ORACLES = {
    "profile_table": f"""
        WITH t AS ({REAL}), d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM t)),
        a AS (SELECT count(*) AS n, count(*) - count(l_tax) AS m FROM t)
        SELECT a.n AS row_count, 7 AS column_count, a.m AS missing_count,
               round(a.m * 100.0::DOUBLE / (a.n * 7), 2) AS missing_percentage, a.n - d.n AS duplicate_count,
               round((a.n - d.n) * 100.0::DOUBLE / a.n, 2) AS duplicate_percentage FROM a, d""",
    "profile_memory": """
        SELECT count(*) AS row_count,
               CAST(16 * count(*) + sum(octet_length(encode(text))) + sum(octet_length(encode(lang)))
                    + sum(octet_length(encode(source))) AS BIGINT) AS memory_usage_bytes FROM documents""",
    "profile_missing": f"WITH t AS ({REAL}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count,"
        f" round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_percentage,"
        f" count(*) > count({c}) AS nullable FROM t" for c in _REAL_COLUMNS),
    "profile_numeric": f"""
        WITH t AS ({REAL}), m AS ({melt('t', NUMBERS, 'DOUBLE')})
        SELECT "column", round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean,
               round(quantile_cont(value, 0.5), 4) AS median, round(stddev_samp(value), 4) AS std,
               round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.75), 4) AS q75
        FROM m GROUP BY "column" """,
    "profile_categories": f"""
        WITH t AS ({REAL}), m AS ({melt('t', [*TEXTS, 'l_linenumber'], 'VARCHAR')}), f AS ({_FREQ}),
        k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place,
                     sum(n) OVER (PARTITION BY "column") AS total, count(*) OVER (PARTITION BY "column") AS c FROM f)
        SELECT "column", CAST(place AS INTEGER) AS place, value, n AS count,
               round(n * 100.0::DOUBLE / total, 2) AS percentage, c AS num_categories FROM k WHERE place <= 10""",
    "profile_unique": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM lineitem" for c in _LINEITEM),
    "profile_duplicates": f"""
        WITH t AS ({REAL})
        SELECT CAST(sum(n) AS BIGINT) AS num_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_count
        FROM (SELECT count(*) AS n FROM t GROUP BY l_linenumber, l_quantity, l_tax, l_returnflag)""",
    "profile_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {s} AS semantic_type, count(*) - count({c}) AS missing_count,"
        f" count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 2) AS unique_percentage,"
        f" {i} AS identifier, {m} AS median,"
        f" {t} AS top_value, (SELECT string_agg({v}, ',' ORDER BY o_orderkey) FROM"
        f" (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)) AS samples FROM orders"
        for c, s, i, m, t, v in (
            ("o_orderkey", _id_or("o_orderkey", "numeric"), _unique_integer("o_orderkey"), "NULL::DOUBLE", "NULL", "CAST(o_orderkey AS VARCHAR)"),
            ("o_custkey", _id_or("o_custkey", "numeric"), _unique_integer("o_custkey"),
             "round(quantile_cont(o_custkey, 0.5), 4)", "NULL", "CAST(o_custkey AS VARCHAR)"),
            ("o_orderstatus", "'categorical'", "false", "NULL::DOUBLE",
             "(SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "o_orderstatus"),
            ("o_totalprice", "'numeric'", "false", "round(quantile_cont(o_totalprice, 0.5), 4)", "NULL", "CAST(o_totalprice AS VARCHAR)"),
            ("o_orderdate", "'datetime'", "false", "NULL::DOUBLE", "NULL", "CAST(o_orderdate AS VARCHAR)"),
            ("o_orderpriority", "'categorical'", "false", "NULL::DOUBLE",
             "(SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "o_orderpriority"),
        )),
    "value_frequencies": f"WITH m AS ({melt('orders', ['o_orderstatus', 'o_orderpriority', 'o_custkey'], 'VARCHAR')}) {_FREQ}",
    "sample_values": " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS place,"
        f" CAST({c} AS VARCHAR) AS value FROM part ORDER BY p_partkey LIMIT 5)" for c in ("p_name", "p_type", "p_size")),
    "ingest_stats": " UNION ALL ".join([
        *(f"SELECT '{c}' AS \"column\", 'numerical' AS type, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std,"
          f" round(CAST(min({c}) AS DOUBLE), 2) AS min, round(CAST(max({c}) AS DOUBLE), 2) AS max, NULL::BIGINT AS \"unique\","
          f" NULL::VARCHAR AS top, count(*) - count({c}) AS missing FROM events" for c in ("value", "user_id")),
        "SELECT 'event_type' AS \"column\", 'categorical' AS type, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE,"
        " count(DISTINCT event_type), (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),"
        " count(*) - count(event_type) FROM events"]),
    "column_facts": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS n_unique,"
        + (f" round(CAST(min({c}) AS DOUBLE), 4) AS low, round(CAST(max({c}) AS DOUBLE), 4) AS high," if n else " NULL::DOUBLE AS low, NULL::DOUBLE AS high,")
        + (f" round(avg(length({c})), 4) AS avg_length, 0.0::DOUBLE AS date_share" if t else " NULL::DOUBLE AS avg_length, NULL::DOUBLE AS date_share")
        + " FROM events"
        for c, n, t in (("event_id", 1, 0), ("ts", 0, 0), ("user_id", 1, 0), ("event_type", 0, 1), ("value", 1, 0), ("props", 0, 1))),
    "roles_customer": " UNION ALL ".join([
        _role_row("customer", "c_custkey", 0, _id_or("c_custkey", "numeric"), _coarse("c_custkey"), _unique_integer("c_custkey")),
        _role_row("customer", "c_name", 1, "'categorical'", "'categorical'", sensitive="true"),
        _role_row("customer", "c_nationkey", 2, "'numeric'", _coarse("c_nationkey")),
        _role_row("customer", "c_acctbal", 3, "'numeric'", "'numerical'"),
        _role_row("customer", "c_mktsegment", 4, "'categorical'", "'categorical'", sensitive=_small("c_mktsegment")),
    ]),
    "roles_orders": " UNION ALL ".join([
        _role_row("orders", "o_orderkey", 0, _id_or("o_orderkey", "numeric"), "'numerical'", _unique_integer("o_orderkey")),
        _role_row("orders", "o_custkey", 1, _id_or("o_custkey", "numeric"), "'numerical'", _unique_integer("o_custkey")),
        _role_row("orders", "o_orderstatus", 2, "'categorical'", "'categorical'", sensitive=_small("o_orderstatus")),
        _role_row("orders", "o_totalprice", 3, "'numeric'", "'numerical'"),
        _role_row("orders", "o_orderdate", 4, "'datetime'", "'datetime'"),
        _role_row("orders", "o_orderpriority", 5, "'categorical'", "'categorical'", sensitive=_small("o_orderpriority")),
    ]),
    "roles_events": " UNION ALL ".join([
        _role_row("events", "event_id", 0, "'identifier'", "'numerical'", "true"),
        _role_row("events", "ts", 1, "'datetime'", "'datetime'"),
        _role_row("events", "user_id", 2, "'identifier'", _coarse("user_id"), "true"),
        _role_row("events", "event_type", 3, "'categorical'", "'categorical'", sensitive=_small("event_type")),
        _role_row("events", "value", 4, "'numeric'", "'numerical'"),
        _role_row("events", "props", 5, "'categorical'", "'categorical'"),
    ]),
    "roles_labels": " UNION ALL ".join([
        _role_row("labels", "doc_id", 0, "'identifier'", "'numerical'", "true"),
        _role_row("labels", "quality", 1, "'boolean'", "'boolean'", sensitive="true"),
        _role_row("labels", "label", 2, "'boolean'", "'boolean'", target="true", sensitive="true"),
    ]),
    "drop_identifiers": "SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "coerce_types": "SELECT event_id, TRY_CAST(props AS DOUBLE) AS props, CAST(user_id AS VARCHAR) AS user_id, value FROM events",
    "mask_column": """
        SELECT c_custkey, repeat('*', length(c_name) - 3) || right(c_name, 3) AS masked,
               CASE WHEN length(c_mktsegment) <= 9 THEN repeat('*', length(c_mktsegment))
                    ELSE repeat('*', length(c_mktsegment) - 9) || right(c_mktsegment, 9) END AS segment FROM customer""",
    "record_hashes": """
        SELECT conv_id, turn, sha256('pepper:conv_id=' || conv_id || '|role=' || role || '|text=' || text || '|turn=' || turn) AS digest
        FROM conversations""",
    "redact_columns": """
        SELECT '[REDACTED]' AS c_custkey, c_name, '[REDACTED]' AS c_nationkey, c_acctbal, c_mktsegment FROM customer""",
    "table_fingerprint": """
        WITH h AS (SELECT sha256('doc_id=' || doc_id || '|lang=' || lang || '|n_chars=' || n_chars || '|source=' || source
                                 || '|text=' || text) AS d FROM documents),
        s AS (SELECT count(*) AS n, """ + ", ".join(
            f"sum(CAST(CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS s{i}" for i in range(4)) + """ FROM h)
        SELECT n AS num_rows, sha256(n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS fingerprint FROM s""",
    "json_safe_cells": """
        SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS balance,
               CASE WHEN s_nationkey = 3 THEN NULL ELSE s_acctbal END AS limit_value FROM supplier""",
    "preview_rows": "SELECT * FROM part ORDER BY p_partkey LIMIT 5",
    "latest_run": """
        SELECT user_id AS dataset_id, arg_max('out/' || event_id, ts) AS output FROM events
        WHERE event_type = 'purchase' GROUP BY user_id""",
    "sample_bounded": f"SELECT o_orderkey FROM orders ORDER BY {uniform(42, 'sample', 'o_orderkey')}, o_orderkey LIMIT 5000",
    "split_stratified": f"""
        SELECT o_orderkey, o_orderpriority,
               row_number() OVER (PARTITION BY o_orderpriority ORDER BY {uniform(42, 'split', 'o_orderkey')}, o_orderkey)
               <= ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY o_orderpriority)) AS is_test FROM orders""",
    "split_repeated": f"""
        WITH u AS (SELECT l_returnflag, {uniform(42, 'split', 'l_orderkey')} AS u FROM lineitem),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY u) <= ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY l_returnflag)) AS is_test FROM u)
        SELECT l_returnflag, count(*) AS n, count(*) FILTER (is_test) AS n_test, round(max(u) FILTER (is_test), 12) AS last_test, round(min(u) FILTER (NOT is_test), 12) AS first_train
        FROM r GROUP BY l_returnflag""",
    "split_plain": f"""
        SELECT c_custkey, row_number() OVER (ORDER BY {uniform(42, 'split', 'c_custkey')}, c_custkey)
               <= ceil(0.2::DOUBLE * count(*) OVER ()) AS is_test FROM customer""",
    "drop_missing": f"WITH t AS ({REAL}) SELECT l_linenumber, count(*) AS n FROM t WHERE l_tax IS NOT NULL GROUP BY 1",
}
