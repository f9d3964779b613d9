"""Tables and SQL fragments that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A (real, synthetic) pair over the whole of lineitem.  The synthetic side shifts prices and
# quantities of the later lines, blanks taxes more often and has a return flag the real side lacks.
REAL = """
SELECT l_linenumber, l_quantity, l_extendedprice, l_discount,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS l_tax, l_returnflag, l_linestatus
FROM lineitem"""
SYNTH = """
SELECT l_linenumber,
       CASE WHEN l_linenumber <= 3 THEN l_quantity
            ELSE l_quantity + l_linenumber * CAST(0.1 AS DOUBLE) END AS l_quantity,
       CASE WHEN l_linenumber <= 3 THEN l_extendedprice
            ELSE l_extendedprice * CAST(1.03 AS DOUBLE) END AS l_extendedprice,
       l_discount, CASE WHEN l_linenumber >= 6 THEN NULL ELSE l_tax END AS l_tax,
       CASE WHEN l_linenumber = 6 THEN 'X' ELSE l_returnflag END AS l_returnflag, l_linestatus
FROM lineitem"""
NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXTS = ["l_returnflag", "l_linestatus"]
COLUMNS = NUMBERS + TEXTS
SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """A table derived from one given table by the same text the SQL side uses."""
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derived(spark, sf_dir, REAL, "lineitem"), derived(spark, sf_dir, SYNTH, "lineitem")


# SQL: both sides of the pair as CTEs
PAIR = f"WITH r AS ({REAL}), s AS ({SYNTH}), b AS (SELECT 'real' AS side, * FROM r UNION ALL SELECT 'synth' AS side, * FROM s)"


def melt(source: str, columns: list[str], cast: str, keys: str = "") -> str:
    """SQL: one row per non-null cell."""
    lead = f"{keys}, " if keys else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS \"column\", CAST({c} AS {cast}) AS value FROM {source} WHERE {c} IS NOT NULL"
        for c in columns
    )


def uniform(seed, tag: str, *key: str, start: int = 1) -> str:
    """SQL: the uniform draw of a row key."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    digest = f"md5(concat_ws('|', '{seed}|{tag}', {parts}))"
    return f"((CAST('0x' || substr({digest}, {start}, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def normal(seed, tag: str, *key: str) -> str:
    """SQL: the standard normal draw of a row key."""
    return (
        f"(sqrt(-2.0::DOUBLE * ln({uniform(seed, tag, *key)}))"
        f" * cos(2.0::DOUBLE * pi() * {uniform(seed, tag, *key, start=14)}))"
    )


def laplace(scale: str, seed, tag: str, *key: str) -> str:
    """SQL: the Laplace draw of a row key."""
    u = f"({uniform(seed, tag, *key)} - 0.5::DOUBLE)"
    return f"(-1.0::DOUBLE * ({scale}) * sign({u}) * ln(1 - 2 * abs({u})))"
