"""Structural fidelity: columns, types, missingness, constants, domains, cardinality, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators.columns import BOOLEAN, FLOAT, INTEGER, common_columns, kinds, tagged_union, with_row
from facsimile.operators.freq import duplicate_counts, side_counts
from facsimile.operators.grades import at_least_zero
from facsimile.session import local_rows

_NUMERIC = (INTEGER, FLOAT, BOOLEAN)


def column_preservation(real: DataFrame, synth: DataFrame) -> DataFrame:
    """``(column, presence)``: common, missing (only real) or extra (only synthetic); schema only."""
    names = [*real.columns, *[c for c in synth.columns if c not in set(real.columns)]]
    presence = lambda c: (
        "common" if c in real.columns and c in synth.columns else "missing" if c in real.columns else "extra"
    )
    return local_rows(real.sparkSession, [(c, presence(c)) for c in names], "column string, presence string")


def type_compatibility(real: DataFrame, synth: DataFrame) -> DataFrame:
    """``(column, real_type, synth_type, compatible)``: equal types, or both numeric (booleans count)."""
    real_types, synth_types = dict(real.dtypes), dict(synth.dtypes)
    real_kinds, synth_kinds = kinds(real), kinds(synth)
    rows = [
        (
            c, real_types[c], synth_types[c],
            real_types[c] == synth_types[c] or (real_kinds[c] in _NUMERIC and synth_kinds[c] in _NUMERIC),
        )
        for c in common_columns(real, synth)
    ]
    return local_rows(
        real.sparkSession, rows, "column string, real_type string, synth_type string, compatible boolean"
    )


def null_rates(real: DataFrame, synth: DataFrame) -> DataFrame:
    """``(column, real_null_rate, synth_null_rate, raw_diff, diff)`` per common column."""
    columns = common_columns(real, synth)
    both = tagged_union(real, synth, columns)
    wide = both.groupBy("side").agg(*[
        F.avg(F.col(c).isNull().cast("int")).alias(f"{i}_rate") for i, c in enumerate(columns)
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{i}_rate").alias("rate")) for i, c in enumerate(columns)
    ])
    sides = wide.select("side", F.inline(rows)).groupBy("column").agg(
        F.coalesce(F.max(F.when(F.col("side") == "real", F.col("rate"))), F.lit(0.0)).alias("r"),
        F.coalesce(F.max(F.when(F.col("side") == "synth", F.col("rate"))), F.lit(0.0)).alias("s"),
    )
    diff = F.abs(F.col("r") - F.col("s"))
    return sides.select(
        "column", F.round("r", 4).alias("real_null_rate"), F.round("s", 4).alias("synth_null_rate"),
        diff.alias("raw_diff"), F.round(diff, 4).alias("diff"),
    )


def constant_preservation(real: DataFrame, synth: DataFrame) -> DataFrame:
    """``(column, real_value, synth_value, preserved)`` for columns with one real value.

    One range per side decides it: a column is constant when its smallest value is its largest.
    """
    columns = common_columns(real, synth)
    both = tagged_union(real, synth, columns)
    aggregates = []
    for i, c in enumerate(columns):
        for side in ("real", "synth"):
            cell = F.when(F.col("side") == side, F.col(c))
            aggregates += [F.min(cell).alias(f"{i}_{side}_min"), F.max(cell).alias(f"{i}_{side}_max")]
    wide = both.agg(*aggregates)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"{i}_real_min").cast("string").alias("real_value"),
            (F.col(f"{i}_real_min") == F.col(f"{i}_real_max")).alias("real_constant"),
            F.col(f"{i}_synth_min").cast("string").alias("synth_value"),
            (F.col(f"{i}_synth_min") == F.col(f"{i}_synth_max")).alias("synth_constant"),
        )
        for i, c in enumerate(columns)
    ])
    found = wide.select(F.inline(rows)).where(F.col("real_constant"))
    same = F.col("synth_constant") & (F.col("real_value") == F.col("synth_value"))
    return found.select("column", "real_value", "synth_value", F.coalesce(same, F.lit(False)).alias("preserved"))


def _nulls_and_constants(real: DataFrame, synth: DataFrame) -> DataFrame:
    """One row (missing_diff, constant_rate) over the common columns, from one scan of each side."""
    columns = common_columns(real, synth)
    ends = [F.struct(F.avg(F.col(c).isNull().cast("int")).alias("nulls"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high"),
                     (F.min(c) == F.max(c)).alias("constant")).alias(str(i)) for i, c in enumerate(columns)]
    one = real.agg(F.array(*ends).alias("r")) if columns else None
    if one is None:
        return real.sparkSession.range(1).select(F.lit(None).cast("double").alias("missing_diff"), F.lit(1.0).alias("constant_rate"))
    both = with_row(one, synth.agg(F.array(*ends).alias("s"))).select(F.inline(F.zip_with("r", "s", lambda r, s: F.struct(r.alias("r"), s.alias("s")))))
    kept = F.coalesce(F.col("s.constant") & (F.col("r.low") == F.col("s.low")), F.lit(False))
    return both.agg(
        F.avg(F.abs(F.coalesce("r.nulls", F.lit(0.0)) - F.coalesce("s.nulls", F.lit(0.0)))).alias("missing_diff"),
        F.coalesce(F.avg(F.when(F.col("r.constant"), kept.cast("int"))), F.lit(1.0)).alias("constant_rate"),
    )


def _domains(counts: DataFrame, texts: list[str]) -> DataFrame:
    """One row (domain_overlap, cardinality_diff): what ``domain_overlap`` and ``cardinality`` average to, from one pass over the counts."""
    in_real, in_synth = F.col("n_real") > 0, F.col("n_synth") > 0
    grouped = counts.groupBy("column").agg(
        F.count_if(in_real).alias("r"), F.count_if(in_synth).alias("s"), F.count_if(in_real & in_synth).alias("both"), F.count(F.lit(1)).alias("n"))
    overlap = F.when(F.col("column").isin(texts) & (F.col("r") > 0), F.col("both") / F.col("n"))
    diff = F.abs(F.col("r") - F.col("s")) / F.greatest(F.col("r"), F.lit(1))
    return grouped.agg(
        F.coalesce(F.avg(overlap), F.lit(1.0)).alias("domain_overlap"), F.avg(F.least(F.lit(1.0), diff)).alias("cardinality_diff"))


def domain_overlap(counts: DataFrame) -> DataFrame:
    """``(column, real_categories, synth_categories, novel_categories, raw_overlap, overlap)``.

    ``counts`` is ``side_counts`` over non-numeric columns; columns without a real value are left out.
    """
    in_real, in_synth = F.col("n_real") > 0, F.col("n_synth") > 0
    grouped = counts.groupBy("column").agg(
        F.count_if(in_real).alias("real_categories"),
        F.count_if(in_synth).alias("synth_categories"),
        F.count_if(in_synth & ~in_real).alias("novel_categories"),
        (F.count_if(in_real & in_synth) / F.count(F.lit(1))).alias("raw_overlap"),
    )
    return grouped.where(F.col("real_categories") > 0).withColumn("overlap", F.round("raw_overlap", 4))


def novel_categories(counts: DataFrame) -> DataFrame:
    """``(column, category, n_synth)``: every value the real column never has."""
    return counts.where((F.col("n_real") == 0) & (F.col("n_synth") > 0)).select(
        "column", F.col("value").alias("category"), "n_synth"
    )


def cardinality(counts: DataFrame) -> DataFrame:
    """``(column, real_cardinality, synth_cardinality, raw_diff, relative_diff)`` from ``side_counts``."""
    grouped = counts.groupBy("column").agg(
        F.count_if(F.col("n_real") > 0).alias("real_cardinality"),
        F.count_if(F.col("n_synth") > 0).alias("synth_cardinality"),
    )
    real, synth = F.col("real_cardinality"), F.col("synth_cardinality")
    diff = F.abs(real - synth) / F.greatest(real, F.lit(1))
    return grouped.select(
        "column", "real_cardinality", "synth_cardinality", diff.alias("raw_diff"),
        F.round(diff, 4).alias("relative_diff"),
    )


def duplicate_rates(real: DataFrame, synth: DataFrame) -> DataFrame:
    """One row ``(real_rate, synth_rate, diff)`` of rows beyond the first of equal rows, all columns."""
    def rate(df: DataFrame, name: str) -> DataFrame:
        counted = duplicate_counts(df)
        return counted.select(
            F.coalesce(F.try_divide(F.col("duplicate_count").cast("double"), F.col("num_rows")), F.lit(0.0)).alias(name)
        )
    joined = with_row(rate(real, "real_rate"), rate(synth, "synth_rate"))
    return joined.select("real_rate", "synth_rate", F.abs(F.col("real_rate") - F.col("synth_rate")).alias("diff"))


def structural_fidelity(real: DataFrame, synth: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """One row with the structural score, status and its parts.

    ``ignore`` names identifier columns that were left out on purpose, so that they do not count as
    missing; by default every real column is expected.
    """
    real, synth = real.drop(*ignore), synth.drop(*ignore)
    columns = common_columns(real, synth)
    missing = [c for c in real.columns if c not in columns]
    extra = [c for c in synth.columns if c not in set(real.columns)]
    preservation = len(columns) / max(len(real.columns), 1)
    numeric, synth_kinds, types = kinds(real), kinds(synth), (dict(real.dtypes), dict(synth.dtypes))
    agreeing = [
        c for c in columns
        if types[0][c] == types[1][c] or (numeric[c] in _NUMERIC and synth_kinds[c] in _NUMERIC)
    ]
    dtype_rate = len(agreeing) / max(len(columns), 1)

    counts = side_counts(tagged_union(real, synth, columns), columns, digest=True)
    texts = [c for c in columns if numeric[c] not in _NUMERIC]
    joined = _nulls_and_constants(real, synth)
    for part in (_domains(counts, texts), duplicate_rates(real, synth)):
        joined = with_row(joined, part)
    score = F.round(
        F.lit(preservation * 25.0) + F.lit(dtype_rate * 20.0)
        + at_least_zero(100.0 * (1.0 - F.col("missing_diff"))) * 0.20
        + F.col("constant_rate") * 10.0
        + F.col("domain_overlap") * 15.0
        + at_least_zero(100.0 * (1.0 - F.col("diff"))) * 0.10,
        2,
    )
    scored = joined.withColumn("score", score)
    return scored.select(
        "score",
        F.when((F.col("score") >= 80) & F.lit(not missing), F.lit("passed"))
        .when(F.col("score") >= 60, F.lit("warning")).otherwise(F.lit("failed")).alias("status"),
        F.lit(len(real.columns)).alias("column_count_real"),
        F.lit(len(synth.columns)).alias("column_count_synth"),
        F.lit(len(columns)).alias("common_columns_count"),
        F.lit(len(missing)).alias("missing_columns"),
        F.lit(len(extra)).alias("extra_columns"),
        F.round(F.lit(preservation), 4).alias("column_preservation_rate"),
        F.round(F.lit(dtype_rate), 4).alias("dtype_match_rate"),
        F.round("missing_diff", 4).alias("mean_missing_difference"),
        F.round("constant_rate", 4).alias("constant_preservation_rate"),
        F.round("domain_overlap", 4).alias("categorical_domain_overlap"),
        F.round("cardinality_diff", 4).alias("mean_cardinality_diff_ratio"),
        F.round("real_rate", 4).alias("real_duplicate_rate"),
        F.round("synth_rate", 4).alias("synth_duplicate_rate"),
        F.round("diff", 4).alias("duplicate_rate_diff"),
    )


def structural_warnings(real: DataFrame, synth: DataFrame) -> DataFrame:
    """``(pillar, message)``: missing and extra columns, type mismatches, lost constants, new categories."""
    # The wording of the messages below
    spark = real.sparkSession
    columns = common_columns(real, synth)
    missing = [c for c in real.columns if c not in columns]
    extra = [c for c in synth.columns if c not in set(real.columns)]
    fixed = []
    if missing:
        fixed.append(f"Synthetic data is missing columns: {missing}")
    if extra:
        fixed.append(f"Synthetic data contains extra unexpected columns: {extra}")
    schema_part = local_rows(spark, [(m,) for m in fixed], "message string")
    types = type_compatibility(real, synth).where(~F.col("compatible")).select(F.format_string(
        "Column '%s' datatype mismatch: real=%s, synth=%s", "column", "real_type", "synth_type").alias("message"))
    lost = constant_preservation(real, synth).where(~F.col("preserved")).select(F.format_string(
        "Constant column '%s' value changed or varied in synthetic data.", "column").alias("message"))
    messages = schema_part.unionByName(types).unionByName(lost)
    by_kind = kinds(real)
    texts = [c for c in columns if by_kind[c] not in _NUMERIC]
    if texts:
        counts = side_counts(tagged_union(real, synth, texts), texts, digest=True)
        messages = messages.unionByName(domain_overlap(counts).where(F.col("novel_categories") > 0).select(
            F.format_string("Column '%s' introduced %d novel categories not in real data.", "column", "novel_categories")
            .alias("message")
        ))
    return messages.select(F.lit("structural").alias("pillar"), "message")
