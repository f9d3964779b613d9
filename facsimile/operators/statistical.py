"""Statistical fidelity: how close the columns of two tables are, one by one and in correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.functions.tails import chi_square_p, kolmogorov_p
from facsimile.operators.columns import common_columns, numeric_columns, string_columns, tagged_union
from facsimile.operators.freq import side_counts
from facsimile.operators.grades import at_least_zero, grade, status
from facsimile.operators.moments import correlation_cells, numeric_moments
from facsimile.operators.prefix import ordered_totals, value_ranges
from facsimile.session import local_rows

# Constants of the published formulas
TINY = 1e-10
CHI_SQUARE_OFFSET = 0.001
SIMILAR_P = 0.05
HISTOGRAM_BINS = 30


def ks_test(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, statistic, p_value, similar)``: two-sample Kolmogorov-Smirnov distance per column."""
    both = tagged_union(real, synth, columns)
    counts = side_counts(both, columns, numeric=True)
    totals = ordered_totals(counts, value_ranges(both, columns), ["n_real", "n_synth"])

    def cdf(side: str):
        upto = F.col(f"{side}_before") + F.col(side)
        return F.try_divide(upto.cast("double"), F.col(f"{side}_total").cast("double"))

    found = totals.groupBy("column").agg(
        F.max(F.abs(cdf("n_real") - cdf("n_synth"))).alias("distance"),
        F.max("n_real_total").alias("n"),
        F.max("n_synth_total").alias("m"),
    )
    enough = (F.col("n") >= 2) & (F.col("m") >= 2)
    scored = found.select(
        "column",
        F.when(enough, F.col("distance")).alias("distance"),
        F.when(enough, kolmogorov_p("distance", F.col("n").cast("double"), F.col("m").cast("double"))).alias("p"),
    )
    return scored.select(
        "column",
        F.round("distance", 6).alias("statistic"),
        F.round("p", 6).alias("p_value"),
        F.coalesce(F.col("p") > SIMILAR_P, F.lit(False)).alias("similar"),
    )


def mean_variance(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, real_mean, synth_mean, mean_deviation_pct, real_variance, synth_variance, variance_ratio)``."""
    both = numeric_moments(tagged_union(real, synth, columns), columns, ["side"])

    def of(side: str, field: str):
        return F.max(F.when((F.col("side") == side) & (F.col("n") >= 2), F.col(field)))

    sides = both.groupBy("column").agg(
        of("real", "mean").alias("rm"), of("synth", "mean").alias("sm"),
        of("real", "variance").alias("rv"), of("synth", "variance").alias("sv"),
    )
    known = F.col("rm").isNotNull() & F.col("sm").isNotNull()
    rm, sm, rv, sv = (F.when(known, F.col(c)) for c in ("rm", "sm", "rv", "sv"))
    return sides.select(
        "column",
        F.round(rm, 4).alias("real_mean"),
        F.round(sm, 4).alias("synth_mean"),
        F.round(F.abs(rm - sm) / (F.abs(rm) + F.lit(TINY)) * 100.0, 2).alias("mean_deviation_pct"),
        F.round(rv, 4).alias("real_variance"),
        F.round(sv, 4).alias("synth_variance"),
        F.round(sv / (rv + F.lit(TINY)), 4).alias("variance_ratio"),
    )


def chi_square(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, categories, statistic, p_value, similar)``: goodness of fit over the union of categories."""
    counts = side_counts(tagged_union(real, synth, columns), columns)
    totals = counts.groupBy("column").agg(
        F.sum("n_real").alias("real_total"), F.sum("n_synth").alias("synth_total"),
        F.count(F.lit(1)).alias("categories"),
    )
    expected = F.col("n_real") + F.lit(CHI_SQUARE_OFFSET)
    scale = F.col("real_total") / (F.col("synth_total") + F.lit(TINY))
    observed = F.col("n_synth") * scale + F.lit(CHI_SQUARE_OFFSET)
    summed = counts.join(totals, "column").groupBy("column").agg(
        F.sum(F.pow(observed - expected, F.lit(2)) / expected).alias("chi2"),
        F.max("categories").alias("categories"),
        F.max("real_total").alias("real_total"),
        F.max("synth_total").alias("synth_total"),
    )
    testable = (F.col("categories") >= 2) & (F.col("real_total") > 0)
    # an empty synthetic column cannot fit: its totals disagree, so the tail is taken as zero
    tail = F.when(F.col("synth_total") == 0, F.lit(0.0)).otherwise(
        chi_square_p("chi2", (F.col("categories") - 1).cast("double"))
    )
    scored = summed.select(
        "column", "categories",
        F.when(testable, F.col("chi2")).alias("chi2"), F.when(testable, tail).alias("p"),
    )
    return scored.select(
        "column", "categories",
        F.round("chi2", 6).alias("statistic"),
        F.round("p", 6).alias("p_value"),
        F.coalesce(F.col("p") > SIMILAR_P, F.lit(True)).alias("similar"),
    )


def histogram(real: DataFrame, synth: DataFrame, columns: list[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(column, bin, center, real_density, synth_density)``: equal-width bins over both tables, none left out."""
    both = tagged_union(real, synth, columns)
    limits = numeric_moments(both, columns).select(
        "column", F.col("min").alias("low"), F.col("max").alias("high"),
        ((F.col("max") - F.col("min")) / F.lit(float(bins))).alias("width"),
    )
    sizes = numeric_moments(both, columns, ["side"]).groupBy("column").agg(
        F.max(F.when(F.col("side") == "real", F.col("n"))).alias("real_n"),
        F.max(F.when(F.col("side") == "synth", F.col("n"))).alias("synth_n"),
    )
    frame = limits.join(sizes, "column").where((F.col("real_n") >= 2) & (F.col("synth_n") >= 2))
    cells = (
        both.select("side", *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(["side"], columns, "column", "value")
        .where(F.col("value").isNotNull())
    )
    # one row per column on this side of the join
    placed = cells.join(F.broadcast(limits), "column").withColumn("bin", _bin(bins))
    counted = placed.groupBy("column", "bin").agg(
        F.count_if(F.col("side") == "real").alias("real_count"),
        F.count_if(F.col("side") == "synth").alias("synth_count"),
    )
    grid = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = grid.join(counted, ["column", "bin"], "left")

    def density(side: str):
        count = F.coalesce(F.col(f"{side}_count"), F.lit(0))
        return F.round(F.try_divide(count.cast("double"), F.col(f"{side}_n") * F.col("width")), 6)

    left = F.col("low") + F.col("bin") * F.col("width")
    right = F.when(F.col("bin") == bins - 1, F.col("high")).otherwise(
        F.col("low") + (F.col("bin") + 1) * F.col("width")
    )
    return filled.select(
        "column", "bin", F.round((left + right) / 2, 4).alias("center"),
        density("real").alias("real_density"), density("synth").alias("synth_density"),
    )


def _bin(bins: int):
    """Bin number by the edges themselves: left-closed, the last bin closed on both sides."""
    low, width, value = F.col("low"), F.col("width"), F.col("value")
    guess = F.coalesce(F.floor(F.try_divide(value - low, width)), F.lit(bins - 1)).cast("int")
    guess = F.least(guess, F.lit(bins - 1))
    down = (guess > 0) & (value < low + guess * width)
    up = (guess < bins - 1) & (value >= low + (guess + 1) * width)
    return F.when(down, guess - 1).when(up, guess + 1).otherwise(guess)


def category_shares(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, category, real_proportion, synth_proportion)`` over the union of categories."""
    counts = side_counts(tagged_union(real, synth, columns), columns)
    totals = counts.groupBy("column").agg(F.sum("n_real").alias("real_n"), F.sum("n_synth").alias("synth_n"))

    def share(side: str):
        found = F.try_divide(F.col(f"n_{side}").cast("double"), F.col(f"{side}_n"))
        return F.round(F.coalesce(found, F.lit(0.0)), 4)

    return counts.join(totals, "column").select(
        "column", F.col("value").alias("category"),
        share("real").alias("real_proportion"), share("synth").alias("synth_proportion"),
    )


def correlation_delta(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """``(col_i, col_j, real_r, synth_r, delta)`` for all k x k cells; undefined cells count as 0."""
    both = tagged_union(real, synth, columns)
    cells = correlation_cells(both, columns, ["side"])
    sides = cells.groupBy("col_i", "col_j").agg(
        F.max(F.when(F.col("side") == "real", F.col("r"))).alias("real_r"),
        F.max(F.when(F.col("side") == "synth", F.col("r"))).alias("synth_r"),
    )
    return sides.withColumn("delta", F.abs(F.col("real_r") - F.col("synth_r")))


def correlation_error(delta: DataFrame) -> DataFrame:
    """One row ``(mean_absolute_error, max_absolute_error)`` over all cells of a delta table."""
    return delta.agg(
        F.round(F.avg("delta"), 6).alias("mean_absolute_error"),
        F.round(F.max("delta"), 6).alias("max_absolute_error"),
    )


def column_scores(real: DataFrame, synth: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, type, statistic, p_value, quality_score, raw_score)`` for every numeric and text column."""
    columns = columns or common_columns(real, synth)
    numbers = [c for c in numeric_columns(real) if c in columns]
    texts = [c for c in string_columns(real) if c in columns]
    parts = []
    if numbers:
        joined = ks_test(real, synth, numbers).join(mean_variance(real, synth, numbers), "column")
        ks_part = F.when(F.col("statistic").isNull(), F.lit(50.0)).otherwise(
            at_least_zero(100.0 - F.col("statistic") * 200.0)
        )
        mean_part = at_least_zero(100.0 - F.coalesce("mean_deviation_pct", F.lit(100.0)))
        parts.append(joined.select(
            "column", F.lit("numerical").alias("type"), "statistic", "p_value",
            (ks_part * 0.6 + mean_part * 0.4).alias("raw_score"),
        ))
    if texts:
        p = F.coalesce("p_value", F.lit(0.0))
        parts.append(chi_square(real, synth, texts).select(
            "column", F.lit("categorical").alias("type"), "statistic", "p_value",
            F.when(F.col("similar"), F.lit(100.0)).otherwise(at_least_zero(p * 200.0)).alias("raw_score"),
        ))
    scores = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return scores.withColumn("quality_score", F.round("raw_score", 2))


def statistical_fidelity(
    real: DataFrame, synth: DataFrame, columns: list[str] | None = None, scores: DataFrame | None = None,
) -> DataFrame:
    """One row: overall score, grade, status, correlation error and counts of analysed columns.

    ``scores`` are the ``column_scores`` of the pair where they are known already.
    """
    columns = columns or common_columns(real, synth)
    numbers = [c for c in numeric_columns(real) if c in columns]
    texts = [c for c in string_columns(real) if c in columns]
    scores = (column_scores(real, synth, columns) if scores is None else scores).select("raw_score")
    if len(numbers) >= 2:
        error = correlation_error(correlation_delta(real, synth, numbers))
    else:
        error = local_rows(
            real.sparkSession, [(0.0, 0.0)], "mean_absolute_error double, max_absolute_error double"
        )
    quality = at_least_zero(100.0 - F.col("mean_absolute_error") * 200.0)
    # the correlation is one more score next to those of the columns, in one small aggregate
    rows = scores.select("raw_score", F.lit(None).cast("double").alias("mae"), F.lit(None).cast("double").alias("top"))
    rows = rows.unionByName(error.select(
        quality.alias("raw_score"), F.col("mean_absolute_error").alias("mae"),
        F.col("max_absolute_error").alias("top"),
    ))
    total = rows.agg(
        F.round(F.avg("raw_score"), 2).alias("score"), F.max("mae").alias("correlation_mae"),
        F.max("top").alias("correlation_max_error"),
    )
    return total.select(
        "score", grade(F.col("score")).alias("grade"), status(F.col("score")).alias("status"),
        F.lit(len(columns)).alias("num_columns_analyzed"), F.lit(len(numbers)).alias("num_numeric"),
        F.lit(len(texts)).alias("num_categorical"), "correlation_mae", "correlation_max_error",
        F.round(at_least_zero(100.0 - F.col("correlation_mae") * 200.0), 2).alias("correlation_quality_score"),
    )


def statistical_warnings(scores: DataFrame, fidelity: DataFrame) -> DataFrame:
    """``(pillar, message)`` for significant column shifts and correlation divergence."""
    # The wording of the messages below
    p = F.col("p_value")
    shifted = scores.where(p < 0.01).select(F.lit("statistical").alias("pillar"), F.when(
        F.col("type") == "numerical",
        F.format_string("Numeric column '%s' has significant distribution shift (KS p=%s).", "column", p.cast("string")),
    ).otherwise(
        F.format_string("Categorical column '%s' has significant frequency shift (Chi2 p=%s).", "column", p.cast("string"))
    ).alias("message"))
    diverging = fidelity.where(F.col("correlation_mae") > 0.3).select(
        F.lit("statistical").alias("pillar"),
        F.format_string(
            "High correlation divergence across numeric features (MAE = %s).",
            F.col("correlation_mae").cast("string"),
        ).alias("message"),
    )
    return shifted.unionByName(diverging)
