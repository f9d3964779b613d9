"""Moments and Pearson correlation of numeric columns in one scan."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from facsimile.operators.columns import long_rows
from facsimile.session import local_rows

# groups whose moments a task holds before it sends them
MAX_GROUPS = 256


def numeric_moments(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(by..., column, n, n_missing, mean, std, variance, min, max)`` with sample deviations."""
    by = by or []
    value = lambda c: F.col(c).cast("double")
    wide = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"{i}_n") for i, c in enumerate(columns)],
        *[F.avg(value(c)).alias(f"{i}_mean") for i, c in enumerate(columns)],
        *[F.var_samp(value(c)).alias(f"{i}_var") for i, c in enumerate(columns)],
        *[F.min(value(c)).alias(f"{i}_min") for i, c in enumerate(columns)],
        *[F.max(value(c)).alias(f"{i}_max") for i, c in enumerate(columns)],
    )
    fields = {
        c: {
            "n": F.col(f"{i}_n"),
            "n_missing": F.col("rows") - F.col(f"{i}_n"),
            "mean": F.col(f"{i}_mean"),
            "std": F.sqrt(f"{i}_var"),
            "variance": F.col(f"{i}_var"),
            "min": F.col(f"{i}_min"),
            "max": F.col(f"{i}_max"),
        }
        for i, c in enumerate(columns)
    }
    return wide.select(*by, F.inline(long_rows(columns, fields)))


def _co_moments(x: np.ndarray, left: list[int], right: list[int]) -> np.ndarray:
    """``(n, mean_x, mean_y, sxx, syy, sxy)`` by pair of columns, over the rows where both are present; NaN is missing."""
    seen = ~np.isnan(x)
    held, counts = seen.astype(np.float64), seen.sum(axis=0)
    with np.errstate(all="ignore"):
        means = np.where(seen, x, 0.0).sum(axis=0) / np.maximum(counts, 1)
        # a value of the column itself near its mean: what is constant is exactly zero from there
        near = np.argmin(np.where(seen, np.abs(x - means), np.inf), axis=0)
        shift = np.where(counts > 0, x[near, np.arange(x.shape[1])], 0.0)
        y = np.where(seen, x - shift, 0.0)
        sums, squares = y.T @ held, (y * y).T @ held
        n = (held.T @ held)[left, right]
        some = np.maximum(n, 1.0)
        sx, sy, qx, qy = sums[left, right], sums[right, left], squares[left, right], squares[right, left]
        found = np.stack([
            n, shift[left] + sx / some, shift[right] + sy / some,
            qx - sx * sx / some, qy - sy * sy / some, (y.T @ y)[left, right] - sx * sy / some,
        ])
        # far from the shift for their spread, or not finite somewhere: measured from a row of their own
        doubtful = (found[3] < 1e-6 * qx) | (found[4] < 1e-6 * qy) | ~np.isfinite(found).all(axis=0)
        for p in np.flatnonzero(doubtful & (n > 0)):
            both = x[seen[:, left[p]] & seen[:, right[p]]][:, [left[p], right[p]]]
            own = both - both[0]
            spread = own - np.where((own == 0).all(axis=0), 0.0, own.mean(axis=0))
            found[1:, p] = [*(both[0] + own.mean(axis=0)), *(spread * spread).sum(axis=0), (spread[:, 0] * spread[:, 1]).sum()]
        found[1:, n == 0] = 0.0
    return found


def _merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Co-moments of two sets of rows together."""
    n = a[0] + b[0]
    some = np.maximum(n, 1.0)
    apart = np.where((a[0] > 0) & (b[0] > 0), b[1:3] - a[1:3], 0.0)
    means = np.where(a[0] > 0, a[1:3] + apart * (b[0] / some), b[1:3])
    weight = a[0] * b[0] / some
    moved = np.stack([apart[0] * apart[0], apart[1] * apart[1], apart[0] * apart[1]]) * weight
    return np.concatenate([n[None], means, a[3:] + b[3:] + moved])


def correlations(
    df: DataFrame, columns: list[str], by: list[str] | None = None, pairs: list[tuple[str, str]] | None = None,
    values: dict[tuple[str, str], tuple[str, str]] | None = None,
) -> DataFrame:
    """``(by..., col_i, col_j, r)`` for i < j in column order, or given pairs; r null where undefined, NaN missing.

    ``values`` names the two columns of ``df`` to correlate for each pair where they are not the pair itself.  A task
    multiplies blocks of rows as matrices, all pairs at once, and sends one row of moments a pair and group: one scan for any
    number of columns.
    """
    by = by or []
    pairs = pairs or list(combinations(columns, 2))
    wanted = [values[pair] if values else pair for pair in pairs]
    slots = {c: k for k, c in enumerate(dict.fromkeys(c for pair in wanted for c in pair))}
    left, right = [slots[x] for x, _ in wanted], [slots[y] for _, y in wanted]
    tags = [f"_by{k}" for k in range(len(by))]
    plain = df.select(*[F.col(c).alias(t) for c, t in zip(by, tags)], *[F.col(c).cast("double").alias(f"_v{k}") for c, k in slots.items()])
    measures = ["n", "mean_x", "mean_y", "sxx", "syy", "sxy"]
    schema = T.StructType([
        *plain.schema.fields[:len(by)], T.StructField("pair", T.IntegerType()), *[T.StructField(m, T.DoubleType()) for m in measures],
    ])
    arrow_schema = to_arrow_schema(schema)

    def grouped(batch: pa.RecordBatch) -> list[tuple[list[pa.Scalar], np.ndarray | slice]]:
        """The groups of a batch: their values of ``by`` and their rows."""
        if not tags:
            return [([], slice(None))]
        codes, firsts = np.zeros(batch.num_rows, np.int64), []
        for t in tags:  # numbers of the groups that occur, never more than rows
            levels = batch.column(t).dictionary_encode(null_encoding="encode")
            codes = codes * len(levels.dictionary) + levels.indices.to_numpy(zero_copy_only=False)
            _, firsts, codes = np.unique(codes, return_index=True, return_inverse=True)
        order = np.argsort(codes, kind="stable")
        rows = np.split(order, np.cumsum(np.bincount(codes))[:-1])
        return [([batch.column(t)[int(first)] for t in tags], part) for first, part in zip(firsts, rows)]

    def rows_of(held: list) -> pa.RecordBatch:
        size = len(pairs)
        lead = [
            pa.concat_arrays([pa.repeat(key[k], size).cast(arrow_schema.field(k).type) for key, _ in held]) for k in range(len(tags))
        ]
        found = np.concatenate([moments for _, moments in held], axis=1)
        return pa.RecordBatch.from_arrays(
            [*lead, pa.array(np.tile(np.arange(size, dtype=np.int32), len(held))), *[pa.array(m) for m in found]], schema=arrow_schema,
        )

    def measured(batches):
        state = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(f"_v{k}").to_numpy(zero_copy_only=False) for k in range(len(slots))], axis=1)
            for key, rows in grouped(batch):
                name, found = tuple(v.as_py() for v in key), _co_moments(x[rows], left, right)
                state[name] = (key, _merged_moments(state[name][1], found) if name in state else found)
            if len(state) > MAX_GROUPS:
                yield rows_of(list(state.values()))
                state = {}
        if state:
            yield rows_of(list(state.values()))

    parts = plain.mapInArrow(measured, schema)
    if not by:  # an empty table has its pairs as well
        parts = parts.unionByName(local_rows(df.sparkSession, [(i, *[0.0] * 6) for i in range(len(pairs))], "pair int, " + ", ".join(f"{m} double" for m in measures)))
    group = Window.partitionBy(*tags, "pair")
    away = lambda m: F.col(m) - F.min(F.when(F.col("n") > 0, F.col(m))).over(group)
    moved = parts.withColumns({"dx": away("mean_x"), "dy": away("mean_y")})
    part = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b)) - F.try_divide(F.sum(F.col("n") * F.col(a)) * F.sum(F.col("n") * F.col(b)), F.sum("n"))
    total = lambda s, a, b: F.sum(s) + F.coalesce(part(a, b), F.lit(0.0))
    summed = moved.groupBy(*tags, "pair").agg(
        F.sum("n").alias("n"), total("sxx", "dx", "dx").alias("sxx"), total("syy", "dy", "dy").alias("syy"), total("sxy", "dx", "dy").alias("sxy"),
    )
    r = F.when(F.col("n") > 1, F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy")))
    listed = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in pairs])
    named = summed.withColumn("_pair", F.get(listed, F.col("pair")))
    return named.select(*[F.col(t).alias(c) for c, t in zip(by, tags)], F.col("_pair.i").alias("col_i"), F.col("_pair.j").alias("col_j"), r.alias("r"))


def correlation_cells(
    df: DataFrame, columns: list[str], by: list[str] | None = None, pairs: DataFrame | None = None,
) -> DataFrame:
    """All k x k cells ``(by..., col_i, col_j, r)``; undefined cells, also on the diagonal, are 0."""
    by = by or []
    upper = pairs if pairs is not None else correlations(df, columns, by)
    upper = upper.withColumn("r", F.coalesce("r", F.lit(0.0)))
    lower = upper.select(*by, F.col("col_j").alias("col_i"), F.col("col_i").alias("col_j"), "r")
    spread = numeric_moments(df, columns, by)
    diagonal = spread.select(
        *by, F.col("column").alias("col_i"), F.col("column").alias("col_j"),
        F.when(F.col("variance") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("r"),
    )
    return upper.unionByName(lower).unionByName(diagonal)
