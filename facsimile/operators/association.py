"""Rank correlation, Cramér's V and the correlation ratio, per side of a tagged union."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from facsimile.operators.freq import numeric_counts
from facsimile.operators.moments import correlations
from facsimile.operators.prefix import long_ranges, ordered_totals, value_ranges
from facsimile.session import cut_lineage, local_rows


# rank tables of up to this many numbers in all (eight megabytes) are broadcast
BROADCAST_NUMBERS = 1_000_000
# rows that a task counts at a time: levels are under 64 characters, so a block of 30 columns stays below a few hundred megabytes
BLOCK_ROWS = 65_536


def average_ranks(
    df: DataFrame, columns: list[str], by: list[str] | None = None, ranges: list[float] | None = None,
) -> DataFrame:
    """``(by..., column, value, rank)``: average rank of each distinct value; ties share it."""
    ranges = ranges if ranges is not None else value_ranges(df, columns)
    totals = ordered_totals(numeric_counts(df, columns, by), ranges, ["n"], by)
    return totals.select(
        *(by or []), "column", "value", (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("rank")
    )


def _rank_names(beside: list[str]) -> list[str]:
    return ["r", *[f"r{j}" for j in range(len(beside))]]


def _cells(of: dict[int, Column]) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(i).alias("column"), of[i].alias("value")) for i in of]))


def _value(name: str) -> Column:
    return F.col(name).cast("double") + F.lit(0.0)


def rank_tables(
    df: DataFrame, columns: list[str], beside: list[str], by: list[str], ranges: list[float] | None = None,
) -> tuple[DataFrame, list[int], list[int]]:
    """``(by..., column, value, r, r<j>...)`` by number of the column, and the numbers of columns whose tables may be
    broadcast, the smallest up to a counted total, and of the others.

    One pass counts every distinct value under all conditions at once and running counts give all ranks.
    """
    flags = [f"_p{j}" for j in range(len(beside))]
    marks = [*by, *[F.col(c).isNotNull().cast("long").alias(p) for c, p in zip(beside, flags)]]
    # read for the cuts, the sums of the ranges and within them
    counts = cut_lineage(
        df.select(*marks, _cells({i: _value(c) for i, c in enumerate(columns)})).where(F.col("value").isNotNull())
        .groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"n{p}") for p in flags])
    )
    measures, names = ["n", *[f"n{p}" for p in flags]], _rank_names(beside)
    totals = ordered_totals(counts, ranges if ranges is not None else long_ranges(counts), measures, by)
    ranks = cut_lineage(totals.select(
        *by, "column", "value", *[(F.col(f"{m}_before") + (F.col(m) + 1) / 2.0).alias(r) for m, r in zip(measures, names)]))
    sizes = {r["column"]: r["n"] for r in ranks.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    small, room = [], BROADCAST_NUMBERS // (len(names) + 2)
    for i in sorted(range(len(columns)), key=lambda i: sizes.get(i, 0)):
        if sizes.get(i, 0) <= room:
            small.append(i)
            room -= sizes.get(i, 0)
    return ranks, small, [i for i in range(len(columns)) if i not in small]


def _broadcast_ranks(
    current: DataFrame, ranks: DataFrame, small: list[int], columns: list[str], beside: list[str], by: list[str],
) -> DataFrame:
    """The ranks of small tables in place of the values ``_v<i>``."""
    for i in small:
        named = [F.col(r).alias(f"{columns[i]}__{r}") for r in _rank_names(beside)]
        lookup = ranks.where(F.col("column") == i).select(*by, F.col("value").alias(f"_v{i}"), *named)
        current = current.join(F.broadcast(lookup), [*by, f"_v{i}"], "left").drop(f"_v{i}")
    return current


def with_ranks(
    df: DataFrame, columns: list[str], beside: list[str], by: list[str] | None = None, ranges: list[float] | None = None,
    tables: tuple[DataFrame, list[int], list[int]] | None = None,
) -> DataFrame:
    """``by`` and each numeric column ``c`` as ``c__r`` and ``c__r<j>``: its average rank within ``by`` over the rows
    where it is present, and over those where the j-th column of ``beside`` is present too.

    Ranks (``tables``, or those of ``rank_tables``) return to the rows in two ways.  Small tables are broadcast.
    The cells of all other columns are melted and meet one table of ranks in one join, which the
    optimizer splits where a value is hot, and one grouping by row number puts the row together: two shuffles
    for any number of columns.
    """
    by, names = by or [], _rank_names(beside)
    ranks, small, large = tables or rank_tables(df, columns, beside, by, ranges)
    current = df.select(*by, *[_value(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    if large:
        # numbers of rows are the same in every later read only once they are written
        current = cut_lineage(current.withColumn("_row", F.monotonically_increasing_id()))
        melted = current.select("_row", *by, _cells({i: F.col(f"_v{i}") for i in large})).where(F.col("value").isNotNull())
        wanted = ranks.where(F.col("column").isin(large))
        joined = melted.join(wanted, [*by, "column", "value"]).select("_row", *by, "column", *names)
        # a row without any of these cells is there as well
        kept = [f"_v{i}" for i in small]
        pieces = joined.unionByName(current.select("_row", *by, *kept), allowMissingColumns=True)
        current = pieces.groupBy("_row", *by).agg(
            *[F.max(c).alias(c) for c in kept],
            *[F.max(F.when(F.col("column") == i, F.col(r))).alias(f"{columns[i]}__{r}") for i in large for r in names],
        ).drop("_row")
    return _broadcast_ranks(current, ranks, small, columns, beside, by)


def spearman(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(by..., col_i, col_j, r)`` for i < j: Pearson over average ranks, pairwise complete.

    Ranks depend on which rows take part: the rank of a value in a pair is the one among the rows where
    the other column is present.  Where one column only is too large to broadcast, its ranks need not
    return to the rows: its pairs are summed by its values.
    """
    by = by or []
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    beside = [c for i, c in enumerate(columns) if nulls[i]]
    rank = lambda c, other: f"{c}__r{beside.index(other) if other in beside else ''}"
    pairs = list(combinations(columns, 2))
    values = {(a, b): (rank(a, b), rank(b, a)) for a, b in pairs}
    ranks, small, large = tables = rank_tables(df, columns, beside, by)
    if len(large) != 1:
        return correlations(with_ranks(df, columns, beside, by, tables=tables), columns, by, values=values)

    name = columns[large[0]]
    rows = df.select(*by, *[_value(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    ranked = _broadcast_ranks(rows, ranks, small, columns, beside, by)
    others = [c for c in columns if c != name]
    mixed = _summed_by_value(df, rows, ranked, ranks.where(F.col("column") == large[0]), name, others, columns, by, rank)
    plain = [p for p in pairs if name not in p]
    return correlations(ranked, columns, by, plain, values).unionByName(mixed) if plain else mixed


def _summed_by_value(df, rows, ranked, ranks, name: str, others: list[str], columns: list[str], by: list[str], rank) -> DataFrame:
    """Rank correlations of the column ``name`` with ``others``: the ranks of these are summed by value of ``name``, and the
    sums meet the ranks of the values.  A shuffle of at most one row a value and task, whatever value is hot."""
    held = f"_v{columns.index(name)}"
    present = [F.count_if(F.col(name).isNotNull() & F.col(c).isNotNull()).alias(f"_n{k}") for k, c in enumerate(others)]
    # average ranks have this mean exactly; the table has one row a group
    middles = df.groupBy(*by).agg(*present).select(*by, *[((F.col(f"_n{k}") + 1) / 2.0).alias(f"_m{k}") for k in range(len(others))])
    beside_middles = lambda frame: frame.join(F.broadcast(middles), by, "left") if by else frame.crossJoin(F.broadcast(middles))
    moved = [(F.col(rank(c, name)) - F.col(f"_m{k}")).alias(f"_x{k}") for k, c in enumerate(others)]
    cells = beside_middles(ranked.where(F.col(held).isNotNull())).select(*by, held, *moved)
    sums = cells.groupBy(*by, held).agg(*[
        part for k in range(len(others)) for part in (
            F.count(f"_x{k}").alias(f"_c{k}"), F.sum(f"_x{k}").alias(f"_s{k}"), F.sum(F.col(f"_x{k}") * F.col(f"_x{k}")).alias(f"_q{k}"))
    ])
    met = beside_middles(sums.join(ranks.withColumnRenamed("value", held), [*by, held], "left"))
    own = lambda k: F.col(rank(name, others[k]).removeprefix(f"{name}__")) - F.col(f"_m{k}")
    wide = met.groupBy(*by).agg(*[
        F.when(F.sum(f"_c{k}") > 1, F.try_divide(
            F.sum(own(k) * F.col(f"_s{k}")), F.sqrt(F.sum(own(k) * own(k) * F.col(f"_c{k}"))) * F.sqrt(F.sum(f"_q{k}"))
        )).alias(f"_r{k}") for k in range(len(others))
    ])
    # a group without any value of the column has its pairs as well
    every = df.select(*by).distinct().join(wide, by, "left") if by else wide
    place = lambda c: (name, c) if columns.index(name) < columns.index(c) else (c, name)
    return every.select(*by, F.inline(F.array(*[
        F.struct(F.lit(place(c)[0]).alias("col_i"), F.lit(place(c)[1]).alias("col_j"), F.col(f"_r{k}").alias("r")) for k, c in enumerate(others)
    ])))


def level_key(name: str) -> Column:
    """A text cell as a level of its column: texts of 64 characters or more stand as their SHA-256."""
    text = F.col(name).cast("string")
    return F.when(F.length(text) < 64, text).otherwise(F.sha2(text, 256))


def contingency(df: DataFrame, pairs: list[tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """``(by..., col_i, col_j, a, b, n)``: joint counts of all pairs in one scan and one aggregate.

    Levels are ``level_key``.  Few pairs, two a column at most, are one row copy a pair.  For more pairs, up
    to the square of the columns, rows are not copied: tasks count blocks of coded rows and send counts, and the
    table is written, as its readers are several.
    """
    by = by or []
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    counted = len(pairs) > 2 * len(names)
    if not counted:
        cells = F.array(*[
            F.struct(F.lit(i).alias("col_i"), F.lit(j).alias("col_j"), level_key(i).alias("a"), level_key(j).alias("b")) for i, j in pairs
        ])
        counts = df.select(*by, F.inline(cells)).where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("n", F.lit(1))
    else:
        counts = block_counts(df, names, pairs, by)
    table = counts.groupBy(*by, "col_i", "col_j", "a", "b").agg(F.sum(F.col("n").cast("long")).alias("n"))
    return cut_lineage(table) if counted else table


def block_counts(df: DataFrame, names: list[str], pairs: list[tuple[str, str]], by: list[str], block: int = BLOCK_ROWS) -> DataFrame:
    """``(by..., col_i, col_j, a, b, n)`` counted within blocks of at most ``block`` rows of a task.

    A block holds each column as codes of its own levels.  A pair of columns costs a count over codes and
    sends its non-empty cells, so a block of few levels sends few rows whatever the number of rows.
    """
    slots = {c: k for k, c in enumerate(names)}
    tags = [f"_by{k}" for k in range(len(by))]
    plain = df.select(*[F.col(c).alias(t) for c, t in zip(by, tags)], *[level_key(c).alias(f"_c{k}") for c, k in slots.items()])
    schema = T.StructType([*plain.schema.fields[:len(by)], *[T.StructField(f, T.StringType()) for f in ("col_i", "col_j", "a", "b")], T.StructField("n", T.LongType())])
    wanted = to_arrow_schema(schema)

    def joint(codes: np.ndarray, sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
        """Non-empty cells, as one code a dimension, and their counts; -1 in any dimension leaves a row out."""
        codes = codes[:, (codes >= 0).all(axis=0)]
        flat = np.ravel_multi_index(tuple(codes), sizes) if codes.shape[1] else np.zeros(0, np.int64)
        cells, counts = np.unique(flat, return_counts=True) if math.prod(sizes) > 4 * block else tally(flat)
        return list(np.unravel_index(cells, sizes)), counts

    def tally(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(flat)
        cells = np.flatnonzero(counts)
        return cells, counts[cells]

    def coded(column: pa.ChunkedArray, null_is_level: bool) -> tuple[np.ndarray, pa.Array]:
        found = column.combine_chunks().dictionary_encode(null_encoding="encode" if null_is_level else "mask")
        return found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary

    def counted(table: pa.Table):
        groups, sides, held = np.zeros(table.num_rows, np.int64), [], []
        for t in tags:  # numbers of the groups that occur, never more than rows
            codes, levels = coded(table[t], True)
            both, groups = np.unique(groups * len(levels) + codes, return_inverse=True)
            sides, held = [*[side[both // len(levels)] for side in sides], both % len(levels)], [*held, levels]
        kinds = int(groups.max()) + 1
        cells = [coded(table[f"_c{k}"], False) for k in slots.values()]
        for i, j in pairs:
            (x, x_levels), (y, y_levels) = cells[slots[i]], cells[slots[j]]
            if not len(x_levels) or not len(y_levels):
                continue
            (g, a, b), counts = joint(np.stack([groups, x, y]), [kinds, len(x_levels), len(y_levels)])
            size = len(counts)
            yield pa.RecordBatch.from_arrays([
                *[levels.take(pa.array(side[g])) for levels, side in zip(held, sides)],
                pa.repeat(i, size), pa.repeat(j, size), x_levels.take(pa.array(a)), y_levels.take(pa.array(b)), pa.array(counts, pa.int64()),
            ], schema=wanted)

    def count_blocks(batches):
        waiting, rows = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                if rows + part.num_rows > block:
                    yield from counted(pa.Table.from_batches(waiting))
                    waiting, rows = [], 0
                waiting.append(part)
                rows += part.num_rows
        if rows:
            yield from counted(pa.Table.from_batches(waiting))

    return plain.mapInArrow(count_blocks, schema).withColumnsRenamed(dict(zip(tags, by)))


def cramers_v(df: DataFrame, pairs: list[tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """``(by..., col_i, col_j, v)``: bias-corrected, with the continuity correction for 2 x 2 tables.

    The statistic comes from the non-empty cells and the margins alone: empty cells add their expected
    count, and expected counts add up to the table total.
    """
    by = by or []
    keys = [*by, "col_i", "col_j"]
    table = contingency(df, pairs, by)
    left = table.groupBy(*keys, "a").agg(F.sum("n").alias("n_a"))
    right = table.groupBy(*keys, "b").agg(F.sum("n").alias("n_b"))
    square = lambda c: F.sum(F.col(c).cast("double") * F.col(c))
    left_side = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("r"), square("n_a").alias("sq_a"), F.sum("n_a").alias("n"))
    right_side = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), square("n_b").alias("sq_b"))
    cells = table.join(left, [*keys, "a"]).join(right, [*keys, "b"]).groupBy(*keys).agg(
        F.sum(F.col("n").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("mass")
    )
    joined = cells.join(left_side, keys).join(right_side, keys)

    n = F.col("n").cast("double")
    plain = n * (F.col("mass") - 1.0)
    # 2 x 2: every |observed - expected| is the same number; recover it and shrink it by one half
    margins = ((n * n - F.col("sq_a")) / 2.0) * ((n * n - F.col("sq_b")) / 2.0)
    gap = F.sqrt(F.greatest(F.lit(0.0), plain) * margins / F.pow(n, F.lit(3)))
    corrected = F.try_divide(F.pow(F.greatest(F.lit(0.0), gap - 0.5), F.lit(2)) * F.pow(n, F.lit(3)), margins)
    chi2 = F.when((F.col("r") == 2) & (F.col("k") == 2), corrected).otherwise(plain)

    r1, k1 = F.col("r") - 1.0, F.col("k") - 1.0
    phi = F.greatest(F.lit(0.0), chi2 / n - F.try_divide(k1 * r1, n - 1.0))
    spread = F.least(
        F.col("k") - F.try_divide(k1 * k1, n - 1.0) - 1.0,
        F.col("r") - F.try_divide(r1 * r1, n - 1.0) - 1.0,
    )
    usable = (n > 1) & (F.col("r") >= 2) & (F.col("k") >= 2) & (spread > 0)
    value = F.least(F.lit(1.0), F.sqrt(F.try_divide(phi, spread)))
    found = joined.select(*keys, F.when(usable, value).otherwise(F.lit(0.0)).alias("v"))
    return _all_pairs(df, found, pairs, by, "v")


def _all_pairs(df: DataFrame, found: DataFrame, pairs: list[tuple[str, str]], by: list[str], value: str) -> DataFrame:
    """Pairs without any complete row get 0."""
    listed = local_rows(df.sparkSession, pairs, "col_i string, col_j string")
    if by:
        sides = df.select(*by).distinct()
        wanted = F.array(*[F.struct(F.lit(i).alias("col_i"), F.lit(j).alias("col_j")) for i, j in pairs])
        listed = sides.select(*by, F.inline(wanted))
    keys = [*by, "col_i", "col_j"]
    return listed.join(found, keys, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def correlation_ratio(df: DataFrame, pairs: list[tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """``(by..., col_i, col_j, eta)`` for (category, number) pairs; a null category is a level of its own.

    The between-group sum is divided by the row count and the total variance by one less, as published.
    """
    by = by or []
    parts = []
    for category in dict.fromkeys(c for c, _ in pairs):
        numbers = [m for c, m in pairs if c == category]
        values = {m: F.col(m).cast("double") for m in numbers}
        level = F.coalesce(F.col(category).cast("string"), F.lit("nan"))
        groups = df.withColumn("level", level).groupBy(*by, "level").agg(
            *[F.count(m).alias(f"{i}_n") for i, m in enumerate(numbers)],
            *[F.avg(values[m]).alias(f"{i}_mean") for i, m in enumerate(numbers)],
            *[F.coalesce(F.var_pop(values[m]), F.lit(0.0)).alias(f"{i}_var") for i, m in enumerate(numbers)],
        )
        rows = groups.select(*by, F.inline(F.array(*[
            F.struct(
                F.lit(category).alias("col_i"), F.lit(m).alias("col_j"), F.col(f"{i}_n").alias("n"),
                F.col(f"{i}_mean").alias("mean"), F.col(f"{i}_var").alias("within"),
            )
            for i, m in enumerate(numbers)
        ]))).where(F.col("n") > 0)
        parts.append(rows)
    levels = reduce(DataFrame.unionByName, parts)
    keys = [*by, "col_i", "col_j"]
    overall = levels.groupBy(*keys).agg(
        F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")
    )
    summed = levels.join(overall, keys).groupBy(*keys).agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2))).alias("between"),
        F.sum(F.col("n") * F.col("within")).alias("inside"),
        F.max("total").alias("total"),
    )
    variance = F.try_divide(F.col("between") + F.col("inside"), F.col("total") - 1.0)
    eta = F.sqrt(F.try_divide(F.col("between") / F.col("total"), variance))
    usable = (F.col("total") >= 2) & (variance > 1e-12)
    found = summed.select(*keys, F.when(usable, F.least(F.lit(1.0), eta)).otherwise(F.lit(0.0)).alias("eta"))
    return _all_pairs(df, found, pairs, by, "eta")
