"""Approximate k nearest neighbours by random-projection buckets: cost in proportion to the rows.

Each of several tables gives a vector a code of signs: on which side of the mean it lies along random +-1 directions.
A point and a query meet where the codes agree on as many leading signs as it takes to leave few enough points
together, so a dense region is divided further than a sparse one.  A bucket that even the full code leaves too large
is cut into parts of equal size; every point is in one part of one bucket a table, and is compared with the queries of that
part only.  A query keeps its k best of all tables; distances are exact, neighbours may be missed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.session import cut_lineage


@dataclass(frozen=True)
class Buckets:
    """``leaf_rows``: points of a bucket, at most; ``signs``: length of a full code.  More tables and larger buckets find more."""

    tables: int = 12
    signs: int = 20
    leaf_rows: int = 1024
    query_rows: int = 4096
    seed: int = 7


def directions(settings: Buckets, width: int) -> np.ndarray:
    """(tables * signs, width) of +-1: the lowest bit of the first hex digit of md5(``seed|table|sign|component``), so that any engine can repeat them."""
    digit = lambda t, s, c: int(hashlib.md5(f"{settings.seed}|{t}|{s}|{c}".encode()).hexdigest()[0], 16)
    return np.array([[1.0 if digit(t, s, c) % 2 else -1.0 for c in range(width)] for t in range(settings.tables) for s in range(settings.signs)])


def _coded(settings: Buckets, lines: np.ndarray, middle: np.ndarray):
    def code(batches):
        for batch in batches:
            x = np.array(batch["features"].tolist(), dtype="float64").reshape(len(batch), -1)
            for low in range(0, len(x), 4096):
                side = np.round((x[low : low + 4096] - middle) @ lines.T, 9) >= 0
                text = np.where(side, "1", "0").reshape(-1, settings.tables, settings.signs)
                part = batch.iloc[low : low + 4096]
                yield part.assign(codes=[["".join(t) for t in row] for row in text])
    return code


def _nearest(k: int):
    def near(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "best": pd.Series(dtype="object")})
        a = np.array(queries["features"].tolist(), dtype="float64")
        b = np.array(points["features"].tolist(), dtype="float64")
        h, copies = points["h"].to_numpy(), points["copies"].to_numpy()
        few, best = min(k, len(b)), []
        step = max(1, int(4e6 // max(1, b.size)))
        for low in range(0, len(a), step):
            # differences, not the expanded square: equal vectors are exactly 0 apart
            d = np.sqrt(((a[low : low + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
            nearest = np.argpartition(d, few - 1, axis=1)[:, :few]
            for i, at in enumerate(nearest):
                best.append([{"d": float(d[i, j]), "h": int(h[j]), "copies": int(copies[j])} for j in at])
        return pd.DataFrame({"q": queries["h"].to_numpy(), "best": best})
    return near


def _parts(counts: DataFrame, settings: Buckets) -> DataFrame:
    """(table, code, bucket, parts): for each full code the shortest prefix that few enough points share, the full code if none is."""
    each = counts.select("table", "code", "n", F.explode(F.sequence(F.lit(0), F.lit(settings.signs))).alias("length"))
    prefix = F.substring(F.col("code"), F.lit(1), F.col("length"))
    held = each.groupBy("table", "length", prefix.alias("bucket")).agg(F.sum("n").alias("held"))
    sized = each.withColumn("bucket", prefix).join(held, ["table", "length", "bucket"])
    fits = F.when(F.col("held") <= settings.leaf_rows, F.struct("length", "bucket"))
    return sized.groupBy("table", "code").agg(F.min(fits).alias("fit"), F.max("n").alias("n")).select(
        "table", "code", F.coalesce("fit.bucket", "code").alias("bucket"),
        F.when(F.col("fit").isNull(), F.ceil(F.col("n") / settings.leaf_rows)).otherwise(1).cast("long").alias("parts"))


def near_distances(queries: DataFrame, points: DataFrame, k: int, settings: Buckets = Buckets()) -> DataFrame:
    """``(features, n, distances)`` like ``knn.nearest_distances``: the k smallest distances found to each distinct query vector.

    Both inputs are ``grouped_vectors``; copies of a point count as separate neighbours.  A query whose bucket
    holds fewer than k points in every table gets fewer distances, an empty table of points none.
    """
    digest = F.xxhash64("features")
    points = cut_lineage(points.select("features", F.least(F.col("n"), F.lit(k)).cast("int").alias("copies"), digest.alias("h")))
    queries = cut_lineage(queries.select("features", "n", digest.alias("h")))
    first = points.limit(1).collect()
    if not first:
        return queries.select("features", "n", F.array().cast("array<double>").alias("distances"))
    width = len(first[0]["features"])
    row = points.agg(*[F.avg(F.col("features")[i]) for i in range(width)]).first()
    code = _coded(settings, directions(settings, width), np.array([round(v, 9) for v in row], dtype="float64"))
    listed = lambda df, schema: df.mapInPandas(code, schema + ", codes array<string>").select("*", F.posexplode("codes").alias("table", "code")).drop("codes")
    coded = cut_lineage(listed(points, "features array<double>, copies int, h long"))
    counts = coded.groupBy("table", "code").agg(F.count(F.lit(1)).alias("n"))
    parts = cut_lineage(_parts(counts, settings))
    placed = coded.join(parts, ["table", "code"]).withColumn("part", F.pmod("h", "parts"))
    asked = cut_lineage(listed(queries.select("features", "h"), "features array<double>, h long"))
    # a query's bucket is the one whose name its code begins with, also where no point has that code
    reach = parts.groupBy("table", "bucket").agg(F.max("parts").alias("parts"))
    own = asked.select("table", "code").distinct().select("table", "code", F.explode(F.sequence(F.lit(0), F.lit(settings.signs))).alias("length")).withColumn(
        "bucket", F.substring(F.col("code"), F.lit(1), F.col("length"))).join(reach, ["table", "bucket"]).select("table", "code", "bucket", "parts")
    met = asked.join(own, ["table", "code"]).withColumn("part", F.pmod("h", "parts")).select("features", "h", "table", "bucket", "part")
    sizes = cut_lineage(met.groupBy("table", "bucket", "part").agg(F.ceil(F.count(F.lit(1)) / settings.query_rows).alias("blocks")))
    keys = ["table", "bucket", "part"]
    left = met.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("h", F.lit(2)), F.col("blocks")))
    right = placed.join(sizes, keys).select(
        *keys, "features", "copies", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    by = [*keys, "block"]
    # both sides may be one table: give the second columns of its own
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_nearest(k), "q long, best array<struct<d: double, h: long, copies: int>>")
    # a point met in several tables counts once
    merged = found.groupBy("q").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))).alias("best"))
    each = F.transform("best", lambda x: F.array_repeat(x["d"], x["copies"]))
    return queries.join(merged, queries["h"] == merged["q"], "left").select(
        "features", "n", F.coalesce(F.slice(F.flatten(each), 1, k), F.array().cast("array<double>")).alias("distances"))
