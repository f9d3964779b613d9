"""Connected components by alternating large-star and small-star rounds over an edge table.

Every round keeps, for each node, an edge to the smallest neighbour it knows.  Minima are taken with
map-side aggregation, so that a hub with a third of all edges is one row per task before the shuffle;
the joins back to the edges are plain equi-joins that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import drop_stored, stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("t"),
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by ``edges`` (columns a, b), for each node that has one.

    Null ends and loops are ignored; an empty table gives an empty table.  Values of a and b need an
    order and equality only.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = stored(pairs.distinct(), "edges")
    mark = _mark(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
        )
        following = stored(small.distinct(), "edges")
        seen = _mark(following)
        drop_stored(current)
        current = following
        if seen == mark:
            break
        mark = seen
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
