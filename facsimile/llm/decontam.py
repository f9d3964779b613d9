"""Benchmark decontamination: which documents hold which test items.

Containment of an item in a document is the share of the item's distinct word shingles that the document
has.  An item with n shingles and containment of at least t misses at most n - ceil(t n) of them, so any
n - ceil(t n) + 1 of them include one that the document has.  The search takes the smallest hashes (a
MinHash sketch) of an item as those shingles; items are partitioned by size, [1, 2), [2, 4), [4, 8), ...,
and every partition has the sketch length that its largest size needs.  So the candidates are complete,
however long the document.  Candidates are then verified on the shingles themselves, not on hashes.

Only DataFrame expressions.  Arrays are opened with ``explode_outer``: for ``explode`` the optimizer pushes a
test of the array's size below the projections that build it, and would build it again for each element.
The sketch table, and then the list of candidate texts (64-bit hashes), are broadcast when counted at
``BROADCAST_ROWS`` rows at most; larger ones are joined by shuffle, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import BROADCAST_ROWS, columns_but, counted, free_name, let, stored

SHINGLE = 5
THRESHOLD_PERCENT = 80


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(listed: Column, make, width: int) -> Column:
    """The results of ``make`` over every run of ``width`` words; of all words where there are fewer; none of none."""
    runs = lambda a: F.when(
        F.size(a) >= width,
        F.transform(F.sequence(F.lit(1), F.size(a) - width + 1), lambda i: make([F.element_at(a, (i + k).cast("int")) for k in range(width)])),
    ).when(F.size(a) > 0, F.array(make([F.array_join(a.cast("array<string>"), "\x00")])))
    return let(listed, runs)


def hashed_shingles(text: Column, width: int = SHINGLE) -> Column:
    """One 64-bit hash for each shingle position of ``text``."""
    return _shingles(F.transform(words(text), lambda w: F.xxhash64(w)), lambda parts: F.xxhash64(*parts), width)


def whole_shingles(text: Column, width: int = SHINGLE) -> Column:
    return F.array_distinct(_shingles(words(text), lambda parts: F.concat_ws(" ", *parts), width))


def sketches(items: DataFrame, percent: int = THRESHOLD_PERCENT, width: int = SHINGLE) -> DataFrame:
    """(item_id, hash): the sketch of every item of ``items`` (item_id, text); items without words have none."""
    largest = lambda s: F.pow(F.lit(2.0), F.length(F.bin(F.size(s)))).cast("int") - 1
    smallest = lambda s: F.slice(s, F.lit(1), largest(s) - F.ceil(largest(s) * percent / 100.0).cast("int") + 1)
    sketch = let(F.array_sort(F.array_distinct(hashed_shingles(F.col("text"), width))), smallest)
    return items.select("item_id", F.explode_outer(sketch).alias("hash")).where("hash IS NOT NULL").distinct()


def candidates(documents: DataFrame, sketch: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(_doc, item_id): texts, named by a 64-bit hash, that have a sketch shingle of an item."""
    exploded = documents.select(F.xxhash64(text).alias("_doc"), F.explode_outer(hashed_shingles(F.col(text), width)).alias("hash"))
    return exploded.join(counted(stored(sketch, "sketch")), "hash").select("_doc", "item_id").distinct()


def contained(documents: DataFrame, items: DataFrame, percent: int = THRESHOLD_PERCENT, width: int = SHINGLE, text: str = "text") -> DataFrame:
    """``documents`` columns with item_id, n_shared, n_item: a row for each item held by at least ``percent``.

    Words are lower-cased runs of letters and digits.  Items with fewer than ``width`` words are one
    shingle and are found only in texts that are that same sequence; null or wordless items and texts
    match nothing.  Repeated documents give repeated rows; repeated items (same id and text) count once,
    and items that share an id but not the text are judged apart.
    """
    listed = items.select("item_id", "text").distinct()
    pairs = candidates(documents, sketches(listed, percent, width), text, width)
    parts = listed.select("item_id", whole_shingles(F.col("text"), width).alias("_parts"))
    wanted = stored(
        pairs.join(parts, "item_id").groupBy("_doc").agg(F.collect_list(F.struct("item_id", "_parts")).alias("_items")), "candidates")
    names = columns_but(documents.columns, ("item_id", "n_shared", "n_item"))
    doc, held, found = (free_name(documents, c) for c in ("_doc", "_items", "_m"))
    wanted = wanted.select(F.col("_doc").alias(doc), F.col("_items").alias(held))
    keys = wanted.select(doc)
    texts = documents.select(*names).withColumn(doc, F.xxhash64(text))
    if keys.count() <= BROADCAST_ROWS:  # so that only texts with a candidate are shuffled to the join below
        texts = texts.join(F.broadcast(keys), doc, "left_semi")
    shared = lambda has: F.transform(held, lambda i: F.struct(
        i["item_id"].alias("item_id"), F.size(F.array_intersect(i["_parts"], has)).cast("long").alias("n_shared"), F.size(i["_parts"]).cast("long").alias("n_item")))
    return (
        texts.join(wanted, doc)
        .select(*names, F.explode_outer(let(whole_shingles(F.col(text), width), shared)).alias(found)).select(*names, f"{found}.*")
        .where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    )


def clean(documents: DataFrame, items: DataFrame, percent: int = THRESHOLD_PERCENT, width: int = SHINGLE, text: str = "text") -> DataFrame:
    """``documents`` without the rows whose text holds an item.

    Null, empty and wordless texts hold none and stay.  Repeated rows go or stay together, an empty table
    stays empty, and columns keep their names, order and values whatever they are called.
    """
    key = free_name(documents, "_text")
    marked = documents.select(F.sha2(text, 256).alias(key), F.col(text).alias("text"))
    held = stored(contained(marked, items, percent, width).select(key).distinct(), "contaminated")
    return documents.withColumn(key, F.coalesce(F.sha2(text, 256), F.lit(""))).join(counted(held), key, "left_anti").drop(key).select(*documents.columns)
