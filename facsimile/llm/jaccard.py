"""Exact Jaccard join of word-shingle sets, skipping by relations of sets, and the components of its links.

Equal sets are one representative.  Candidates come from prefixes: with one order of all shingles, two
sets that link share one of their first |x| - ceil(t |x|) + 1 shingles.  The order is rare first, by a
sketch of shingle counts over all documents; any fixed order is exact, this one keeps lists short.

Relations between sets are then used to skip work.  This departs from set-relation skipping as published: no list
is skipped in blocks by position, and no set's answers are derived from a similar set's answers:

* Lists of shared prefix shingles are not crossed one by one.  Every list has a leader, its smallest
  member, and all lists of one leader form one bundle, so sets that share many shingles meet once.
* A bundle is cut into blocks by size; blocks whose sizes cannot reach the threshold are skipped.
* Every set carries a parity bitmap of its shingles.  The bits in which two bitmaps differ are a lower
  bound of the symmetric difference, so most pairs are refused without their sets.
* What is left of a bundle answers for itself through its most similar pairs: first only a spanning forest
  of the remaining pairs is verified on the whole sets.  Sets that a verified link joins need no pair
  among them any more; the pairs that still lie between different components are verified then.

A hot bundle is dealt to block pairs of bounded size; no task holds more than two blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facsimile.llm.common import counted, drop_stored, free_name, small_batches, stored
from facsimile.llm.components import components
from facsimile.llm.tokens import buffers, byte_table, hash_words, mixed, portions, runs_hashed, word_bounds

SKETCH_BITS, SKETCH_PARTS = 20, 64
BLOCK_ROWS = 1024  # sets of a block
FAR = 1 << 30
_TABLE = byte_table(202, lower=True)
_FIRST, _SECOND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Settings:
    """Sets link when 100 * intersection >= percent * union of their shingles of ``width`` words."""

    width: int = 4
    percent: int = 85


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, first): the sorted distinct shingle hashes of each row, one row after the other.

    A row with fewer words than ``width`` has one shingle, its whole sequence; one without words has none.
    """
    starts, ends, first = word_bounds(data, at)
    words = hash_words(data, starts, ends, _TABLE)[0]
    sizes = np.diff(first)
    runs = runs_hashed(words, width, 3)
    owner = np.repeat(np.arange(len(sizes)), np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(int)))
    values = np.empty(len(owner), np.uint64)
    out = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))]).astype(np.int64)
    full = np.flatnonzero(sizes >= width)
    if len(full):
        picks = np.repeat(first[:-1][full] - out[:-1][full], np.diff(out)[full]) + np.flatnonzero((sizes >= width)[owner])
        values[(sizes >= width)[owner]] = runs[picks]
    for row in np.flatnonzero((sizes > 0) & (sizes < width)):
        values[out[row]] = runs_hashed(words[first[row] : first[row + 1]], int(sizes[row]), 3 + int(sizes[row]))[0]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))]).astype(np.int64)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def _profiled(width: int):
    """Rows of kind 0: n, one, two (size and 128-bit digest of the set of a document); of kind 1: a part of the task's shingle counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["kind", "id", "n", "one", "two", "counts"]
        for batch, data, at in portions(batches, "_text"):
            values, first = shingle_sets(data, at, width)
            np.add.at(counts, (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(rows, np.int32)), batch.column(0), pa.array(np.diff(first)), pa.array(_sums(mixed(values ^ _FIRST), first)),
                pa.array(_sums(mixed(values ^ _SECOND), first)), pa.nulls(rows, pa.binary())], names)
        part = len(counts) // SKETCH_PARTS
        blobs = [zlib.compress(counts[k * part : (k + 1) * part].tobytes(), 1) for k in range(SKETCH_PARTS)]
        zero = pa.array(np.zeros(SKETCH_PARTS, np.int64))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.ones(SKETCH_PARTS, np.int32)), zero, pa.array(np.arange(SKETCH_PARTS)), zero, zero, pa.array(blobs, pa.binary())], names)

    return scan


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the sketch parts that reach this task, one at a time."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = np.frombuffer(zlib.decompress(blob.as_py()), np.uint32).astype(np.uint64)
            held[part] = held[part] + counts if part in held else counts
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int64()), pa.array([zlib.compress(c.tobytes(), 1) for c in held.values()], pa.binary())], ["n", "counts"])


def prefix_length(sizes: np.ndarray, percent: int) -> np.ndarray:
    return sizes + (-sizes * percent) // 100 + 1


def _postings(width: int, percent: int, counts: np.ndarray):
    """(shingle, id) of the rare-first prefix of each document's set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in portions(batches, "_text"):
            values, first = shingle_sets(data, at, width)
            sizes = np.diff(first)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            common = counts[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.lexsort((values, common, owner))
            place = np.arange(len(values)) - first[:-1][owner]
            order = order[place < prefix_length(sizes, percent)[owner]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[order].view(np.int64)), batch.column(0).take(pa.array(owner[order]))], ["shingle", "id"])

    return scan


def bitmap_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: the power of two from twice its size on, 256 at least."""
    return np.maximum(256, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))


def parity(values: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _described(width: int, percent: int):
    """(id, size, members, bits, map, low): one row for the size class of the set, and one folded for the class below where a partner may be there."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in portions(batches, "_text"):
            values, first = shingle_sets(data, at, width)
            sizes = np.diff(first)
            bits = bitmap_bits(sizes)
            ids, rows = batch.column(0).to_pylist(), []
            for k in range(len(sizes)):
                members = values[first[k] : first[k + 1]]
                bitmap = parity(members, int(bits[k]))
                rows.append((ids[k], sizes[k], members.tobytes(), bits[k], bitmap.tobytes(), True))
                if bits[k] > 256 and sizes[k] * percent <= 100 * (bits[k] // 4):  # the class below ends at bits / 4
                    half = len(bitmap) // 2
                    rows.append((ids[k], sizes[k], None, bits[k] // 2, (bitmap[:half] ^ bitmap[half:]).tobytes(), False))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "size", "members", "bits", "map", "low"])

    return scan


def possible(maps: np.ndarray, sizes: np.ndarray, low: np.ndarray, ids: np.ndarray, percent: int) -> np.ndarray:
    """(rows, rows) lower bounds of the symmetric difference; FAR where the pair cannot link."""
    n = len(ids)
    out = np.full((n, n), FAR, np.int32)
    step = max(1, (1 << 19) // max(1, n * maps.shape[1]))
    for a in range(0, n, step):
        b = min(n, a + step)
        both = sizes[a:b, None] + sizes[None]
        ok = (np.maximum(sizes[a:b, None], sizes[None]) * percent <= 100 * np.minimum(sizes[a:b, None], sizes[None]))
        ok &= (low[a:b, None] | low[None]) & (ids[a:b, None] != ids[None])
        if not ok.any():
            continue
        apart = np.bitwise_count(maps[a:b, None] ^ maps[None]).sum(axis=2, dtype=np.int32)
        # 100 I >= p U with I = (s - d) / 2 and U = (s + d) / 2 for a difference of d and a sum of sizes s
        out[a:b] = np.where(ok & (100 * (both - apart) >= percent * (both + apart)), apart, FAR)
    return out


def forest(bounds: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest with the least bounds, by Prim's method; pairs at FAR are no edges."""
    n, edges = len(bounds), []
    best, parent, inside = np.full(n, FAR, np.int32), np.full(n, -1), np.zeros(n, bool)
    for _ in range(n):
        open_best = np.where(inside, FAR + 1, best)
        node = int(open_best.argmin())
        if parent[node] >= 0 and open_best[node] < FAR:
            edges.append((int(parent[node]), node))
        inside[node] = True
        nearer = bounds[node] < best
        best[nearer], parent[nearer] = bounds[node][nearer], node
    return edges


_KEYS = ["bundle", "bits", "i", "j"]
_FOUND = "a long, b long, bundle long, bits long, i long, j long"


def _by_group(answer):
    """Run ``answer(columns, maps)`` on each group of rows that stand together, and join what it gives (a, b, key or None)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(table: pa.RecordBatch, upto: int, bounds: np.ndarray) -> pa.RecordBatch:
            names = [n for n in table.schema.names if n != "map"]
            columns = {n: table.column(n).to_numpy(zero_copy_only=False) for n in names}
            data, at = buffers(table.column(table.schema.get_field_index("map")))
            out = []
            for a, b in zip(bounds, [*bounds[1:], upto]):
                if b - a > 1:
                    maps = np.ascontiguousarray(data[at[a] : at[b]]).view(np.uint64).reshape(b - a, -1)
                    key = [int(columns[k][a]) for k in _KEYS]
                    out += [(x, y, *key) for x, y in answer({n: c[a:b] for n, c in columns.items()}, maps)]
            kinds = [part.split()[0] for part in _FOUND.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 6)], kinds)

        held = None
        for batch in batches:
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in _KEYS])
            bounds = np.concatenate([[0], 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
            if len(bounds) > 1:
                yield answered(batch, bounds[-1], bounds[:-1])
            held = batch.slice(bounds[-1])
        if held is not None and held.num_rows:
            yield answered(held, held.num_rows, np.array([0]))

    return scan


def _first_pairs(percent: int):
    """The forest of a group; and, with null for a and b, its key if it holds more possible pairs than those."""

    def run(rows: dict[str, np.ndarray], maps: np.ndarray) -> list[tuple]:
        ids = rows["id"]
        bounds = possible(maps, rows["size"], rows["low"].astype(bool), ids, percent)
        edges = forest(bounds) if (bounds < FAR).any() else []
        out = [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i, j in edges]
        return out + [(None, None)] if (bounds < FAR).sum() > 2 * len(edges) else out

    return run


def _other_pairs(percent: int):
    def run(rows: dict[str, np.ndarray], maps: np.ndarray) -> list[tuple]:
        ids, group = rows["id"], rows["component"]
        if (group == group[0]).all():
            return []
        apart = np.triu(possible(maps, rows["size"], rows["low"].astype(bool), ids, percent) < FAR, 1) & (group[:, None] != group[None])
        return [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i, j in np.argwhere(apart)]

    return run


def _verified(percent: int):
    """(a, b) of the pairs whose sets, sorted 64-bit hashes, link."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[at] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return scan


def join(documents: DataFrame, settings: Settings = Settings(), text: str = "text", identity: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(membership, links): (id, n, leader) for every row, and (a, b) between leaders, whose components are those of all links.

    ``leader`` is the smallest id with an equal set, null for an empty set or where all such ids are null.
    ``links`` are true links; pairs that they already connect may be missing, no other is.  A node is an
    id: rows that share one share their links.  Rows with a null id link with nothing.
    """
    w, p = settings.width, settings.percent
    small_batches(documents.sparkSession)
    source = documents.select(F.col(identity).cast("long").alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    told = stored(source.mapInArrow(_profiled(w), "kind int, id long, n long, one long, two long, counts binary"), "sets")
    parts = told.where("kind = 1").select("n", "counts").repartition(min(SKETCH_PARTS, 16), "n").mapInArrow(_added, "n long, counts binary").collect()
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)  # beyond 2**32 - 1 all are as common
    for r in parts:
        blob = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint64)
        counts[r["n"] * len(blob) : (r["n"] + 1) * len(blob)] = np.minimum(blob, 2**32 - 1)
    rows = told.where("kind = 0").select("id", "n", "one", "two")
    groups = rows.where("n > 0 AND id IS NOT NULL").groupBy("one", "two", "n").agg(F.min("id").alias("leader"), F.max("id").alias("_last"))
    # stored, so that the join has its own exchange, in which a set that very many documents share can be split
    copied = stored(groups.where("leader <> _last").drop("_last"), "copied")
    membership = rows.join(copied, ["one", "two", "n"], "left").select(
        "id", "n", F.when(F.col("n") > 0, F.coalesce("leader", "id")).alias("leader"))
    membership = stored(membership, "members")
    # an id may stand for several texts; it is left out only if none of them leads
    copies = stored(membership.groupBy("id").agg(F.bool_and(F.coalesce(F.col("leader") != F.col("id"), F.lit(True))).alias("_copy")).where("_copy AND id IS NOT NULL").select("id"), "copies")
    leading = source.where("id IS NOT NULL").join(counted(copies), "id", "left_anti")
    postings = stored(leading.mapInArrow(_postings(w, p, counts), "shingle long, id long"), "postings")
    lists = postings.groupBy("shingle").agg(F.min("id").alias("bundle"), F.max("id").alias("_last")).where(F.col("bundle") != F.col("_last")).drop("_last")
    bundles = stored(postings.join(lists, "shingle").select("bundle", "id").distinct(), "bundles")
    drop_stored(postings)
    involved = stored(bundles.select("id").distinct(), "involved")
    sets = stored(
        leading.join(counted(involved), "id", "left_semi").mapInArrow(_described(w, p), "id long, size long, members binary, bits long, map binary, low boolean"), "described")
    # a set whose neighbours in size are too small and too large meets no partner in this bundle
    near = W.partitionBy("bundle", "bits").orderBy("size", "id")
    close = (F.lag("size").over(near) * 100 >= F.col("size") * p) | (F.col("size") * 100 >= F.lead("size").over(near) * p)
    members = stored(
        bundles.join(sets.select("id", "bits", "size", "low"), "id").withColumn("_close", F.coalesce(close, F.lit(False))).where("_close").drop("_close"), "close")
    sizes = stored(
        members.groupBy("bundle", "bits").agg(F.count(F.lit(1)).alias("_rows"), F.bool_or("low").alias("_low")).where("_rows > 1 AND _low")
        .select("bundle", "bits", F.ceil(F.col("_rows") / BLOCK_ROWS).alias("_blocks")), "classes")
    maps = sets.select("id", "bits", "size", "map")

    def dealt(some: DataFrame, answer) -> DataFrame:
        """The groups (bundle, bits, pair of blocks) of ``some`` members, each in one task."""
        blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda k: F.struct(F.least(k, "_block").alias("i"), F.greatest(k, "_block").alias("j")))
        rows = some.join(sizes, ["bundle", "bits"]).join(maps, ["id", "bits", "size"]).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
        rows = rows.withColumn("_met", F.explode(blocks)).select("*", "_met.i", "_met.j").drop("_met", "_block", "_blocks")
        return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "id", "size").mapInArrow(_by_group(answer), _FOUND)

    found = stored(dealt(members, _first_pairs(p)), "found")
    first = stored(found.where("a IS NOT NULL").select("a", "b").distinct(), "pairs")
    links = stored(_linked(first, sets, p), "links")
    open_groups = stored(found.where("a IS NULL").select(*_KEYS).distinct(), "open")
    joined = components(links).select(F.col("node").alias("id"), "component")
    again = members.join(counted(stored(open_groups.select("bundle", "bits").distinct(), "open-groups")), ["bundle", "bits"], "left_semi")
    again = stored(again.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")), "again")
    others = dealt(again, _other_pairs(p)).select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    return membership, links.unionByName(_linked(stored(others, "pairs"), sets, p))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "paired")
    whole = sets.where("low").select("id", "members").join(counted(ids), "id", "left_semi")
    both = (
        pairs.join(whole.select(F.col("id").alias("a"), F.col("members").alias("_x")), "a")
        .join(whole.select(F.col("id").alias("b"), F.col("members").alias("_y")), "b").select("a", "b", "_x", "_y")
    )
    return both.mapInArrow(_verified(percent), "a long, b long").distinct()


def groups(documents: DataFrame, settings: Settings = Settings(), text: str = "text", identity: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) for every row: the size of its set and the smallest id that links reach, its own included.

    Null, empty and wordless texts have 0 shingles and are their own component, copies of each other too.
    A null id keeps a null component.  Repeated rows give repeated rows.
    """
    membership, links = join(documents, settings, text, identity)
    found = components(links).select(F.col("node").alias("leader"), "component")
    lowest = membership.join(found, "leader", "left").withColumn("component_id", F.coalesce("component", "leader", "id"))
    repeated = lowest.groupBy("id").agg(F.min("component_id").alias("_low"), F.max("component_id").alias("_high")).where("_low <> _high")
    shared = stored(repeated.select(F.col("_low").alias("a"), F.col("_high").alias("b")), "shared-ids")
    if shared.take(1):  # ids that stand for several sets join their components
        wider = components(shared).select(F.col("node").alias("component_id"), F.col("component").alias("_wider"))
        lowest = lowest.join(wider, "component_id", "left").withColumn("component_id", F.coalesce("_wider", "component_id"))
    return lowest.select("id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(documents: DataFrame, settings: Settings = Settings(5, 80), text: str = "text", identity: str = "doc_id") -> DataFrame:
    """``documents`` with one document of each group: the one whose id is the component.

    Of rows that repeat a non-null id one stays, the one whose text has the smallest digest.  Rows without
    words and rows with a null id are nobody's duplicate and stay.
    """
    found = stored(groups(documents, settings, text, identity), "groups")
    dropped = stored(found.where("component_id <> id").select(F.col("id").alias(identity)).distinct(), "duplicates")
    kept = documents.join(counted(dropped), identity, "left_anti")
    often = stored(found.where("id IS NOT NULL").groupBy(F.col("id").alias(identity)).count().where("count > 1").select(identity), "repeated")
    if often.take(1):
        some, place = kept.join(often, identity, "left_semi"), free_name(documents, "_k")
        first = some.withColumn(place, F.row_number().over(W.partitionBy(identity).orderBy(F.sha2(text, 256), *[c for c in documents.columns if c not in (identity, text)]))).where(F.col(place) == 1)
        kept = kept.join(often, identity, "left_anti").unionByName(first.drop(place))
    return kept.select(*documents.columns)
