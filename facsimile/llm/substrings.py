"""Substring deduplication by recompression: words inside a window that occurs earlier are removed.

Recompression rewrites a word sequence in rounds: a run of one symbol becomes a symbol, then symbols of one
half of the alphabet absorb a right neighbour of the other half.  Names are 64-bit hashes of what a symbol
stands for, so all tasks name alike without talking, and a symbol's parse depends on a few words around
it only.  That stretch is tracked exactly: wherever the stretch recurs, so does the symbol.  A window
therefore holds the same interior symbols wherever it occurs, and the longest of them (then the one with
the smallest hash) is its anchor.

Windows that occur twice have anchors that occur twice.  So: count anchors over all documents; for
documents with a shared anchor, name the windows of such anchors by their whole word sequence (a second
hash beside the anchor's name); in each group of equal windows all but the earliest are repeats; remove
the words that repeats cover.

Texts that equal an earlier text need none of this and are set aside first.  A group of equal windows that may
be large, by the count of its anchor, is dealt to salted parts whose earliest windows meet in a second round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facsimile.llm.common import counted, drop_stored, small_batches, stored
from facsimile.llm.tokens import byte_table, hash_words, mixed, portions, runs_hashed, word_bounds

WINDOW = 20
ROUNDS = 2  # of pairing
PART_ROWS = 4096  # windows of an anchor that are ordered in one group
DOCUMENT = ["doc", "part", "twin"]  # a document: its id and two 64-bit hashes of its text, so that texts without an id stay apart
_TABLE = byte_table(303, lower=False)
_NONE = np.uint64(2**64 - 1)
_RUN, _PAIR, _SIDE = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)

Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
"""Symbols of all rows: name, row, number of words, and the stretch [low, high) of words that fixes the symbol."""


def _neighbours(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(low and high of the left neighbour, low and high of the right one); a row's end lies one word beyond."""
    n = len(row)
    same = row[1:] == row[:-1]
    left_low, left_high, right_low, right_high = low - 1, low.copy(), high.copy(), high + 1
    left_low[1:][same], left_high[1:][same] = low[: n - 1][same], high[: n - 1][same]
    right_low[:-1][same], right_high[:-1][same] = low[1:][same], high[1:][same]
    return left_low, left_high, right_low, right_high


def runs(level: Level) -> Level:
    """Every maximal run of one symbol becomes one symbol; a symbol's neighbours are part of what fixes it."""
    name, row, span, low, high = level
    if not len(name):
        return level
    head = np.ones(len(name), bool)
    head[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    left_low, left_high, right_low, right_high = _neighbours(row, low, high)
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(name)))
    last = at + size - 1
    named = np.where(size > 1, mixed(name[at] * _RUN + size.astype(np.uint64)), name[at])
    lows = np.minimum(np.minimum(low[at], left_low[at]), right_low[last])
    highs = np.maximum(np.maximum(high[last], right_high[last]), left_high[at])
    return named, row[at], np.add.reduceat(span, at), lows, highs


def pairs(level: Level, turn: int) -> Level:
    """A symbol of the left half absorbs a right neighbour of the right half; either looks at that neighbour only."""
    name, row, span, low, high = level
    n = len(name)
    if n < 2:
        return level
    right_side = (mixed(name + _SIDE * np.uint64(turn + 1)) & np.uint64(1)).astype(bool)
    left_low, left_high, right_low, right_high = _neighbours(row, low, high)
    joins = np.zeros(n, bool)  # with its right neighbour
    joins[:-1] = ~right_side[:-1] & right_side[1:] & (row[1:] == row[:-1])
    lows = np.minimum(low, np.where(right_side, left_low, right_low))
    highs = np.maximum(high, np.where(right_side, left_high, right_high))
    absorbed = np.zeros(n, bool)
    absorbed[1:] = joins[:-1]
    at = np.flatnonzero(~absorbed)
    two = joins[at]
    after = np.minimum(at + 1, n - 1)
    named = np.where(two, mixed(mixed(name[at] * _PAIR + np.uint64(turn)) + name[after]), name[at])
    return (
        named, row[at], span[at] + np.where(two, span[after], 0),
        np.where(two, np.minimum(lows[at], lows[after]), lows[at]), np.where(two, np.maximum(highs[at], highs[after]), highs[at]))


def levels(words: np.ndarray, row: np.ndarray) -> list[Level]:
    """From the words themselves to the highest symbols."""
    place = np.arange(len(words), dtype=np.int64)
    out = [(words, row, np.ones(len(words), np.int64), place, place + 1)]
    current = runs(out[0])
    for turn in range(ROUNDS):
        current = pairs(current, turn)
        out.append(current)
    return out


def anchors(words: np.ndarray, first: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row, anchor, place): the first word of every window, its row, its anchor's name and where that stands."""
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(sizes)), sizes)
    count = np.maximum(sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    windows = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][owner]
    best, where = np.full(len(words) + 1, _NONE, np.uint64), np.zeros(len(words) + 1, np.int64)
    for name, _, span, low, high in reversed(levels(words, row)):
        key = (np.uint64(63) - np.minimum(span, 63).astype(np.uint64)) << np.uint64(58) | name >> np.uint64(6)
        fits = (high - low <= width) & (low >= 0)
        order = np.flatnonzero(fits)
        order = order[np.argsort(key[order], kind="stable")[::-1]]  # of equal places the last, smallest, is kept
        key, low, length = key[order], low[order], (high - low)[order]
        found, place = np.full(len(words) + 1, _NONE, np.uint64), np.zeros(len(words) + 1, np.int64)
        for back in range(width):
            ok = np.flatnonzero((length + back <= width) & (low >= back))
            ok = ok[key[ok] < found[low[ok] - back]]
            found[low[ok] - back], place[low[ok] - back] = key[ok], low[ok]
        best, where = np.where(best == _NONE, found, best), np.where(best == _NONE, place, where)
        if not (best[windows] == _NONE).any():
            break
    return windows, owner, best[windows], where[windows]


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(data, at)
    return hash_words(data, starts, ends, _TABLE)[0], first


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc, part, twin, n): the distinct anchors of each document and in how many places, or stretches of windows, they serve."""
    for batch, data, at in portions(batches, "_text"):
        words, first = _words(data, at)
        _, owner, key, place = anchors(words, first)
        if not len(key):
            continue
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[head], owner[head]
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(head)
        rows = pa.array(owner[starts])
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[starts].view(np.int64)), *(batch.column(k).take(rows) for k in range(3)), pa.array(np.diff(np.append(starts, len(key))))],
            ["anchor", *DOCUMENT, "n"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, anchor, doc, part, twin, start, salts) of the windows whose anchor is in the document's list."""
    for batch, data, at in portions(batches, "_text"):
        words, first = _words(data, at)
        windows, owner, key, _ = anchors(words, first)
        whole = runs_hashed(words, WINDOW, 17)
        bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        lists, salts = batch.column(4), batch.column(5)
        picked, salted = [], []
        for k in range(batch.num_rows):
            wanted = np.array(lists[k].values).view(np.uint64)
            order = np.argsort(wanted)
            wanted, salt = wanted[order], np.array(salts[k].values)[order]
            mine = key[bounds[k] : bounds[k + 1]]
            place = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
            hit = np.flatnonzero(wanted[place] == mine)
            picked.append(bounds[k] + hit)
            salted.append(salt[place[hit]])
        picked = np.concatenate(picked).astype(np.int64)
        rows = pa.array(owner[picked])
        yield pa.RecordBatch.from_arrays([
            pa.array(whole[windows[picked]].view(np.int64)), pa.array(key[picked].view(np.int64)), *(batch.column(k).take(rows) for k in range(3)),
            pa.array((windows[picked] - first[:-1][owner[picked]]).astype(np.int32)), pa.array(np.concatenate(salted).astype(np.int32))],
            ["window", "anchor", *DOCUMENT, "start", "salts"])


def _kept(whole: bool):
    """(id, n_words, n_removed, kept): what the repeated windows of each document leave; ``whole``: every word of a text with a window goes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_of, gone_of, kept = [], [], []
            lists = batch.column(2) if batch.num_columns > 2 else None
            for k, text in enumerate(batch.column(1)):
                words = text.as_py().split()  # bytes: at ASCII blanks
                stays = np.ones(len(words), bool)
                if lists is not None:
                    starts = np.array(lists[k].values)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + WINDOW, -1)
                    stays = np.cumsum(edge)[:-1] == 0
                elif whole and len(words) >= WINDOW:
                    stays[:] = False
                words_of.append(len(words))
                gone_of.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(words if stays.all() else compress(words, stays)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words_of, pa.int64()), pa.array(gone_of, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    return scan


def _hashed_kept(whole: bool):
    inner = _kept(whole)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in inner(batches):
            digests = pa.array([hashlib.sha256(k.as_buffer()).hexdigest() for k in batch.column(3)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], digests], ["id", "n_words", "n_removed", "kept_sha256"])

    return scan


def _picked(documents: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``documents`` semi- or anti-joined to a stored table of (doc, part, twin), broadcast if it is counted small."""
    return documents.join(counted(ids), DOCUMENT, how)


def repeats(texts: DataFrame) -> DataFrame:
    """(doc, part, twin, starts): the windows of ``texts`` (doc, part, twin, _text) whose word sequence also starts earlier.

    Earlier: smaller doc, then smaller part, then smaller twin, then smaller start.
    """
    rows = stored(texts.mapInArrow(_anchor_rows, "anchor long, doc long, part long, twin long, n long"), "anchors")
    salts = F.ceil(F.col("_count") / PART_ROWS).cast("int")
    shared = rows.groupBy("anchor").agg(F.sum("n").alias("_count")).where("_count > 1").select("anchor", salts.alias("salts"))
    wanted = stored(
        rows.join(shared, "anchor").groupBy(*DOCUMENT).agg(F.collect_list(F.struct("anchor", "salts")).alias("_w"))
        .select(*DOCUMENT, F.col("_w.anchor").alias("anchors"), F.col("_w.salts").alias("salts")), "wanted")
    drop_stored(rows)
    ids = wanted.select(*DOCUMENT)
    listed = _picked(texts, ids, "left_semi").join(wanted, DOCUMENT).select(*DOCUMENT, "_text", "anchors", "salts")
    windows = listed.mapInArrow(_window_rows, "window long, anchor long, doc long, part long, twin long, start int, salts int")
    order = [*DOCUMENT, "start"]
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("doc", "start"), F.col("salts"))).otherwise(0)
    ranked = stored(
        windows.withColumn("_salt", salt).withColumn("_k", F.rank().over(W.partitionBy("window", "anchor", "_salt").orderBy(*order)))
        .where("_k > 1 OR salts > 1").select(*order, "window", "anchor", "_k"), "ranked")
    firsts = ranked.where("_k = 1").withColumn("_k", F.rank().over(W.partitionBy("window", "anchor").orderBy(*order)))
    later = ranked.where("_k > 1").select(*order).unionByName(firsts.where("_k > 1").select(*order))
    return stored(later.groupBy(*DOCUMENT).agg(F.collect_list("start").alias("starts")), "repeats")


def deduplicate(documents: DataFrame, text: str = "text", identity: str = "doc_id", digests: bool = False) -> DataFrame:
    """(identity, n_words, n_removed, kept): the words that stay, joined by one blank, as bytes; with ``digests`` their SHA-256, kept_sha256.

    Words are runs of bytes that are no ASCII blank.  Documents are ordered by id, a null id last; texts
    that share an id by two hashes of the text, 128 bits in all.  Equal rows are one document and get equal results; a null text
    has no words.  A text with fewer words than a window stays whole.
    """
    small_batches(documents.sparkSession)
    base = documents.select(
        F.col(identity).cast("long").alias("id"), F.coalesce(F.col(identity).cast("long"), F.lit(2**63 - 1)).alias("doc"),
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    base = base.withColumns({"part": F.xxhash64("_text"), "twin": F.xxhash64(F.lit(1), "_text")})
    same = base.groupBy(F.sha2("_text", 256).alias("_sha")).agg(F.min("doc").alias("_first"), F.max("doc").alias("_last")).where("_first <> _last")
    later = (
        base.select(*DOCUMENT, F.sha2("_text", 256).alias("_sha")).join(stored(same, "same"), "_sha").where(F.col("doc") > F.col("_first"))
        .select(*DOCUMENT).distinct()
    )
    copies = stored(later, "copies")
    firsts = _picked(base, copies, "left_anti")
    often = stored(base.groupBy(*DOCUMENT).count().where("count > 1").select(*DOCUMENT), "repeated")
    once = firsts
    if often.take(1):  # rows repeated whole are one document
        once = _picked(firsts, often, "left_anti").unionByName(_picked(firsts, often, "left_semi").dropDuplicates(DOCUMENT))
    found = repeats(once.select(*DOCUMENT, "_text"))
    make = _hashed_kept if digests else _kept
    schema = f"id long, n_words long, n_removed long, {'kept_sha256 string' if digests else 'kept binary'}"
    hit = found.select(*DOCUMENT)
    some = _picked(firsts, hit, "left_semi").join(found, DOCUMENT).select("id", "_text", "starts").mapInArrow(make(False), schema)
    none = _picked(firsts, hit, "left_anti").select("id", "_text").mapInArrow(make(False), schema)
    gone = _picked(base, copies, "left_semi").select("id", "_text").mapInArrow(make(True), schema)
    return some.unionByName(none).unionByName(gone).withColumnRenamed("id", identity)
